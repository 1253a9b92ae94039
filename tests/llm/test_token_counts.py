"""Token counts against the tokenizer library, and their defined cases."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceline.llm import bpe_stream, token_counts
from paceline.llm.queries import op11_token_counts, tokenizer_path
from paceline.llm.shared import scratch_folder

SIGNS = "'stmdrevl aeé1²٣Σİ-\n\t́한🙂 "


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "It's I'll we're 12 3!'s <|endoftext|>x<|startoftext|>", "'s", "''s", "a" * 3000, "ab'" * 900, "word " * 5000]
    out += ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return out + ["same text here", "same text here"]


def expected(rows):
    lib = Tokenizer.from_file(tokenizer_path())
    return [(len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for t in rows]


def test_pre_tokens_are_the_patterns():
    import unicodedata

    rows = [t or "" for t in texts()]
    tokens, part = token_counts.pre_tokens([token_counts.normalize(t) for t in rows])
    got = {}
    for word, k in zip(tokens.to_pylist(), part.tolist(), strict=True):
        got.setdefault(k, []).append(word)
    for k, t in enumerate(rows):
        assert got.get(k, []) == bpe_stream._WORD.findall(bpe_stream._lower(unicodedata.normalize("NFC", t)))


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_TEXT", 5000)
    rows = ["x" * 12_000 + " <|endoftext|> " + "it's " * 3000, "é " * 9000, "y" * 5001]
    block = token_counts._Block(*bpe_stream.load(tokenizer_path()))
    for t in rows:
        parts = list(token_counts._stretches(t))
        assert "".join(x for x, _ in parts) == t and any(whole for _, whole in parts) == (t[0] in "xy")
        block.add(t)
    words, row, which, counts = block.frequencies()
    pieces = [len(block.cache[w]) // 4 for w in words.to_pylist()]
    total = list(block.known)
    for r, k, n in zip(row, which, counts, strict=True):
        total[r] += n * pieces[k]
    assert total == [n for _, n in expected(rows)]


@pytest.mark.parametrize("common", [1 << 16, 0, 3])
def test_counts_equal_the_library(spark, common):
    rows = texts() + ["x" * 12_000 + " <|endoftext|> " + "it's " * 3000]
    names = "doc_id long, text string, kind string, n_tokens int, block string, payload string"
    docs = spark.createDataFrame([(k // 2 if k % 5 else None, t, str(k), k, "b", "p") for k, t in enumerate(rows)], names).repartition(3)
    got = token_counts.count_tokens(docs, tokenizer_path(), scratch_folder(spark, "tokens"), 5, keep=("doc_id", "kind", "n_tokens", "block", "payload"), common=common).collect()
    assert len(got) == len(rows)
    want = expected(rows)
    for r in got:
        assert (r.n_bytes, r.n_tokens_) == want[int(r.kind)] and r.n_tokens == int(r.kind) and r.block == "b"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = token_counts.count_tokens(docs, tokenizer_path(), scratch_folder(spark, "tokens"), 2)
    assert got.count() == 0 and got.columns == ["doc_id", "n_bytes", "n_tokens"]


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], expected([r.text for r in docs]), strict=True))
    got = op11_token_counts(spark, sf).where(F.col("n_bytes") >= 0).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
