"""Tokens of the Jaccard join on their way to the buckets and back to their blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm import table

from paceline.llm import jaccard
from paceline.llm.shared import scratch_folder


def some_texts(n=60, words=40, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def dealt(parts, run):
    """`run` on each bucket of `parts`, one after the other."""
    whole = pa.Table.from_batches(parts)
    bucket = whole.column("bucket").to_numpy()
    return [out for b in np.unique(bucket).tolist() for out in run(iter(whole.filter(pa.array(bucket == b)).combine_chunks().to_batches()))]


def test_bytes_of_a_token_do_not_grow_with_the_buckets():
    part = pa.RecordBatch.from_arrays([pa.array(some_texts(200, 300))], ["text"])
    n_tokens = 200 * 296
    for n_buckets in (4, 4000):
        size = 0
        for out in jaccard._tokens_out(n_buckets, np.zeros(0, np.uint64))(iter([part])):
            size += sum(len(x) - 8 for x in out.column("payload").to_pylist())
        assert size <= 7 * n_tokens + 40 * 200


@pytest.mark.parametrize("hot_line", [False, True])
def test_blocks_get_back_what_other_classes_hold(monkeypatch, hot_line):
    monkeypatch.setattr(jaccard, "FLUSH_BYTES", 2000)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 3)
    base = some_texts()
    line = " ".join(f"c{k}" for k in range(20))
    texts = [*base[:40], *base[:20], *(t.rsplit(" ", 2)[0] + " x y" for t in base[10:15]), *(line + f" e{k}" for k in range(20)), *base[:3], "a b", "a b", "", None]
    parts = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 9], pa.string())], ["text"]) for k in range(0, len(texts), 9)]
    sets = {}
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        token, ptr = jaccard.shingles(raw, np.array([0, len(raw)]))
        if len(token):
            sets[int(jaccard.classes(token, ptr)[0])] = token
    token, held = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    hot = token[held >= 16] if hot_line else np.zeros(0, np.uint64)
    shared = {cls: int((held[np.searchsorted(token, own)] > 1).sum()) for cls, own in sets.items()}
    wanted = {cls: (len(own), shared[cls]) for cls, own in sets.items() if shared[cls] >= -(-75 * len(own) // 100)}
    sent = list(jaccard._tokens_out(5, hot)(iter(parts)))
    back = dealt(sent, jaccard._share(5))
    out = [r for part in dealt(back, jaccard._survivors(5, hot, held[held >= 16].astype(np.uint32) if hot_line else np.zeros(0, np.uint32))) for r in part.to_pylist()]
    assert len(out) == len(wanted) == 30 and {r["cls"]: (r["n"], r["shared"]) for r in out} == wanted


def test_copies_in_many_parts_are_no_partners(spark):
    alone, near = some_texts(2, 60)
    texts = [alone] * 300 + [near] * 40 + [near + " more"] * 40
    docs = table(spark, texts).repartition(8)
    folder = scratch_folder(spark, "t")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, folder, 4).collect()}
    assert got == {k: 0 if k < 300 else 300 for k in range(380)}
    assert spark.read.parquet(f"{folder}/survivors").count() == 2
