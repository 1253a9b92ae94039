"""Token counts without token ids: pieces of a pre-token are counted once.

A text's pre-tokens (what the tokenizer's normalization and split make of it) are
found for a block of texts at once and counted per document.  Each distinct
pre-token is merged once, wherever and however often it occurs; a document's count
is the sum of its frequencies times the pieces.  No ids are built or kept.

The join is done in two parts.  A table of at most `COMMON` pre-tokens of a sample of
`SAMPLE_ROWS` texts (a documented bound, so it may be broadcast) answers the common
ones at once.  All others are numbered in their block and sent to buckets, once a
block: a bucket merges each of its distinct pre-tokens and sends the numbers of
pieces back to the blocks.  So a hot pre-token is a row per block at most, and which
pre-tokens the sample holds changes no result.

Kinds of tokenizer files and special tokens: as in `bpe_stream`.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a special token's
string in a text is that token; rows are counted one by one, repeated rows and equal
or null ids too; a text of more than `LONG_TEXT` characters is cut at white space, a
stretch of that length without any is encoded as a stream of constant memory; columns
that aren't kept are not read, and kept columns may have any name; an empty table
gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Hasher, free_names
from .bpe_stream import _WHITE, Merges, _lower, encode, load
from .packed import block_numbers, bucket_order, in_bucket_order, joined, squeeze, string_array, string_bytes, unsqueeze
from .sampling import bounded_sample

#: Characters of text in a block.
BLOCK_CHARS = 1 << 22
#: A longer text is cut at white space.
LONG_TEXT = 1 << 21
#: Pre-tokens in the broadcast table, their longest length in bytes, and the texts it is taken from.
COMMON, COMMON_BYTES, SAMPLE_ROWS = 1 << 16, 48, 4000

_SPACE = regex.compile(rf"[{_WHITE}]")
_BLANK, _LETTER, _NUMBER, _SIGN = range(4)
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """White space, letter, number or other sign: a class for each code point."""
    if not _table:
        every = "".join(map(chr, range(0x110000)))
        table = np.full(0x110000, _SIGN, np.uint8)
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (rf"[{_WHITE}]+", _BLANK)):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _table.append(table)
    return _table[0]


def pre_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of normalized texts as one string array, and the text that each is of."""
    whole = "\n".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    data = np.frombuffer(whole.encode(), np.uint8)
    kind = _classes()[points]
    if not len(points):
        return string_array(data, np.zeros(1, np.int64)), np.zeros(0, np.int64)
    ink = kind != _BLANK
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    first = np.flatnonzero(edge[:-1] & ink)
    last = np.flatnonzero(edge[1:] & ink) + 1
    # a lone apostrophe takes s, t, m, d or re, ve, ll of the letters behind it
    at = np.flatnonzero((kind[first] == _SIGN) & (last - first == 1) & (points[first] == ord("'")))
    at = at[at + 1 < len(first)]
    at = at[(first[at + 1] == last[at]) & (kind[first[at + 1]] == _LETTER)]
    if len(at):
        a = points[first[at + 1]]
        b = np.where(last[at + 1] - first[at + 1] > 1, points[np.minimum(first[at + 1] + 1, len(points) - 1)], 0)
        takes = np.isin(a, [ord(c) for c in "stmd"]).astype(np.int64)
        for x, y in ("re", "ve", "ll"):
            takes[(a == ord(x)) & (b == ord(y))] = 2
        last[at] += takes
        first[at + 1] += takes
        full = first < last
        first, last = first[full], last[full]
    text = np.cumsum(points == ord("\n"))  # as normalized texts hold no other line ends
    if len(data) == len(points):
        sizes, packed = last - first, data[ink]
    else:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        sizes, packed = place[last] - place[first], data[np.repeat(ink, width)]
    return string_array(packed, np.concatenate([[0], np.cumsum(sizes)])), text[first]


def normalize(text: str) -> str:
    """NFC, lower case, white space as spaces."""
    return _SPACE.sub(" ", _lower(unicodedata.normalize("NFC", text))) if not text.isascii() else text.lower().translate(_ASCII_SPACE)


_ASCII_SPACE = {c: " " for c in range(128) if _SPACE.match(chr(c))}


def _stretches(text: str) -> Iterator[tuple[str, bool]]:
    """A text in parts of about LONG_TEXT characters that end before white space; True: no white space was found."""
    at = 0
    while len(text) - at > LONG_TEXT:
        end = at + LONG_TEXT
        m = None
        for m in _SPACE.finditer(text, max(at, end - 4096), end):
            pass
        if m is None:
            m = _SPACE.search(text, end)
            cut = m.start() if m else len(text)
            yield text[at:cut], True
        else:
            cut = m.start()
            yield text[at:cut], False
        at = cut
    yield text[at:], False


class _Block:
    """Texts of a block as normalized parts, with tokens that are known without pre-tokens."""

    def __init__(self, merges: Merges, cache):
        self.merges, self.cache = merges, cache
        special = merges.specials
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.clear()

    def clear(self) -> None:
        self.parts: list[str] = []
        self.rows: list[int] = []
        self.known: list[int] = []
        self.chars = 0

    def add(self, text: str) -> None:
        row, known = len(self.known), 0
        for stretch, whole in _stretches(text):
            if whole:
                known += sum(len(ids) for ids in encode(stretch, self.merges, self.cache)) // 4
                continue
            found = self.specials.findall(stretch) if self.specials and "<" in stretch else []
            known += len(found)
            for part in self.specials.split(stretch) if found else (stretch,):
                self.parts.append(normalize(part))
                self.rows.append(row)
        self.known.append(known)
        self.chars += len(text)

    def frequencies(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens; row, pre-token's number and frequency of each pair, by row."""
        tokens, part = pre_tokens(self.parts)
        coded = tokens.dictionary_encode()
        rows = np.array(self.rows, np.int64)[part] if len(part) else np.zeros(0, np.int64)
        n = max(1, len(coded.dictionary))
        pairs, counts = np.unique(rows * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        return coded.dictionary, pairs // n, pairs % n, counts


def _texts(parts: Iterator[pa.RecordBatch], place: int, block: _Block) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Adds the texts of a task's rows to the block; gives slices of rows, and whether the block is complete."""
    for part in parts:
        texts, at = part.column(place), 0
        for k in range(part.num_rows):
            block.add(texts[k].as_py() or "")
            if block.chars >= BLOCK_CHARS:
                yield part.slice(at, k + 1 - at), True
                at = k + 1
        if at < part.num_rows:
            yield part.slice(at), False


def common_pre_tokens(docs: DataFrame, path: str, text: str = "text", most: int = COMMON) -> tuple[pa.Array, np.ndarray]:
    """At most `most` pre-tokens of a sample that occur twice or more in it, and their numbers of pieces."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(*load(path))
        for _, full in _texts(parts, 0, block):
            if full:
                yield from found(block)
        yield from found(block)

    def found(block: _Block) -> Iterator[pa.RecordBatch]:
        words, _, which, counts = block.frequencies()
        block.clear()
        total = np.bincount(which, counts, len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(total)], ["token", "n"])

    sample = bounded_sample(docs.select(F.col(text).alias("text_")), "text_", SAMPLE_ROWS)
    totals = sample.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = totals.where((F.col("n") > 1) & (F.octet_length("token") <= COMMON_BYTES)).orderBy(F.desc("n"), "token").limit(most)
    tokens = [r.token for r in top.select("token").collect()]
    _, cache = load(path)
    return pa.array(tokens, pa.large_string()), np.array([len(cache[t]) // 4 for t in tokens], np.int64)


def count_tokens(docs: DataFrame, path: str, folder: str, n_buckets: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",), common: int = COMMON) -> DataFrame:
    """The `keep` columns, n_bytes and n_tokens (long) of every row.

    `folder`: a new folder that all executors share; `n_buckets`: tasks that merge pre-tokens.
    """
    n_bytes, n_tokens, kind, block_, bucket, known_, payload, sent_ = free_names(keep, ["n_bytes", "n_tokens", "kind", "block", "bucket", "known", "payload", "sent"])
    hot, hot_pieces = common_pre_tokens(docs, path, text, common)
    picked = docs.select(*keep, F.col(text).alias("text_"))
    fields = picked.schema.fields[: len(keep)]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    width = len(keep)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers, held = _Block(*load(path)), block_numbers(), []
        for rows, full in _texts(parts, width, block):
            held.append(rows)
            if full:
                yield from close(block, held, next(numbers))
                held = []
        if held:
            yield from close(block, held, next(numbers))

    def close(block: _Block, held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        texts = rows.column(width)
        words, row, which, counts = block.frequencies()
        known = np.array(block.known, np.int64)
        block.clear()
        place = pc.index_in(words, value_set=hot).to_numpy(zero_copy_only=False) if len(hot) else np.full(len(words), np.nan)
        rare = np.isnan(place.astype(float))
        pieces = np.zeros(len(words), np.int64)
        pieces[~rare] = hot_pieces[place[~rare].astype(np.int64)]
        known += np.bincount(row, counts * pieces[which], len(known)).astype(np.int64)
        # the others: numbered by bucket
        others = words.filter(pa.array(rare))
        order, cuts = bucket_order(_buckets(others, n_buckets))
        code = np.zeros(len(words), np.int64)
        code[np.flatnonzero(rare)[order]] = np.arange(len(order))
        left = rare[which]
        row, which, counts = row[left], code[which[left]], counts[left]
        ends = np.searchsorted(row, np.arange(len(known) + 1))
        lists = [squeeze(which[a:b], counts[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n = len(known)
        columns = [c.combine_chunks() for c in rows.columns[:width]]
        size = pc.fill_null(pc.binary_length(texts.combine_chunks()), 0).cast(pa.int64())
        yield batch([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), *columns, size, pa.array(known), pa.array(lists, pa.binary()), pa.nulls(n, pa.list_(pa.string()))])
        ranked = others.take(pa.array(order)).cast(pa.string())
        for b, i, j in cuts:
            nulls = [pa.nulls(1, c.type) for c in columns]
            yield batch([pa.array([1], pa.int32()), pa.array([number]), pa.array([b], pa.int32()), *nulls, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([ranked.slice(i, j - i).to_pylist()], pa.list_(pa.string()))])

    names = [kind, block_, bucket, *keep, n_bytes, known_, payload, sent_]

    def batch(arrays: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(arrays, names)

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, buckets, sizes, tokens = [], [], [], []
        for part in parts:
            blocks += part.column(0).to_pylist()
            buckets += part.column(1).to_pylist()
            lists = part.column(2)
            sizes += pc.list_value_length(lists).to_pylist()
            tokens.append(lists.flatten())
        if not blocks:
            return
        coded = pa.chunked_array(tokens).combine_chunks().dictionary_encode()
        _, cache = load(path)
        pieces = np.array([len(cache[t]) // 4 for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum([0, *sizes])
        answers = [squeeze(pieces[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(answers, pa.binary())], [block_, bucket, payload])

    def total(_: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = joined([unsqueeze(x)[0] for x in in_bucket_order(answers, bucket, payload)])
        out = rows.column(known_).to_numpy().copy()
        for k, one in enumerate(rows.column(payload).to_pylist()):
            if one is not None:
                which, counts = unsqueeze(one)
                out[k] += int(counts @ pieces[which])
        return pa.Table.from_arrays([*(rows.column(c) for c in (*keep, n_bytes)), pa.array(out, pa.int64())], names=[*keep, n_bytes, n_tokens])

    schema = f"`{kind}` int, `{block_}` long, `{bucket}` int, {kept}`{n_bytes}` long, `{known_}` long, `{payload}` binary, `{sent_}` array<string>"
    picked.mapInArrow(scan, schema).write.partitionBy(kind).mode("overwrite").parquet(f"{folder}/blocks")
    spark = docs.sparkSession
    written = spark.read.schema(schema).parquet(f"{folder}/blocks")
    sent = written.where(F.col(kind) == 1).select(block_, bucket, sent_)
    answers = sent.repartitionById(n_buckets, F.col(bucket)).mapInArrow(merged, f"`{block_}` long, `{bucket}` int, `{payload}` binary")
    rows = written.where(F.col(kind) == 0).select(block_, *keep, n_bytes, known_, payload)
    return rows.groupBy(block_).cogroup(answers.groupBy(block_)).applyInArrow(total, f"{kept}`{n_bytes}` long, `{n_tokens}` long")


def _buckets(strings: pa.Array, n: int) -> np.ndarray:
    """A bucket for each string, by its bytes."""
    raw, off = string_bytes(strings)
    return (Hasher(raw)(off[:-1], off[1:]) % np.uint64(n)).astype(np.int64) if len(strings) else np.zeros(0, np.int64)
