"""Phrase collocations by relational mining over persisted, sorted occurrences (SETM).

The occurrences of the groups of one length are a relation (place, group) sorted by
piece and position.  One length is extended to the next in four steps:

1. merge-join: a group at one place and one at the next place of the same piece make a
   longer group (they share all words but the first and the last);
2. group-count: each block of texts counts its distinct pairs, which go to buckets by
   a hash and are summed there;
3. semi-join: a bucket answers each block which of its pairs are frequent, with a new
   number for each; all other occurrences are dropped;
4. what is left is written as the sorted relation of the next length.

A block's relation is a compressed row, and a pair is sent once a block however often it
occurs there, so neither a frequent word nor a hot language meets in one task.  Places
are numbered so that neighbours in a piece differ by 1 and all others by more.

A phrase's weakest cut, its score and the phrases that a longer one explains are then
found in columns, by exact decimal arithmetic.

Defined cases: null and empty texts have no words; a null language is `und`; repeated
rows count again; ties are ordered by score, count and phrase in byte order; ids and
other columns are not read; a text of any length is one block's; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Hasher, blocks, mix, text_bytes
from .packed import block_numbers, bucket_order, in_bucket_order, joined, squeeze, string_array, string_bytes, unsqueeze

#: Bytes of text in a block.
BLOCK_BYTES = 1 << 21
#: Parts in which the best phrases of a language are looked for before they meet.
TOP_PARTS = 32

_RELATION, _SENT = 0, 1
_GROUP, _ANSWER, _TOTAL = 0, 1, 2

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True


def occurrences(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of UTF-8 texts in lower case, their texts, and their places."""
    raw = _LOWER[raw]
    ink = ~_GAP[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    borders = off[1:-1]
    borders = borders[(borders > 0) & (borders < len(raw))]
    first[borders] = ink[borders]
    last[borders - 1] = ink[borders - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    piece = np.cumsum(_CUT[raw], dtype=np.int32)[start] if len(start) else start
    step = np.ones(len(start), np.int64)
    step[1:] += (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    return string_array(raw[ink], np.concatenate([[0], np.cumsum(end - start)])), doc, np.cumsum(step)


def _pack(place: np.ndarray, group: np.ndarray) -> bytes:
    return squeeze(np.diff(place, prepend=0), group)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, group = unsqueeze(data)
    return np.cumsum(step), group


def extended(place: np.ndarray, group: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Merge-join of a sorted relation with itself one place on.

    Returns the places, each one's distinct pair, and the pairs (left, right, count)
    ordered by bucket, then left and right, with the bounds of each bucket.
    """
    at = np.flatnonzero(np.diff(place) == 1)
    known, code = np.unique(group, return_inverse=True)
    pairs, which, counts = np.unique(code[at] * len(known) + code[at + 1], return_inverse=True, return_counts=True)
    left, right = known[pairs // max(1, len(known))], known[pairs % max(1, len(known))]
    hashed = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(right.astype(np.uint64)))
    order, cuts = bucket_order((hashed % np.uint64(n_buckets)).astype(np.int64))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return place[at], rank[which], left[order], right[order], counts[order], order, cuts


def _numbers(n: int, bucket: int, n_buckets: int) -> np.ndarray:
    """Numbers from 1 on that no other bucket gives out."""
    return np.arange(n, dtype=np.int64) * n_buckets + bucket + 1


def _write(rows: DataFrame, folder: str, kind: str = "kind") -> DataFrame:
    rows.write.partitionBy(kind).mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _words(docs: DataFrame, folder: str, n_buckets: int, text: str, lang: str) -> DataFrame:
    """Relation of all words in block numbers, and the words that each block sends to buckets."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers()
        for part in parts:
            langs = pc.fill_null(part.column(0).cast(pa.large_string()), "und").dictionary_encode()
            raw, off = text_bytes(part.column(1))
            lang_code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, own, own_off in blocks(raw, off, BLOCK_BYTES):
                words, doc, place = occurrences(own, own_off)
                if len(place):
                    yield from close(next(numbers), words, lang_code[i:j][doc], langs.dictionary, place)

    def close(number: int, words: pa.Array, lang_code: np.ndarray, langs: pa.Array, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        coded = words.dictionary_encode()
        n = len(coded.dictionary)
        keys, which, counts = np.unique(lang_code * n + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        names = pc.binary_join_element_wise(langs.take(pa.array(keys // n)), coded.dictionary.take(pa.array(keys % n)), pa.scalar(" ", pa.large_string()))
        raw, off = string_bytes(names)
        order, cuts = bucket_order((Hasher(raw)(off[:-1], off[1:]) % np.uint64(n_buckets)).astype(np.int64))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield batch([_RELATION], [number], [None], [_pack(place, rank[which])], [None])
        names = names.take(pa.array(order)).cast(pa.string())
        for b, first, last in cuts:
            yield batch([_SENT], [number], [b], [squeeze(counts[order[first:last]])], [names.slice(first, last - first).to_pylist()])

    def batch(kind: list, block: list, bucket: list, payload: list, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), pa.array(keys, pa.list_(pa.string()))], ["kind", "block", "bucket", "payload", "keys"])

    picked = docs.select(F.col(lang).cast("string").alias("lang_"), F.col(text).alias("text_"))
    return _write(picked.mapInArrow(scan, "kind int, block long, bucket int, payload binary, keys array<string>"), folder)


def _count_words(sent: DataFrame, folder: str, n_buckets: int, least: int) -> DataFrame:
    """Frequent words (id, lang, last, f), the answers to the blocks, and all words of each language in each bucket."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_, buckets, counts, keys, sizes = [], [], [], [], []
        for part in parts:
            blocks_ += part.column(0).to_pylist()
            buckets += part.column(1).to_pylist()
            counts += [unsqueeze(x)[0] for x in part.column(2).to_pylist()]
            keys.append(part.column(3).flatten())
        if not blocks_:
            return
        sizes = np.cumsum([0, *map(len, counts)])
        coded = pa.chunked_array(keys).combine_chunks().dictionary_encode()
        which, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        total = np.zeros(len(names), np.int64)
        np.add.at(total, which, joined(counts))
        ranked = pc.array_sort_indices(names).to_numpy()
        frequent = ranked[total[ranked] >= least]
        ids = np.zeros(len(names), np.int64)
        ids[frequent] = _numbers(len(frequent), buckets[0], n_buckets)
        langs = [x.rpartition(" ")[0] for x in names.to_pylist()]
        per_lang: dict[str, int] = {}
        for x, n in zip(langs, total.tolist(), strict=True):
            per_lang[x] = per_lang.get(x, 0) + n
        answers = [squeeze(ids[which[a:b]]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        k = len(blocks_)
        yield batch([_ANSWER] * k, blocks_, buckets, [None] * k, [None] * k, answers, [None] * k, [None] * k)
        k = len(frequent)
        yield batch([_GROUP] * k, [None] * k, [None] * k, ids[frequent].tolist(), total[frequent].tolist(), [None] * k, [langs[i] for i in frequent], [names[int(i)].as_py().rpartition(" ")[2] for i in frequent])
        k = len(per_lang)
        yield batch([_TOTAL] * k, [None] * k, [None] * k, [None] * k, list(per_lang.values()), [None] * k, list(per_lang), [None] * k)

    def batch(*columns: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "block", "bucket", "id", "f", "payload", "lang", "last"])

    dealt = sent.select("block", "bucket", "payload", "keys").repartitionById(n_buckets, F.col("bucket"))
    return _write(dealt.mapInArrow(count, "kind int, block long, bucket int, id long, f long, payload binary, lang string, last string"), folder)


def _frequent_words(relation: DataFrame, answers: DataFrame, folder: str) -> DataFrame:
    """The relation of frequent words, by their ids."""

    def keep(_: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids = joined([unsqueeze(x)[0] for x in in_bucket_order(answers, "bucket", "payload")])
        return _semi_joined(rows, lambda place, code: (place, ids[code]))

    return _relation(relation, answers, keep, folder)


def _semi_joined(rows: pa.Table, named) -> pa.Table:
    """A block's relation without the occurrences that have no number."""
    out = []
    for data in rows.column("payload").to_pylist():
        place, ids = named(*_unpack(data))
        out.append(_pack(place[ids > 0], ids[ids > 0]))
    return pa.Table.from_arrays([rows.column("block"), pa.array(out, pa.binary())], names=["block", "payload"])


def _relation(relation: DataFrame, answers: DataFrame, keep, folder: str) -> DataFrame:
    rows = relation.select("block", "payload").groupBy("block").cogroup(answers.select("block", "bucket", "payload").groupBy("block")).applyInArrow(keep, "block long, payload binary")
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _count_pairs(relation: DataFrame, folder: str, n_buckets: int, least: int, answered: bool) -> DataFrame:
    """Frequent pairs of neighbouring groups (id, left, right, f) and, if asked for, the answers to the blocks."""

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                _, _, left, right, counts, _, cuts = extended(*_unpack(data), n_buckets)
                payloads = [squeeze(np.diff(left[a:b], prepend=0), right[a:b], counts[a:b]) for _, a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cuts), pa.int64()), pa.array([b for b, _, _ in cuts], pa.int32()), pa.array(payloads, pa.binary())], ["block", "bucket", "payload"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_, buckets, entries = [], [], []
        for part in parts:
            blocks_ += part.column(0).to_pylist()
            buckets += part.column(1).to_pylist()
            entries += [unsqueeze(x) for x in part.column(2).to_pylist()]
        if not blocks_:
            return
        sizes = np.cumsum([0, *(len(e[0]) for e in entries)])
        left, right, counts = joined([np.cumsum(e[0]) for e in entries]), joined([e[1] for e in entries]), joined([e[2] for e in entries])
        del entries
        order = np.lexsort((right, left))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first)
        ids = np.zeros(len(first), np.int64)
        frequent = np.flatnonzero(total >= least)
        ids[frequent] = _numbers(len(frequent), buckets[0], n_buckets)
        if answered:
            own = np.empty(len(order), np.int64)
            own[order] = ids[np.cumsum(new) - 1]
            k = len(blocks_)
            none = pa.nulls(k, pa.int64())
            yield batch(np.full(k, _ANSWER), pa.array(blocks_, pa.int64()), pa.array(buckets, pa.int32()), none, none, none, none, [squeeze(own[a:b]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])
        k, at = len(frequent), order[first[frequent]]
        yield batch(np.full(k, _GROUP), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(ids[frequent]), pa.array(left[at]), pa.array(right[at]), pa.array(total[frequent]), [None] * k)

    def batch(kind: np.ndarray, *columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *columns[:-1], pa.array(columns[-1], pa.binary())], ["kind", "block", "bucket", "id", "left", "right", "f", "payload"])

    dealt = relation.select("block", "payload").mapInArrow(send, "block long, bucket int, payload binary").repartitionById(n_buckets, F.col("bucket"))
    return _write(dealt.mapInArrow(count, "kind int, block long, bucket int, id long, left long, right long, f long, payload binary"), folder)


def _frequent_pairs(relation: DataFrame, answers: DataFrame, n_buckets: int, folder: str) -> DataFrame:
    """The relation of frequent pairs, each at the place where it begins."""

    def keep(_: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids = joined([unsqueeze(x)[0] for x in in_bucket_order(answers, "bucket", "payload")])

        def named(place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, pair, *_ = extended(place, group, n_buckets)
            return at, ids[pair]

        return _semi_joined(rows, named)

    return _relation(relation, answers, keep, folder)


def mine(docs: DataFrame, folder: str, n_buckets: int, least: int = 10, longest: int = 3, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """All phrases of 1 to `longest` words that occur `least` times or more in their language, and (lang, n) of all words.

    The phrases of each length are a table: id, lang, phrase, last (word), f, left and
    right (ids of the phrases without the last and the first word), firsts and rests
    (counts of the first 1, 2, ... words and of what is left behind them).
    """
    spark = docs.sparkSession
    scanned = _words(docs, f"{folder}/words", n_buckets, text, lang)
    counted = _count_words(scanned.where(f"kind = {_SENT}"), f"{folder}/count1", n_buckets, least)
    totals = counted.where(f"kind = {_TOTAL}").groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<long>")
    phrases = [counted.where(f"kind = {_GROUP}").select("id", "lang", F.col("last").alias("phrase"), "last", "f", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), none.alias("firsts"), none.alias("rests"))]
    relation = _frequent_words(scanned.where(f"kind = {_RELATION}"), counted.where(f"kind = {_ANSWER}"), f"{folder}/relation1")
    for size in range(2, longest + 1):
        counted = _count_pairs(relation, f"{folder}/count{size}", n_buckets, least, size < longest)
        pairs = counted.where(f"kind = {_GROUP}").select("id", "left", "right", "f")
        start = phrases[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.col("f").alias("start_f"), F.col("firsts").alias("start_firsts"))
        end = phrases[-1].select(F.col("id").alias("right"), "last", F.col("f").alias("end_f"), F.col("rests").alias("end_rests"))
        named = pairs.join(start, "left").join(end, "right").select(
            "id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f", "left", "right",
            F.concat("start_firsts", F.array("start_f")).alias("firsts"), F.concat(F.array("end_f"), "end_rests").alias("rests"),
        )
        named.write.mode("overwrite").parquet(f"{folder}/phrases{size}")
        phrases.append(spark.read.schema(named.schema).parquet(f"{folder}/phrases{size}"))
        if size < longest:
            relation = _frequent_pairs(relation, counted.where(f"kind = {_ANSWER}"), n_buckets, f"{folder}/relation{size}")
    return phrases, totals


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of each phrase at its weakest cut, exactly."""
    cuts = F.expr(
        "transform(arrays_zip(firsts, rests), (c, k) -> named_struct("
        "'score', (CAST(1000000 AS DECIMAL(7, 0)) * CAST(f AS DECIMAL(15, 0)) * CAST(f AS DECIMAL(15, 0))) div (CAST(c.firsts AS DECIMAL(15, 0)) * CAST(c.rests AS DECIMAL(15, 0))),"
        " 'k', k, 'l', c.firsts, 'r', c.rests))"
    )
    weakest = F.array_min(cuts)
    return phrases.withColumn("cut_", weakest).select("id", "lang", "phrase", F.col("f").alias("a"), F.col("cut_.l").alias("l"), F.col("cut_.r").alias("r"), F.col("cut_.score").alias("score"))


def collocations(docs: DataFrame, folder: str, n_buckets: int, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer frequent one holds it and has at least `share` percent of its count.
    """
    phrases, totals = mine(docs, folder, n_buckets, least, longest, text, lang)
    left = []
    for k in range(1, longest):
        own = scored(phrases[k])
        if k + 1 < longest:  # of all longer phrases one of the next length occurs most
            longer = phrases[k + 1].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer_"))
            own = own.join(longer, "id", "left").where(F.coalesce(100 * F.col("longer_") < share * F.col("a"), F.lit(True)))
        left.append(own.select("lang", "phrase", "a", "l", "r", "score"))
    every = left[0]
    for more in left[1:]:
        every = every.unionByName(more)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = every.withColumn("part_", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    few = parted.withColumn("rank_", F.row_number().over(Window.partitionBy("lang", "part_").orderBy(*best))).where(F.col("rank_") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
