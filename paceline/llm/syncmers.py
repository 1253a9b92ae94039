"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the smallest (by hash) of its s-mers is
its first or its last.  That depends on the k-mer alone, so an edit changes the
anchors near it and no others.  A fingerprint is, for each of two lengths of k-mer,
the `SIZE` anchors of smallest hash with their places (a repeated anchor counts as often as it occurs, each time
with a hash of its own); likeness compares two fingerprints anchor by anchor,
counting those whose places keep their order in both texts, so text put in or left
out between anchors costs only the anchors near it.

Defined cases: null counts as empty text; a text too short for a k-mer has one
anchor of that kind, the hash of the whole text; an empty text has none; two empty
texts have likeness 1, an empty and another one 0; equal texts have equal
fingerprints; equal or null ids are separate rows in order of a hash of their
texts; extra columns are not read; an empty table gives an empty table; a very
long text is a block of its own, read whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from . import blobs

#: (k, s) of the two kinds of anchors that every text has: specific ones, and more of them for short texts.
KINDS = ((12, 4), (7, 3))
#: Anchors that a fingerprint keeps of each kind, at most (`fingerprints` with size None keeps all, for exact likeness).
SIZE = 64

Anchors = tuple[np.ndarray, np.ndarray]  # hashes (uint32, ascending) and places
Fingerprint = tuple[Anchors, ...]  # one of each kind


def _smers(raw: np.ndarray, s: int) -> np.ndarray:
    m = max(0, len(raw) - s + 1)
    packed = np.zeros(m, np.uint64)
    for k in range(s):
        packed = (packed << np.uint64(8)) | raw[k : k + m]
    return B.mix(packed + np.uint64(s))


def closed_syncmers(raw: np.ndarray, k: int, s: int) -> np.ndarray:
    """Places of the closed syncmers of a run of bytes."""
    h, w = _smers(raw, s), k - s + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    low, span = h, 1
    while span < w:  # smallest of a window of w by doubling
        step = min(span, w - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    n = len(low)
    return np.flatnonzero((low == h[:n]) | (low == h[w - 1 : w - 1 + n]))


def _bottom(place: np.ndarray, key: np.ndarray, doc: np.ndarray, n_docs: int, size: int | None) -> list[Anchors]:
    """The `size` smallest keys of each document with their places; a key's later occurrences get keys of their own."""
    both = (doc.astype(np.uint64) << np.uint64(32)) | key
    order = np.argsort(both, kind="stable")  # occurrences stay in order of place
    first = np.ones(len(order), bool)
    first[1:] = both[order[1:]] != both[order[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    again = (np.arange(len(order)) - start).astype(np.uint64)
    key = key.copy()
    later = order[~first]
    key[later] = B.mix(key[later] + (again[~first] << np.uint64(32))) >> np.uint64(32)

    n = np.bincount(doc, minlength=n_docs)
    size = int(n.max(initial=0)) if size is None else size
    share = np.minimum(1.0, 3 * size / np.maximum(n, 1))
    small = key < share[doc] * 2.0**32
    short = np.bincount(doc[small], minlength=n_docs) < np.minimum(n, size)
    chosen = np.flatnonzero(small | short[doc])
    order = chosen[np.lexsort((place[chosen], key[chosen], doc[chosen]))]
    ptr = np.searchsorted(doc[order], np.arange(n_docs + 1))
    ends = np.minimum(ptr[1:], ptr[:-1] + size)
    h, p = key[order].astype(np.uint32), place[order].astype(np.uint32)
    return [(h[a:b], p[a:b]) for a, b in zip(ptr[:-1], ends, strict=True)]


def fingerprints(texts: list[bytes], size: int | None = SIZE) -> list[Fingerprint]:
    """Anchors of each kind of each text: the `size` smallest of each, or all of them (None)."""
    sizes = np.array([len(x) for x in texts], np.int64)
    out: list[list[Anchors]] = [[] for _ in texts]
    for k, s in KINDS:
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (total == 0 or total + sizes[j] <= B.BLOCK_BYTES):
                total += int(sizes[j])
                j += 1
            raw = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            off = np.concatenate([[0], np.cumsum(sizes[i:j])])
            place = closed_syncmers(raw, k, s)
            doc = np.searchsorted(off, place, "right") - 1
            inside = place + k <= off[doc + 1]
            place, doc = place[inside], doc[inside]
            key = B.Hasher(raw)(place, place + k) >> np.uint64(32)
            for x, got in enumerate(_bottom(place - off[doc], key, doc, j - i, size), i):
                if not len(got[0]) and sizes[x]:
                    whole = int.from_bytes(hashlib.sha256(texts[x]).digest()[:4], "big")
                    got = (np.array([whole], np.uint32), np.zeros(1, np.uint32))
                out[x].append(got)
            i = j
    return [tuple(x) for x in out]


def encode(fingerprint: Fingerprint) -> str:
    """A fingerprint as text: for each kind hash and place of each anchor as 8 hex digits."""
    return ":".join(np.stack(x, 1).astype(">u4").tobytes().hex() for x in fingerprint)


def likeness(a: Fingerprint, b: Fingerprint, size: int | None = SIZE) -> float:
    """0 to 1: an estimate of the share of the texts' anchors, of both kinds, that match in order of place (longest increasing run)."""
    matched = seen = 0
    for one, two in zip(a, b, strict=True):
        first, second = (dict(zip(x[0].tolist(), x[1].tolist(), strict=True)) for x in (one, two))
        union = sorted({**first, **second})[:size]
        common = sorted((first[h], second[h]) for h in union if h in first and h in second)
        ends: list[int] = []  # the smallest last place of an increasing run of each length
        for _, place in common:
            k = bisect_left(ends, place)
            ends[k : k + 1] = [place]
        matched, seen = matched + len(ends), seen + len(union)
    return 2 * matched / (seen + matched) if seen else 1.0


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and the fingerprint (string) of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 2000):
                cut = part.slice(k, 2000)
                got = fingerprints([(x or "").encode() for x in cut.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in range(len(keep))), pa.array([encode(x) for x in got], pa.string())], [*keep, "fingerprint"])

    picked = docs.select(*keep, F.col(text).alias("text_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, fingerprint string")


_LOWEST = -(2**63)
#: Bytes of text in a range of ids, about.
RANGE_BYTES = 32 << 20
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple[int, str]], following: list[str], prints: list[Fingerprint], next_prints: list[Fingerprint]) -> pa.RecordBatch:
    """The result rows of (doc_id, text) and the texts behind them."""
    edited = []
    for (_, t), nxt in zip(rows, following, strict=True):
        n = len(t) // 3
        edited.append((t[: len(t) - n] + nxt[:n]).encode())
    changed = fingerprints(edited)
    columns = [
        pa.array([None if x == _LOWEST else x for x, _ in rows], pa.int64()),
        pa.array([len(t) for _, t in rows], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array([encode(x) for x in prints], pa.string()),
        pa.array([encode(x) for x in changed], pa.string()),
        pa.array([likeness(x, y) for x, y in zip(prints, changed, strict=True)], pa.float64()),
        pa.array([likeness(x, y) for x, y in zip(prints, next_prints, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _OUT.split(", ")])


def compare_with_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is replaced by the head of the next one.

    The next document is that of the next lower doc_id (after the lowest: the
    highest; null is lower than all; equal ids are ordered by a hash of the text).
    Ids are cut into ranges at approximate quantiles; an id of so many rows that
    several quantiles fall on it is cut by the hash.  Texts are shuffled once, to
    their range.  Only the highest row of each range goes to a second one, as the
    successor of that range's lowest.  A row that repeats the id and the text of an
    earlier one of its task has that one behind it, and is not shuffled at all.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    if n_ranges is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_ranges = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES))
    cuts = rows.approxQuantile("doc_id", [k / n_ranges for k in range(1, n_ranges)], 0.2 / n_ranges) if n_ranges > 1 else []
    edges = np.sort(np.array(cuts, np.float64)).clip(_LOWEST, 2.0**63 - 1024).astype(np.int64)

    def range_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
        share = hashes.astype(np.float64) / 2.0**64 + 0.5
        return np.minimum(first + (share * (last - first + 1)).astype(np.int64), last)

    def highest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for part in parts:
            ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
            at = range_of(ids, hashes)
            order = np.lexsort((hashes, ids, at))
            for k in order[np.append(at[order][1:] != at[order][:-1], True)] if len(order) else ():
                best[int(at[k])] = max(best.get(int(at[k]), (_LOWEST, _LOWEST)), (int(ids[k]), int(hashes[k])))
        got = [(k, *v) for k, v in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], ["range", "id", "hash"])

    # one row for each of n_ranges ranges
    tops = {r["range"]: (r["top"]["id"], r["top"]["hash"]) for r in rows.select("doc_id", "hash").mapInArrow(highest, "range int, id long, hash long").groupBy("range").agg(F.max(F.struct("id", "hash")).alias("top")).collect()}
    order = sorted(tops)
    above = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}

    def repeats(ids: np.ndarray, hashes: np.ndarray, seen: set[int]) -> np.ndarray:
        """Whether a row repeats an earlier one of the task."""
        keys = B.mix(B.mix(ids.view(np.uint64)) + hashes.view(np.uint64)).tolist()
        out = np.zeros(len(keys), bool)
        for k, key in enumerate(keys):
            if key in seen:
                out[k] = True
            seen.add(key)
        return out

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["range", "extra", "doc_id", "hash", "text"], set()
        for part in parts:
            ids, hashes = part.column(0).to_numpy(), part.column(2).to_numpy()
            at = range_of(ids, hashes)
            new = np.flatnonzero(~repeats(ids, hashes, seen))
            top = np.array([k for k in new if tops[int(at[k])] == (int(ids[k]), int(hashes[k]))], np.int64)
            for chosen, extra, to in ((new, 0, at[new]), (top, 1, np.array([above[int(at[k])] for k in top], np.int64))):
                take = pa.array(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.full(len(chosen), extra, np.int32)), part.column(0).take(take), part.column(2).take(take), part.column(1).take(take)], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose successor is yet to come
        for part in parts:
            for k in range(0, part.num_rows, 1000):
                cut = part.slice(k, 1000)
                got = list(zip(cut.column(1).to_pylist(), cut.column(2).to_pylist(), cut.column(4).to_pylist(), strict=True))
                seq = ([held] if held else []) + got
                held = seq[-1]
                prints = fingerprints([x[2].encode() for x in seq])
                own = [i for i in range(len(seq) - 1) if not seq[i][0]]
                yield _compared([seq[i][1:] for i in own], [seq[i + 1][2] for i in own], [prints[i] for i in own], [prints[i + 1] for i in own])

    def alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in parts:
            again = part.take(pa.array(np.flatnonzero(repeats(part.column(0).to_numpy(), part.column(2).to_numpy(), seen))))
            for k in range(0, again.num_rows, 1000):
                cut = again.slice(k, 1000)
                got = list(zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True))
                prints = fingerprints([t.encode() for _, t in got])
                yield _compared(got, [t for _, t in got], prints, prints)

    dealt = blobs.by_bucket(rows.mapInArrow(deal, "range int, extra int, doc_id long, hash long, text string"), n_ranges, "range")
    ranked = dealt.sortWithinPartitions("extra", F.desc("doc_id"), F.desc("hash"))
    return ranked.mapInArrow(run, _OUT).unionByName(rows.mapInArrow(alike, _OUT))
