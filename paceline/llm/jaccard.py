"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct 5-word shingles (64-bit hashes).  Two sets
with Jaccard similarity of at least t share, under any order of all tokens, a
token among the first n - ceil(t n) + 1 of each.  Three orders are used.

* Rarity (tokens by the number of sets that hold them).  A set all of whose
  prefix tokens occur nowhere else has no partner: it must have ceil(t n) tokens
  that some other set holds too.  Sets that have are few; only they go on, with
  their shared tokens, and their prefix makes posting lists.
* Ascending and descending hash.  Each set keeps its prefixes under these orders as
  32-bit hashes.  A pair of a posting list stays a candidate only if the prefixes of
  the two share a token under both orders as well; for that a quarter of the tokens
  of each is read.  The whole sets are fetched only for pairs that pass all three
  filters, and their overlap counted.

Equal sets are one class from the start, so copies cost nothing more.  Within the
posting list of a token no pairs are made between sets already in one component:
first each list links its members to its most central set (whose tokens the most
sets hold), and only where a list still spans several components are the pairs
across components looked at (with a bound on the overlap from bitmaps).  No list,
bucket or candidate is cut off.

A task cuts its texts into blocks and numbers the classes of each.  A token travels
with that number (16 bits), not with its class, so it takes the same bytes however
many buckets there are.  Tokens held once stay in their bucket; the others come back
to their block, and so do the classes, with the number of blocks that hold them: a
token held by no more than the copies of a class is no shared one.  The first copy of
a class goes on.

Tokens that some part of the input holds often are counted first.  A token of
HOT_SHARE of all sets or more is hot: its entries are spread by set, not by token,
and its number comes from that count, so no task gathers it.

Defined cases: null and empty texts have no shingles and no links; a text with
fewer than five words is one shingle; a null doc_id takes part in links and is
never a component id, unless all of a component are null; equal ids and repeated
rows are separate rows; a similarity of exactly t links; extra columns are not
read; an empty table gives an empty table; a very long text is a block of its own,
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from . import blobs
from .packed import block_numbers

WIDTH = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 75, 100
#: Text that a task holds as tokens at a time (bytes).
FLUSH_BYTES = 4 << 20
#: Tokens of a bucket, about; there are at least as many buckets as asked for.
BUCKET_TOKENS = 1 << 19
#: Prefix tokens whose posting lists make a bucket, about.
LIST_TOKENS = 1 << 20
#: Sets among those of a flush that make a token a candidate for a hot one, and the share of all sets that makes it one.
HOT_LOCAL, HOT_SHARE = 16, 1 / 500
HUB_ROUNDS = 3
#: A hub round that links a smaller share of its pairs is the last one.
HUB_SHARE = 1 / 100
#: Classes of a block at most, numbered by 16 bits.
BLOCK_CLASSES = 1 << 16
_BITS = 1024

_STEP = np.uint64(0xA0761D6478BD642F | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Every token of every class of a block is shuffled as 7 bytes, the last of which is mostly 0; what is known of a class as a whole goes once, apart.
_PLACE = {"at_low": np.uint8, "at_high": np.uint8}
_TOKEN = {"low": np.uint32, "high": np.uint8} | _PLACE
_SHARED = _TOKEN | {"df": np.uint32}
_HOT_TOKEN = {"low": np.uint32} | _PLACE
_CLASS = {"cls": np.int64, "n": np.uint32, "ahead": np.uint64, "behind": np.uint64} | _PLACE
_LEADER = _CLASS | {"copies": np.uint32}
#: Entries of a block; `source` is the bucket of tokens on their way back, or one of the two below.
_SENT = "bucket int, block long, source int, payload binary"
_OF_CLASSES, _OF_HOT = -1, -2
#: The bit of `high` that marks the number of a hot token.
_HOT = np.uint8(1 << 7)
_POSTING = {"token": np.uint64, "cls": np.int64, "n": np.uint32, "comp": np.int64, "weight": np.float32}


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n among which, under any order, a similar set has one too."""
    return n.astype(np.int64) - least(n) + 1


def least(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n must share with a similar one."""
    return -((-NUM * n.astype(np.int64)) // DEN)


def similar(inter: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return DEN * inter >= NUM * (n_a + n_b - inter)


def shingles(raw: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and n+1 offsets into them."""
    raw = _LOWER[raw]
    starts, ends, wptr = B.words(raw, off)
    word = B.Hasher(raw)(starts, ends)
    n_words = np.diff(wptr)
    doc = np.repeat(np.arange(len(off) - 1), n_words)
    whole = n_words < width
    place = np.arange(len(word))
    gram, end = word.copy(), wptr[1:][doc]
    size = np.minimum(n_words, width)[doc]
    # a window of `width`, or all words where the document has fewer
    keep = (place + size <= end) & (~whole[doc] | (place == wptr[:-1][doc]))
    place, size, doc = place[keep], size[keep], doc[keep]
    gram = gram[keep]
    for k in range(1, width):
        more = size > k
        gram[more] = gram[more] * _STEP + word[place[more] + k]
    token = B.mix(gram + size.astype(np.uint64))
    by_token = np.argsort(token)
    low = doc[by_token]
    order = by_token[np.argsort(low.astype(np.uint16) if len(off) < 65536 else low, kind="stable")]
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(off)))


def classes(token: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A hash of each document's set."""
    total = B.per_doc(B.mix(token ^ np.uint64(0x8BB84B93962EACC9)).view(np.int64), ptr)
    return B.mix(total.view(np.uint64) + np.diff(ptr).astype(np.uint64)).view(np.int64)


def _flushes(parts: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(token, at, about) of the classes that are new to a flush, some megabytes of text at a time; `at` is the place of the token's class in `about`."""
    held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
    size, seen = 0, np.zeros(0, np.int64)

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
        token = np.concatenate([x[0] for x in held])
        about = {k: np.concatenate([x[1][k] for x in held]) for k in held[0][1]}
        held.clear()
        for i in range(0, len(about["n"]), BLOCK_CLASSES):
            own = {k: c[i : i + BLOCK_CLASSES] for k, c in about.items()}
            n = int(own["n"].sum())
            yield token[:n], np.repeat(np.arange(len(own["n"]), dtype=np.uint16), own["n"]), own
            token = token[n:]

    for part in parts:
        raw, off = B.text_bytes(part.column(column))
        for _, _, data, cuts in B.blocks(raw, off, 1 << 20):
            token, ptr = shingles(data, cuts)
            cls, n = classes(token, ptr), np.diff(ptr)
            first = np.zeros(len(cls), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            first &= ~np.isin(cls, seen) & (n > 0)  # a copy in the same flush adds nothing
            seen = np.concatenate([seen, cls[first]])
            p = prefix_length(n[first])
            about = {"cls": cls[first], "n": n[first].astype(np.uint32), "ahead": token[ptr[:-1][first] + p - 1], "behind": token[ptr[1:][first] - p]}
            held.append((token[np.repeat(first, n)], about))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield from cut()
                size, seen = 0, np.zeros(0, np.int64)
    if held:
        yield from cut()


def sets(docs: DataFrame, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row (null without one), n_shingles, cls (a hash of the set) of each row.

    Rows with n_shingles -1 are tokens (`cls`) that many sets (`row`) of some part of the input hold.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "n_shingles", "cls"]
        held: list[np.ndarray] = []
        size, seen = 0, np.zeros(0, np.int64)

        def often() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n >= HOT_LOCAL].view(np.int64), n[n >= HOT_LOCAL].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n), pa.array(np.full(len(n), -1, np.int64)), pa.array(token)], names)

        for part in parts:
            raw, off = B.text_bytes(part.column(1))
            for i, j, data, cuts in B.blocks(raw, off, 1 << 20):
                token, ptr = shingles(data, cuts)
                cls, n = classes(token, ptr), np.diff(ptr)
                own = [part.column(k).slice(i, j - i) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.array(cls)], names)
                first = np.zeros(len(cls), bool)
                first[np.unique(cls, return_index=True)[1]] = True
                first &= ~np.isin(cls, seen)
                seen = np.concatenate([seen, cls[first]])
                held.append(token[np.repeat(first, n)])
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield often()
                    held, size, seen = [], 0, np.zeros(0, np.int64)
        if held:
            yield often()

    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"))
    return picked.mapInArrow(run, "doc_id long, row long, n_shingles long, cls long")


def _name(token: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token, and the number that stands for it: its bucket and 39 bits of its place in there.

    Buckets are ranges of the hash, so the numbers are in the order of the tokens.
    As buckets grow in number with the tokens, two tokens of a bucket have one number
    with the same small chance at every size.
    """
    count = np.uint64(n_buckets)
    bucket = ((token >> np.uint64(40)) * count) >> np.uint64(24)
    start = ((bucket << np.uint64(24)) + count - np.uint64(1)) // count << np.uint64(40)
    place = (token - start) >> np.uint64(((1 << 24) // n_buckets + 1).bit_length() + 1)
    return bucket.astype(np.int32), (bucket << np.uint64(40)) | place


def _places(at: np.ndarray) -> dict[str, np.ndarray]:
    """`_PLACE` of each number; the bytes of one place together compress better."""
    return {"at_low": (at & 0xFF).astype(np.uint8), "at_high": (at >> 8).astype(np.uint8)}


def _at(columns: dict[str, np.ndarray]) -> np.ndarray:
    return columns["at_high"].astype(np.int64) << 8 | columns["at_low"]


def _spread(x: np.ndarray, n_buckets: int) -> np.ndarray:
    return (B.mix(x.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)


def _rows(bucket: np.ndarray, block: np.ndarray, source: int, payload: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(np.full(len(block), source, np.int32)), payload]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "source", "payload"])


def _tokens_out(n_buckets: int, hot: np.ndarray):
    """Every token of every class of a block, dealt to token buckets (entries of hot ones at random), and what is known of the classes, dealt by class."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block_numbers()
        for token, at, about in _flushes(parts, 0):
            block = next(number)
            bucket, name = _name(token, n_buckets)
            low, high = (name & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((name >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
            if len(hot):
                k = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                is_hot = hot[k] == token
                low[is_hot] = k[is_hot]
                bucket[is_hot] = _spread(about["cls"][at[is_hot]], n_buckets)
                high[is_hot] = _HOT
            for part in blobs.deal(bucket, {"low": low, "high": high} | _places(at)):
                yield _rows(part.column(0).to_numpy(), np.full(part.num_rows, block), 0, part.column(1))
            for part in blobs.deal(_spread(about["cls"], n_buckets), about | _places(np.arange(len(about["n"])))):
                yield _rows(part.column(0).to_numpy(), np.full(part.num_rows, block), _OF_CLASSES, part.column(1))

    return run


def _gather(parts: Iterator[pa.RecordBatch], kinds: dict[str, dict[str, type]]) -> tuple[int, np.ndarray, dict[str, dict[str, np.ndarray]]]:
    """The bucket, its blocks and, for each of `kinds` (tokens, classes, hot), all entries as columns, with the place of their block in the blocks and their source."""
    own, blocks = 0, {}
    got: dict[str, list] = {kind: [] for kind in kinds}
    for part in parts:
        for own, block, source, payload in zip(*(part.column(k).to_pylist() for k in range(3)), part.column(3), strict=True):
            kind = {_OF_CLASSES: "classes", _OF_HOT: "hot"}.get(source, "tokens")
            columns = blobs.unpack(payload.as_buffer().to_pybytes(), kinds[kind])
            got[kind].append((blocks.setdefault(block, len(blocks)), source, columns))
    out = {}
    for kind, columns in kinds.items():
        held = got.pop(kind)
        size = [len(x[2]["at_low"]) for x in held]
        out[kind] = {c: np.concatenate([np.zeros(0, t), *(x[2][c] for x in held)]) for c, t in columns.items()}
        out[kind] |= {name: np.repeat(np.array([x[k] for x in held], np.int64), size) for k, name in enumerate(("block", "source"))}
    return own, np.array(list(blocks), np.int64), out


def _share(n_buckets: int):
    """Tokens that two or more classes of all blocks hold, with their number, and the first copy of each class, with the number of copies, dealt to the buckets of their blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks, got = _gather(parts, {"tokens": _TOKEN, "classes": _CLASS})
        where = _spread(blocks, n_buckets)

        def back(entries: dict[str, np.ndarray], order: np.ndarray, kinds: dict[str, type], source: int) -> Iterator[pa.RecordBatch]:
            for part in blobs.deal(entries["block"][order], {k: entries[k][order] for k in kinds}):
                k = part.column(0).to_numpy()
                yield _rows(where[k], blocks[k], source, part.column(1))

        e = got["classes"]
        order = np.lexsort((_at(e), blocks[e["block"]], e["cls"]))
        start = np.flatnonzero(np.concatenate([[True], np.diff(e["cls"][order]) != 0])) if len(order) else order
        e["copies"] = np.zeros(len(order), np.uint32)
        e["copies"][order[start]] = np.diff(np.append(start, len(order)))
        yield from back(e, order[start], _LEADER, _OF_CLASSES)
        e = got["tokens"]
        hot = e["high"] == _HOT
        yield from back(e, np.flatnonzero(hot), _HOT_TOKEN, _OF_HOT)
        place = np.flatnonzero(~hot)
        token = e["high"][place].astype(np.uint64) << np.uint64(32) | e["low"][place]
        order = np.argsort(token)
        token, order = token[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else order
        count = np.diff(np.append(start, len(token)))
        e["df"] = np.zeros(len(e["low"]), np.uint32)
        e["df"][order] = np.repeat(count, count)
        yield from back(e, np.flatnonzero(e["df"] > 1), _SHARED, own)

    return run


def _survivors(n_buckets: int, hot: np.ndarray, hot_sets: np.ndarray):
    """Classes that have enough shared tokens for a partner: their shared tokens, rarest first, the prefix length and the prefixes by hash."""
    _, hot_names = _name(hot, n_buckets)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, got = _gather(parts, {"tokens": _SHARED, "classes": _LEADER, "hot": _HOT_TOKEN})
        known, e, often = got["classes"], got["tokens"], got["hot"]
        key = known["block"] << 16 | _at(known)
        by_key = np.argsort(key)
        known, key = {k: c[by_key] for k, c in known.items()}, key[by_key]
        token = e["source"].astype(np.uint64) << np.uint64(40) | e["high"].astype(np.uint64) << np.uint64(32) | e["low"]
        token = np.concatenate([token, hot_names[often["low"]]])
        df = np.concatenate([e["df"], hot_sets[often["low"]]])
        held = np.concatenate([x["block"] << 16 | _at(x) for x in (e, often)])
        if not len(key) or not len(held):
            return
        own = np.minimum(np.searchsorted(key, held), len(key) - 1)
        shared = df > known["copies"][own]
        shared[len(e["df"]) :] = True  # a part of the input has classes enough of a hot token
        order = np.flatnonzero(shared & (key[own] == held))  # not of later copies
        order = order[np.lexsort((token[order], df[order], own[order]))]
        if not len(order):
            return
        own = own[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(start, len(own)))
        enough = count >= least(known["n"][own[start]])
        order, at = order[np.repeat(enough, count)], own[start[enough]]
        if not len(order):
            return
        token, df = token[order], df[order]
        end = np.cumsum(count[enough])
        start = end - count[enough]
        cls, n = known["cls"][at], known["n"][at]
        weight = np.add.reduceat(df.astype(np.float64), start) / n
        short = (B.mix(token) >> np.uint64(32)).astype(np.uint32)
        last, least_one = (np.repeat(_name(known[k][at], n_buckets)[1], end - start) for k in ("ahead", "behind"))
        ahead = [token <= last, token >= least_one]
        for i in range(0, len(start), 2000):
            a, b = start[i : i + 2000], end[i : i + 2000]
            prefix = (b - a) - least(n[i : i + 2000]) + 1
            tokens = [token[x:y].tobytes() for x, y in zip(a, b, strict=True)]
            heads = [token[x : x + q].tobytes() for x, q in zip(a, prefix, strict=True)]
            maps = [_bitmap(token[x:y]).tobytes() for x, y in zip(a, b, strict=True)]
            columns = [pa.array(cls[i : i + 2000]), pa.array(n[i : i + 2000].astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(heads, pa.binary()), pa.array(weight[i : i + 2000]), pa.array(maps, pa.binary()), pa.array(tokens, pa.binary())]
            both = [pa.array([np.sort(short[x:y][inside[x:y]]).tobytes() for x, y in zip(a, b, strict=True)], pa.binary()) for inside in ahead]
            yield pa.RecordBatch.from_arrays([*columns, *both], ["cls", "n", "shared", "head", "weight", "bits", "tokens", "ascending", "descending"])

    return run


_SURVIVOR = "cls long, n int, shared int, head binary, weight double, bits binary, tokens binary, ascending binary, descending binary"


def _bitmap(token: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of _BITS places, as 64-bit words."""
    bit = (B.mix(token) % np.uint64(_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=_BITS) & 1).astype(np.uint8)).view(np.uint64)


def _postings_out(n_buckets: int, bitmaps: bool):
    """(token, cls, n, comp) of each prefix token of each survivor, dealt to token buckets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 4000):
                cut = part.slice(k, 4000)
                heads = [np.frombuffer(x, np.uint64) for x in cut.column(3).to_pylist()]
                cls, n, shared, weight, comp = (cut.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
                prefix = np.array([len(t) for t in heads], np.int64)
                token = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                bucket = (B.mix(token) % np.uint64(n_buckets)).astype(np.int32)
                columns = {"token": token, "cls": np.repeat(cls, prefix), "n": np.repeat(n, prefix).astype(np.uint32), "comp": np.repeat(comp, prefix), "weight": np.repeat(weight, prefix).astype(np.float32)}
                if bitmaps:
                    maps = np.frombuffer(b"".join(cut.column(6).to_pylist()), np.uint64).reshape(-1, _BITS // 64)
                    columns |= {"shared": np.repeat(shared.astype(np.uint32), prefix)} | {f"b{i}": np.repeat(maps[:, i], prefix) for i in range(maps.shape[1])}
                yield from blobs.deal(bucket, columns)

    return run


def _lists(got: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Entries by token, without lists that lie in one component; starts and ends of the lists."""
    order = np.argsort(got["token"], kind="stable")
    token, comp = got["token"][order], got["comp"][order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(start, len(token)))
    several = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
    order = order[np.repeat(several, count)]
    count = count[several]
    end = np.cumsum(count)
    return {k: c[order] for k, c in got.items() if k != "bucket"}, end - count, end


def _sized(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether two sets are close enough in size."""
    return similar(np.minimum(n_a, n_b), n_a, n_b)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs (member, hub) without repeats; which of the two is called a stays."""
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _hub_pairs(first: bool):
    """Links from the members of each list to its most central one, or (not `first`) to the most central one outside that one's component."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = blobs.gather(parts, _POSTING)
        if got is None:
            return
        e, start, end = _lists(got)
        if not len(start):
            return
        where = np.repeat(np.arange(len(start)), end - start)
        n, cls, comp, weight = e["n"].astype(np.int64), e["cls"], e["comp"], -e["weight"]
        hub = np.repeat(np.lexsort((cls, weight, where))[start], end - start)
        if not first:
            outside = comp != comp[hub]  # there are some in every list
            hub = np.repeat(np.lexsort((cls, weight, ~outside, where))[start], end - start)
        good = (comp != comp[hub]) & _sized(n, n[hub])
        yield _pair_batch(cls[good], cls[hub[good]])

    return run


def _mixed_members(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes in lists that span several components."""
    got = blobs.gather(parts, _POSTING)
    if got is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_lists(got)[0]["cls"]))], ["cls"])


def _cross_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list across components whose sizes and bitmaps allow the similarity."""
    kinds = _POSTING | {"shared": np.uint32} | {f"b{i}": np.uint64 for i in range(_BITS // 64)}
    got = blobs.gather(parts, kinds)
    if got is None:
        return
    e, start, end = _lists(got)
    n, cls, comp, shared = e["n"].astype(np.int64), e["cls"], e["comp"], e["shared"].astype(np.int64)
    maps = np.stack([e[f"b{i}"] for i in range(_BITS // 64)], 1)
    found_a, found_b, n_found = [], [], 0
    for s, t in zip(start.tolist(), end.tolist(), strict=True):
        for i in range(s, t, 256):
            x, y = np.arange(i, min(i + 256, t))[:, None], np.arange(i, t)[None, :]
            good = (y > x) & (comp[x] != comp[y]) & _sized(n[x], n[y])
            p, q = np.nonzero(good)
            p, q = p + i, q + i
            apart = np.bitwise_count(maps[p] ^ maps[q]).sum(1).astype(np.int64)
            most = np.minimum((shared[p] + shared[q] - apart) // 2, np.minimum(shared[p], shared[q]))
            good = similar(most, n[p], n[q])
            found_a.append(cls[p[good]])
            found_b.append(cls[q[good]])
            n_found += int(good.sum())
            if n_found > 1 << 20:
                yield _pair_batch(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, n_found = [], [], 0
    if n_found:
        yield _pair_batch(np.concatenate(found_a), np.concatenate(found_b))


def _common(a: pa.Array, b: pa.Array, kind: type) -> np.ndarray:
    """Numbers that two packed lists without repeats share, pair by pair."""
    return np.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind))) for x, y in zip(a, b, strict=True)], np.int64)


def _in_all_orders(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, prefixes of both) that share a prefix token under both hash orders too."""
    for part in parts:
        good = np.ones(part.num_rows, bool)
        for k in (2, 3):
            good[good] = _common(part.column(k).filter(pa.array(good)), part.column(k + 2).filter(pa.array(good)), np.uint32) > 0
        yield part.select(["a", "b"]).filter(pa.array(good))


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n and tokens of both) that are similar."""
    for part in parts:
        n_a, n_b = part.column(2).to_numpy().astype(np.int64), part.column(4).to_numpy().astype(np.int64)
        good = similar(_common(part.column(3), part.column(5), np.uint64), n_a, n_b)
        yield part.select(["a", "b"]).filter(pa.array(good))


def with_columns_of_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """`pairs` (a, b) with `columns` of the classes a (a member) and b (its hub).

    The members' come first, so those of a hub of many members are read once and not
    sent with each of them; such a hub is a skewed key that adaptive execution splits.
    """
    one, two = (table.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", *[f"{c}_{x}" for x in "ab" for c in columns])


def components(edges: DataFrame, scratch: str) -> DataFrame:
    """cls, comp: the smallest cls reachable from each end of `edges` (a, b).

    In each round every component's root takes the smallest root next to it and
    edges inside a component go.  The ids are hashes, so rounds grow with the
    logarithm of the number of ends.
    """
    spark = edges.sparkSession
    labels = edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct().select("cls", F.col("cls").alias("comp"))
    k = 0
    while True:
        labels.write.mode("overwrite").parquet(f"{scratch}/labels_{k}")
        edges.write.mode("overwrite").parquet(f"{scratch}/edges_{k}")
        labels, edges = spark.read.parquet(f"{scratch}/labels_{k}"), spark.read.parquet(f"{scratch}/edges_{k}")
        if edges.isEmpty():
            return labels
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("root"), F.least("a", "low").alias("to"))
        labels = labels.join(low, labels["comp"] == low["root"], "left").select("cls", F.coalesce("to", "comp").alias("comp"))
        one, two = low.select(F.col("root").alias("a"), F.col("to").alias("to_a")), low.select(F.col("root").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(one, "a").join(two, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        k += 1


def near_duplicates(docs: DataFrame, scratch: str, n_buckets: int, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; with `row` (a column of unique longs) also row and leads.

    Under `scratch` stay pairs_K, candidates_K and links_K of each round: the pairs that
    share a prefix token by rarity, those that do under all orders, and the similar ones.

    One row of each component leads: that of the smallest key, null last, then of the
    smallest row.  `scratch` is a folder that all executors share; a row of it holds a
    class's shared tokens, so it is smaller than the texts.  `n_buckets` is the least
    number of buckets; large inputs have more.
    """
    spark = docs.sparkSession
    sets(docs, text, key, row).withColumn("part", (F.monotonically_increasing_id() % n_buckets).cast("int")).write.mode("overwrite").parquet(f"{scratch}/sets")
    rows = spark.read.parquet(f"{scratch}/sets")
    total, n_sets = rows.where("n_shingles > 0").agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    n_buckets = max(n_buckets, -(-(total or 0) // BUCKET_TOKENS))
    # a token counts once per set and part, so no more than total / (HOT_SHARE * n_sets) are hot
    often = rows.where("n_shingles = -1").groupBy("cls").agg(F.sum("row").alias("n")).where(F.col("n") >= HOT_SHARE * n_sets).toPandas()
    hot, hot_sets = often["cls"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64).clip(2, 2**32 - 1).astype(np.uint32)
    hot, hot_sets = hot[np.argsort(hot)], hot_sets[np.argsort(hot)]
    rows = rows.where("n_shingles >= 0")

    dealt = docs.select(text).mapInArrow(_tokens_out(n_buckets, hot), _SENT)
    shared = blobs.by_bucket(dealt, n_buckets).mapInArrow(_share(n_buckets), _SENT)
    blobs.by_bucket(shared, n_buckets).mapInArrow(_survivors(n_buckets, hot, hot_sets), _SURVIVOR).write.mode("overwrite").parquet(f"{scratch}/survivors")
    survivors = spark.read.schema(_SURVIVOR).parquet(f"{scratch}/survivors")

    n_lists = max(n_buckets // 4, -(-(survivors.agg(F.sum(F.octet_length("head"))).first()[0] or 0) // 8 // LIST_TOKENS))

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{scratch}/{name}")

    labels = survivors.select("cls", F.col("cls").alias("comp"))
    tried = spark.createDataFrame([], "a long, b long")
    rounds = [*range(HUB_ROUNDS), "cross"]
    while rounds:
        k = rounds.pop(0)
        last = k == "cross"
        placed = survivors.withColumn("comp", F.col("cls")) if k == 0 else survivors.join(labels, "cls")
        placed = placed.select("cls", "n", "shared", "head", "weight", "comp", *(["bits"] if last else []))
        if last:
            mixed = blobs.by_bucket(placed.mapInArrow(_postings_out(n_lists, False), blobs.SCHEMA), n_lists).mapInArrow(_mixed_members, "cls long").distinct()
            placed = placed.join(mixed, "cls", "left_semi")
        postings = blobs.by_bucket(placed.mapInArrow(_postings_out(n_lists, last), blobs.SCHEMA), n_lists)
        pairs = postings.mapInArrow(_cross_pairs if last else _hub_pairs(k == 0), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        pairs = kept(pairs, f"pairs_{k}")
        # tokens grow with the input, so they are never broadcast; the pairs of the last round are few as a rule, and then pick its classes out before the shuffles
        table = survivors.join(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "cls", "left_semi") if last else survivors
        table = table.hint("merge")
        candidates = with_columns_of_both(pairs, table, ["ascending", "descending"])
        candidates = kept(candidates.mapInArrow(_in_all_orders, "a long, b long"), f"candidates_{k}")
        links = kept(with_columns_of_both(candidates, table, ["n", "tokens"]).mapInArrow(_verify, "a long, b long"), f"links_{k}")
        if links.isEmpty():  # nothing joins, so further hub rounds would try the same
            rounds = rounds[-1:]
            continue
        tried = tried.union(pairs)
        if not last and links.count() < HUB_SHARE * pairs.count():
            rounds = rounds[-1:]
        ends = links
        if k != 0:  # the links join components of the rounds before
            one, two = (labels.select(F.col("cls").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
            ends = links.join(one, "a").join(two, "b").where("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()
        moved = components(ends, f"{scratch}/components_{k}").select(F.col("cls").alias("comp"), F.col("comp").alias("to"))
        labels = kept(labels.join(moved, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")), f"classes_{k}")

    return smallest_ids(rows, labels, n_buckets, row is not None)


def smallest_ids(rows: DataFrame, labels: DataFrame, shares: int, with_rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (and row, leads) from the classes of `rows` (with `part`, any fixed spread) and their components.

    A class or a component may hold a third of all rows, so neither is a join key
    by itself: copies of a class fold by (class, part), the classes of a component
    by (component, share), and ids come back the same two ways.  A text without
    shingles is a class of its own.
    """
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    heads = rows.where("n_shingles > 0").groupBy("cls", "part").agg(least_row.alias("low"))
    heads = heads.join(labels, "cls", "left").select("cls", "part", "low", F.coalesce("comp", "cls").alias("comp"), F.pmod(F.xxhash64("cls", "part"), F.lit(shares)).alias("share"))
    folded = heads.groupBy("comp", "share").agg(F.min("low").alias("low"))
    lowest = folded.groupBy("comp").agg(F.min("low").alias("first"))
    named = folded.join(lowest, "comp").select("comp", "share", "first")
    by_class = heads.join(named, ["comp", "share"]).select("cls", "part", "first")
    placed = rows.withColumn("cls", F.when(F.col("n_shingles") > 0, F.col("cls"))).join(by_class, ["cls", "part"], "left")
    out = placed.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "row", F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("leads"))
    return out if with_rows else out.drop("row", "leads")
