"""Arrow batches as flat numpy byte arrays: shared helpers of the text operators.

The operators work on the UTF-8 bytes of many documents at once.  A record
batch is cut into blocks of a few megabytes (a longer document is a block of
its own), so the memory of a task depends on the block size and on the longest
single document, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, up to n."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 65536)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shifts and odd multiplications), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(raw: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents of about `limit` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def free_names(taken: list[str] | tuple[str, ...], names: list[str]) -> list[str]:
    """`names`, each with as many _ behind it as it takes to differ from `taken` (without regard to case)."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of `flags` (one per byte, word or line) in each interval of `off`."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and n+1 offsets of the documents into them.

    A word is a longest run of bytes other than space and 0x09 to 0x0D inside one document.
    """
    ink = ~_WHITE[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


class Hasher:
    """Hashes of any byte ranges of a block from one prefix sum."""

    def __init__(self, raw: np.ndarray):
        p, self.inverse = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[raw] * p[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal entry anywhere, and which have one earlier on."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    later[order[1:]] = same
    return any_, later


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `width` that begins at one of `starts`."""
    step = np.zeros(n + 1, np.int32)
    step[starts] += 1  # starts are distinct
    step[np.minimum(starts + width, n)] -= 1 if width else 0
    return np.cumsum(step[:-1]) > 0
