"""Arrays of whole numbers as one compressed value, and blocks of rows that a table answers.

Several operators cut their input into blocks, number the distinct keys of a block,
send those keys to buckets and get one number back for each.  A key travels once a
block, not once a row, and the answer needs no key, as it comes back in the order
in which the keys were sent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

_KINDS = (np.uint8, np.uint16, np.uint32, np.int64)
_HEAD = np.dtype([("kind", "u1"), ("n", "<i8")])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in the smallest type that holds them, compressed together."""
    heads = np.zeros(len(arrays), _HEAD)
    parts = []
    for k, a in enumerate(arrays):
        low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        kind = 3 if low < 0 else next(i for i, t in enumerate(_KINDS) if high <= np.iinfo(t).max)
        heads[k] = kind, len(a)
        flat = np.ascontiguousarray(a, _KINDS[kind])
        parts.append(flat.view(np.uint8).reshape(len(flat), -1).T.tobytes() if len(flat) else b"")  # bytes of one place together
    raw = bytes([len(arrays)]) + heads.tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    """The arrays of `squeeze`, as 64-bit numbers."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    heads = np.frombuffer(raw, _HEAD, raw[0], 1)
    at, out = 1 + heads.nbytes, []
    for kind, n in heads:
        width = np.dtype(_KINDS[kind]).itemsize
        flat = np.frombuffer(raw, np.uint8, int(n) * width, at).reshape(width, int(n))
        out.append(np.ascontiguousarray(flat.T).view(_KINDS[kind]).ravel().astype(np.int64) if n else np.zeros(0, np.int64))
        at += int(n) * width
    return out


def block_numbers() -> Iterator[int]:
    """Numbers that no other task of the job gives out."""
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    while True:
        yield base
        base += 1


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings between `offsets` (n+1) of UTF-8 `data`."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 data and n+1 offsets of a large-string array without nulls."""
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def bucket_order(buckets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts equal buckets together (else as they are), and (bucket, first, last) of each."""
    order = np.argsort(buckets, kind="stable")
    ranked = buckets[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
    return order, [(int(ranked[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(ranked)], strict=True)]


def in_bucket_order(table: pa.Table, bucket: str, payload: str) -> list[bytes]:
    """The `payload`s of a block by rising `bucket`."""
    numbers, values = table.column(bucket).to_pylist(), table.column(payload).to_pylist()
    return [values[k] for k in np.argsort(np.array(numbers, np.int64), kind="stable")]


def joined(parts: Sequence[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)
