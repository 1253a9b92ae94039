"""Columns of numbers shuffled as packed rows.

A shuffle of single (token, document) rows costs several times their bytes.
Here each task packs its rows per bucket: one row (bucket, payload) holds many
entries, column after column, so that the shuffle's compression works well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, payload binary"


def pack(columns: dict[str, np.ndarray]) -> bytes:
    n = len(next(iter(columns.values())))
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values())


def unpack(payload: bytes, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(payload, np.int64, 1)[0]), 8, {}
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        out[name] = np.frombuffer(payload, kind, n, at)
        at += n * size
    return out


def deal(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, payload): the entries of each bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")
    ranked = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ends = np.append(cuts[1:], len(ranked))
    sorted_columns = {k: c[order] for k, c in columns.items()}
    payloads = [pack({k: c[a:b] for k, c in sorted_columns.items()}) for a, b in zip(cuts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(ranked[cuts].astype(np.int32)), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def by_bucket(rows: DataFrame, n_buckets: int, bucket: str = "bucket") -> DataFrame:
    """Each bucket in a partition of its own (a hash of the buckets would put several into one)."""
    return rows.repartitionById(n_buckets, bucket)


def gather(parts: Iterable[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray] | None:
    """All entries of a partition, which is one bucket, as columns, and the number of the `bucket`; None if there are none."""
    got = {k: [] for k in kinds}
    own = None
    for part in parts:
        for bucket, payload in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            columns = unpack(payload.as_buffer().to_pybytes(), kinds)
            for k, c in columns.items():
                got[k].append(c)
            own = bucket
    if own is None:
        return None
    return {k: np.concatenate(got.pop(k)) for k in kinds} | {"bucket": own}
