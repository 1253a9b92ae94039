"""Bounded, repeatable samples of rows to fit a model on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, by: str | Sequence[str], most: int, seed: int = 11) -> DataFrame:
    """At most `most` of `rows`: those of the smallest hash of the `by` columns, so reruns choose the same.

    A table of no more than `most` rows is taken whole.  Rows are bounded, not keys:
    of rows that are equal in `by` (a key that many rows repeat) only as many are
    taken as still fit.  What comes to the driver are `most` hashes with their counts.
    """
    n = rows.count()
    if n <= most:
        return rows
    names = [by] if isinstance(by, str) else list(by)
    place = F.xxhash64(F.lit(seed), *names)
    low = -(2**63) + int(2**64 * min(1.0, 1.2 * most / n))
    chosen: list = []
    for few in (True, False):  # hashes of few rows as a rule; of all where the smallest are those of too few rows
        ranked = rows.where(place < F.lit(low)) if few and low < 2**63 else rows
        chosen = ranked.groupBy(place.alias("place_")).count().orderBy("place_").limit(most).collect()
        if not few or sum(r["count"] for r in chosen) >= most:
            break
    taken = 0
    for r in chosen:
        if taken + r["count"] > most:
            rest = rows.where(place == F.lit(r["place_"])).limit(most - taken)  # rows alike in `by`
            return rows.where(place < F.lit(r["place_"])).unionByName(rest) if taken else rest
        taken += r["count"]
    return rows.where(place <= F.lit(chosen[-1]["place_"]))
