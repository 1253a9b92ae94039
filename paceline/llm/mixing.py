"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words.  A row of the source is due
`target / source size` copies: the whole part is certain, and the fractional
part is rounded by the pivotal method.  Two rows exchange mass (in words, so
the source's expected total is kept) until one of them is whole; the other goes
on to the next pair.  Rows are dealt into salted buckets of their source, so a
source with a third of all rows is many small groups.  Each bucket leaves at
most one fractional row, and these residuals go up a reduction tree until each
source has one, which a last draw rounds.

Draws come from a hash of (seed, row key, level), and groups are sorted before
they are paired, so reruns and retried tasks give the same mix.

Defined cases: a null source is a source of its own and sorts last; null or
empty text has size 0 and takes 0 words; rows with equal or null ids, and repeated
rows, are rows that are due separately, with keys and so buckets of their own;
rows of equal size are paired in order of their keys; a table whose texts have no
words takes nothing; a very long text is one row, paired first; extra columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import batches as B

#: Rows that one task pairs at a time, about.
BUCKET_ROWS = 2_000
#: Residuals that meet in one node of the tree.
FAN_IN = 64
MOST_COPIES = 3.0
_COLUMNS = "doc_id long, source string, size long, source_size long, target double, due double, left double, level int, node long"


def with_size(docs: DataFrame, keep: Sequence[str] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The `keep` columns and `size`, the number of words of the text (null: 0)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, off = B.text_bytes(part.column(len(keep)))
            sizes = [np.diff(B.words(data, cuts)[2]) for _, _, data, cuts in B.blocks(raw, off)]
            sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(sizes)], [*keep, "size"])

    picked = docs.select(*keep, F.col(text).alias("text_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, size long")


def targets(sizes: DataFrame, scratch: str, weights: Sequence[float] = (5, 2, 1), most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_rows, target: one row per source.

    The sources, by code point with null last, weigh `weights` in turn.  The
    shares are of all sizes; a target stops at `most` times its source's size
    and the excess is shared again by weight, which is the level L at which
    sum(min(most * size, L * weight)) is the total.  L only grows from round to
    round, each of which is two sums over the table of sources; their order comes
    from ranges of it, so there may be any number of them.
    """
    spark = sizes.sparkSession
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranged = by_source.withColumn("last_", F.col("source").isNull()).repartitionByRange("last_", "source").withColumn("range_", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("range_").orderBy("last_", "source"))
    ranged.withColumn("place_", place).write.mode("overwrite").parquet(f"{scratch}/sources")
    ranked = spark.read.parquet(f"{scratch}/sources")
    before, begins = 0, []
    for r in ranked.groupBy("range_").count().orderBy("range_").collect():  # one row for each range
        begins.append((r["range_"], before))
        before += r["count"]
    ranked = ranked.join(F.broadcast(spark.createDataFrame(begins, "range_ int, before_ long")), "range_")
    turn = ((F.col("before_") + F.col("place_") - 1) % len(weights)).cast("int")
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)).withColumn("most_", F.col("source_size") * F.lit(float(most)))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, grows = -1.0, True
    while grows:
        full = F.col("most_") <= F.col("w") * F.lit(level)
        full_words, free = ranked.agg(F.sum(F.when(full, F.col("most_"))), F.sum(F.when(~full, F.col("w")))).first()
        new = (total - (full_words or 0.0)) / free if free else float("inf")
        grows, level = new > level, max(level, new)
    return ranked.select("source", "source_size", "n_rows", F.least(F.lit(level) * F.col("w"), F.col("most_")).alias("target"))


def _draws(seed: int, level: int, keys: np.ndarray) -> np.ndarray:
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + level * 0xD1342543DE82EF95 + 1) % 2**64)
    return (B.mix(B.mix(keys.astype(np.int64).view(np.uint64)) ^ salt) >> np.uint64(11)) * 2.0**-53


def pivot(size: np.ndarray, left: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Pairs rows in turn until at most one of `left` (0 to 1) is fractional.

    Each step moves words between two rows so that one becomes 0 or 1 and the
    expected value of both stays; `size * left` keeps its sum.
    """
    left = left.copy()
    eps, holder = 1e-9, -1
    for k in range(len(left)):
        if not eps < left[k] < 1 - eps:
            left[k] = round(left[k])
            continue
        if holder < 0:
            holder = k
            continue
        i, j = holder, k
        ratio = size[j] / size[i]
        up = min(1 - left[i], left[j] * ratio)  # what row i can take from row j
        down = min(left[i], (1 - left[j]) * ratio)
        step = up if draw[k] * (up + down) < down else -down
        left[i] += step
        left[j] -= step / ratio
        whole_i, whole_j = not eps < left[i] < 1 - eps, not eps < left[j] < 1 - eps
        if whole_i:
            left[i] = round(left[i])
        if whole_j:
            left[j] = round(left[j])
        holder = -1 if whole_i and whole_j else j if whole_i else i
    return left


def _level(level: int, seed: int):
    """Pairs one group; every column is passed on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["doc_id"].fillna(-1).to_numpy().astype(np.int64)
        order = np.lexsort((ids, -rows["size"].to_numpy()))  # long texts first, so that a short one is left over
        rows = rows.iloc[order].copy()
        rows["left"] = pivot(rows["size"].to_numpy(float), rows["left"].to_numpy(), _draws(seed, level, ids[order]))
        return rows

    return run


def mix(
    docs: DataFrame,
    scratch: str,
    weights: Sequence[float] = (5, 2, 1),
    most: float = MOST_COPIES,
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (long) of every row of `docs`.

    `docs` has doc_id, source and text.  Small tables (no text) are written under
    `scratch`, a folder that all executors share.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), "source", "text").withColumn("row", F.monotonically_increasing_id())
    with_size(rows, ("own", "source", "row")).write.mode("overwrite").parquet(f"{scratch}/row_sizes")
    sized = spark.read.parquet(f"{scratch}/row_sizes").withColumn("same", F.xxhash64("own", "source", "size"))
    with_row_keys(sized, "row", "same").drop("row", "same").write.mode("overwrite").parquet(f"{scratch}/sizes")
    mixed = mix_sizes(spark.read.parquet(f"{scratch}/sizes"), scratch, weights, most, seed, bucket_rows, fan_in, ("own",))
    return mixed.drop("doc_id").withColumnRenamed("own", "doc_id")


def with_row_keys(sizes: DataFrame, row: str, same: str) -> DataFrame:
    """`sizes` with doc_id, a key of its own for each row.

    `row` is a number from `monotonically_increasing_id`, `same` a hash of the row's
    content.  Rows of equal content get keys from that hash and their turn, so the
    keys of a table, and with them its mix, don't depend on how its rows lie.
    """
    rows = sizes.withColumn("part_", F.shiftright(row, 33))
    before = Window.partitionBy(same).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the table
    parts = rows.groupBy(same, "part_").agg(F.count(F.lit(1)).alias("n_")).select(same, "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    turn = F.row_number().over(Window.partitionBy(same, "part_").orderBy(row)) + F.col("before_")
    return rows.join(parts, [same, "part_"]).withColumn("doc_id", F.xxhash64(same, turn)).drop("part_", "before_")


def mix_sizes(
    sizes: DataFrame,
    scratch: str,
    weights: Sequence[float] = (5, 2, 1),
    most: float = MOST_COPIES,
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
    fan_in: int = FAN_IN,
    keep: Sequence[str] = (),
) -> DataFrame:
    """`mix` of doc_id, source and size; the `keep` columns (long) of each row are passed on."""
    spark = sizes.sparkSession
    columns = _COLUMNS + "".join(f", {c} long" for c in keep)
    targets(sizes, scratch, weights, most).write.mode("overwrite").parquet(f"{scratch}/targets")
    per_source = spark.read.parquet(f"{scratch}/targets")
    largest = per_source.agg(F.max("n_rows")).first()[0] or 0

    n_nodes = max(1, -(-largest // bucket_rows))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    own_nodes = F.ceil(F.col("n_rows") / F.lit(bucket_rows))
    rows = (
        sizes.join(per_source, sizes["source"].eqNullSafe(per_source["source"]))
        .select("doc_id", sizes["source"], "size", "source_size", "target", "n_rows", due.alias("due"), *keep)
        .withColumn("left", F.when(F.col("size") > 0, F.col("due") - F.floor("due")).otherwise(F.lit(0.0)))
        .withColumn("level", F.lit(0))
        .withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), own_nodes))
        .drop("n_rows")
    )
    done, level = [], 0
    while True:
        at = f"{scratch}/level_{level}"
        rows.groupBy("source", "node").applyInPandas(_level(level, seed), columns).write.mode("overwrite").parquet(at)
        paired = spark.read.schema(columns).parquet(at)
        whole = (F.col("left") == 0) | (F.col("left") == 1)
        done.append(paired.where(whole))
        rows = paired.where(~whole)
        if n_nodes == 1:
            break
        n_nodes, level = -(-n_nodes // fan_in), level + 1
        rows = rows.withColumn("level", F.lit(level)).withColumn("node", F.floor(F.col("node") / fan_in))
    last = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "doc_id", "source"), F.lit(2**40)) / F.lit(float(2**40))
    done.append(rows.withColumn("left", (last < F.col("left")).cast("double")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.floor("due") + F.col("left").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *keep)
