"""Row-wise and per-track operators over detections and positions.

All take tables keyed by run_id, track_id and frame (from 1); missing frames are
missing rows.  Windows run over one track of one run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("run_id", "track_id")


def track_window(*more: str) -> Window:
    return Window.partitionBy(*KEY, *more).orderBy("frame")


def finite_points(rows: DataFrame, x: str = "map_x", y: str = "map_y") -> DataFrame:
    """Rows whose point is known and finite."""
    ok = F.lit(True)
    for c in (F.col(x), F.col(y)):
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return rows.where(ok)


def usable_boxes(rows: DataFrame, least_score: float, width: float, height: float) -> DataFrame:
    """Boxes above a score, with sides over one pixel, that don't cover the whole picture."""
    whole = (F.col("x1") <= 0) & (F.col("y1") <= 0) & (F.col("x2") >= width) & (F.col("y2") >= height)
    return rows.where((F.col("confidence") > least_score) & (F.col("x2") - F.col("x1") > 1) & (F.col("y2") - F.col("y1") > 1) & ~whole)


def mean_score(keypoints: Column) -> Column:
    return F.aggregate(keypoints, F.lit(0.0), lambda a, p: a + p["score"]) / F.size(keypoints)


def confidence_class(rows: DataFrame, threshold: float, keypoint_threshold: float | None = None, low: float = 0.1) -> DataFrame:
    """`part`: primary above the threshold, secondary between `low` and it, else null; both need good keypoints where a threshold is given."""
    good = F.lit(True) if keypoint_threshold is None else F.coalesce(mean_score(F.col("keypoints")) > keypoint_threshold, F.lit(False))
    c = F.col("confidence")
    return rows.withColumn("part", F.when(good & (c > threshold), "primary").when(good & (c > low) & (c < threshold), "secondary"))


def weak_keypoints_zeroed(keypoints: Column, threshold: float) -> Column:
    """Scores below the threshold become 0; the places stay."""
    return F.transform(keypoints, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(p["score"] < threshold, F.lit(0.0)).otherwise(p["score"]).alias("score")))


def missing_keypoints_zeroed(keypoints: Column) -> Column:
    """Points at (0, 0) with a score below 0.5 become all 0."""
    bad = lambda p: (p["x"] == 0) & (p["y"] == 0) & (p["score"] < 0.5)
    return F.transform(keypoints, lambda p: F.struct(*[F.when(bad(p), F.lit(0.0)).otherwise(p[c]).alias(c) for c in ("x", "y", "score")]))


def quantized(keypoints: Column) -> Column:
    return F.transform(keypoints, lambda p: F.struct(F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"), F.round(p["score"], 3).alias("score")))


def islands(rows: DataFrame, label: str | None = None) -> DataFrame:
    """start_frame, end_frame, n_frames of each run of consecutive frames (of equal `label`) of each track."""
    by = [*KEY, *([label] if label else [])]
    placed = rows.withColumn("island_", F.col("frame") - F.row_number().over(Window.partitionBy(*by).orderBy("frame")))
    return placed.groupBy(*by, "island_").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_frames")).drop("island_")


def interpolated(rows: DataFrame, interval: int = 20, columns: Sequence[str] = ("map_x", "map_y")) -> DataFrame:
    """Gaps of fewer than `interval` frames filled on straight lines."""
    w = track_window()
    nexts = [F.lead(c).over(w).alias(f"next_{c}") for c in columns]
    ahead = rows.select(*KEY, "frame", *columns, F.lead("frame").over(w).alias("next_frame"), *nexts)
    gap = F.col("next_frame") - F.col("frame")
    last = F.when((gap > 1) & (gap < interval), F.col("next_frame") - 1).otherwise(F.col("frame"))
    filled = ahead.withColumn("at", F.explode(F.sequence(F.col("frame"), last)))
    share = (F.col("at") - F.col("frame")) / gap
    values = [F.when(F.col("at") == F.col("frame"), F.col(c)).otherwise(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * share).alias(c) for c in columns]
    return filled.select(*KEY, F.col("at").alias("frame"), *values, (F.col("at") != F.col("frame")).alias("filled"))


def without_repeats(rows: DataFrame) -> DataFrame:
    """Rows whose whole-number position differs from the one before."""
    w = track_window()
    here = F.struct(F.col("map_x").cast("int"), F.col("map_y").cast("int"))
    return rows.withColumn("before_", F.lag(here).over(w)).where(F.col("before_").isNull() | (F.col("before_") != here)).drop("before_")


def map_velocity(rows: DataFrame) -> DataFrame:
    """vx, vy: the unit step from the position before (null at first, 0 where nothing moved)."""
    w = track_window()
    dx, dy = F.col("map_x") - F.lag("map_x").over(w), F.col("map_y") - F.lag("map_y").over(w)
    n = F.sqrt(dx * dx + dy * dy)
    return rows.withColumns({"vx": F.when(n > 0, dx / n).when(n == 0, 0.0), "vy": F.when(n > 0, dy / n).when(n == 0, 0.0)})


def steady_velocity(rows: DataFrame, k: int = 3) -> DataFrame:
    """vx, vy: mean step over the last k frames where all k were seen, else null."""
    w = track_window()
    whole = F.col("frame") - F.lag("frame", k - 1).over(w) == k - 1
    return rows.withColumns({v: F.when(whole, (F.col(c) - F.lag(c, k - 1).over(w)) / (k - 1)) for v, c in (("vx", "map_x"), ("vy", "map_y"))})


def trail(rows: DataFrame) -> DataFrame:
    """Segments from each track's last seen position to the present one."""
    w = track_window()
    out = rows.select(*KEY, "frame", F.lag("frame").over(w).alias("from_frame"), F.lag("map_x").over(w).alias("from_x"), F.lag("map_y").over(w).alias("from_y"), F.col("map_x").alias("to_x"), F.col("map_y").alias("to_y"))
    return out.where("from_frame is not null")


def dense(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """One row for every frame of a run (`totals`: run_id, total_frames) and track; null where it was not seen."""
    tracks = rows.select(*KEY).distinct().join(totals, "run_id")
    frames = tracks.select(*KEY, F.explode(F.sequence(F.lit(1), F.col("total_frames").cast("int"))).alias("frame"))
    return frames.join(rows, [*KEY, "frame"], "left")


#: Frames of a track that `smoothed` handles at a time.
PART = 256


def smoothed(rows: DataFrame, low: float = 0.1, high: float = 0.3, threshold: float = 5.0) -> DataFrame:
    """Adaptive exponential smoothing of each track's positions.

    The weight of a new position falls from `high` to `low` as the step grows.
    Each position needs the smoothed one before, so a track is a fold over its
    positions; it goes in parts of PART frames, so that the growing result is copied
    once a part.
    """
    point = F.struct("frame", F.col("map_x").cast("double").alias("x"), F.col("map_y").cast("double").alias("y"))
    parts = rows.groupBy(*KEY, F.floor(F.col("frame") / PART).alias("part_")).agg(F.sort_array(F.collect_list(point)).alias("points_"))
    tracks = parts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("part_", "points_"))).alias("parts_"))
    done = "array<struct<frame:int,x:double,y:double>>"

    def step(out: Column, p: Column, before: Column) -> Column:
        last = F.coalesce(F.try_element_at(out, F.lit(-1)), F.try_element_at(before, F.lit(-1)), p)
        weight = F.least(F.lit(high), F.greatest(F.lit(low), 1 - F.hypot(p["x"] - last["x"], p["y"] - last["y"]) / threshold))
        mixed = lambda c: weight * p[c] + (1 - weight) * last[c]
        return F.concat(out, F.array(F.struct(p["frame"].cast("int").alias("frame"), mixed("x").alias("x"), mixed("y").alias("y"))))

    def part(out: Column, q: Column) -> Column:
        return F.concat(out, F.aggregate(q["points_"], F.array().cast(done), lambda own, p: step(own, p, out)))

    smooth = F.aggregate("parts_", F.array().cast(done), part)
    return tracks.select(*KEY, F.explode(smooth).alias("p_")).select(*KEY, "p_.frame", F.col("p_.x").alias("map_x"), F.col("p_.y").alias("map_y"))


def gaussian_smoothed(rows: DataFrame, tau: float = 10.0) -> DataFrame:
    """Positions of each track smoothed by a Gaussian process (RBF kernel, unit noise).

    The length scale follows from the size n of the track: tau * ln(tau^3 / n),
    within 1/tau and tau^2.  A track is solved whole.  The kernel falls to nothing a
    few length scales away, so the equations are a band; from tau^3 rows on they are
    one by one.
    """

    def run(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("frame")
        t, v = track["frame"].to_numpy(float), track[["map_x", "map_y"]].to_numpy(float)
        n = len(t)
        scale = float(np.clip(tau * np.log(tau**3 / n), 1 / tau, tau**2))
        mean = v.mean(0)
        out = _solved(t, v - mean, scale) + mean
        return track.assign(map_x=out[:, 0], map_y=out[:, 1])

    rows = rows.select(*KEY, "frame", "map_x", "map_y")
    return rows.groupBy(*KEY).applyInPandas(run, rows.schema)


def _solved(t: np.ndarray, v: np.ndarray, scale: float, block: int = 256) -> np.ndarray:
    """K (K + I)^-1 v for the kernel K of ascending times.

    Blocks of rows are as long as the kernel reaches (1e-17 of its height), so each
    meets only its neighbours and the system is solved block by block, exactly.
    """
    reach = 8.9 * scale
    cuts = [0]
    while cuts[-1] < len(t):
        a = cuts[-1]
        cuts.append(max(min(len(t), a + block), int(np.searchsorted(t, t[a] + reach, "right"))))
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    kernel = lambda a, b: np.exp(-((t[a, None] - t[None, b]) ** 2) / (2 * scale**2))
    pivots, rest = [], []
    for k, p in enumerate(parts):  # block elimination
        own, right = kernel(p, p) + np.eye(p.stop - p.start), v[p].copy()
        if k:
            side = kernel(p, parts[k - 1])
            own -= side @ np.linalg.solve(pivots[-1], side.T)
            right -= side @ np.linalg.solve(pivots[-1], rest[-1])
        pivots.append(own)
        rest.append(right)
    x = np.empty_like(v)
    for k in range(len(parts) - 1, -1, -1):
        right = rest[k]
        if k + 1 < len(parts):
            right = right - kernel(parts[k], parts[k + 1]) @ x[parts[k + 1]]
        x[parts[k]] = np.linalg.solve(pivots[k], right)
    return v - x  # K (K + I)^-1 = I - (K + I)^-1
