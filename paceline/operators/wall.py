"""Keeping to the wall: arm lengths, bands, excursions and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scores as S
from . import frames

LEAST_SAMPLES, OUTLIER_SPREAD, FALLBACK_LENGTH, LEAST_EXCURSION = 5, 3.0, 25.0, 0.5
PROBE = 6.0


def floor_anchor(keypoints: Column, box: Sequence[Column], least_score: float) -> Column:
    """struct<x,y>: the middle of the ankles where both are sure enough, else the middle of the box's lower side."""
    left, right = F.get(keypoints, F.lit(15)), F.get(keypoints, F.lit(16))
    sure = (left["score"] >= least_score) & (right["score"] >= least_score)
    ankles = F.struct(((left["x"] + right["x"]) * 0.5).alias("x"), ((left["y"] + right["y"]) * 0.5).alias("y"))
    return F.when(F.coalesce(sure, F.lit(False)), ankles).otherwise(G.box_bottom(*box))


def arm_length(keypoints: Column, box: Sequence[Column], h: Sequence[float], least_score: float) -> Column:
    """Mean shoulder-to-elbow length in map units, by the map's scale at the floor below; null where it can't be told."""

    def scale(at: Column) -> Column:
        points = F.array(*[G.project(at["x"] + dx, at["y"] + dy, h) for dx, dy in ((0.0, 0.0), (PROBE, 0.0), (0.0, PROBE))])
        apart = lambda p, k: F.hypot(F.get(p, F.lit(k))["x"] - F.get(p, F.lit(0))["x"], F.get(p, F.lit(k))["y"] - F.get(p, F.lit(0))["y"]) / PROBE
        return S.let(points, lambda p: F.struct(apart(p, 1).alias("x"), apart(p, 2).alias("y")))

    def length(k: Column) -> Column:
        def side(shoulder: int, elbow: int) -> Column:
            a, b = F.get(keypoints, F.lit(shoulder)), F.get(keypoints, F.lit(elbow))
            sure = (a["score"] >= least_score) & (b["score"] >= least_score) & (k["x"] > 0) & (k["y"] > 0)
            return F.when(sure, F.hypot((b["x"] - a["x"]) * k["x"], (b["y"] - a["y"]) * k["y"]))

        good = lambda v: F.filter(v, lambda x: x > 0)
        return S.let(good(F.array(side(5, 7), side(6, 8))), lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda t, x: t + x) / F.size(v)))

    return S.let(S.let(floor_anchor(keypoints, box, least_score), scale), length)


def robust_lengths(samples: DataFrame, column: str = "length") -> DataFrame:
    """run_id, track_id, length: the median of the samples within three median deviations of the median; null for fewer than five."""
    rows = samples.where(F.col(column).isNotNull() & ~F.isnan(column))
    tracks = rows.groupBy("run_id", "track_id").agg(F.sort_array(F.collect_list(F.col(column).cast("double"))).alias("v_"))  # of one track's frames
    tracks = tracks.withColumn("m_", _middle(F.col("v_")))
    tracks = tracks.withColumn("s_", _middle(F.sort_array(F.transform("v_", lambda v: F.abs(v - F.col("m_"))))))
    tracks = tracks.withColumn("kept_", F.filter("v_", lambda v: (F.col("s_") <= 0) | (F.abs(v - F.col("m_")) <= OUTLIER_SPREAD * F.col("s_"))))
    length = F.when(F.size("v_") < LEAST_SAMPLES, F.lit(None)).when((F.col("s_") <= 0) | (F.size("kept_") < LEAST_SAMPLES), F.col("m_")).otherwise(_middle(F.col("kept_")))
    return tracks.select("run_id", "track_id", length.alias("length"))


def _middle(ranked: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(ranked)
    at = lambda k: F.get(ranked, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def resolved_lengths(chosen: DataFrame, lengths: DataFrame) -> DataFrame:
    """run_id, track_id, length, source: a track's own length, else its team's median, else the constant."""
    rows = chosen.select("run_id", "track_id").join(lengths, ["run_id", "track_id"], "left")
    team = rows.groupBy("run_id").agg(F.median("length").alias("team_"))
    rows = rows.join(team, "run_id")
    source = F.when(F.col("length").isNotNull(), "track_keypoints").when(F.col("team_").isNotNull(), "team_median").otherwise("fallback_constant")
    return rows.select("run_id", "track_id", F.coalesce("length", "team_", F.lit(FALLBACK_LENGTH)).alias("length"), source.alias("source"))


def banded(positions: DataFrame, lengths: DataFrame, boundary: G.Polygon, near: float = 0.0, far: float = 1.0) -> DataFrame:
    """Positions of the chosen tracks with `label` (too_close, too_far, safe) by their distance to the wall."""
    rows = positions.join(lengths.select("run_id", "track_id", "length"), ["run_id", "track_id"])
    return rows.withColumn("label", S.wall_band(G.boundary_distance(F.col("map_x"), F.col("map_y"), boundary), F.col("length"), near, far))


def adherence(rows: DataFrame, fps: float) -> DataFrame:
    """Share of safe frames of each track, and frames and seconds too close and too far."""
    out = rows.groupBy("run_id", "track_id").agg(F.count(F.lit(1)).alias("n_seen"), *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("safe", "too_close", "too_far")])
    seconds = [F.round(F.col(f"n_{x}") / F.lit(fps), 3).alias(f"{x}_sec") for x in ("too_close", "too_far")]
    return out.select("*", (F.col("n_safe") / F.col("n_seen")).alias("score"), *seconds)


def wall_scores(runs: DataFrame, per_track: DataFrame) -> DataFrame:
    means = per_track.groupBy("run_id").agg(F.avg("score").alias("score"))
    return runs.select("run_id").join(means, "run_id", "left").select("run_id", F.coalesce(F.bround("score", 2), F.lit(0.0)).alias("score"))


def excursions(rows: DataFrame, fps: float, least_seconds: float = LEAST_EXCURSION) -> DataFrame:
    """Runs outside the safe band of at least half a second; `n` counts all runs of the track, safe and short ones too."""
    runs = frames.islands(rows, "label").withColumn("n", F.row_number().over(Window.partitionBy("run_id", "track_id").orderBy("start_frame")))
    least = max(1, round(least_seconds * fps))
    out = runs.where((F.col("label") != "safe") & (F.col("n_frames") >= least))
    kind = F.concat(F.lit("wall_"), F.col("label"))
    return out.withColumns({
        "duration_sec": F.round(F.col("n_frames") / F.lit(fps), 3), "type": kind, "flag_id": F.concat_ws("_", kind, F.col("track_id").cast("string"), F.col("n").cast("string")),
        "start_time": S.frame_time(F.col("start_frame"), F.lit(fps)), "end_time": S.frame_time(F.col("end_frame"), F.lit(fps)),
    })


def saved_violations(flags: DataFrame) -> DataFrame:
    """run_id, track_id, seconds, windows (array of start and end, by start) from saved wall flags.

    The track is the flag's own, else read from its id `<type>_<track>_<n>`; swapped
    ends are put right; the duration is the saved one, else end - start.
    """
    wall = flags.where(F.col("type").isin("wall_too_close", "wall_too_far"))
    rest = F.when(F.startswith("flag_id", F.concat(F.col("type"), F.lit("_"))), F.expr("substring(flag_id, length(type) + 2)"))
    parsed = F.expr("try_cast(regexp_extract(rest_, '^(.+)_[^_]*$|^(.+)$', 1) AS INT)")
    rows = wall.withColumn("rest_", rest).withColumn("track_id", F.coalesce(F.col("track_id"), parsed)).where("track_id is not null and start_frame is not null and end_frame is not null")
    seconds = F.coalesce("duration_sec", F.col("end_time") - F.col("start_time"), F.lit(0.0))
    window = F.struct(F.least("start_frame", "end_frame").alias("start_frame"), F.greatest("start_frame", "end_frame").alias("end_frame"))
    return rows.groupBy("run_id", "track_id").agg(F.sum(F.greatest(seconds, F.lit(0.0))).alias("seconds"), F.sort_array(F.collect_list(window)).alias("windows"))


def map_scales(walls: DataFrame) -> DataFrame:
    """run_id, wall_id, scale (pixels per unit), run_scale (their mean by pixel length) and ratio of both.

    `walls`: run_id, wall_id, x1, y1, x2, y2, real_length; walls of no length are left out.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    w = Window.partitionBy("run_id")
    rows = walls.withColumn("px_", length).where("px_ > 0 and real_length > 0").withColumn("scale", F.col("px_") / F.col("real_length"))
    rows = rows.withColumn("run_scale", F.sum(F.col("scale") * F.col("px_")).over(w) / F.sum("px_").over(w))
    return rows.select("run_id", "wall_id", "scale", "run_scale", (F.col("scale") / F.col("run_scale")).alias("ratio"))
