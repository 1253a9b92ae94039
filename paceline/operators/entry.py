"""Entering the room: gaps, directions, doors and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scores as S
from ..plans.rooms import Door, Room

VECTOR_SECONDS = 2.0


def door_of(x: Column, y: Column, doors: Sequence[Door]) -> Column:
    """Index of the first door whose polygon holds the point, else of the nearest by centre; null without doors or point."""
    if not doors:
        return F.lit(None).cast("int")
    ranked = []
    for k, d in enumerate(doors):
        inside = G.point_in_polygon(x, y, d.polygon)
        dx, dy = x - F.lit(d.centre[0]), y - F.lit(d.centre[1])
        ranked.append(F.struct((~inside).cast("int").alias("out"), F.when(inside, F.lit(0.0)).otherwise(dx * dx + dy * dy).alias("d"), F.lit(k).alias("k")))
    return F.when(x.isNotNull() & y.isNotNull(), F.array_min(F.array(*ranked))["k"])


def entry_points(positions: DataFrame, doors: Sequence[Door]) -> DataFrame:
    """run_id, track_id, entry_frame: the first frame inside any door, else the first frame."""
    inside = F.lit(False)
    for d in doors:
        inside = inside | G.point_in_polygon(F.col("map_x"), F.col("map_y"), d.polygon)
    first_inside = F.min(F.when(inside, F.col("frame")))
    return positions.groupBy("run_id", "track_id").agg(F.coalesce(first_inside, F.min("frame")).alias("entry_frame"))


def entry_vectors(positions: DataFrame, chosen: DataFrame, room: Room, seconds: float = VECTOR_SECONDS) -> DataFrame:
    """One row for each chosen track (`entrants`): entry point, fitted step over `seconds`, door and side.

    The velocity is the least-squares slope of the positions over the window that
    begins at the entry frame; side A or B is the way in that it points along more.
    """
    doors, frames = room.axes(), max(2, round(seconds * room.fps))
    at = entry_points(positions, doors)
    rows = positions.join(at, ["run_id", "track_id"]).where((F.col("frame") >= F.col("entry_frame")) & (F.col("frame") < F.col("entry_frame") + frames))
    t = (F.col("frame") - F.col("entry_frame")) / F.lit(float(room.fps))
    fits = rows.groupBy("run_id", "track_id").agg(
        F.min("entry_frame").alias("start_frame"),
        F.min_by("map_x", "frame").alias("start_x"),
        F.min_by("map_y", "frame").alias("start_y"),
        F.count(F.lit(1)).alias("n_fit"),
        (F.regr_slope("map_x", t) * seconds).alias("dx"),
        (F.regr_slope("map_y", t) * seconds).alias("dy"),
    )
    fits = fits.join(chosen.select("run_id", "track_id", "entry_number"), ["run_id", "track_id"])
    door = door_of(F.col("start_x"), F.col("start_y"), doors)
    fits = fits.withColumn("door_index", F.coalesce(door, F.lit(-1))).withColumn("door_type", F.get(F.array(*[F.lit(d.kind) for d in doors]), door) if doors else F.lit(None).cast("string"))
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    along_a = F.get(F.array(*[(F.col("dx") * d.p_a[0] + F.col("dy") * d.p_a[1]) / n for d in doors]), F.col("door_index")) if doors else F.lit(None).cast("double")
    along_b = F.get(F.array(*[(F.col("dx") * d.p_b[0] + F.col("dy") * d.p_b[1]) / n for d in doors]), F.col("door_index")) if doors else F.lit(None).cast("double")
    # an exact tie of the projections is an A; sums of the same numbers may differ in the last digit
    sign = F.when((F.col("door_index") < 0) | n.isNull() | (n <= 1e-9), 0).when(along_a >= along_b, 1).otherwise(-1)
    return fits.withColumn("sign", sign).withColumn("side", F.when(F.col("sign") > 0, "A").when(F.col("sign") < 0, "B").otherwise("UNKNOWN")).withColumn("start_time", S.frame_time(F.col("start_frame"), F.lit(room.fps)))


def pair_gaps(chosen: DataFrame, room: Room) -> DataFrame:
    """Gap, allowance, score and violation between successive entrants."""
    w = Window.partitionBy("run_id").orderBy("entry_number")
    rows = chosen.select(
        "run_id", F.lag("entry_number").over(w).alias("from_entry"), F.col("entry_number").alias("to_entry"), F.lag("track_id").over(w).alias("from_track"), F.col("track_id").alias("to_track"),
        F.lag("first_frame").over(w).alias("from_frame"), F.col("first_frame").alias("to_frame"),
    ).where("from_entry is not null")
    gap = (F.col("to_frame") - F.col("from_frame")) / F.lit(room.fps)
    allowed = S.allowed_gap(F.col("pair_number"), room.hesitation_threshold, room.hesitation_second)
    rows = rows.withColumn("pair_number", F.col("from_entry")).withColumn("gap_sec", gap).withColumn("allowed_sec", allowed)
    return rows.withColumn("score", S.hesitation(F.col("gap_sec"), F.col("allowed_sec"))).withColumn("violation", F.col("gap_sec") > F.col("allowed_sec"))


def hesitation_scores(runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """run_id, score: the mean of the pair scores; -1 with fewer than two entrants."""
    means = gaps.groupBy("run_id").agg(F.avg("score").alias("score"))
    return runs.select("run_id").join(means, "run_id", "left").select("run_id", F.coalesce(F.round("score", 2), F.lit(-1.0)).alias("score"))


def total_entry(chosen: DataFrame, room: Room) -> DataFrame:
    """Span from the first to the last entrant against the sum of the allowed gaps; one row per run."""
    spans = chosen.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_entries"), F.min("first_frame").alias("start_frame"), F.max("first_frame").alias("end_frame"))
    second = 2 * room.hesitation_threshold if room.hesitation_second is None else room.hesitation_second
    pairs = F.col("n_entries") - 1
    limit = F.when(pairs <= 0, 0.0).otherwise(pairs * room.hesitation_threshold + F.when(pairs >= 2, second - room.hesitation_threshold).otherwise(0.0))
    rows = spans.withColumn("duration_sec", (F.col("end_frame") - F.col("start_frame")) / F.lit(room.fps)).withColumn("limit_sec", limit)
    over = F.col("duration_sec") - F.col("limit_sec")
    score = F.when(F.col("n_entries") < 2, 0.0).when(over <= 0, 1.0).otherwise(F.round(S.time_penalty(over, F.col("limit_sec")), 2))
    return rows.withColumn("score", score).withColumn("violation", (F.col("n_entries") >= 2) & (over > 0))


def vector_transitions(vectors: DataFrame, by_door: bool = False) -> DataFrame:
    """Successive entrants with a known side (of the same door where asked) and whether the side changed."""
    w = Window.partitionBy("run_id", *(["door_index"] if by_door else [])).orderBy("entry_number")
    rows = vectors.where("sign <> 0").select(
        "run_id", "door_index", F.lag("entry_number").over(w).alias("from_entry"), F.col("entry_number").alias("to_entry"), F.lag("sign").over(w).alias("from_sign"), F.col("sign").alias("to_sign"),
        F.lag("start_frame").over(w).alias("start_frame"), F.col("start_frame").alias("end_frame"), F.row_number().over(w).alias("n_"),
    )
    return rows.where("from_entry is not null").withColumn("transition_number", F.col("n_") - 1).withColumn("alternates", F.col("from_sign") != F.col("to_sign")).drop("n_")


def vector_scores(runs: DataFrame, transitions: DataFrame) -> DataFrame:
    """run_id, score: the share of transitions that alternate; -1 without any."""
    shares = transitions.groupBy("run_id").agg(F.avg(F.col("alternates").cast("int")).alias("score"))
    return runs.select("run_id").join(shares, "run_id", "left").select("run_id", F.coalesce(F.bround("score", 2), F.lit(-1.0)).alias("score"))


def entry_flags(vectors: DataFrame, transitions: DataFrame, gaps: DataFrame, total: DataFrame, chosen: DataFrame, room: Room) -> DataFrame:
    """Flags of the four entry rules: run_id, flag_id, type, severity, frame, end_frame, entry_number, track_id, message."""
    none_int, fps = F.lit(None).cast("int"), room.fps
    unknown = vectors.where("sign = 0").join(chosen.select("run_id", "track_id", F.col("first_frame").alias("seen")), ["run_id", "track_id"]).select(
        "run_id", F.concat(F.lit("entrance_vector_unknown_"), F.col("entry_number").cast("string")).alias("flag_id"), F.lit("vector_unknown").alias("type"), F.col("seen").alias("frame"), none_int.alias("end_frame"),
        "entry_number", "track_id", F.format_string("Entry %d moved too little to tell its direction.", "entry_number").alias("message"),
    )
    same_side = transitions.where("not alternates").select(
        "run_id", F.concat(F.lit("entrance_vector_direction_violation_"), F.col("transition_number").cast("string")).alias("flag_id"), F.lit("vector_direction_violation").alias("type"), F.col("start_frame").alias("frame"), "end_frame",
        none_int.alias("entry_number"), none_int.alias("track_id"), F.format_string("Entry %d went the same way as entry %d.", "to_entry", "from_entry").alias("message"),
    )
    late = gaps.where("violation").select(
        "run_id", F.concat(F.lit("entrance_pair_time_violation_"), F.col("pair_number").cast("string")).alias("flag_id"), F.lit("pair_time_violation").alias("type"), F.col("from_frame").alias("frame"), F.col("to_frame").alias("end_frame"),
        none_int.alias("entry_number"), none_int.alias("track_id"), F.format_string("Entry %d came %.2fs after entry %d; %.2fs are allowed.", "to_entry", "gap_sec", "from_entry", "allowed_sec").alias("message"),
    )
    long = total.where("violation").select(
        "run_id", F.lit("entrance_total_entry_time_violation").alias("flag_id"), F.lit("total_entry_time_violation").alias("type"), F.col("start_frame").alias("frame"), "end_frame",
        none_int.alias("entry_number"), none_int.alias("track_id"), F.format_string("The team took %.2fs to enter; %.2fs are allowed.", "duration_sec", "limit_sec").alias("message"),
    )
    out = unknown.unionByName(same_side).unionByName(late).unionByName(long)
    return out.withColumn("severity", F.lit("warning")).withColumn("time_sec", S.frame_time(F.col("frame"), F.lit(fps)))


def ordered_flags(flags: DataFrame) -> DataFrame:
    """Unique flags of each run with their place by frame (unknown last), type and id."""
    w = Window.partitionBy("run_id").orderBy(F.coalesce("frame", F.lit(10**9)), "type", "flag_id")
    return flags.dropDuplicates(["run_id", "flag_id"]).withColumn("place", F.row_number().over(w))
