"""Who is who: roles, entry order and the tracks that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Track ids from here on were in the room before the team.
INROOM_FROM = 99


def track_spans(positions: DataFrame) -> DataFrame:
    """n_samples, first_frame, last_frame of each track."""
    return positions.groupBy("run_id", "track_id").agg(F.count(F.lit(1)).alias("n_samples"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def _any(c: F.Column) -> F.Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def inroom_ids(detections: DataFrame) -> DataFrame:
    """run_id, track_id of tracks marked as in the room, or with a late id and no mark at all."""
    marked = _any((F.col("identity_role") == "inroom") | F.col("is_inroom") | (F.col("birth_location") == "inroom")).alias("marked")
    known = _any(F.col("identity_role").isNotNull()).alias("known")
    found = detections.groupBy("run_id", "track_id").agg(marked, known)
    return found.where(F.col("marked") | (~F.col("known") & (F.col("track_id") >= INROOM_FROM))).select("run_id", "track_id")


def entry_ids(detections: DataFrame) -> DataFrame:
    """run_id, track_id of tracks marked as entering."""
    marked = _any((F.col("identity_role") == "entry") | F.col("is_entry") | (F.col("birth_location") == "entry")).alias("marked")
    return detections.groupBy("run_id", "track_id").agg(marked).where("marked").select("run_id", "track_id")


def inferred_roles(detections: DataFrame, inroom_from: int = INROOM_FROM) -> DataFrame:
    """run_id, track_id, role (inroom or entry) for comparisons.

    A track's last known role counts.  In a run without in-room tracks late ids
    are, and in a run without entering tracks all that are not in the room are.
    """
    last = F.max_by("identity_role", F.when(F.col("identity_role").isNotNull(), F.col("frame")))
    role = detections.groupBy("run_id", "track_id").agg(last.alias("role"))
    run = Window.partitionBy("run_id")
    some_inroom = F.coalesce(F.bool_or(F.col("role") == "inroom").over(run), F.lit(False))
    placed = role.withColumn("inroom", F.when(some_inroom, F.coalesce(F.col("role") == "inroom", F.lit(False))).otherwise(F.col("track_id") >= inroom_from))
    some_entry = F.coalesce(F.bool_or((F.col("role") == "entry") & ~F.col("inroom")).over(run), F.lit(False))
    placed = placed.withColumn("entry", F.when(some_entry, F.coalesce(F.col("role") == "entry", F.lit(False)) & ~F.col("inroom")).otherwise(~F.col("inroom")))
    return placed.where("inroom or entry").select("run_id", "track_id", F.when(F.col("inroom"), "inroom").otherwise("entry").alias("role"))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of tracks that `ids` does not hold."""
    return rows.join(ids.select("run_id", "track_id"), ["run_id", "track_id"], "left_anti")


def first_frame(detections: DataFrame, ids: DataFrame) -> DataFrame:
    """run_id, first_frame: the first frame with any of the tracks."""
    return detections.join(ids, ["run_id", "track_id"], "left_semi").groupBy("run_id").agg(F.min("frame").alias("first_frame"))


def drill_start(detections: DataFrame) -> DataFrame:
    """run_id, start_frame: the first frame with a track that enters."""
    entering = F.col("is_entry") | (F.col("birth_location") == "entry")
    return detections.where(entering).groupBy("run_id").agg(F.min("frame").alias("start_frame"))


def entrants(positions: DataFrame, inroom: DataFrame | None = None, team: int = 0) -> DataFrame:
    """run_id, track_id, n_samples, first_frame, last_frame, entry_number of the tracks that count.

    The `team` tracks with most samples (then the earliest, then by id; all for 0
    or less), numbered by their first frame, then by id.
    """
    spans = track_spans(positions if inroom is None else without(positions, inroom))
    if team > 0:
        longest = Window.partitionBy("run_id").orderBy(F.desc("n_samples"), "first_frame", "track_id")
        spans = spans.withColumn("place_", F.row_number().over(longest)).where(F.col("place_") <= team).drop("place_")
    return spans.withColumn("entry_number", F.row_number().over(Window.partitionBy("run_id").orderBy("first_frame", "track_id")))


def hit_streaks(rows: DataFrame) -> DataFrame:
    """`rows` with hits: how often a track was seen again without a miss up to each frame.

    The frame in which a track is born is no hit; after a missing frame the count begins anew at 1.
    """
    w = Window.partitionBy("run_id", "track_id").orderBy("frame")
    spans = rows.withColumn("span_", F.col("frame") - F.row_number().over(w)).withColumn("born_", F.min("span_").over(Window.partitionBy("run_id", "track_id")))
    n = F.row_number().over(Window.partitionBy("run_id", "track_id", "span_").orderBy("frame"))
    return spans.withColumn("hits", n - (F.col("span_") == F.col("born_")).cast("int")).drop("span_", "born_")


def confirmed_roles(births: DataFrame, interior_frames: int = 3, least_hits: int = 3) -> DataFrame:
    """run_id, track_id, role, locked_frame, first_output.

    As `role_evidence`, but a track is `inroom` only in a frame with `least_hits` hits.
    One without a proven role is a candidate by where it was born (entry_candidate,
    inroom_candidate), else unknown.  `first_output` is the first frame with that many
    hits from the one on in which the role is proven.
    """
    rows = hit_streaks(births)
    proven = role_evidence(rows, interior_frames, F.col("hits") >= least_hits)
    born = rows.groupBy("run_id", "track_id").agg(F.min_by("location", "frame").alias("born_"))
    out = rows.select("run_id", "track_id", "frame", "hits").join(proven.select("run_id", "track_id", "locked_frame"), ["run_id", "track_id"]).where((F.col("frame") >= F.col("locked_frame")) & (F.col("hits") >= least_hits))
    first = out.groupBy("run_id", "track_id").agg(F.min("frame").alias("first_output"))
    candidate = F.when(F.col("born_") == "entry", "entry_candidate").when(F.col("born_") == "interior", "inroom_candidate").otherwise("unknown")
    rows = proven.join(born, ["run_id", "track_id"]).join(first, ["run_id", "track_id"], "left")
    return rows.select("run_id", "track_id", F.coalesce("role", candidate).alias("role"), "locked_frame", "first_output")


def role_evidence(births: DataFrame, interior_frames: int = 10, confirmed: Column | None = None) -> DataFrame:
    """Frames of each track in entry, buffer and interior, longest interior streak, and the role they prove.

    `births` has run_id, track_id, frame, location.  A track becomes `entry` at its
    first frame in an entry, or `inroom` once interior_frames interior frames
    follow each other and none before was in an entry or its buffer; the first to
    hold counts, and neither leaves role and locked_frame null.  `confirmed` is what
    else must hold in the frame that makes a track `inroom`.
    """
    w = Window.partitionBy("run_id", "track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    near = F.col("location").isin("entry", "entry_buffer").cast("int")
    inside = F.col("location") == "interior"
    rows = births.withColumn("near_", F.sum(near).over(w)).withColumn("breaks_", F.sum((~inside).cast("int")).over(w))
    streak = Window.partitionBy("run_id", "track_id", "breaks_").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak_", F.sum(inside.cast("int")).over(streak))
    out = rows.groupBy("run_id", "track_id").agg(
        F.count_if(F.col("location") == "entry").alias("n_entry"),
        F.count_if(F.col("location") == "entry_buffer").alias("n_buffer"),
        F.count_if(inside).alias("n_interior"),
        F.max("streak_").alias("longest_interior"),
        F.min(F.when(F.col("location") == "entry", F.col("frame"))).alias("entry_at"),
        F.min(F.when((F.col("streak_") >= interior_frames) & (F.col("near_") == 0) & (F.lit(True) if confirmed is None else confirmed), F.col("frame"))).alias("inroom_at"),
    )
    first = F.least("entry_at", "inroom_at")
    role = F.when(first == F.col("entry_at"), "entry").when(first == F.col("inroom_at"), "inroom")
    return out.select("run_id", "track_id", "n_entry", "n_buffer", "n_interior", "longest_interior", role.alias("role"), first.alias("locked_frame"))
