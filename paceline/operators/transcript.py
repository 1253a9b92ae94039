"""Transcripts: cleaning, scores, and the window of a drill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

GRACE_SECONDS, LEAST_ALIGNMENT = 0.5, 0.4


def cleaned(segments: DataFrame, offset: float = 0.0) -> DataFrame:
    """Segments with ordered ends, trimmed text and words, all shifted by `offset` seconds."""

    def word(w: Column) -> Column:
        a, b = F.least(w["start"], w["end"]), F.greatest(w["start"], w["end"])
        return F.struct(F.trim(w["word"]).alias("word"), (a + offset).alias("start"), (b + offset).alias("end"), w["score"].alias("score"))

    return segments.withColumns({
        "start": F.least("start", "end") + offset, "end": F.greatest("start", "end") + offset,
        "text": F.trim("text"), "words": F.transform("words", word),
    })


def mean_score(words: Column) -> Column:
    """Mean of the known word scores, null without any."""
    known = F.filter(F.transform(words, lambda w: w["score"]), lambda s: s.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.size(known))


def drill_windows(runs: DataFrame, segments: DataFrame, required: Sequence[str], least_score: float = LEAST_ALIGNMENT, grace: float = GRACE_SECONDS) -> DataFrame:
    """The window of every run: run_id, start_frame, end_frame, end_uncertain, reason, matched_id.

    `runs`: run_id, drill_start (null: nobody entered), total_frames, fps.
    Candidates are the segments from the drill's start on that have all required
    words; the latest with a good enough alignment (or none known) ends the drill,
    else the latest of all.
    """
    fps = S.usable_fps(F.col("fps"))
    start = F.greatest(F.col("drill_start"), F.lit(1))
    said = segments.join(runs.select("run_id", "drill_start", "fps"), "run_id")
    said = said.where(F.col("start") >= (start - 1) / fps).where(S.has_all(S.tokens(F.coalesce("text", F.lit(""))), required)).withColumn("score_", mean_score(F.col("words")))
    passes = F.col("score_").isNull() | (F.col("score_") >= least_score)
    entry = F.struct(F.coalesce("end", "start").alias("end"), F.col("id"))
    best = said.groupBy("run_id").agg(F.max_by(entry, F.when(passes, F.col("id"))).alias("good_"), F.max_by(entry, "id").alias("any_"))
    spoken = segments.select("run_id").distinct().withColumn("spoken_", F.lit(True))
    rows = runs.join(best, "run_id", "left").join(spoken, "run_id", "left")
    chosen = F.coalesce("good_", "any_")
    entered = F.col("drill_start").isNotNull()
    reason = (
        F.when(~entered, "no_entry_detected").when(F.col("spoken_").isNull(), "no_transcription_available").when(chosen.isNull(), "no_clearance_phrase_found")
        .when(F.col("good_").isNotNull(), "selected_latest_passing_score_gate").otherwise("selected_latest_below_score_gate")
    )
    total = F.greatest(F.col("total_frames"), F.lit(1))
    end = F.greatest(start, F.least(total, F.bround((chosen["end"] + max(0.0, grace)) * fps).cast("int")))
    sure = entered & chosen.isNotNull()
    return rows.select(
        "run_id", F.when(entered, start).otherwise(1).cast("int").alias("start_frame"), F.when(sure, end).otherwise(total).cast("int").alias("end_frame"), (~sure).alias("end_uncertain"), reason.alias("reason"), F.when(sure, chosen["id"]).alias("matched_id"),
    )


def active_lines(times: DataFrame, segments: DataFrame) -> DataFrame:
    """run_id, t, id: the last segment that began by t, if it has not ended; null else.

    Times and segment starts of a run are put in one order and the last start is carried along.
    """
    a = segments.select("run_id", F.col("start").alias("at_"), F.lit(0).alias("kind_"), F.struct("id", F.col("end").alias("end")).alias("line_"))
    b = times.select("run_id", F.col("t").alias("at_"), F.lit(1).alias("kind_"), F.lit(None).cast(a.schema["line_"].dataType).alias("line_"))
    w = Window.partitionBy("run_id").orderBy("at_", "kind_", F.col("line_.id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("last_", F.last("line_", ignorenulls=True).over(w)).where("kind_ = 1")
    return rows.select("run_id", F.col("at_").alias("t"), F.when(F.col("last_.end") >= F.col("at_"), F.col("last_.id")).alias("id"))
