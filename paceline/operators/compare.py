"""Trainee against reference runs, by a pair table (pair_id, run_a: trainee, run_b: reference).

Per-run tables are joined twice; the sides meet in a full outer join on
(pair_id, key), so what only one side has stays with nulls on the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def sides(pairs: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """pair_id, keys, value_a, value_b: a per-run table of both runs of every pair."""

    def one(run: str, end: str) -> DataFrame:
        rows = pairs.select("pair_id", F.col(run).alias("run_id")).join(table, "run_id")
        return rows.select("pair_id", *keys, *[F.col(v).alias(f"{v}_{end}") for v in values])

    return one("run_a", "a").join(one("run_b", "b"), ["pair_id", *keys], "full")


def timing(delta: Column, tolerance: float = 0.0, same: str = "MATCH") -> Column:
    """FASTER, SLOWER, the same, or N/A for a missing side."""
    return F.when(delta.isNull(), "N/A").when(F.abs(delta) <= tolerance, same).when(delta < 0, "FASTER").otherwise("SLOWER")


def hesitation(pairs: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gap and score differences of each pair of entrants, and the trend."""
    rows = sides(pairs, gaps.select("run_id", "pair_number", "gap_sec", "score"), ["pair_number"], ["gap_sec", "score"])
    delta = F.col("gap_sec_a") - F.col("gap_sec_b")
    return rows.withColumns({"gap_delta": delta, "score_delta": F.col("score_a") - F.col("score_b"), "trend": timing(delta)})


def vectors(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Sides of each entry number and whether they match."""
    rows = sides(pairs, table.select("run_id", "entry_number", "sign"), ["entry_number"], ["sign"])
    known = (F.col("sign_a") != 0) & (F.col("sign_b") != 0)
    return rows.withColumn("match", F.when(known, F.col("sign_a") == F.col("sign_b")))


def total_entry(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Spans, limits and scores of both runs and their differences (spans in seconds of each run's own frame rate)."""
    rows = sides(pairs, totals, [], ["duration_sec", "limit_sec", "score"])
    return rows.withColumns({"duration_delta": F.col("duration_sec_a") - F.col("duration_sec_b"), "score_delta": F.col("score_a") - F.col("score_b")})


def walls(pairs: DataFrame, adherence: DataFrame, chosen: DataFrame) -> DataFrame:
    """Wall scores and seconds outside the band by entry number, with verdicts."""
    table = adherence.join(chosen.select("run_id", "track_id", "entry_number"), ["run_id", "track_id"]).withColumn("outside_sec", F.col("too_close_sec") + F.col("too_far_sec"))
    rows = sides(pairs, table, ["entry_number"], ["score", "outside_sec"])
    score, seconds = F.col("score_a") - F.col("score_b"), F.col("outside_sec_a") - F.col("outside_sec_b")
    return rows.withColumns({"score_verdict": F.when(score.isNull(), "N/A").otherwise(S.verdict(score, 0.01)), "time_verdict": F.when(seconds.isNull(), "N/A").otherwise(S.verdict(-seconds, 0.10))})


def captures(pairs: DataFrame, captured: DataFrame) -> DataFrame:
    """Capture times of each pod on both sides, and which side took it."""
    rows = sides(pairs, captured, ["pod_idx"], ["assigned_id", "capture_time_sec"])
    a, b = F.col("capture_time_sec_a"), F.col("capture_time_sec_b")
    took = F.when(a.isNotNull() & b.isNotNull(), "BOTH").when(a.isNotNull(), "TRAINEE").when(b.isNotNull(), "REFERENCE").otherwise("NONE")
    return rows.withColumns({"time_delta": a - b, "captured": took})


def clearance(pairs: DataFrame, cleared: DataFrame, starts: DataFrame, fps: float, tolerance: float = 0.25) -> DataFrame:
    """Seconds from the team's entry to each clearance on both sides; `starts`: run_id, first_frame."""
    table = cleared.join(starts, "run_id", "left").withColumn("clear_sec", (F.col("end_frame") - F.col("first_frame")) / F.lit(fps))
    rows = sides(pairs, table, ["inroom_id"], ["clear_sec"])
    delta = F.col("clear_sec_a") - F.col("clear_sec_b")
    return rows.withColumns({"delta": delta, "trend": timing(delta, tolerance, "SIMILAR")})


def scores(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Both runs' scores of every metric, the difference, its band and a sentence."""
    rows = sides(pairs, metrics, ["metric"], ["score"])
    a, b = F.col("score_a"), F.col("score_b")
    return rows.withColumns({"delta": a - b, "band": S.relative_band(a, b), "sentence": S.comparison_sentence(a, b)})


def compared_team(counts_a: Column, counts_b: Column, team: int = 0) -> Column:
    """How many entrants to compare: the team's size, else the smaller count, else the larger where one is 0."""
    if team > 0:
        return F.lit(team)
    low = F.least(counts_a, counts_b)
    return F.when(low > 0, low).otherwise(F.greatest(counts_a, counts_b))


def clipped(pairs: DataFrame, curve: DataFrame) -> DataFrame:
    """pair_id, side, t, value: both curves (run_id, t, value) up to the end of the shorter one."""
    rows = pairs.select("pair_id", F.lit("a").alias("side"), F.col("run_a").alias("run_id")).unionByName(pairs.select("pair_id", F.lit("b").alias("side"), F.col("run_b").alias("run_id"))).join(curve, "run_id")
    ends = rows.groupBy("pair_id", "side").agg(F.max("t").alias("e_")).groupBy("pair_id").agg(F.min("e_").alias("end_"))
    return rows.join(ends, "pair_id").where(F.col("t") <= F.col("end_")).select("pair_id", "side", "t", "value")


def capture_times(pairs: DataFrame, captured: DataFrame, limits: Sequence[float]) -> DataFrame:
    """Capture time and score of each pod on both sides, their differences, the trend, and which side lacks a time."""
    limit = F.coalesce(F.try_element_at(F.array(*[F.lit(float(x)) for x in limits]), F.col("pod_idx") + 1), F.lit(float(limits[-1])))
    rows = sides(pairs, captured, ["pod_idx"], ["assigned_id", "capture_time_sec"]).withColumn("limit_sec", limit)
    for end in "ab":
        time = F.col(f"capture_time_sec_{end}")
        rows = rows.withColumn(f"score_{end}", F.when(time.isNull(), 0.0).when(time <= F.col("limit_sec"), 1.0).otherwise(S.time_penalty(time - F.col("limit_sec"), F.col("limit_sec"))))
    a, b = F.col("capture_time_sec_a"), F.col("capture_time_sec_b")
    lacks = F.when(a.isNull() & b.isNull(), "BOTH").when(a.isNull(), "TRAINEE").when(b.isNull(), "REFERENCE")
    return rows.withColumns({"time_delta": a - b, "score_delta": F.col("score_a") - F.col("score_b"), "trend": timing(a - b), "lacks": lacks})


def capture_time_totals(rows: DataFrame) -> DataFrame:
    """Per pair: pods, pods timed on both sides, mean differences, and pods left out by the side that lacks a time."""
    return rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_pods"), F.count("time_delta").alias("n_timed"), F.avg("time_delta").alias("mean_time_delta"), F.avg("score_delta").alias("mean_score_delta"),
        *[F.count_if(F.col("lacks") == side).alias(f"n_lacks_{side.lower()}") for side in ("TRAINEE", "REFERENCE", "BOTH")],
    )


def teammate_coverage(pairs: DataFrame, coverage: DataFrame, chosen: DataFrame, fps: float) -> DataFrame:
    """Coverage of each entrant on both sides, seconds unseen, and the team's own row (entry_number null)."""
    numbers = chosen.select("run_id", "track_id", "entry_number")
    rows = coverage.join(numbers, ["run_id", "track_id"], "left").where("entry_number is not null or track_id is null").withColumn("unseen_sec", F.col("unseen") / F.lit(fps))
    per_number = rows.withColumn("entry_", F.coalesce("entry_number", F.lit(0)))  # 0: the team
    out = sides(pairs, per_number, ["entry_"], ["score", "unseen_sec"])
    return out.withColumn("entry_number", F.nullif("entry_", F.lit(0))).withColumn("delta", F.col("score_a") - F.col("score_b")).drop("entry_")


def threat_coverage(pairs: DataFrame, finals: DataFrame, per_threat: DataFrame, fps: float) -> DataFrame:
    """Final coverage (0 without threats) and mean uncovered seconds per threat on both sides, with verdicts.

    `finals`: run_id, score; `per_threat`: run_id, track_id, present, covered.
    """
    uncovered = per_threat.where("present > 0").groupBy("run_id").agg(F.avg(F.greatest(F.lit(0.0), (F.col("present") - F.col("covered")) / F.lit(fps))).alias("uncovered_sec"))
    rows = sides(pairs, finals.join(uncovered, "run_id", "left"), [], ["score", "uncovered_sec"])
    score, seconds = F.col("score_a") - F.col("score_b"), F.col("uncovered_sec_a") - F.col("uncovered_sec_b")
    return rows.withColumns({"delta": score, "score_verdict": S.verdict(score, 0.02), "uncovered_delta": seconds, "uncovered_verdict": F.when(seconds.isNull(), "N/A").otherwise(S.verdict(-seconds, 0.10))})


def threats(pairs: DataFrame, per_threat: DataFrame) -> DataFrame:
    """Every in-room id of either side with the frames it was present and covered in, 0 where a side lacks it."""
    rows = sides(pairs, per_threat.withColumnRenamed("track_id", "inroom_id"), ["inroom_id"], ["present", "covered"])
    return rows.fillna(0, [f"{c}_{e}" for c in ("present", "covered") for e in "ab"])


def floor_coverage(pairs: DataFrame, summary: DataFrame, curve: DataFrame) -> DataFrame:
    """Final covered share of both sides (the summary's, else the curve's last, else 0) and the verdict."""
    last = curve.groupBy("run_id").agg(F.max_by("fraction", "frame").alias("last_"))
    table = last.join(summary.select("run_id", "final_fraction"), "run_id", "full").select("run_id", F.coalesce("final_fraction", "last_", F.lit(0.0)).alias("final"))
    rows = sides(pairs, table, [], ["final"])
    delta = F.coalesce("final_a", F.lit(0.0)) - F.coalesce("final_b", F.lit(0.0))
    return rows.withColumns({"delta": delta, "verdict": S.verdict(delta, 0.02, "HIGHER", "LOWER", "SAME")})


def coverage_time(pairs: DataFrame, summary: DataFrame, limit: float) -> DataFrame:
    """Time to full coverage and score of both sides; a run that never covers the room scores 0."""
    time = F.col("time_to_full")
    score = F.when(time.isNull(), 0.0).when(time <= limit, 1.0).otherwise(S.time_penalty(time - limit, F.lit(limit)))
    rows = sides(pairs, summary.withColumn("score", score), [], ["time_to_full", "score"])
    a, b = F.col("time_to_full_a"), F.col("time_to_full_b")
    trend = F.when(a.isNull() & b.isNull(), "NEITHER").when(a.isNull(), "REFERENCE ONLY").when(b.isNull(), "TRAINEE ONLY").otherwise(timing(a - b, 0.05, "SAME"))
    delta = F.coalesce("score_a", F.lit(0.0)) - F.coalesce("score_b", F.lit(0.0))
    return rows.withColumns({"time_delta": a - b, "trend": trend, "score_delta": delta, "score_verdict": S.verdict(delta, 0.01)})


def holds(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean hold of each pod on both sides and the difference; `samples`: run_id, pod_idx, hold."""
    rows = sides(pairs, samples.groupBy("run_id", "pod_idx").agg(F.avg("hold").alias("score")), ["pod_idx"], ["score"])
    return rows.withColumn("delta", F.col("score_a") - F.col("score_b"))


# ---- what a pair of runs comes to ------------------------------------------


def with_fps(table: DataFrame, fps: DataFrame | float) -> DataFrame:
    """`table` with fps_: one rate for all, or each run's own (run_id, fps; the default where it is missing or not above 0)."""
    if not isinstance(fps, DataFrame):
        return table.withColumn("fps_", F.lit(float(fps)))
    return table.join(fps.select("run_id", F.col("fps").alias("own_")), "run_id", "left").withColumn("fps_", S.usable_fps(F.col("own_"))).drop("own_")


def timed_gaps(chosen: DataFrame, fps: DataFrame | float, threshold: float, second: float | None = None) -> DataFrame:
    """run_id, pair_number, gap_sec, allowed_sec, score of successive entrants, in seconds of each run's own rate."""
    w = Window.partitionBy("run_id").orderBy("entry_number")
    rows = with_fps(chosen, fps).select("run_id", "entry_number", "fps_", (F.col("entry_number") - 1).alias("pair_number"), ((F.col("first_frame") - F.lag("first_frame").over(w)) / F.col("fps_")).alias("gap_sec"))
    rows = rows.where("gap_sec is not null").withColumn("allowed_sec", S.allowed_gap(F.col("pair_number"), threshold, second))
    return rows.select("run_id", "pair_number", "gap_sec", "allowed_sec", S.hesitation(F.col("gap_sec"), F.col("allowed_sec")).alias("score"))


def hesitation_totals(rows: DataFrame) -> DataFrame:
    """Of each pair of runs (`hesitation`): gaps on both sides, their mean difference and trend, the mean score of either side's gaps and their difference."""
    out = rows.groupBy("pair_id").agg(F.count("gap_delta").alias("n_gaps"), F.avg("gap_delta").alias("mean_gap_delta"), F.avg("score_a").alias("mean_score_a"), F.avg("score_b").alias("mean_score_b"))
    return out.withColumns({"score_delta": F.col("mean_score_a") - F.col("mean_score_b"), "trend": timing(F.col("mean_gap_delta"))})


def alternation(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pair_id, entry_number, sides and alternations (1, 0, null for the first known side and unknown ones) of both runs, the difference and a verdict."""
    known = vectors.where("sign <> 0")
    w = Window.partitionBy("run_id").orderBy("entry_number")
    turns = known.select("run_id", "entry_number", F.lag("sign").over(w).alias("before_"), "sign").select("run_id", "entry_number", (F.col("before_") != F.col("sign")).cast("int").alias("turns"))
    table = vectors.select("run_id", "entry_number", "track_id", "sign").join(turns, ["run_id", "entry_number"], "left")
    rows = sides(pairs, table, ["entry_number"], ["track_id", "sign", "turns"])
    delta = F.col("turns_a") - F.col("turns_b")
    known_both = (F.col("sign_a") != 0) & (F.col("sign_b") != 0)
    return rows.withColumns({"match": F.when(known_both, F.col("sign_a") == F.col("sign_b")), "delta": delta, "verdict": F.when(delta.isNull(), "N/A").otherwise(S.verdict(delta, 0.0))})


def vector_totals(rows: DataFrame) -> DataFrame:
    """Of each pair of runs (`alternation`): entries with a known side on both, how many match and their share, the share of turns of either run (0 without any), their difference and a verdict."""
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = rows.groupBy("pair_id").agg(F.count("match").alias("n_known"), F.count_if(F.col("match")).alias("n_match"), share("turns_a").alias("alternation_a"), share("turns_b").alias("alternation_b"))
    delta = F.col("alternation_a") - F.col("alternation_b")
    return out.withColumns({"match_share": F.col("n_match") / F.nullif(F.col("n_known"), F.lit(0)), "alternation_delta": delta, "verdict": S.verdict(delta, 0.0)})


def capture_totals(pairs: DataFrame, captured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of each pair of runs: pods compared, captured on either side and their share (1 without pods), and pods that entrants of the same number are to hold."""
    numbers = chosen.select("run_id", F.col("track_id").alias("assigned_id"), "entry_number")
    table = captured.join(numbers, ["run_id", "assigned_id"], "left")
    rows = sides(pairs, table, ["pod_idx"], ["entry_number", "capture_frame", "assigned_id"])
    own = {e: F.count(f"assigned_id_{e}") for e in "ab"}
    share = lambda e: F.when(own[e] > 0, F.count(f"capture_frame_{e}") / own[e]).otherwise(1.0)
    return rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_pods"), F.count("capture_frame_a").alias("n_captured_a"), F.count("capture_frame_b").alias("n_captured_b"),
        share("a").alias("score_a"), share("b").alias("score_b"), F.count_if(F.col("entry_number_a") == F.col("entry_number_b")).alias("n_same_entry"),
    )


def clearance_totals(pairs: DataFrame, cleared: DataFrame, starts: DataFrame, fps: DataFrame | float, tolerance: float = 0.05) -> DataFrame:
    """Of each pair of runs: people in the room of either run, how many each cleared and their rates (1 without anybody), the difference with a verdict, and the mean difference in seconds (not below 0 each) where both cleared."""
    table = with_fps(cleared.join(starts, "run_id", "left"), fps)
    table = table.withColumn("clear_sec", F.greatest(F.lit(0.0), (F.col("end_frame") - F.col("first_frame")) / F.col("fps_")))
    rows = sides(pairs, table.select("run_id", "inroom_id", "end_frame", "clear_sec"), ["inroom_id"], ["end_frame", "clear_sec"])
    out = pairs.select("pair_id").join(rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("end_frame_a").alias("na"), F.count("end_frame_b").alias("nb"), F.avg(F.col("clear_sec_a") - F.col("clear_sec_b")).alias("mean_delta"),
    ), "pair_id", "left").fillna(0, ["n", "na", "nb"])
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(1.0)
    out = out.select("pair_id", F.col("n").alias("n_inroom"), F.col("na").alias("n_cleared_a"), F.col("nb").alias("n_cleared_b"), rate("na").alias("rate_a"), rate("nb").alias("rate_b"), "mean_delta")
    delta = F.round(F.col("rate_a") - F.col("rate_b"), 9)
    return out.withColumns({"rate_delta": delta, "verdict": S.verdict(delta, tolerance, "HIGHER", "LOWER", "SAME")})


def hold_totals(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Of each pair of runs: persons that hold a pod, and the mean of their mean scores (0 without any), with the difference; `samples`: run_id, track_id, hold."""
    tracks = samples.groupBy("run_id", "track_id").agg(F.avg("hold").alias("h_")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_held"), F.avg("h_").alias("overall"))
    rows = pairs.select("pair_id").join(sides(pairs, tracks, [], ["n_held", "overall"]), "pair_id", "left").fillna(0, ["n_held_a", "n_held_b", "overall_a", "overall_b"])
    return rows.withColumn("delta", F.col("overall_a") - F.col("overall_b"))


def records(pairs: DataFrame, metrics: DataFrame, roles: DataFrame) -> DataFrame:
    """One comparison record for each pair and metric: its name, label (words of the name, each with a capital), both runs with role and score, the band and the sentence.

    `roles`: run_id, role.
    """
    rows = scores(pairs, metrics).join(pairs, "pair_id")
    role = lambda end: roles.select(F.col("run_id").alias(f"run_{end}"), F.col("role").alias(f"role_{end}"))
    rows = rows.join(role("a"), "run_a", "left").join(role("b"), "run_b", "left")
    label = F.initcap(F.translate("metric", "_", " "))
    return rows.select("pair_id", "metric", label.alias("label"), "run_a", "role_a", "score_a", "run_b", "role_b", "score_b", "band", "sentence")
