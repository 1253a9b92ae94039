"""Registered queries that compare runs: run 2k+1 as trainee, 2k as reference."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..operators import compare, entry, gaze, pods, wall
from ..streaming import live
from . import fixtures as X
from . import metrics as M
from . import queries_entry as E
from . import queries_room as R
from . import registry
from . import sqltext as Q
from .fixtures import ROOM
from .folders import shared_folder
from .queries_entry import pos, r6, team

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_PAIRS = "pairs AS (SELECT a.run_id // 2 AS pair_id, a.run_id AS run_a, b.run_id AS run_b FROM runs a JOIN runs b ON b.run_id = a.run_id - 1 WHERE a.run_id % 2 = 1)"


def add(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def pairs(spark, d):
    r = X.runs(pos(spark, d))
    a, b = r.select(F.col("run_id").alias("run_a")), r.select(F.col("run_id").alias("run_b"))
    return a.join(b, F.col("run_b") == F.col("run_a") - 1).where("run_a % 2 = 1").select(F.expr("run_a div 2").alias("pair_id"), "run_a", "run_b")


def both(table: str, keys: str, values: list[str]) -> str:
    ks = ["pair_id", *[k for k in keys.split(", ") if k]]
    side = lambda run, end: "SELECT " + ", ".join([*ks, *[f"{v} AS {v}_{end}" for v in values]]) + f" FROM pairs JOIN {table} t ON t.run_id = {run}"
    return f"({side('run_a', 'a')}) FULL JOIN ({side('run_b', 'b')}) USING ({', '.join(ks)})"


@add(Q.query("SELECT pair_id, pair_number, round(gap_sec_a - gap_sec_b, 6) AS gap_delta, round(score_a - score_b, 6) AS score_delta, CASE WHEN gap_sec_a - gap_sec_b IS NULL THEN 'N/A' WHEN gap_sec_a - gap_sec_b < 0 THEN 'FASTER' WHEN gap_sec_a - gap_sec_b > 0 THEN 'SLOWER' ELSE 'MATCH' END AS trend FROM " + both("gap_scores", "pair_number", ["gap_sec", "score"]), Q.TEAM, Q.GAPS, _PAIRS))
def C1_hesitation(spark, d):
    out = compare.hesitation(pairs(spark, d), entry.pair_gaps(team(pos(spark, d)), ROOM))
    return out.select("pair_id", "pair_number", r6("gap_delta").alias("gap_delta"), r6("score_delta").alias("score_delta"), "trend")


@add(Q.query("SELECT pair_id, entry_number, sign_a, sign_b, CASE WHEN sign_a <> 0 AND sign_b <> 0 THEN sign_a = sign_b END AS match FROM " + both("vectors", "entry_number", ["sign"]), Q.TEAM, Q.VECTORS, _PAIRS))
def C2_entrance_vectors(spark, d):
    p = pos(spark, d)
    return compare.vectors(pairs(spark, d), entry.entry_vectors(p, team(p), ROOM))


@add(Q.query("SELECT pair_id, round(duration_sec_a - duration_sec_b, 6) AS duration_delta, round(score_a - score_b, 6) AS score_delta FROM " + both("total", "", ["duration_sec", "score"]), Q.TEAM, Q.TOTAL, _PAIRS))
def C3_total_entry(spark, d):
    out = compare.total_entry(pairs(spark, d), entry.total_entry(team(pos(spark, d)), ROOM))
    return out.select("pair_id", r6("duration_delta").alias("duration_delta"), r6("score_delta").alias("score_delta"))


@add(Q.query("SELECT pair_id, entry_number, track_id_a, track_id_b FROM " + both("chosen", "entry_number", ["track_id"]), Q.TEAM, _PAIRS))
def J9_entrant_pairs(spark, d):
    return compare.sides(pairs(spark, d), team(pos(spark, d)), ["entry_number"], ["track_id"])


@add(Q.query("SELECT pair_id, metric, score_a, score_b, round(score_a - score_b, 6) AS delta, CASE WHEN score_b = 0 THEN CASE WHEN score_a = 0 THEN 'at' WHEN score_a > 0 THEN 'above' ELSE 'below' END WHEN score_a / score_b >= 1 THEN 'above' WHEN score_a / score_b >= 0.9 THEN 'at' WHEN score_a / score_b >= 0.7 THEN 'near' ELSE 'below' END AS band FROM " + both("scores", "metric", ["score"]), *E._SCORES, _PAIRS))
def C13_scores(spark, d):
    return compare.scores(pairs(spark, d), E.R10_metrics(spark, d)).select("pair_id", "metric", "score_a", "score_b", r6("delta").alias("delta"), "band")


@add(Q.query("SELECT DISTINCT pair_id, track_id FROM pairs JOIN positions ON run_id = run_a OR run_id = run_b", _PAIRS))
def U1_union_of_ids(spark, d):
    out = compare.sides(pairs(spark, d), pos(spark, d).select("run_id", "track_id").distinct(), ["track_id"], [])
    return out.select("pair_id", "track_id")


@add(Q.query("SELECT pair_id, pod_idx, assigned_id_a, assigned_id_b, round(capture_time_sec_a - capture_time_sec_b, 6) AS time_delta, CASE WHEN capture_time_sec_a IS NOT NULL AND capture_time_sec_b IS NOT NULL THEN 'BOTH' WHEN capture_time_sec_a IS NOT NULL THEN 'TRAINEE' WHEN capture_time_sec_b IS NOT NULL THEN 'REFERENCE' ELSE 'NONE' END AS captured FROM " + both("captures", "pod_idx", ["assigned_id", "capture_time_sec"]), *R._GC, _PAIRS))
def C5_captures(spark, d):
    out = compare.captures(pairs(spark, d), R._captures(spark, d))
    return out.select("pair_id", "pod_idx", "assigned_id_a", "assigned_id_b", r6("time_delta").alias("time_delta"), "captured")


@add(Q.query("SELECT pair_id, inroom_id, round(clear_sec_a - clear_sec_b, 6) AS delta, CASE WHEN clear_sec_a - clear_sec_b IS NULL THEN 'N/A' WHEN abs(clear_sec_a - clear_sec_b) <= 0.25 THEN 'SIMILAR' WHEN clear_sec_a < clear_sec_b THEN 'FASTER' ELSE 'SLOWER' END AS trend FROM " + both("cleared_", "inroom_id", ["clear_sec"]), *R._C, "cleared_ AS (SELECT c.run_id, c.inroom_id, (c.end_frame - f.f) / 30.0 AS clear_sec FROM cleared c LEFT JOIN (SELECT run_id, min(frame) AS f FROM friends GROUP BY run_id) f ON f.run_id = c.run_id)", _PAIRS))
def C7_clearance(spark, d):
    start = pos(spark, d).where("track_id <> 99").groupBy("run_id").agg(F.min("frame").alias("first_frame"))
    return compare.clearance(pairs(spark, d), R._cleared(spark, d), start, 30.0).select("pair_id", "inroom_id", r6("delta").alias("delta"), "trend")


@add(Q.query("SELECT pair_id, entry_number, CASE WHEN sa - sb IS NULL THEN 'N/A' WHEN sa - sb > 0.01 THEN 'BETTER' WHEN sa - sb < -0.01 THEN 'WORSE' ELSE 'SIMILAR' END AS score_verdict FROM (SELECT pair_id, entry_number, score_a AS sa, score_b AS sb FROM " + both("walls_", "entry_number", ["score"]) + ")", Q.TEAM, R._WALL, R._ADHERE, "walls_ AS (SELECT run_id, entry_number, n_safe / n_seen AS score FROM adherence JOIN chosen USING (run_id, track_id))", _PAIRS))
def C4_walls(spark, d):
    out = compare.walls(pairs(spark, d), wall.adherence(R._banded(spark, d), 30.0), team(pos(spark, d)))
    return out.select("pair_id", "entry_number", "score_verdict")


@add(Q.query("SELECT pair_id, CASE WHEN least(n_a, n_b) > 0 THEN least(n_a, n_b) ELSE greatest(n_a, n_b) END AS team FROM " + both("counts_", "", ["n"]), "counts_ AS (SELECT run_id, count(*) AS n FROM spans GROUP BY run_id)", _PAIRS))
def T6_compared_team(spark, d):
    p = pos(spark, d).where("track_id <> 99")
    rows = compare.sides(pairs(spark, d), p.groupBy("run_id").agg(F.count_distinct("track_id").alias("n")), [], ["n"])
    return rows.select("pair_id", compare.compared_team(F.col("n_a"), F.col("n_b")).alias("team"))


@add(Q.query("SELECT pair_id, side, t, value FROM (SELECT pair_id, 'a' AS side, run_a AS run_id FROM pairs UNION ALL SELECT pair_id, 'b', run_b FROM pairs) JOIN curves USING (run_id) JOIN (SELECT pair_id, min(e) AS e FROM (SELECT pair_id, r, max(t) AS e FROM (SELECT pair_id, run_a AS r FROM pairs UNION ALL SELECT pair_id, run_b FROM pairs) JOIN curves ON run_id = r GROUP BY ALL) GROUP BY pair_id) USING (pair_id) WHERE t <= e", "curves AS (SELECT run_id, CAST(frame AS DOUBLE) AS t, sum(map_x) AS value FROM positions GROUP BY ALL)", _PAIRS))
def T7_clipped_curves(spark, d):
    curve = pos(spark, d).groupBy("run_id", F.col("frame").cast("double").alias("t")).agg(F.sum("map_x").alias("value"))
    return compare.clipped(pairs(spark, d), curve)


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.selectExpr("user_id % 5 AS run_id", "user_id AS track_id", "CAST(event_id AS INT) AS frame", "ts", "value > 20 AS in_area", "value > 40 AS is_entry")


@add("SELECT user_id % 5 AS run_id, CAST(min(event_id) AS INT) AS first_frame FROM events WHERE value > 40 GROUP BY 1")
def M2_first_entries(spark, d):
    return live.first_entries(_events(spark, d))


@add("SELECT user_id % 5 AS run_id, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS count FROM events GROUP BY 1, 2")
def M6_presence(spark, d):
    return live.presence(_events(spark, d), "1 hour")


_LIMITS = (2.0, 4.0)
_T, _L = "capture_time_sec_{e}", "l"
_POINTS = ", ".join(f"CASE WHEN {_T.format(e=e)} IS NULL THEN 0.0 WHEN {_T.format(e=e)} <= l THEN 1.0 WHEN {_T.format(e=e)} - l >= l THEN 0.0 ELSE exp(-({_T.format(e=e)} - l) / (l - ({_T.format(e=e)} - l))) END AS s{e}" for e in "ab")
_BY_POD = f"by_pod AS (SELECT *, capture_time_sec_a - capture_time_sec_b AS dt, {_POINTS} FROM (SELECT *, CASE pod_idx WHEN 0 THEN 2.0 ELSE 4.0 END AS l FROM " + both("captures", "pod_idx", ["assigned_id", "capture_time_sec"]) + "))"


def _capture_times(spark, d):
    return compare.capture_times(pairs(spark, d), R._captures(spark, d), _LIMITS)


@add(Q.query("SELECT pair_id, pod_idx, round(dt, 6) AS time_delta, round(sa - sb, 6) AS score_delta, CASE WHEN dt IS NULL THEN 'N/A' WHEN dt < 0 THEN 'FASTER' WHEN dt > 0 THEN 'SLOWER' ELSE 'MATCH' END AS trend FROM by_pod", *R._GC, _PAIRS, _BY_POD))
def C6_capture_times(spark, d):
    return _capture_times(spark, d).select("pair_id", "pod_idx", r6("time_delta").alias("time_delta"), r6("score_delta").alias("score_delta"), "trend")


@add(Q.query("SELECT pair_id, count(*) AS n_pods, count(dt) AS n_timed, round(avg(dt), 6) AS mean_time_delta, round(avg(sa - sb), 6) AS mean_score_delta, count(*) FILTER (capture_time_sec_a IS NULL AND capture_time_sec_b IS NOT NULL) AS n_lacks_trainee, count(*) FILTER (capture_time_sec_a IS NOT NULL AND capture_time_sec_b IS NULL) AS n_lacks_reference, count(*) FILTER (capture_time_sec_a IS NULL AND capture_time_sec_b IS NULL) AS n_lacks_both FROM by_pod GROUP BY pair_id", *R._GC, _PAIRS, _BY_POD))
def C6_capture_time_totals(spark, d):
    out = compare.capture_time_totals(_capture_times(spark, d))
    return out.withColumns({c: r6(c) for c in ("mean_time_delta", "mean_score_delta")})


@add(Q.query("SELECT pair_id, pod_idx, assigned_id_a, assigned_id_b FROM " + both("assigned_pods", "pod_idx", ["assigned_id"]), *R._G, _PAIRS, "assigned_pods AS (SELECT run_id, pod_idx, track_id AS assigned_id FROM assigned WHERE pod_idx IS NOT NULL)"))
def J8_pod_pairs(spark, d):
    a = pods.assign_by_side(R._vectors(spark, d), ROOM).where("pod_idx is not null").select("run_id", "pod_idx", F.col("track_id").alias("assigned_id"))
    return compare.sides(pairs(spark, d), a, ["pod_idx"], ["assigned_id"])


_COVER = "covers AS (SELECT s.run_id, coalesce(c.entry_number, 0) AS entry_, s.score, s.unseen / 30.0 AS unseen_sec FROM (SELECT run_id, track_id, count(*) FILTER (NOT seen) AS unseen, 1 - count(*) FILTER (NOT seen) / count(*) AS score FROM seen GROUP BY GROUPING SETS ((run_id, track_id), (run_id))) s LEFT JOIN chosen c ON c.run_id = s.run_id AND c.track_id = s.track_id WHERE c.entry_number IS NOT NULL OR s.track_id IS NULL)"


@add(Q.query("SELECT pair_id, nullif(entry_, 0) AS entry_number, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, round(score_a - score_b, 6) AS delta, round(unseen_sec_a, 6) AS unseen_sec_a, round(unseen_sec_b, 6) AS unseen_sec_b FROM " + both("covers", "entry_", ["score", "unseen_sec"]), Q.TEAM, *R._S, _COVER, _PAIRS))
def C8_teammate_coverage(spark, d):
    out = compare.teammate_coverage(pairs(spark, d), gaze.teammate_coverage(R._seen(spark, d)), team(pos(spark, d)), 30.0)
    return out.withColumns({c: r6(c) for c in ("score_a", "score_b", "delta", "unseen_sec_a", "unseen_sec_b")})


_PER = "per_threat AS (SELECT run_id, track_id AS inroom_id, count(*) AS present, count(*) FILTER (watched) AS covered FROM watched GROUP BY ALL)"
_FINAL = "finals AS (SELECT r.run_id, coalesce(c / p, 0.0) AS score, u.u FROM runs r LEFT JOIN (SELECT run_id, count(*) AS p, count(*) FILTER (w) AS c FROM (SELECT run_id, frame, bool_or(watched) AS w FROM watched GROUP BY ALL) GROUP BY run_id) x ON x.run_id = r.run_id LEFT JOIN (SELECT run_id, avg((present - covered) / 30.0) AS u FROM per_threat GROUP BY run_id) u ON u.run_id = r.run_id)"


@add(Q.query("SELECT pair_id, round(score_a - score_b, 6) AS delta, CASE WHEN score_a - score_b > 0.02 THEN 'BETTER' WHEN score_a - score_b < -0.02 THEN 'WORSE' ELSE 'SIMILAR' END AS score_verdict, round(u_a - u_b, 6) AS uncovered_delta, CASE WHEN u_a - u_b IS NULL THEN 'N/A' WHEN u_b - u_a > 0.1 THEN 'BETTER' WHEN u_b - u_a < -0.1 THEN 'WORSE' ELSE 'SIMILAR' END AS uncovered_verdict FROM " + both("finals", "", ["score", "u"]), *R._W, _PER, _FINAL, _PAIRS))
def C9_threat_coverage(spark, d):
    w = R._watched(spark, d)
    out = compare.threat_coverage(pairs(spark, d), gaze.threat_scores(X.runs(pos(spark, d)), w, 0.0).select("run_id", "score"), gaze.per_threat(w), 30.0)
    return out.select("pair_id", r6("delta").alias("delta"), "score_verdict", r6("uncovered_delta").alias("uncovered_delta"), "uncovered_verdict")


@add(Q.query("SELECT pair_id, inroom_id, coalesce(present_a, 0) AS present_a, coalesce(present_b, 0) AS present_b, coalesce(covered_a, 0) AS covered_a, coalesce(covered_b, 0) AS covered_b FROM " + both("per_threat", "inroom_id", ["present", "covered"]), *R._W, _PER, _PAIRS))
def J10_threat_pairs(spark, d):
    return compare.threats(pairs(spark, d), gaze.per_threat(R._watched(spark, d)))


@add(Q.query("SELECT pair_id, round(final_fraction_a - final_fraction_b, 6) AS delta, CASE WHEN final_fraction_a - final_fraction_b > 0.02 THEN 'HIGHER' WHEN final_fraction_a - final_fraction_b < -0.02 THEN 'LOWER' ELSE 'SAME' END AS verdict FROM " + both("summary", "", ["final_fraction"]), *R._R, R._SUM, _PAIRS))
def C10_floor_coverage(spark, d):
    # every third run has no summary and falls back to its curve
    out = compare.floor_coverage(pairs(spark, d), R._summary(spark, d).where("run_id % 3 <> 0"), R._curve(spark, d))
    return out.select("pair_id", r6("delta").alias("delta"), "verdict")


@add(None)
def C10_floor_coverage_whole(spark, d):
    # both sides have the few rows of newly seen cells, which are found once
    new = registry.stored(R._new(spark, d, R.PIXEL), f"{shared_folder(spark, 'coverage')}/new")
    out = compare.floor_coverage(pairs(spark, d), R._whole_summary(spark, d, new).where("run_id % 3 <> 0"), R._whole_curve(spark, d, new))
    return out.select("pair_id", r6("delta").alias("delta"), "verdict")


_TIMED = "timed AS (SELECT run_id, time_to_full AS t, CASE WHEN time_to_full IS NULL OR time_to_full >= 8 THEN 0.0 WHEN time_to_full <= 4 THEN 1.0 ELSE exp(-(time_to_full - 4) / (8 - time_to_full)) END AS score FROM summary)"


@add(Q.query("SELECT pair_id, round(t_a - t_b, 6) AS time_delta, CASE WHEN t_a IS NULL AND t_b IS NULL THEN 'NEITHER' WHEN t_a IS NULL THEN 'REFERENCE ONLY' WHEN t_b IS NULL THEN 'TRAINEE ONLY' WHEN abs(t_a - t_b) <= 0.05 THEN 'SAME' WHEN t_a < t_b THEN 'FASTER' ELSE 'SLOWER' END AS trend, round(score_a - score_b, 6) AS score_delta, CASE WHEN score_a - score_b > 0.01 THEN 'BETTER' WHEN score_a - score_b < -0.01 THEN 'WORSE' ELSE 'SIMILAR' END AS score_verdict FROM " + both("timed", "", ["t", "score"]), *R._R, R._SUM, _TIMED, _PAIRS))
def C11_coverage_time(spark, d):
    out = compare.coverage_time(pairs(spark, d), R._summary(spark, d), 4.0)
    return out.select("pair_id", r6("time_delta").alias("time_delta"), "trend", r6("score_delta").alias("score_delta"), "score_verdict")


@add(None)
def C11_coverage_time_whole(spark, d):
    out = compare.coverage_time(pairs(spark, d), R._whole_summary(spark, d), 4.0)
    return out.select("pair_id", r6("time_delta").alias("time_delta"), "trend", r6("score_delta").alias("score_delta"), "score_verdict")


@add(Q.query("SELECT pair_id, pod_idx, round(h_a, 6) AS score_a, round(h_b, 6) AS score_b, round(h_a - h_b, 6) AS delta FROM " + both("held", "pod_idx", ["h"]), Q.TEAM, R._HOLD.replace("p.track_id, frame, exp", "p.track_id, pod_idx, frame, exp"), "held AS (SELECT run_id, pod_idx, avg(h) AS h FROM holding GROUP BY ALL)", _PAIRS))
def C12_hold_area(spark, d):
    out = compare.holds(pairs(spark, d), R._hold(spark, d))
    return out.withColumns({c: r6(c) for c in ("score_a", "score_b", "delta")})


@add(Q.query("SELECT pair_id, metric, score_a, score_b FROM " + both("scores", "metric", ["score"]), *E._SCORES, _PAIRS))
def J11_score_pairs(spark, d):
    return compare.sides(pairs(spark, d), E.R10_metrics(spark, d), ["metric"], ["score"])


@add("SELECT run_id, track_id, frame FROM (SELECT user_id % 5 AS run_id, user_id AS track_id, CAST(event_id AS INT) AS frame, min(CASE WHEN value > 400 THEN event_id END) OVER (PARTITION BY user_id % 5) AS f FROM events) WHERE f IS NULL OR frame <= f + 200")
def M3_until_stop(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id % 5 AS run_id", "user_id AS track_id", "CAST(event_id AS INT) AS frame", "value > 400 AS is_entry")
    return live.until_stop(e, 200).select("run_id", "track_id", "frame")


_BIRTHS = "SELECT user_id % 5 AS run_id, CAST(event_id AS INT) AS frame, CASE event_id % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'entry_buffer' WHEN 2 THEN 'interior' ELSE 'outside' END AS location, CAST(user_id % 10 AS DOUBLE) / 10 AS confidence FROM events"


@add(f"SELECT run_id, frame, location FROM (SELECT *, min(CASE WHEN location = 'entry' AND confidence >= 0.5 THEN frame END) OVER (PARTITION BY run_id) AS f FROM ({_BIRTHS})) WHERE location = 'interior' OR (location IN ('entry', 'entry_buffer') AND confidence >= 0.5 AND (f IS NULL OR frame < f + 300))")
def M5_accepted_births(spark, d):
    births = spark.sql(_BIRTHS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    return live.accepted_births(births, 300, 0.5).select("run_id", "frame", "location")


# ---- what pairs come to, with each run's own frame rate ---------------------

# Runs are of 30 or 60 frames a second; every fifth run doesn't say and counts as 30.
_FPS = "rates AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 30.0 WHEN run_id % 3 = 0 THEN 60.0 ELSE 30.0 END AS fps FROM runs)"
_GAPS_FPS = """own_gaps AS (SELECT run_id, entry_number - 1 AS pair_number, (first_frame - lag(first_frame) OVER (PARTITION BY run_id ORDER BY entry_number)) / fps AS gap_sec FROM chosen JOIN rates USING (run_id)),
own_scores AS (SELECT *, exp(-power(greatest(0.0, gap_sec - CASE WHEN pair_number = 2 THEN 2.0 ELSE 1.0 END), 2) / 0.5) AS score FROM own_gaps WHERE gap_sec IS NOT NULL)"""
_TREND = "CASE WHEN {0} IS NULL THEN 'N/A' WHEN {0} < 0 THEN 'FASTER' WHEN {0} > 0 THEN 'SLOWER' ELSE 'MATCH' END"


def rates(spark, d):
    return X.runs(pos(spark, d)).select("run_id", F.expr("CASE WHEN run_id % 5 = 0 THEN NULL WHEN run_id % 3 = 0 THEN 60D ELSE 30D END").alias("fps"))


@add(Q.query("SELECT pair_id, count(d) AS n_gaps, round(avg(d), 6) AS mean_gap_delta, round(avg(score_a), 6) AS mean_score_a, round(avg(score_b), 6) AS mean_score_b, round(avg(score_a) - avg(score_b), 6) AS score_delta, " + _TREND.format("round(avg(d), 9)") + " AS trend FROM (SELECT *, gap_sec_a - gap_sec_b AS d FROM " + both("own_scores", "pair_number", ["gap_sec", "score"]) + ") GROUP BY pair_id", Q.TEAM, _FPS, _GAPS_FPS, _PAIRS))
def C1_hesitation_totals(spark, d):
    gaps = compare.timed_gaps(team(pos(spark, d)), rates(spark, d), 1.0)
    out = compare.hesitation_totals(compare.hesitation(pairs(spark, d), gaps)).withColumn("trend", compare.timing(F.round("mean_gap_delta", 9)))
    return out.select("pair_id", "n_gaps", *[r6(c).alias(c) for c in ("mean_gap_delta", "mean_score_a", "mean_score_b", "score_delta")], "trend")


_TURNS = "turned AS (SELECT v.run_id, v.entry_number, v.track_id, v.sign, t.turns FROM vectors v LEFT JOIN (SELECT run_id, entry_number, CAST(lag(sign) OVER (PARTITION BY run_id ORDER BY entry_number) <> sign AS INT) AS turns FROM vectors WHERE sign <> 0) t USING (run_id, entry_number))"
_TURNED = both("turned", "entry_number", ["track_id", "sign", "turns"])
_MATCH = "CASE WHEN sign_a <> 0 AND sign_b <> 0 THEN sign_a = sign_b END"


@add(Q.query(f"SELECT pair_id, entry_number, track_id_a, track_id_b, {_MATCH} AS match, turns_a - turns_b AS delta, CASE WHEN turns_a - turns_b IS NULL THEN 'N/A' WHEN turns_a > turns_b THEN 'BETTER' WHEN turns_a < turns_b THEN 'WORSE' ELSE 'SIMILAR' END AS verdict FROM {_TURNED}", Q.TEAM, Q.VECTORS, _TURNS, _PAIRS))
def C2_alternation(spark, d):
    p = pos(spark, d)
    return compare.alternation(pairs(spark, d), entry.entry_vectors(p, team(p), ROOM)).select("pair_id", "entry_number", "track_id_a", "track_id_b", "match", "delta", "verdict")


@add(Q.query(f"SELECT *, CASE WHEN alternation_delta > 0 THEN 'BETTER' WHEN alternation_delta < 0 THEN 'WORSE' ELSE 'SIMILAR' END AS verdict FROM (SELECT pair_id, count(m) AS n_known, count(*) FILTER (m) AS n_match, round(coalesce(avg(turns_a), 0), 6) AS alternation_a, round(coalesce(avg(turns_b), 0), 6) AS alternation_b, round(count(*) FILTER (m) / nullif(count(m), 0), 6) AS match_share, round(coalesce(avg(turns_a), 0) - coalesce(avg(turns_b), 0), 6) AS alternation_delta FROM (SELECT *, {_MATCH} AS m FROM {_TURNED}) GROUP BY pair_id)", Q.TEAM, Q.VECTORS, _TURNS, _PAIRS))
def C2_entrance_vector_totals(spark, d):
    p = pos(spark, d)
    out = compare.vector_totals(compare.alternation(pairs(spark, d), entry.entry_vectors(p, team(p), ROOM)))
    return out.withColumns({c: r6(c) for c in ("alternation_a", "alternation_b", "match_share", "alternation_delta")})


@add(Q.query("SELECT pair_id, round(duration_sec_a - duration_sec_b, 6) AS duration_delta FROM " + both("own_total", "", ["duration_sec"]), Q.TEAM, _FPS, "own_total AS (SELECT run_id, (max(first_frame) - min(first_frame)) / any_value(fps) AS duration_sec FROM chosen JOIN rates USING (run_id) GROUP BY run_id)", _PAIRS))
def C3_total_entry_rates(spark, d):
    span = compare.with_fps(team(pos(spark, d)), rates(spark, d)).groupBy("run_id").agg(((F.max("first_frame") - F.min("first_frame")) / F.first("fps_")).alias("duration_sec"))
    rows = compare.sides(pairs(spark, d), span, [], ["duration_sec"])
    return rows.select("pair_id", r6(F.col("duration_sec_a") - F.col("duration_sec_b")).alias("duration_delta"))


@add(Q.query("SELECT pair_id, count(*) AS n_pods, count(capture_frame_a) AS n_captured_a, count(capture_frame_b) AS n_captured_b, round(CASE WHEN count(assigned_id_a) > 0 THEN count(capture_frame_a) / count(assigned_id_a) ELSE 1.0 END, 6) AS score_a, round(CASE WHEN count(assigned_id_b) > 0 THEN count(capture_frame_b) / count(assigned_id_b) ELSE 1.0 END, 6) AS score_b, count(*) FILTER (entry_number_a = entry_number_b) AS n_same_entry FROM "
  + both("numbered", "pod_idx", ["entry_number", "capture_frame", "assigned_id"]) + " GROUP BY pair_id", *R._GC, "numbered AS (SELECT c.*, e.entry_number FROM captures c LEFT JOIN chosen e ON e.run_id = c.run_id AND e.track_id = c.assigned_id)", _PAIRS))
def C5_capture_totals(spark, d):
    out = compare.capture_totals(pairs(spark, d), R._captures(spark, d), team(pos(spark, d)))
    return out.withColumn("score_a", r6("score_a")).withColumn("score_b", r6("score_b"))


@add(Q.query("""SELECT pair_id, n AS n_inroom, na AS n_cleared_a, nb AS n_cleared_b, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(m, 6) AS mean_delta, round(ra - rb, 6) AS rate_delta, CASE WHEN round(ra - rb, 9) > 0.05 THEN 'HIGHER' WHEN round(ra - rb, 9) < -0.05 THEN 'LOWER' ELSE 'SAME' END AS verdict
FROM (SELECT *, CASE WHEN n > 0 THEN na / n ELSE 1.0 END AS ra, CASE WHEN n > 0 THEN nb / n ELSE 1.0 END AS rb FROM (SELECT p.pair_id, count(x.inroom_id) AS n, count(x.end_frame_a) AS na, count(x.end_frame_b) AS nb, avg(x.clear_sec_a - x.clear_sec_b) AS m FROM pairs p LEFT JOIN (SELECT * FROM """ + both("own_cleared", "inroom_id", ["end_frame", "clear_sec"]) + ") x ON x.pair_id = p.pair_id GROUP BY p.pair_id))", *R._C, _FPS, "own_cleared AS (SELECT c.run_id, c.inroom_id, c.end_frame, greatest(0.0, (c.end_frame - f.f) / fps) AS clear_sec FROM cleared c LEFT JOIN (SELECT run_id, min(frame) AS f FROM friends GROUP BY run_id) f ON f.run_id = c.run_id JOIN rates ON rates.run_id = c.run_id)", _PAIRS))
def C7_clearance_totals(spark, d):
    start = pos(spark, d).where("track_id <> 99").groupBy("run_id").agg(F.min("frame").alias("first_frame"))
    out = compare.clearance_totals(pairs(spark, d), R._cleared(spark, d), start, rates(spark, d))
    return out.withColumns({c: r6(c) for c in ("rate_a", "rate_b", "mean_delta", "rate_delta")})


@add(Q.query("SELECT p.pair_id, coalesce(n_held_a, 0) AS n_held_a, coalesce(n_held_b, 0) AS n_held_b, round(coalesce(overall_a, 0), 6) AS overall_a, round(coalesce(overall_b, 0), 6) AS overall_b, round(coalesce(overall_a, 0) - coalesce(overall_b, 0), 6) AS delta FROM pairs p LEFT JOIN (SELECT * FROM " + both("overall_", "", ["n_held", "overall"]) + ") x ON x.pair_id = p.pair_id", Q.TEAM, R._HOLD, "overall_ AS (SELECT run_id, count(*) AS n_held, avg(m) AS overall FROM (SELECT run_id, track_id, avg(h) AS m FROM holding GROUP BY ALL) GROUP BY run_id)", _PAIRS))
def C12_hold_totals(spark, d):
    out = compare.hold_totals(pairs(spark, d), R._hold(spark, d))
    return out.withColumns({c: r6(c) for c in ("overall_a", "overall_b", "delta")})


@add(Q.query("SELECT pair_id, metric, CASE metric WHEN 'entrance_hesitation' THEN 'Entrance Hesitation' WHEN 'entrance_vectors' THEN 'Entrance Vectors' WHEN 'total_entry_time' THEN 'Total Entry Time' END AS label, run_a, 'trainee' AS role_a, score_a, run_b, 'expert' AS role_b, score_b FROM (SELECT * FROM " + both("scores", "metric", ["score"]) + ") JOIN pairs USING (pair_id)", *E._SCORES, _PAIRS))
def C13_records(spark, d):
    roles = X.runs(pos(spark, d)).select("run_id", F.when(F.col("run_id") % 2 == 0, "expert").otherwise("trainee").alias("role"))
    return compare.records(pairs(spark, d), E.R10_metrics(spark, d), roles).select("pair_id", "metric", "label", "run_a", "role_a", "score_a", "run_b", "role_b", "score_b")


# ---- all metrics -----------------------------------------------------------

_PARTS = [
    ("entrance_hesitation", "SELECT run_id, score FROM scores WHERE metric = 'entrance_hesitation'"), ("total_entry_time", "SELECT run_id, score FROM scores WHERE metric = 'total_entry_time'"), ("entrance_vectors", "SELECT run_id, score FROM scores WHERE metric = 'entrance_vectors'"),
    ("move_along_wall", "SELECT run_id, coalesce(s, 0.0) AS score FROM runs LEFT JOIN (SELECT run_id, round_even(avg(n_safe / n_seen), 2) AS s FROM adherence GROUP BY run_id) USING (run_id)"),
    ("threat_clearance", "SELECT run_id, coalesce(s, 1.0) AS score FROM runs LEFT JOIN (SELECT run_id, round_even(count(end_frame) / count(*), 2) AS s FROM cleared GROUP BY run_id) USING (run_id)"),
    ("teammate_coverage", "SELECT run_id, coalesce(s, 1.0) AS score FROM runs LEFT JOIN (SELECT run_id, round_even(count(*) FILTER (seen) / count(*), 2) AS s FROM seen GROUP BY run_id) USING (run_id)"),
    ("threat_coverage", "SELECT run_id, round_even(coalesce(c / p, 1.0), 2) AS score FROM runs LEFT JOIN (SELECT run_id, count(*) AS p, count(*) FILTER (w) AS c FROM (SELECT run_id, frame, bool_or(watched) AS w FROM watched GROUP BY ALL) GROUP BY run_id) USING (run_id)"),
    ("capture_pod_time", f"SELECT run_id, coalesce(s, 0.0) AS score FROM runs LEFT JOIN (SELECT run_id, round(avg(p), 2) AS s FROM (SELECT run_id, assigned_id, round(avg(CASE WHEN {R._T} IS NULL THEN 0.0 WHEN {R._T} <= l THEN 1.0 WHEN {R._T} - l >= l THEN 0.0 ELSE exp(-({R._T} - l) / (l - ({R._T} - l))) END), 2) AS p FROM (SELECT *, CASE pod_idx WHEN 0 THEN 2.0 ELSE 4.0 END AS l FROM captures) GROUP BY ALL) GROUP BY run_id) USING (run_id)"),
    ("room_coverage", "SELECT r.run_id, coalesce(final_fraction, 0.0) AS score FROM runs r LEFT JOIN summary USING (run_id)"),
    ("room_coverage_time", "SELECT r.run_id, round_even(coalesce(t.score, 0.0), 2) AS score FROM runs r LEFT JOIN timed t USING (run_id)"),
    ("capture_pods", "SELECT run_id, coalesce(s, 1.0) AS score FROM runs LEFT JOIN (SELECT run_id, round_even(count(capture_frame) / count(*), 2) AS s FROM captures GROUP BY run_id) USING (run_id)"),
    ("hold_area", "SELECT run_id, CASE WHEN n >= 4 THEN round(s, 2) ELSE 0.0 END AS score FROM runs LEFT JOIN (SELECT run_id, avg(m) AS s, count(*) AS n FROM (SELECT run_id, track_id, avg(h) AS m FROM holding GROUP BY ALL) GROUP BY run_id) USING (run_id)"),
]
_UNION = " UNION ALL ".join(f"SELECT run_id, '{name}' AS metric, score FROM ({body})" for name, body in _PARTS)


def _all_metrics(spark, d, step):
    room = dataclasses.replace(ROOM, visual_angle=R.ANGLE, pod_limits=_LIMITS, floor_step=step)
    folder = shared_folder(spark, "metrics")
    tables = E.tables(spark, d, folder)
    p = tables["positions"]
    tables |= {"boxes": X.detections(spark, d, p), "gaze": X.gaze(spark, d, p), "keypoints": X.keypoints(spark, d, p), "lengths": R._resolved(spark, d), "map_gaze": R._mapgaze(spark, d, p)}
    return M.REGISTRY.run(tables, room, folder=folder)


@add(Q.query(_UNION, Q.TEAM, Q.GAPS, Q.TOTAL, Q.VECTORS, Q.transitions(True), E._METRICS, R._WALL, R._ADHERE, *R._W, *R._S, *R._R, R._SUM, _TIMED, R._ORDERS, R._ASSIGN, R._SAMPLES, R._CAPTURE, R._HOLD))
def R10_all_metrics(spark, d):
    return _all_metrics(spark, d, R.STEP)


@add(None)
def R10_all_metrics_whole(spark, d):
    return _all_metrics(spark, d, R.PIXEL)
