"""Registered queries: frames, geometry, roles, entry rules; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scores as S
from ..operators import entry, frames, roles
from . import fixtures as X
from . import metrics as M
from . import registry
from . import sqltext as Q
from .fixtures import ROOM
from .folders import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K = ("run_id", "track_id", "frame")


def add(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: F.Column | str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def pos(spark: SparkSession, d: str) -> DataFrame:
    return X.positions(spark, d)


def team(p: DataFrame) -> DataFrame:
    return roles.entrants(p, X.inroom(p), ROOM.team)


def tables(spark: SparkSession, d: str, folder: str | None = None) -> dict[str, DataFrame]:
    """Positions (written to `folder` where one is given), runs and who is in the room."""
    p = registry.stored(pos(spark, d), f"{folder}/positions") if folder else pos(spark, d)
    return {"positions": p, "inroom": X.inroom(p), "runs": X.runs(p)}


@add(Q.query("SELECT run_id, track_id, frame FROM positions JOIN (SELECT run_id AS r, CASE WHEN run_id % 3 = 0 THEN NULL ELSE 60 END AS a, CASE WHEN run_id % 2 = 0 THEN NULL ELSE 200 END AS b FROM runs) w ON r = run_id WHERE frame >= coalesce(a, 1) AND (b IS NULL OR frame <= b)"))
def P1_window_filter(spark, d):
    p = pos(spark, d)
    windows = X.runs(p).select("run_id", F.expr("CASE WHEN run_id % 3 = 0 THEN NULL ELSE 60 END").alias("a"), F.expr("CASE WHEN run_id % 2 = 0 THEN NULL ELSE 200 END").alias("b"))
    return p.join(windows, "run_id").where(S.in_window(F.col("frame"), F.col("a"), F.col("b"))).select(*K)


@add(Q.query("SELECT run_id, track_id, frame, round((frame - 1) / CASE WHEN run_id % 3 = 0 THEN 30.0 WHEN run_id % 3 = 1 THEN 60.0 ELSE 30.0 END, 3) AS time_sec FROM positions"))
def P2_frame_time(spark, d):
    fps = F.expr("CASE WHEN run_id % 3 = 0 THEN 0.0D WHEN run_id % 3 = 1 THEN 60.0D ELSE 30.0D END")
    return pos(spark, d).select(*K, S.frame_time(F.col("frame"), fps).alias("time_sec"))


@add(Q.query("SELECT run_id, track_id, frame FROM positions WHERE rk % 11 <> 0"))
def P3_finite_points(spark, d):
    return frames.finite_points(pos(spark, d).withColumn("map_x", F.expr("map_x / CASE WHEN rk % 22 = 0 THEN double('NaN') WHEN rk % 11 = 0 THEN null ELSE 1 END"))).select(*K)


@add(Q.query("SELECT run_id, track_id, frame FROM detections WHERE confidence > 0.4 AND NOT (x1 <= 100 AND y1 <= 0 AND x2 >= 100 AND y2 >= 0) AND x2 - x1 > 1 AND y2 - y1 > 1"))
def P4_usable_boxes(spark, d):
    shifted = X.detections(spark, d).withColumn("x1", F.col("x1") - 100).withColumn("x2", F.col("x2") - 100)
    return frames.usable_boxes(shifted, 0.4, 0.0, 0.0).select(*K)


@add(Q.query("SELECT run_id, track_id, frame, CASE WHEN confidence > 0.5 THEN 'primary' WHEN confidence > 0.1 AND confidence < 0.5 THEN 'secondary' END AS part FROM detections"))
def P5_confidence_class(spark, d):
    return frames.confidence_class(X.detections(spark, d), 0.5).select(*K, "part")


@add(Q.query("SELECT run_id, track_id, frame, (x1 + x2) / 2 AS xc, (y1 + y2) / 2 AS yc, x2 - x1 AS w, y2 - y1 AS h, round((x2 - x1) / (y2 - y1), 6) AS aspect, (x2 - x1) * (y2 - y1) AS area FROM detections"))
def P8_box_formats(spark, d):
    c = [F.col(x) for x in ("x1", "y1", "x2", "y2")]
    xc, yc, w, h = G.xyxy_to_xywh(*c)
    return X.detections(spark, d).select(*K, xc.alias("xc"), yc.alias("yc"), w.alias("w"), h.alias("h"), r6(G.tlwh_to_xyah(*G.xyxy_to_tlwh(*c))[2]).alias("aspect"), G.xyxy_to_xysr(*c)[2].alias("area"))


H = (0.5, 0.02, 3.0, 0.01, 0.6, -2.0, 0.0001, 0.0002, 1.0)
_w = "(0.0001 * {x} + 0.0002 * {y} + 1.0)"
_px = "(0.5 * {x} + 0.02 * {y} + 3.0) / " + _w
_py = "(0.01 * {x} + 0.6 * {y} - 2.0) / " + _w


@add(Q.query(f"SELECT run_id, track_id, frame, round({_px.format(x='x1', y='y1')}, 6) AS mx, round({_py.format(x='x1', y='y1')}, 6) AS my, round(x1, 4) AS back_x, round(y1, 4) AS back_y FROM detections"))
def P9_homography(spark, d):
    p = X.detections(spark, d).withColumn("m", G.project(F.col("x1"), F.col("y1"), H))
    back = G.project(F.col("m.x"), F.col("m.y"), G.invert(H))
    # the way back may end in -0.0
    return p.select(*K, r6("m.x").alias("mx"), r6("m.y").alias("my"), (F.round(back["x"], 4) + 0.0).alias("back_x"), (F.round(back["y"], 4) + 0.0).alias("back_y"))


@add(Q.query(f"SELECT run_id, track_id, frame, round({_px.format(x='(x1 + x2) / 2', y='y2')}, 6) AS mx, round({_py.format(x='(x1 + x2) / 2', y='y2')}, 6) AS my FROM detections"))
def P10_box_to_map(spark, d):
    foot = G.box_bottom(*(F.col(x) for x in ("x1", "y1", "x2", "y2")))
    m = G.project(foot["x"], foot["y"], H)
    return X.detections(spark, d).select(*K, r6(m["x"]).alias("mx"), r6(m["y"]).alias("my"))


@add(Q.query(f"SELECT run_id, track_id, frame, round(sqrt(power({_px.format(x='x1', y='y1')} - map_x, 2) + power({_py.format(x='x1', y='y1')} - map_y, 2)), 6) AS error FROM detections"))
def P11_calibration_error(spark, d):
    m = G.project(F.col("x1"), F.col("y1"), H)
    return X.detections(spark, d).select(*K, r6(F.hypot(m["x"] - F.col("map_x"), m["y"] - F.col("map_y"))).alias("error"))


_L = ((22, 0), (450, 0), (450, 200), (250, 200), (250, 316), (22, 316))


@add(Q.query(f"SELECT run_id, track_id, frame, {Q.inside('map_x', 'map_y', _L)} AS inside_list, {Q.inside('map_x', 'map_y', _L)} AS inside_column FROM positions"))
def P12_point_in_polygon(spark, d):
    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in _L])
    x, y = F.col("map_x"), F.col("map_y")
    return pos(spark, d).select(*K, G.point_in_polygon(x, y, _L).alias("inside_list"), G.point_in_polygon(x, y, poly).alias("inside_column"))


_SMALL = ((100, 50), (300, 50), (300, 250), (100, 250))


@add(Q.query(
    f"SELECT run_id, track_id, frame, CASE WHEN {Q.inside('map_x', 'map_y', _SMALL)} THEN map_x WHEN map_x > 100 AND map_x < 300 AND map_y > 50 AND map_y < 250 THEN map_x ELSE greatest(100.0, least(300.0, map_x)) END AS x, "
    f"CASE WHEN {Q.inside('map_x', 'map_y', _SMALL)} THEN map_y ELSE greatest(50.0, least(250.0, map_y)) END AS y FROM positions"
))
def P13_snap_into(spark, d):
    s = G.snap_into(F.col("map_x"), F.col("map_y"), _SMALL)
    return pos(spark, d).select(*K, s["x"].alias("x"), s["y"].alias("y"))


@add(Q.query(f"SELECT run_id, track_id, frame, round({Q.distance('map_x', 'map_y', ROOM.boundary)}, 6) AS distance, round({Q.distance('map_x', 'map_y', ROOM.boundary)}, 6) AS by_column FROM positions"))
def P14_wall_distance(spark, d):
    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ROOM.boundary])
    x, y = F.col("map_x"), F.col("map_y")
    return pos(spark, d).select(*K, r6(G.boundary_distance(x, y, ROOM.boundary)).alias("distance"), r6(G.boundary_distance(x, y, poly)).alias("by_column"))


_BUFFERED = [G.scaled(p, 1.15) for p in ROOM.doors]


@add(Q.query(
    f"SELECT run_id, track_id, frame, CASE WHEN rk % 13 = 0 THEN 'unknown' WHEN {Q.any_inside('map_x', 'map_y', ROOM.doors)} THEN 'entry' WHEN "
    + "(" + " OR ".join(f"(map_x >= {p[0][0]:.6f} AND map_x < {p[1][0]:.6f} AND map_y >= {p[0][1]:.6f} AND map_y < {p[2][1]:.6f})" for p in _BUFFERED) + ")"
    + f" THEN 'entry_buffer' WHEN {Q.inside('map_x', 'map_y', _SMALL)} THEN 'interior' WHEN map_x >= 90 AND map_x < 310 AND map_y >= 40 AND map_y < 260 THEN 'boundary_band' ELSE 'outside' END AS location FROM positions"
))
def P15_birth_location(spark, d):
    x = F.expr("CASE WHEN rk % 13 = 0 THEN NULL ELSE map_x END")
    return pos(spark, d).select(*K, G.birth_location(x, F.col("map_y"), _SMALL, ROOM.doors, pad=0.1).alias("location"))


@add(Q.query(f"SELECT run_id, track_id, frame, CASE sign WHEN 1 THEN 'A' WHEN -1 THEN 'B' ELSE 'UNKNOWN' END AS side FROM (SELECT run_id, track_id, start_frame AS frame, sign FROM vectors)", Q.TEAM, Q.VECTORS))
def P24_entry_side(spark, d):
    p = pos(spark, d)
    return entry.entry_vectors(p, team(p), ROOM).select("run_id", "track_id", F.col("start_frame").alias("frame"), "side")


@add(Q.query("SELECT run_id, track_id, frame, CASE WHEN frame % 7 = 0 THEN 0.0 WHEN (frame % 50) / 10.0 >= frame % 7 THEN 0.0 ELSE round(exp(-((frame % 50) / 10.0) / (frame % 7 - (frame % 50) / 10.0)), 6) END AS score FROM positions"))
def P25_time_penalty(spark, d):
    return pos(spark, d).select(*K, r6(S.time_penalty((F.col("frame") % 50) / 10.0, (F.col("frame") % 7).cast("double"))).alias("score"))


@add(Q.query("SELECT run_id, track_id, frame, round(exp(-power(greatest(0.0, (frame % 90) / 30.0 - CASE WHEN track_id = 2 THEN 2.0 ELSE 1.0 END), 2) / 0.5), 6) AS score FROM positions"))
def P26_hesitation(spark, d):
    return pos(spark, d).select(*K, r6(S.hesitation((F.col("frame") % 90) / 30.0, S.allowed_gap(F.col("track_id")))).alias("score"))


@add(Q.query("SELECT run_id, track_id, frame, round(exp(-(power(map_x - 75, 2) + power(map_y - 263, 2)) / 5000.0), 6) AS score FROM positions"))
def P27_hold(spark, d):
    return pos(spark, d).select(*K, r6(S.hold(F.hypot(F.col("map_x") - 75, F.col("map_y") - 263))).alias("score"))


@add(Q.query("SELECT DISTINCT run_id, 22 + CAST(trunc(p * 428) AS INT) AS tl_x, CAST(trunc(p * 316) AS INT) AS tl_y, CAST(trunc(450 - p * 428) AS INT) AS br_x, CAST(trunc(316 - p * 316) AS INT) AS br_y FROM (SELECT run_id, CAST(0.25 AS DOUBLE) AS p FROM runs)"))
def P35_wall_polygon(spark, d):
    poly = G.wall_polygon(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ROOM.boundary]), 0.25)
    out = X.runs(pos(spark, d)).withColumn("w", poly)
    return out.select("run_id", *[F.get("w", F.lit(k))[c].alias(f"{n}_{c}") for k, n in ((0, "tl"), (2, "br")) for c in ("x", "y")])


@add(Q.query("SELECT run_id, track_id, frame, CAST(22 + 2 * (frame % 40) AS DOUBLE) AS x, CAST(2 * (frame % 30) AS DOUBLE) AS y FROM positions"))
def P36_place_from_walls(spark, d):
    one, zero = F.lit(1.0), F.lit(0.0)
    s = G.place_from_walls(F.lit(22.0), F.lit(0.0), (one, zero), (zero, one), (F.col("frame") % 30).cast("double"), (F.col("frame") % 40).cast("double"), F.lit(2.0))
    return pos(spark, d).select(*K, s["x"].alias("x"), s["y"].alias("y"))


@add(Q.query(f"SELECT run_id, track_id, frame, CASE WHEN dist < 0.5 * 25 THEN 'too_close' WHEN dist > 25 THEN 'too_far' ELSE 'safe' END AS band FROM (SELECT *, {Q.distance('map_x', 'map_y', ROOM.boundary)} AS dist FROM positions)"))
def P37_wall_band(spark, d):
    return pos(spark, d).select(*K, S.wall_band(G.boundary_distance(F.col("map_x"), F.col("map_y"), ROOM.boundary), F.lit(25.0), near=0.5).alias("band"))


@add(Q.query("SELECT run_id, track_id, frame, CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'at' ELSE 'above' END WHEN a / b >= 1 THEN 'above' WHEN a / b >= 0.9 THEN 'at' WHEN a / b >= 0.7 THEN 'near' ELSE 'below' END AS band FROM (SELECT *, CAST(frame % 11 AS DOUBLE) AS a, CAST(rk % 10 AS DOUBLE) AS b FROM positions)"))
def P34_relative_band(spark, d):
    return pos(spark, d).select(*K, S.relative_band((F.col("frame") % 11).cast("double"), (F.col("rk") % 10).cast("double")).alias("band"))


@add(Q.query("SELECT run_id, track_id, frame, printf('Your score of %.2f is %s the reference''s %.2f.', a, CASE WHEN a - b > 0.05 THEN 'above' WHEN a - b < -0.05 THEN 'below' ELSE 'in line with' END, b) AS sentence FROM (SELECT *, CAST(frame % 9 AS DOUBLE) / 4 AS a, CAST(rk % 10 AS DOUBLE) / 4 AS b FROM positions)"))
def P38_comparison_sentence(spark, d):
    return pos(spark, d).select(*K, S.comparison_sentence((F.col("frame") % 9).cast("double") / 4, (F.col("rk") % 10).cast("double") / 4).alias("sentence"))


@add("SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, coalesce(t[1], '') AS first_token, coalesce(t[len(t)], '') AS last_token, (list_contains(t, 'the') AND list_contains(t, 'of')) AS has_both FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\w\\s'']+', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9 ''.,\n]', '', 'g') AS text FROM documents))")
def P30_tokens(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace("text", r"[^a-zA-Z0-9 '.,\n]", "").alias("text"))
    t = docs.withColumn("t", S.tokens(F.coalesce("text", F.lit(""))))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"), F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).alias("last_token"), S.has_all(F.col("t"), ["the", "of"]).alias("has_both"))


P31_has_required = lambda spark, d: P30_tokens(spark, d).select("doc_id", "has_both")
QUERIES["P31_has_required"] = P31_has_required
ORACLES["P31_has_required"] = f"SELECT doc_id, has_both FROM ({ORACLES['P30_tokens']})"


@add("SELECT event_id, concat_ws('_', event_type, CASE WHEN s = '' THEN 'untitled' ELSE left(s, 12) END, strftime(ts, '%Y%m%d_%H%M%S')) AS run_id FROM (SELECT *, trim(regexp_replace(props, '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS s FROM events)")
def P33_run_id(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.concat_ws("_", "event_type", S.slug(F.col("props"), 12), F.date_format("ts", "yyyyMMdd_HHmmss")).alias("run_id"))


@add(Q.query("SELECT run_id, track_id, count(*) AS n_samples, min(frame) AS first_frame, max(frame) AS last_frame FROM positions GROUP BY ALL"))
def A1_track_spans(spark, d):
    return roles.track_spans(pos(spark, d))


@add(Q.query("SELECT run_id, track_id FROM detections GROUP BY ALL HAVING bool_or(identity_role = 'inroom' OR is_inroom) OR (count(identity_role) = 0 AND track_id >= 99)"))
def A2_inroom_ids(spark, d):
    return roles.inroom_ids(X.detections(spark, d))


@add(Q.query("SELECT run_id, track_id FROM detections GROUP BY ALL HAVING bool_or(coalesce(identity_role = 'entry', false) OR is_entry)"))
def A3_entry_ids(spark, d):
    return roles.entry_ids(X.detections(spark, d))


@add(Q.query("SELECT run_id, track_id, CASE WHEN inroom THEN 'inroom' ELSE 'entry' END AS role FROM (SELECT *, CASE WHEN bool_or(entry) OVER (PARTITION BY run_id) THEN entry ELSE NOT inroom END AS e FROM (SELECT run_id, track_id, max(identity_role) AS role, coalesce(max(identity_role) = 'inroom', false) AS inroom, coalesce(max(identity_role) = 'entry', false) AS entry FROM detections GROUP BY ALL)) WHERE inroom OR e"))
def A4_inferred_roles(spark, d):
    return roles.inferred_roles(X.detections(spark, d))


@add(Q.query("SELECT run_id, min(frame) AS first_frame FROM friends GROUP BY run_id"))
def A5_first_entry(spark, d):
    p = pos(spark, d)
    return roles.first_frame(p, p.where("track_id <> 99").select("run_id", "track_id").distinct())


@add(Q.query("SELECT run_id, min(frame) AS start_frame FROM detections WHERE is_entry GROUP BY run_id"))
def A6_drill_start(spark, d):
    return roles.drill_start(X.detections(spark, d))


@add(Q.query("SELECT run_id, track_id, entry_number, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy, n_fit FROM vectors", Q.TEAM, Q.VECTORS))
def A21_entry_velocity(spark, d):
    p = pos(spark, d)
    return entry.entry_vectors(p, team(p), ROOM).select("run_id", "track_id", "entry_number", (F.round("dx", 4) + 0.0).alias("dx"), (F.round("dy", 4) + 0.0).alias("dy"), "n_fit")


@add(Q.query("SELECT run_id, coalesce(round_even(s, 2), -1.0) AS score FROM runs LEFT JOIN (SELECT run_id, avg(CAST(alternates AS INT)) AS s FROM turns GROUP BY run_id) USING (run_id)", Q.TEAM, Q.VECTORS, Q.transitions(True)))
def A22_entrance_vectors(spark, d):
    return M.REGISTRY.run(tables(spark, d), ROOM, ["entrance_vectors"]).select("run_id", "score")


@add(Q.query("SELECT run_id, coalesce(round(s, 2), -1.0) AS score FROM runs LEFT JOIN (SELECT run_id, avg(score) AS s FROM gap_scores GROUP BY run_id) USING (run_id)", Q.TEAM, Q.GAPS))
def A23_hesitation(spark, d):
    return M.REGISTRY.run(tables(spark, d), ROOM, ["entrance_hesitation"]).select("run_id", "score")


@add(Q.query("SELECT run_id, n_entries, start_frame, end_frame, round(duration_sec, 6) AS duration_sec, limit_sec, score, violation FROM total", Q.TEAM, Q.TOTAL))
def A24_total_entry(spark, d):
    return entry.total_entry(team(pos(spark, d)), ROOM).withColumn("duration_sec", r6("duration_sec"))


@add(Q.query("SELECT run_id, count(DISTINCT track_id) AS n_tracks FROM positions GROUP BY run_id"))
def A30_distinct_tracks(spark, d):
    return pos(spark, d).groupBy("run_id").agg(F.count_distinct("track_id").alias("n_tracks"))


@add(Q.query("SELECT run_id, entry_number, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM chosen GROUP BY GROUPING SETS ((run_id, entry_number), (run_id))", Q.TEAM))
def A31_overall_row(spark, d):
    t = team(pos(spark, d))
    return t.rollup("run_id", "entry_number").agg(F.sum("n_samples").alias("n_samples")).where("run_id is not null")


@add(Q.query("SELECT run_id, track_id, entry_number FROM entrants"))
def W1_entry_number(spark, d):
    p = pos(spark, d)
    return roles.entrants(p, X.inroom(p)).select("run_id", "track_id", "entry_number")


@add(Q.query("SELECT run_id, pair_number, to_entry, from_track, to_track, from_frame, to_frame, round(gap_sec, 6) AS gap_sec, allowed_sec, round(score, 6) AS score, violation FROM gap_scores", Q.TEAM, Q.GAPS))
def W2_pair_gaps(spark, d):
    g = entry.pair_gaps(team(pos(spark, d)), ROOM)
    return g.select("run_id", "pair_number", "to_entry", "from_track", "to_track", "from_frame", "to_frame", r6("gap_sec").alias("gap_sec"), "allowed_sec", r6("score").alias("score"), "violation")


@add(Q.query("SELECT run_id, from_entry, to_entry, from_sign, to_sign, alternates FROM turns", Q.TEAM, Q.VECTORS, Q.transitions(True)))
def W3_alternation(spark, d):
    p = pos(spark, d)
    return entry.vector_transitions(entry.entry_vectors(p, team(p), ROOM), True).select("run_id", "from_entry", "to_entry", "from_sign", "to_sign", "alternates")


_BAND = f"banded AS (SELECT *, CASE WHEN {Q.distance('map_x', 'map_y', ROOM.boundary)} > 25 THEN 'too_far' ELSE 'safe' END AS label FROM positions)"
_ISLANDS = "islands AS (SELECT run_id, track_id, label, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames FROM (SELECT *, frame - row_number() OVER (PARTITION BY run_id, track_id, label ORDER BY frame) AS g FROM banded) GROUP BY run_id, track_id, label, g)"


@add(Q.query("SELECT * FROM islands", _BAND, _ISLANDS))
def W4_label_runs(spark, d):
    label = S.wall_band(G.boundary_distance(F.col("map_x"), F.col("map_y"), ROOM.boundary), F.lit(25.0))
    return frames.islands(pos(spark, d).withColumn("label", label), "label")


@add(Q.query("SELECT run_id, track_id, g AS frame, CASE WHEN g = frame THEN map_x ELSE round(map_x + (nx - map_x) * ((g - frame) / (nf - frame)), 6) END AS map_x, CASE WHEN g = frame THEN map_y ELSE round(map_y + (ny - map_y) * ((g - frame) / (nf - frame)), 6) END AS map_y, g <> frame AS filled FROM (SELECT *, unnest(CASE WHEN nf - frame > 1 AND nf - frame < 20 THEN range(frame, nf) ELSE [frame] END) AS g FROM (SELECT *, lead(frame) OVER w AS nf, lead(map_x) OVER w AS nx, lead(map_y) OVER w AS ny FROM positions WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame)))"))
def W12_interpolation(spark, d):
    out = frames.interpolated(pos(spark, d))
    return out.withColumn("map_x", r6("map_x")).withColumn("map_y", r6("map_y"))


@add(Q.query("SELECT run_id, track_id, frame FROM (SELECT *, lag(CAST(trunc(map_x / 4) AS INT)) OVER w AS px, lag(CAST(trunc(map_y / 4) AS INT)) OVER w AS py FROM positions WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame)) WHERE px IS NULL OR px <> CAST(trunc(map_x / 4) AS INT) OR py <> CAST(trunc(map_y / 4) AS INT)"))
def W13_without_repeats(spark, d):
    return frames.without_repeats(pos(spark, d).withColumn("map_x", F.col("map_x") / 4).withColumn("map_y", F.col("map_y") / 4)).select(*K)


@add(Q.query("SELECT run_id, track_id, frame, CASE WHEN n > 0 THEN round(dx / n, 6) WHEN n = 0 THEN 0.0 END AS vx, CASE WHEN n > 0 THEN round(dy / n, 6) WHEN n = 0 THEN 0.0 END AS vy FROM (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM (SELECT *, map_x - lag(map_x) OVER w AS dx, map_y - lag(map_y) OVER w AS dy FROM positions WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame)))"))
def W14_map_velocity(spark, d):
    return frames.map_velocity(pos(spark, d)).select(*K, r6("vx").alias("vx"), r6("vy").alias("vy"))


@add(Q.query("SELECT run_id, track_id, frame, CASE WHEN frame - f2 = 2 THEN (map_x - x2) / 2 END AS vx, CASE WHEN frame - f2 = 2 THEN (map_y - y2) / 2 END AS vy FROM (SELECT *, lag(frame, 2) OVER w AS f2, lag(map_x, 2) OVER w AS x2, lag(map_y, 2) OVER w AS y2 FROM positions WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame))"))
def W15_steady_velocity(spark, d):
    return frames.steady_velocity(pos(spark, d)).select(*K, "vx", "vy")


_SMOOTH = """path_ AS (SELECT run_id, track_id, list({'f': frame, 'x': map_x, 'y': map_y} ORDER BY frame) AS p FROM positions GROUP BY ALL),
smooth AS (SELECT run_id, track_id, 1 AS k, p, p[1].x AS x, p[1].y AS y FROM path_
  UNION ALL SELECT run_id, track_id, k + 1, p, w * p[k + 1].x + (1 - w) * x, w * p[k + 1].y + (1 - w) * y FROM (SELECT *, least(0.3, greatest(0.1, 1 - sqrt(power(p[k + 1].x - x, 2) + power(p[k + 1].y - y, 2)) / 5.0)) AS w FROM smooth WHERE k < len(p)))"""


@add(Q.recursive("SELECT run_id, track_id, p[k].f AS frame, round(x, 6) AS map_x, round(y, 6) AS map_y FROM smooth", _SMOOTH))
def W16_smoothed(spark, d):
    out = frames.smoothed(pos(spark, d))
    return out.withColumn("map_x", r6("map_x")).withColumn("map_y", r6("map_y"))


@add(Q.query("SELECT run_id, track_id, frame, from_frame, from_x, from_y, map_x AS to_x, map_y AS to_y FROM (SELECT *, lag(frame) OVER w AS from_frame, lag(map_x) OVER w AS from_x, lag(map_y) OVER w AS from_y FROM friends WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame)) WHERE from_frame IS NOT NULL"))
def W17_trail(spark, d):
    return frames.trail(pos(spark, d).where("track_id <> 99"))


@add(Q.query("SELECT t.run_id, t.track_id, t.frame, map_x, map_y FROM (SELECT run_id, track_id, unnest(range(1, n + 1)) AS frame FROM (SELECT DISTINCT run_id, track_id FROM positions) JOIN (SELECT run_id, max(frame) AS n FROM positions GROUP BY run_id) USING (run_id)) t LEFT JOIN positions USING (run_id, track_id, frame)"))
def W18_dense(spark, d):
    p = pos(spark, d)
    return frames.dense(p.select(*K, "map_x", "map_y"), p.groupBy("run_id").agg(F.max("frame").alias("total_frames"))).select(*K, "map_x", "map_y")


@add(None)
def W19_gaussian_smoothed(spark, d):
    out = frames.gaussian_smoothed(pos(spark, d))
    return out.withColumn("map_x", r6("map_x")).withColumn("map_y", r6("map_y"))


@add(Q.query("SELECT run_id, track_id, n_samples, first_frame, last_frame, entry_number FROM chosen", Q.TEAM))
def T1_entrants(spark, d):
    return team(pos(spark, d))


@add(Q.query("SELECT run_id, track_id, frame FROM friends"))
def J2_without_inroom(spark, d):
    p = pos(spark, d)
    return roles.without(p, X.inroom(p)).select(*K)


@add(Q.query(f"SELECT run_id, track_id, frame, {Q.door_index('map_x', 'map_y', Q.DOORS)} AS door_index FROM positions"))
def J6_door(spark, d):
    return pos(spark, d).select(*K, entry.door_of(F.col("map_x"), F.col("map_y"), ROOM.axes()).alias("door_index"))


@add(Q.query("SELECT DISTINCT run_id, track_id FROM friends"))
def U3_entry_complement(spark, d):
    p = pos(spark, d)
    return p.select("run_id", "track_id").distinct().join(X.inroom(p), ["run_id", "track_id"], "left_anti")


@add(Q.query("SELECT run_id, entry_number, track_id, first_frame AS start_frame, round((first_frame - 1) / 30.0, 3) AS start_time, n_samples FROM chosen", Q.TEAM))
def R1_entries(spark, d):
    t = team(pos(spark, d))
    return t.select("run_id", "entry_number", "track_id", F.col("first_frame").alias("start_frame"), S.frame_time(F.col("first_frame"), F.lit(ROOM.fps)).alias("start_time"), "n_samples")


@add(Q.query("SELECT run_id, entry_number, track_id, start_frame, start_x, start_y, door_index, 'STRAIGHT' AS door_type, sign FROM vectors", Q.TEAM, Q.VECTORS))
def R2_entry_vectors(spark, d):
    p = pos(spark, d)
    return entry.entry_vectors(p, team(p), ROOM).select("run_id", "entry_number", "track_id", "start_frame", "start_x", "start_y", "door_index", "door_type", "sign")


@add(Q.query("SELECT run_id, transition_number, from_entry, to_entry, start_frame, end_frame, alternates FROM turns", Q.TEAM, Q.VECTORS, Q.transitions(False)))
def R3_vector_transitions(spark, d):
    p = pos(spark, d)
    return entry.vector_transitions(entry.entry_vectors(p, team(p), ROOM)).select("run_id", "transition_number", "from_entry", "to_entry", "start_frame", "end_frame", "alternates")


@add(Q.query("SELECT run_id, pair_number, from_frame, to_frame, 'entrance_pair_time_violation_' || pair_number AS flag_id FROM gap_scores WHERE violation", Q.TEAM, Q.GAPS))
def R4_pair_gap_flags(spark, d):
    g = entry.pair_gaps(team(pos(spark, d)), ROOM).where("violation")
    return g.select("run_id", "pair_number", "from_frame", "to_frame", F.concat(F.lit("entrance_pair_time_violation_"), F.col("pair_number").cast("string")).alias("flag_id"))


@add(Q.query("SELECT run_id, n_entries, start_frame, end_frame, round((start_frame - 1) / 30.0, 3) AS start_time, round((end_frame - 1) / 30.0, 3) AS end_time, score FROM total", Q.TEAM, Q.TOTAL))
def R5_total_entry_row(spark, d):
    t = entry.total_entry(team(pos(spark, d)), ROOM)
    return t.select("run_id", "n_entries", "start_frame", "end_frame", S.frame_time(F.col("start_frame"), F.lit(ROOM.fps)).alias("start_time"), S.frame_time(F.col("end_frame"), F.lit(ROOM.fps)).alias("end_time"), "score")


_FLAGS = """flags AS (
SELECT v.run_id, 'entrance_vector_unknown_' || v.entry_number AS flag_id, 'vector_unknown' AS type, c.first_frame AS frame, NULL AS end_frame FROM vectors v JOIN chosen c USING (run_id, track_id) WHERE sign = 0
UNION ALL SELECT run_id, 'entrance_vector_direction_violation_' || transition_number, 'vector_direction_violation', start_frame, end_frame FROM turns WHERE NOT alternates
UNION ALL SELECT run_id, 'entrance_pair_time_violation_' || pair_number, 'pair_time_violation', from_frame, to_frame FROM gap_scores WHERE violation
UNION ALL SELECT run_id, 'entrance_total_entry_time_violation', 'total_entry_time_violation', start_frame, end_frame FROM total WHERE violation)"""
_ENTRY = (Q.TEAM, Q.VECTORS, Q.transitions(False), Q.GAPS, Q.TOTAL, _FLAGS)


def _flags(spark, d):
    p = pos(spark, d)
    t = team(p)
    v = entry.entry_vectors(p, t, ROOM)
    return entry.entry_flags(v, entry.vector_transitions(v), entry.pair_gaps(t, ROOM), entry.total_entry(t, ROOM), t, ROOM)


@add(Q.query("SELECT run_id, flag_id, type, frame, end_frame, 'warning' AS severity, round((frame - 1) / 30.0, 3) AS time_sec FROM flags", *_ENTRY))
def R6_flags(spark, d):
    return _flags(spark, d).select("run_id", "flag_id", "type", "frame", "end_frame", "severity", "time_sec")


@add(Q.query("SELECT run_id, flag_id, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(frame, 1000000000), type, flag_id) AS place FROM flags", *_ENTRY))
def T2_flag_order(spark, d):
    return entry.ordered_flags(_flags(spark, d)).select("run_id", "flag_id", "place")


@add(Q.query("SELECT DISTINCT run_id, flag_id FROM flags", *_ENTRY))
def U5_unique_flags(spark, d):
    f = _flags(spark, d)
    return f.unionByName(f).dropDuplicates(["run_id", "flag_id"]).select("run_id", "flag_id")


_METRICS = """scores AS (SELECT run_id, 'entrance_hesitation' AS metric, coalesce(round(s, 2), -1.0) AS score FROM runs LEFT JOIN (SELECT run_id, avg(score) AS s FROM gap_scores GROUP BY run_id) USING (run_id)
UNION ALL SELECT run_id, 'total_entry_time', score FROM total
UNION ALL SELECT run_id, 'entrance_vectors', coalesce(round_even(s, 2), -1.0) FROM runs LEFT JOIN (SELECT run_id, avg(CAST(alternates AS INT)) AS s FROM turns GROUP BY run_id) USING (run_id))"""
_SCORES = (Q.TEAM, Q.GAPS, Q.TOTAL, Q.VECTORS, Q.transitions(True), _METRICS)


@add(Q.query("SELECT * FROM scores", *_SCORES))
def R10_metrics(spark, d):
    folder = shared_folder(spark, "metrics")
    return M.REGISTRY.run(tables(spark, d, folder), ROOM, ["entrance_hesitation", "total_entry_time", "entrance_vectors"], folder)


@add(Q.query("SELECT metric, count(*) AS n_runs, round(avg(score), 6) AS mean FROM scores GROUP BY metric", *_SCORES))
def X1_metric_plugins(spark, d):
    return R10_metrics(spark, d).groupBy("metric").agg(F.count(F.lit(1)).alias("n_runs"), r6(F.avg("score")).alias("mean"))


@add(Q.query("SELECT * FROM scores WHERE metric = 'total_entry_time'", *_SCORES))
def X2_enabled_metrics(spark, d):
    return M.REGISTRY.run(tables(spark, d), ROOM, ["total_entry_time"])


@add(Q.query("SELECT run_id FROM runs WHERE run_id % 2 = 1"))
def X3_unprocessed(spark, d):
    r = X.runs(pos(spark, d))
    return registry.unprocessed(r, r.where("run_id % 2 = 0"))


@add(Q.query("SELECT * FROM scores WHERE metric = 'entrance_vectors'", *_SCORES))
def X4_assessment(spark, d):
    return registry.assessment(R10_metrics(spark, d), "Entrance_Vectors")
