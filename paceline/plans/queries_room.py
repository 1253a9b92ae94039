"""Registered queries: keypoints, wall, gaze, coverage, pods, pairs, transcripts; with their SQL where SQL expresses them."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import entry, frames, gaze, pairs, pods, transcript, wall
from . import fixtures as X
from . import queries_entry as E
from . import sqltext as Q
from .fixtures import ROOM
from .queries_entry import K, pos, r6, team

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
H, ANGLE, COVER = E.H, 40.0, 60.0
BOX = ("x1", "y1", "x2", "y2")


def add(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def boxcols():
    return [F.col(c) for c in BOX]


# ---- keypoints -------------------------------------------------------------


@add(Q.query("SELECT run_id, track_id, frame, round(list_sum(list_transform(k, lambda p: CASE WHEN p.score < 0.4 THEN 0 ELSE p.score END)), 6) AS weak, round(list_sum(list_transform(k, lambda p: p.x)), 6) AS xs FROM keypoints"))
def P6_weak_keypoints(spark, d):
    k = X.keypoints(spark, d).withColumn("w", frames.weak_keypoints_zeroed(F.col("keypoints"), 0.4))
    total = lambda c: F.aggregate("w", F.lit(0.0), lambda a, p: a + p[c])
    return k.select(*K, r6(total("score")).alias("weak"), r6(total("x")).alias("xs"))


@add(Q.query("SELECT run_id, track_id, frame, round(k[2].x / 8, 2) AS x, round(k[3].y / 8, 2) AS y, round(k[4].score / 16, 3) AS score FROM keypoints"))
def P7_quantized(spark, d):
    k = X.keypoints(spark, d).withColumn("q", frames.quantized(F.transform("keypoints", lambda p: F.struct((p["x"] / 8).alias("x"), (p["y"] / 8).alias("y"), (p["score"] / 16).alias("score")))))
    return k.select(*K, F.expr("q[1].x").alias("x"), F.expr("q[2].y").alias("y"), F.expr("q[3].score").alias("score"))


_ANCHOR = "CASE WHEN k[16].score >= 0.5 AND k[17].score >= 0.5 THEN (k[16].{c} + k[17].{c}) / 2 ELSE {e} END"


@add(Q.query(f"SELECT run_id, track_id, frame, {_ANCHOR.format(c='x', e='(x1 + x2) / 2')} AS x, {_ANCHOR.format(c='y', e='y2')} AS y FROM keypoints"))
def P16_floor_anchor(spark, d):
    a = wall.floor_anchor(F.col("keypoints"), boxcols(), 0.5)
    return X.keypoints(spark, d).select(*K, a["x"].alias("x"), a["y"].alias("y"))


_P = "CASE WHEN k[{i}].score > 0.3 THEN k[{i}].{c} END"


def _mid(a: int, b: int, c: str) -> str:
    return f"({_P.format(i=a, c=c)} + {_P.format(i=b, c=c)}) / 2"


_GV = ", ".join(f"coalesce({_mid(2, 3, c)}, {_P.format(i=1, c=c)}, {_P.format(i=2, c=c)}, {_P.format(i=3, c=c)}) AS o{c}, coalesce({_mid(4, 5, c)}, {_P.format(i=4, c=c)}, {_P.format(i=5, c=c)}) AS e{c}" for c in "xy")


@add(Q.query(f"SELECT run_id, track_id, frame, CASE WHEN n > 0 THEN ox END AS ox, CASE WHEN n > 0 THEN oy END AS oy, CASE WHEN n > 0 THEN round((ox - ex) / n, 6) END AS dx, CASE WHEN n > 0 THEN round((oy - ey) / n, 6) END AS dy FROM (SELECT *, sqrt((ox - ex) * (ox - ex) + (oy - ey) * (oy - ey)) AS n FROM (SELECT run_id, track_id, frame, {_GV} FROM keypoints))"))
def P18_gaze_vector(spark, d):
    g = X.keypoints(spark, d).withColumn("g", gaze.gaze_vector(F.col("keypoints")))
    return g.select(*K, "g.ox", "g.oy", r6("g.dx").alias("dx"), r6("g.dy").alias("dy"))


@add(Q.query("SELECT run_id, track_id, frame, ((k[10].score > 0 AND k[10].x BETWEEN x1 + 10 AND x2 AND k[10].y BETWEEN y1 AND y2 - 30) OR (k[11].score > 0 AND k[11].x BETWEEN x1 + 10 AND x2 AND k[11].y BETWEEN y1 AND y2 - 30)) AS inside FROM keypoints"))
def P22_wrist_inside(spark, d):
    box = [F.col("x1") + 10, F.col("y1"), F.col("x2"), F.col("y2") - 30]
    return X.keypoints(spark, d).select(*K, gaze.wrist_inside(F.col("keypoints"), box).alias("inside"))


def _group(ks) -> str:
    return f"list_filter([{', '.join(f'k[{i + 1}]' for i in ks)}], lambda p: p.score > 0.5)"


@add(Q.query(f"SELECT run_id, track_id, frame, CAST(len(h) AS INT) AS support, round(list_avg(list_transform(h, lambda p: p.x)), 6) AS x, round(list_avg(list_transform(h, lambda p: p.score)), 6) AS confidence FROM (SELECT *, {_group((11, 12, 19))} AS h FROM keypoints) WHERE len(h) > 0"))
def P28_pose_anchors(spark, d):
    a = X.keypoints(spark, d).withColumn("h", F.try_element_at(pairs.anchors(F.col("keypoints"), 0.5), F.lit("hip")))
    return a.where("h is not null").select(*K, F.col("h.support").alias("support"), r6("h.x").alias("x"), r6("h.confidence").alias("confidence"))


@add(Q.query("SELECT run_id, track_id, frame, greatest(y2 - y1, 0.75 * (x2 - x1) * 4, 1.0) AS scale FROM detections"))
def P29_pose_scale(spark, d):
    return X.detections(spark, d).select(*K, pairs.pose_scale([F.col("x1") * 4, F.col("y1"), F.col("x2") * 4, F.col("y2")]).alias("scale"))


# ---- cones and boxes -------------------------------------------------------


def _cones(half: float, length: float = 10000.0, source: str = "gaze", name: str = "cones") -> str:
    c, s = repr(math.cos(math.radians(half))), repr(math.sin(math.radians(half)))
    z = "CASE WHEN n = 0 THEN 0.0 ELSE {} END"
    cols = ["ox", "oy", f"ox + ({c} * ux - {s} * uy) * {length!r}", f"oy + ({s} * ux + {c} * uy) * {length!r}", f"ox + ({c} * ux + {s} * uy) * {length!r}", f"oy + ({c} * uy - {s} * ux) * {length!r}"]
    named = ", ".join(f"{z.format(x)} AS {n}" for x, n in zip(cols, gaze._T, strict=True))
    return f"{name} AS (SELECT run_id, track_id, frame, n = 0 AS blank, {named} FROM (SELECT *, dx / n AS ux, dy / n AS uy FROM (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM {source})))"


def _sat(t: str, b: str) -> str:
    tx, ty = [f"{t}.t{k}x" for k in range(3)], [f"{t}.t{k}y" for k in range(3)]
    x1, y1, x2, y2 = (f"{b}.{c}" for c in BOX)
    parts = [f"least({', '.join(tx)}) < {x2}", f"greatest({', '.join(tx)}) > {x1}", f"least({', '.join(ty)}) < {y2}", f"greatest({', '.join(ty)}) > {y1}"]
    for k in range(3):
        j = (k + 1) % 3
        nx, ny = f"({ty[k]} - {ty[j]})", f"({tx[j]} - {tx[k]})"
        p = [f"{nx} * {a} + {ny} * {c}" for a, c in zip(tx, ty, strict=True)]
        q = [f"{nx} * {a} + {ny} * {c}" for a, c in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
        parts += [f"least({', '.join(p)}) < greatest({', '.join(q)})", f"least({', '.join(q)}) < greatest({', '.join(p)})"]
    return "(" + " AND ".join(parts) + ")"


@add(Q.query("SELECT run_id, track_id, frame, " + ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in gaze._T) + " FROM cones", _cones(15.0)))
def P19_cone(spark, d):
    return gaze.with_cone(X.gaze(spark, d), 15.0).select(*K, *[(F.round(c, 3) + 0.0).alias(c) for c in gaze._T])


_OTHERS = "SELECT c.run_id, c.frame, c.track_id AS viewer, b.track_id AS target, {x} AS hit FROM cones c JOIN detections b ON c.run_id = b.run_id AND c.frame = b.frame AND c.track_id <> b.track_id"


@add(Q.query(_OTHERS.format(x=_sat("c", "b")), _cones(ANGLE / 2)))
def P20_cone_meets_box(spark, d):
    c = gaze.with_cone(X.gaze(spark, d), ANGLE / 2).withColumnRenamed("track_id", "viewer")
    b = X.detections(spark, d).select("run_id", "frame", F.col("track_id").alias("target"), *BOX)
    return c.join(b, ["run_id", "frame"]).where("viewer <> target").select("run_id", "frame", "viewer", "target", gaze.sees().alias("hit"))


_TOUCH = "touching AS (SELECT a.run_id, a.frame, a.track_id AS inroom_id, b.track_id AS friend_id, a.x1, a.y1, a.x2, a.y2 FROM detections a JOIN detections b ON a.run_id = b.run_id AND a.frame = b.frame AND a.track_id = 99 AND b.track_id <> 99 WHERE a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2)"


def _sides(spark, d):
    b = X.detections(spark, d)
    return b.where("track_id = 99"), b.where("track_id <> 99")


@add(Q.query("SELECT run_id, frame, inroom_id, friend_id FROM touching", _TOUCH))
def P21_boxes_touch(spark, d):
    return gaze.touching_pairs(*_sides(spark, d)).select("run_id", "frame", "inroom_id", "friend_id")


@add(Q.query(f"SELECT p.run_id, p.frame, inroom_id, friend_id, coalesce({_sat('c', 'p')}, false) AS looks FROM touching p LEFT JOIN cones c ON c.run_id = p.run_id AND c.frame = p.frame AND c.track_id = friend_id", _TOUCH, _cones(ANGLE / 2)))
def J3_contact_pairs(spark, d):
    return gaze.contact(gaze.touching_pairs(*_sides(spark, d)), X.gaze(spark, d), ANGLE).select("run_id", "frame", "inroom_id", "friend_id", "looks")


_WRIST = "((k[10].score > 0 AND k[10].x BETWEEN p.x1 AND p.x2 AND k[10].y BETWEEN p.y1 AND p.y2) OR (k[11].score > 0 AND k[11].x BETWEEN p.x1 AND p.x2 AND k[11].y BETWEEN p.y1 AND p.y2))"
_CLEAR = f"""contact AS (SELECT p.run_id, p.frame, inroom_id, friend_id, coalesce({_sat('c', 'p')}, false) AS looks, coalesce({_WRIST}, false) AS reaches
  FROM touching p LEFT JOIN cones c ON c.run_id = p.run_id AND c.frame = p.frame AND c.track_id = friend_id LEFT JOIN keypoints q ON q.run_id = p.run_id AND q.frame = p.frame AND q.track_id = friend_id),
islands_ AS (SELECT *, frame - row_number() OVER (PARTITION BY run_id, inroom_id, friend_id ORDER BY frame) AS g FROM contact),
counts_ AS (SELECT *, sum(CAST(reaches AS INT)) OVER w AS nw, sum(CAST(looks AS INT)) OVER w AS ng FROM islands_ WINDOW w AS (PARTITION BY run_id, inroom_id, friend_id, g ORDER BY frame)),
valid_ AS (SELECT run_id, inroom_id, friend_id, count(*) AS n, min(CASE WHEN nw >= 1 AND ng >= 1 THEN frame END) AS start_frame, max(frame) AS end_frame FROM counts_ GROUP BY run_id, inroom_id, friend_id, g),
contact_runs AS (SELECT run_id, inroom_id, friend_id, start_frame, end_frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id, inroom_id, friend_id ORDER BY end_frame) AS r FROM valid_ WHERE n >= 4 AND start_frame IS NOT NULL) WHERE r = 1),
cleared AS (SELECT t.run_id, t.inroom_id, start_frame, end_frame, friend_id FROM (SELECT DISTINCT run_id, 99 AS inroom_id FROM positions WHERE track_id = 99) t LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, inroom_id ORDER BY start_frame, end_frame, friend_id) AS r FROM contact_runs) WHERE r = 1) b ON b.run_id = t.run_id)"""
_C = (_TOUCH, _cones(ANGLE / 2), _CLEAR)


def _runs_of_contact(spark, d):
    rows = gaze.contact(gaze.touching_pairs(*_sides(spark, d)), X.gaze(spark, d), ANGLE, X.keypoints(spark, d))
    return gaze.contact_runs(rows, frames=4, wrist_frames=1, gaze_frames=1)


def _cleared(spark, d):
    return gaze.clearance(X.inroom(pos(spark, d)), _runs_of_contact(spark, d))


@add(Q.query("SELECT * FROM contact_runs", *_C))
def W6_contact_runs(spark, d):
    return _runs_of_contact(spark, d)


@add(Q.query("SELECT * FROM cleared", *_C))
def T3_clearance(spark, d):
    return _cleared(spark, d)


@add(Q.query("SELECT run_id, coalesce(s, 1.0) AS score FROM runs LEFT JOIN (SELECT run_id, round_even(count(end_frame) / count(*), 2) AS s FROM cleared GROUP BY run_id) USING (run_id)", *_C))
def A15_clearance_score(spark, d):
    return gaze.clearance_scores(X.runs(pos(spark, d)), _cleared(spark, d))


_SEEN = f"seen AS (SELECT b.run_id, b.frame, b.track_id, coalesce(bool_or(c.track_id <> b.track_id AND (c.blank OR {_sat('c', 'b')})), false) AS seen FROM (SELECT * FROM detections WHERE track_id <> 99) b LEFT JOIN (SELECT * FROM team_cones WHERE track_id <> 99) c ON c.run_id = b.run_id AND c.frame = b.frame GROUP BY ALL)"
_S = (_cones(COVER / 2, name="team_cones"), _SEEN)


def _seen(spark, d):
    return gaze.seen_teammates(_sides(spark, d)[1], X.gaze(spark, d).where("track_id <> 99"), COVER)


@add(Q.query("SELECT * FROM seen", *_S))
def J4_seen_teammates(spark, d):
    return _seen(spark, d)


@add(Q.query("SELECT run_id, track_id, count(*) AS present, count(*) FILTER (NOT seen) AS unseen, round(1 - count(*) FILTER (NOT seen) / count(*), 6) AS score FROM seen GROUP BY GROUPING SETS ((run_id, track_id), (run_id))", *_S))
def A13_teammate_coverage(spark, d):
    return gaze.teammate_coverage(_seen(spark, d)).withColumn("score", r6("score"))


@add(Q.query("SELECT run_id, frame, round(sum(s) OVER w / sum(p) OVER w, 4) AS coverage FROM (SELECT run_id, frame, count(*) AS p, count(*) FILTER (seen) AS s FROM seen GROUP BY ALL) WINDOW w AS (PARTITION BY run_id ORDER BY frame)", *_S))
def W8_teammate_curve(spark, d):
    return gaze.teammate_curve(_seen(spark, d)).withColumn("coverage", F.round("coverage", 4))


_ACTIVE = """active AS (SELECT b.* FROM detections b LEFT JOIN cleared c ON c.run_id = b.run_id AND c.inroom_id = b.track_id WHERE b.track_id = 99 AND (c.end_frame IS NULL OR b.frame < c.end_frame)
  AND EXISTS (SELECT 1 FROM friends f WHERE f.run_id = b.run_id AND f.frame = b.frame))"""
_WATCH = f"watched AS (SELECT b.run_id, b.frame, b.track_id, coalesce(bool_or(c.blank OR {_sat('c', 'b')}), false) AS watched FROM active b LEFT JOIN (SELECT * FROM cones WHERE track_id <> 99) c ON c.run_id = b.run_id AND c.frame = b.frame GROUP BY ALL)"
_W = (*_C, _ACTIVE, _WATCH)


def _active(spark, d):
    return gaze.active_threats(X.detections(spark, d), X.inroom(pos(spark, d)), _cleared(spark, d))


def _watched(spark, d):
    return gaze.watched_threats(_active(spark, d), X.gaze(spark, d).where("track_id <> 99"), ANGLE)


@add(Q.query("SELECT run_id, frame, track_id FROM active", *_C, _ACTIVE))
def J5_active_threats(spark, d):
    return _active(spark, d).select("run_id", "frame", "track_id")


@add(Q.query("SELECT run_id, coalesce(p, 0) AS present, coalesce(c, 0) AS covered, round(coalesce(c / p, 1.0), 6) AS score FROM runs LEFT JOIN (SELECT run_id, count(*) AS p, count(*) FILTER (w) AS c FROM (SELECT run_id, frame, bool_or(watched) AS w FROM watched GROUP BY ALL) GROUP BY run_id) USING (run_id)", *_W))
def A14_threat_coverage(spark, d):
    return gaze.threat_scores(X.runs(pos(spark, d)), _watched(spark, d)).withColumn("score", r6("score"))


@add(Q.query("SELECT run_id, frame, round(avg(CAST(w AS INT)) OVER (PARTITION BY run_id ORDER BY frame), 6) AS coverage FROM (SELECT run_id, frame, bool_or(watched) AS w FROM watched GROUP BY ALL)", *_W))
def W9_threat_curve(spark, d):
    return gaze.threat_curve(_watched(spark, d)).withColumn("coverage", r6("coverage"))


# ---- room coverage ---------------------------------------------------------

STEP = 20.0
_LEN = 1.5 * math.hypot(428, 316)
_ON_MAP = [(E._px.format(x=x, y=y), E._py.format(x=x, y=y)) for x, y in (("ox", "oy"), ("(ox + dx)", "(oy + dy)"))]
# Gaze goes to the map by its origin and the point one step ahead.
_MAPGAZE = f"mapgaze AS (SELECT run_id, track_id, frame, {_ON_MAP[0][0]} AS ox, {_ON_MAP[0][1]} AS oy, {_ON_MAP[1][0]} - {_ON_MAP[0][0]} AS dx, {_ON_MAP[1][1]} - {_ON_MAP[0][1]} AS dy FROM gaze WHERE track_id <> 99 AND (dx <> 0 OR dy <> 0))"
_turn = "(t{j}x - t{k}x) * (y - t{k}y) - (t{j}y - t{k}y) * (x - t{k}x)"
_turns = [_turn.format(k=k, j=(k + 1) % 3) for k in range(3)]
_CELLS = f"""grid AS (SELECT i AS cx, j AS cy, 22 + (i + 0.5) * {STEP!r} AS x, (j + 0.5) * {STEP!r} AS y FROM range(22) a(i), range(16) b(j)),
cells AS (SELECT run_id, cx, cy, min(frame) AS first_frame FROM mapcones, grid WHERE {Q.inside('x', 'y', ROOM.boundary)} AND (({' AND '.join(f'{t} >= 0' for t in _turns)}) OR ({' AND '.join(f'{t} <= 0' for t in _turns)})) GROUP BY ALL),
n_cells AS (SELECT count(*) AS n FROM grid WHERE {Q.inside('x', 'y', ROOM.boundary)}),
curve AS (SELECT run_id, frame, round(coalesce(sum(c) OVER (PARTITION BY run_id ORDER BY frame), 0) / (SELECT n FROM n_cells), 2) AS fraction FROM (SELECT DISTINCT run_id, frame FROM positions) LEFT JOIN (SELECT run_id, first_frame AS frame, count(*) AS c FROM cells GROUP BY ALL) USING (run_id, frame))"""
_R = (_MAPGAZE, _cones(15.0, _LEN, "mapgaze", "mapcones"), _CELLS)


def _mapgaze(spark, d, rows=None):
    return gaze.on_map(X.gaze(spark, d, rows).where("track_id <> 99"), H)


def _new(spark, d, step=STEP):
    """The cells that a run sees first in a frame, of positions that come together by run while they are narrow."""
    return gaze.newly_seen(_mapgaze(spark, d, X.positions(spark, d, together=True)), ROOM.boundary, 15.0, step)


def _curve(spark, d, step=STEP, new=None):
    return gaze.counted_curve(pos(spark, d), _new(spark, d, step) if new is None else new, len(gaze.cell_grid(ROOM.boundary, step)[0]))


def _summary(spark, d, step=STEP, new=None):
    first = _mapgaze(spark, d).groupBy("run_id").agg(F.min("frame").alias("first_frame"))
    return gaze.coverage_summary(_curve(spark, d, step, new), first, 30.0)


# The queries with SQL have cells of 20 pixels; those named whole have every pixel, for which SQL is too slow.
PIXEL = 1.0


def _whole_curve(spark, d, new=None):
    return _curve(spark, d, PIXEL, new)


def _whole_summary(spark, d, new=None):
    return _summary(spark, d, PIXEL, new)


@add(None)
def A19_room_coverage_whole(spark, d):
    return _whole_curve(spark, d)


@add(None)
def A20_coverage_time_whole(spark, d):
    return _whole_summary(spark, d).withColumn("score", r6(gaze.coverage_time_score(F.col("time_to_full"), F.lit(4.0))))


@add(None)
def W11_rebased_curve_whole(spark, d):
    start = pos(spark, d).where("track_id <> 99").groupBy("run_id").agg(F.min("frame").alias("first_frame"))
    return gaze.rebased_curve(_whole_curve(spark, d), start, 30.0).withColumn("t", r6("t"))


@add(Q.query("SELECT * FROM curve", *_R))
def A19_room_coverage(spark, d):
    return _curve(spark, d)


_SUM = "summary AS (SELECT c.run_id, round((min(CASE WHEN fraction >= 1 THEN frame END) - any_value(f.first_frame)) / 30.0, 2) AS time_to_full, max_by(fraction, frame) AS final_fraction, any_value(f.first_frame) AS first_frame FROM curve c LEFT JOIN (SELECT run_id, min(frame) AS first_frame FROM mapgaze GROUP BY run_id) f ON f.run_id = c.run_id GROUP BY c.run_id)"


@add(Q.query("SELECT run_id, time_to_full, final_fraction, first_frame, CASE WHEN time_to_full IS NULL OR time_to_full >= 8 THEN 0.0 WHEN time_to_full <= 4 THEN 1.0 ELSE round(exp(-(time_to_full - 4) / (8 - time_to_full)), 6) END AS score FROM summary", *_R, _SUM))
def A20_coverage_time(spark, d):
    return _summary(spark, d).withColumn("score", r6(gaze.coverage_time_score(F.col("time_to_full"), F.lit(4.0))))


@add(Q.query("SELECT run_id, round((frame - f) / 30.0, 6) AS t, fraction FROM curve JOIN (SELECT run_id, min(frame) AS f FROM friends GROUP BY run_id) USING (run_id) WHERE frame >= f", *_R))
def W11_rebased_curve(spark, d):
    start = pos(spark, d).where("track_id <> 99").groupBy("run_id").agg(F.min("frame").alias("first_frame"))
    return gaze.rebased_curve(_curve(spark, d), start, 30.0).withColumn("t", r6("t"))


# ---- wall ------------------------------------------------------------------


def _lengths_frame(spark, d):
    k = X.keypoints(spark, d).where("track_id <> 99")
    return k.select(*K, wall.arm_length(F.col("keypoints"), boxcols(), H, 0.3).alias("length"))


def _sq(x: str, y: str) -> tuple[str, str]:
    return E._px.format(x=x, y=y), E._py.format(x=x, y=y)


def _hyp(a: tuple[str, str], b: tuple[str, str]) -> str:
    return f"sqrt(power(({a[0]}) - ({b[0]}), 2) + power(({a[1]}) - ({b[1]}), 2)) / 6"


def _arm(a: int, b: int) -> str:
    return f"CASE WHEN k[{a}].score >= 0.3 AND k[{b}].score >= 0.3 AND sqrt(power((k[{b}].x - k[{a}].x) * kx, 2) + power((k[{b}].y - k[{a}].y) * ky, 2)) > 0 THEN sqrt(power((k[{b}].x - k[{a}].x) * kx, 2) + power((k[{b}].y - k[{a}].y) * ky, 2)) END"


_p0, _p1, _p2 = _sq("ax", "ay"), _sq("(ax + 6)", "ay"), _sq("ax", "(ay + 6)")
_ARM = f"""anchor_ AS (SELECT *, {_ANCHOR.format(c='x', e='(x1 + x2) / 2').replace('0.5', '0.3')} AS ax, {_ANCHOR.format(c='y', e='y2').replace('0.5', '0.3')} AS ay FROM keypoints WHERE track_id <> 99),
scale_ AS (SELECT *, {_hyp(_p1, _p0)} AS kx, {_hyp(_p2, _p0)} AS ky FROM anchor_),
arms_ AS (SELECT run_id, track_id, frame, {_arm(6, 8)} AS l1, {_arm(7, 9)} AS l2 FROM scale_),
arms AS (SELECT run_id, track_id, frame, coalesce((l1 + l2) / 2, l1, l2) AS length FROM arms_)"""


@add(Q.query("SELECT run_id, track_id, frame, round(length, 5) AS length FROM arms", _ARM))
def A9_arm_length(spark, d):
    return _lengths_frame(spark, d).withColumn("length", F.round("length", 5))


_ROBUST = """mid_ AS (SELECT run_id, track_id, median(length) AS m, count(*) AS n FROM arms WHERE length IS NOT NULL GROUP BY ALL),
dev_ AS (SELECT a.run_id, a.track_id, a.length, abs(a.length - m) AS dd, m, n FROM arms a JOIN mid_ USING (run_id, track_id) WHERE a.length IS NOT NULL),
mad_ AS (SELECT run_id, track_id, median(dd) AS mad FROM dev_ GROUP BY ALL),
robust AS (SELECT run_id, track_id, CASE WHEN any_value(n) < 5 THEN NULL WHEN any_value(mad) <= 0 OR count(*) < 5 THEN any_value(m) ELSE median(length) END AS length FROM dev_ JOIN mad_ USING (run_id, track_id) WHERE mad <= 0 OR dd <= 3 * mad GROUP BY ALL)"""


@add(Q.query("SELECT run_id, track_id, round(length, 5) AS length FROM robust", _ARM, _ROBUST))
def A10_robust_length(spark, d):
    return wall.robust_lengths(_lengths_frame(spark, d)).withColumn("length", F.round("length", 5))


_RESOLVED = "some_ AS (SELECT * FROM robust WHERE run_id % 3 <> 0 AND track_id % 2 = 1), resolved AS (SELECT c.run_id, c.track_id, coalesce(s.length, median(s.length) OVER (PARTITION BY c.run_id), 25.0) AS length, CASE WHEN s.length IS NOT NULL THEN 'track_keypoints' WHEN median(s.length) OVER (PARTITION BY c.run_id) IS NOT NULL THEN 'team_median' ELSE 'fallback_constant' END AS source FROM chosen c LEFT JOIN some_ s USING (run_id, track_id))"


def _resolved(spark, d):
    # some tracks have no length of their own, some runs no track that has one, so that every source occurs
    some = wall.robust_lengths(_lengths_frame(spark, d)).where("run_id % 3 <> 0 and track_id % 2 = 1")
    return wall.resolved_lengths(team(pos(spark, d)), some)


@add(Q.query("SELECT run_id, track_id, round(length, 5) AS length, source FROM resolved", Q.TEAM, _ARM, _ROBUST, _RESOLVED))
def A11_length_fallback(spark, d):
    return _resolved(spark, d).withColumn("length", F.round("length", 5))


# The band of each track is as wide as its resolved arm length; the near bound is 0 lengths, so nothing is too close.
_BANDED = f"banded AS (SELECT p.run_id, p.track_id, frame, CASE WHEN {Q.distance('map_x', 'map_y', ROOM.boundary)} > length THEN 'too_far' ELSE 'safe' END AS label FROM positions p JOIN resolved USING (run_id, track_id))"
_WALL = ",\n".join([_ARM, _ROBUST, _RESOLVED, _BANDED])
_ADHERE = "adherence AS (SELECT run_id, track_id, count(*) AS n_seen, count(*) FILTER (label = 'safe') AS n_safe, count(*) FILTER (label = 'too_far') AS n_too_far FROM banded GROUP BY ALL)"


def _banded(spark, d):
    return wall.banded(pos(spark, d), _resolved(spark, d), ROOM.boundary)


@add(Q.query("SELECT run_id, coalesce(s, 0.0) AS score FROM runs LEFT JOIN (SELECT run_id, round_even(avg(n_safe / n_seen), 2) AS s FROM adherence GROUP BY run_id) USING (run_id)", Q.TEAM, _WALL, _ADHERE))
def A12_wall_adherence(spark, d):
    return wall.wall_scores(X.runs(pos(spark, d)), wall.adherence(_banded(spark, d), 30.0))


_EXC = "excursions AS (SELECT *, row_number() OVER (PARTITION BY run_id, track_id ORDER BY start_frame) AS n FROM islands)"


@add(Q.query("SELECT run_id, track_id, label, start_frame, end_frame, n, round(n_frames / 30.0, 3) AS duration_sec, 'wall_' || label || '_' || track_id || '_' || n AS flag_id FROM excursions WHERE label <> 'safe' AND n_frames >= 15", Q.TEAM, _WALL, E._ISLANDS, _EXC))
def W5_wall_excursions(spark, d):
    return wall.excursions(_banded(spark, d), 30.0).select("run_id", "track_id", "label", "start_frame", "end_frame", "n", "duration_sec", "flag_id")


@add(Q.query("SELECT run_id, track_id, round(sum(round(n_frames / 30.0, 3)), 6) AS seconds, min(start_frame) AS first_start, count(*) AS n_windows FROM excursions WHERE label <> 'safe' AND n_frames >= 15 GROUP BY ALL", Q.TEAM, _WALL, E._ISLANDS, _EXC))
def A25_saved_violations(spark, d):
    flags = wall.excursions(_banded(spark, d), 30.0)
    half = flags.withColumn("track_id", F.when(F.col("track_id") % 2 == 0, F.col("track_id"))).withColumn("duration_sec", F.when(F.col("n") > 0, F.col("duration_sec")))
    out = wall.saved_violations(half)
    return out.select("run_id", "track_id", r6("seconds").alias("seconds"), F.expr("windows[0].start_frame").alias("first_start"), F.size("windows").cast("long").alias("n_windows"))


# ---- pods ------------------------------------------------------------------


def _vectors(spark, d):
    p = pos(spark, d)
    return entry.entry_vectors(p, team(p), ROOM)


# Which pod each entrant gets, by door and starting side, worked out by hand: door 0 is in the wall x = 22 with its centre at
# (41, 155) and ways in along +y and -y; pods 3, 2, 0 lie on its first side (deepest first), pod 1 on the other.  Door 1 is in
# the wall y = 0 with its centre at (230, 20) and ways along -x and +x; pods 0, 1 lie on its first side, 3, 2 on the other.
_ORDERS = """orders_ AS (SELECT * FROM (VALUES (0, 1, 1, 3), (0, 1, 2, 1), (0, 1, 3, 2), (0, 1, 4, 0), (0, -1, 1, 1), (0, -1, 2, 3), (0, -1, 3, 2), (0, -1, 4, 0),
  (1, 1, 1, 0), (1, 1, 2, 3), (1, 1, 3, 1), (1, 1, 4, 2), (1, -1, 1, 3), (1, -1, 2, 0), (1, -1, 3, 2), (1, -1, 4, 1)) t(door_index, start_, entry_number, pod_idx))"""
_ASSIGN = "assigned AS (SELECT v.run_id, v.track_id, v.entry_number, o.pod_idx FROM vectors v JOIN (SELECT run_id, door_index AS d, CASE WHEN sign = 0 THEN 1 ELSE sign END AS st FROM vectors WHERE entry_number = 1) f USING (run_id) LEFT JOIN orders_ o ON o.door_index = d AND o.start_ = st AND o.entry_number = v.entry_number)"
_G = (Q.TEAM, Q.VECTORS, _ORDERS, _ASSIGN)


@add(Q.query("SELECT * FROM assigned", *_G))
def G1_assign_by_side(spark, d):
    return pods.assign_by_side(_vectors(spark, d), ROOM)


_GROUPED = dataclasses.replace(ROOM, pod_groups=("A", "B", "A", "B"))
# Distances and directions from the doors' centres to the pods, pods 0 and 2 being group A.
_BY_GROUP = """spot AS (SELECT * FROM (VALUES (0, 75.0, 263.0, 'A'), (1, 75.0, 53.0, 'B'), (2, 290.0, 263.0, 'A'), (3, 397.0, 263.0, 'B')) v(pod, px, py, grp)),
middle AS (SELECT * FROM (VALUES (0, 41.0, 155.0), (1, 230.0, 20.0)) v(door_index, mx, my)),
lead AS (SELECT run_id, door_index, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-9 THEN max(CASE WHEN grp = 'A' THEN (dx * (px - mx) + dy * (py - my)) / sqrt(power(px - mx, 2) + power(py - my, 2)) END) ELSE 0 END AS a,
  CASE WHEN sqrt(dx * dx + dy * dy) > 1e-9 THEN max(CASE WHEN grp = 'B' THEN (dx * (px - mx) + dy * (py - my)) / sqrt(power(px - mx, 2) + power(py - my, 2)) END) ELSE 0 END AS b FROM vectors JOIN middle USING (door_index), spot WHERE entry_number = 1 GROUP BY run_id, door_index, dx, dy),
turn_ AS (SELECT run_id, pod, grp, CASE WHEN a >= b THEN 'A' ELSE 'B' END AS st, row_number() OVER (PARTITION BY run_id, grp ORDER BY power(px - mx, 2) + power(py - my, 2) DESC) AS r FROM lead JOIN middle USING (door_index), spot),
by_group AS (SELECT v.run_id, v.track_id, v.entry_number, t.pod AS pod_idx FROM vectors v LEFT JOIN turn_ t ON t.run_id = v.run_id AND v.entry_number = CASE WHEN grp = st THEN 2 * r - 1 ELSE 2 * r END)"""


@add(Q.query("SELECT * FROM by_group", Q.TEAM, Q.VECTORS, _BY_GROUP))
def G2_assign_by_group(spark, d):
    return pods.assign_by_group(_vectors(spark, d), _GROUPED)


_DOORLESS = dataclasses.replace(ROOM, doors=())
# The outline runs from (22, 0) along y = 0, x = 450, y = 316 and x = 22: 428 + 316 + 428 + 316 = 1488.  Its centre is (236, 158).
# The pods' nearest points are (75, 316), (75, 0), (290, 316) and (450, 263), so far along: 1119, 53, 904 and 691.
_OUTLINE = """began AS (SELECT run_id, track_id, min(frame) AS f0 FROM positions GROUP BY ALL),
first_vector AS (SELECT run_id, min_by(map_x, frame) AS x0, min_by(map_y, frame) AS y0, regr_slope(map_x, (frame - f0) / 30.0) * 2 AS dx, regr_slope(map_y, (frame - f0) / 30.0) * 2 AS dy
  FROM positions JOIN began USING (run_id, track_id) JOIN chosen USING (run_id, track_id) WHERE entry_number = 1 AND frame >= f0 AND frame < f0 + 60 GROUP BY run_id),
wall_ AS (SELECT *, least(y0, 450 - x0, 316 - y0, x0 - 22) AS near FROM first_vector),
way_in AS (SELECT *, CASE near WHEN y0 THEN x0 WHEN 450 - x0 THEN 450 WHEN 316 - y0 THEN x0 ELSE 22 END AS wx, CASE near WHEN y0 THEN 0 WHEN 450 - x0 THEN y0 WHEN 316 - y0 THEN 316 ELSE y0 END AS wy,
  CASE near WHEN y0 THEN x0 - 22 WHEN 450 - x0 THEN 428 + y0 WHEN 316 - y0 THEN 744 + 450 - x0 ELSE 1172 + 316 - y0 END AS ws, CASE WHEN (236 - x0) * dy - (158 - y0) * dx >= 0 THEN 1 ELSE -1 END AS st FROM wall_),
outer_spot AS (SELECT * FROM (VALUES (0, 75.0, 316.0, 1119.0), (1, 75.0, 0.0, 53.0), (2, 290.0, 316.0, 904.0), (3, 450.0, 263.0, 691.0)) v(pod, qx, qy, qs)),
parted AS (SELECT *, CASE WHEN (236 - wx) * (qy - wy) - (158 - wy) * (qx - wx) >= 0 THEN 1 ELSE -1 END AS side FROM way_in, outer_spot),
far_ AS (SELECT *, round(((CASE WHEN side = -1 THEN qs - ws ELSE ws - qs END) % 1488 + 1488) % 1488, 9) AS along FROM parted),
rank_ AS (SELECT *, row_number() OVER (PARTITION BY run_id, side ORDER BY along DESC, pod) AS r, count(*) FILTER (side = st) OVER (PARTITION BY run_id) AS mine, count(*) FILTER (side <> st) OVER (PARTITION BY run_id) AS theirs FROM far_),
outlined AS (SELECT c.run_id, c.track_id, c.entry_number, r.pod AS pod_idx FROM chosen c LEFT JOIN rank_ r ON r.run_id = c.run_id AND c.entry_number = CASE WHEN side = st THEN r.r + least(r.r - 1, theirs) ELSE r.r + least(r.r, mine) END)"""


@add(Q.query("SELECT * FROM outlined", Q.TEAM, _OUTLINE))
def G1_assign_without_door(spark, d):
    p = pos(spark, d)
    return pods.assign_by_side(entry.entry_vectors(p, team(p), _DOORLESS), _DOORLESS)


# The doorway is the first entrant's first position; pods right of it (+1) and left of it take turns.
_DOORWAY = """early_ AS (SELECT p.run_id, map_x, map_y, row_number() OVER (PARTITION BY p.run_id ORDER BY frame) AS k FROM positions p JOIN chosen USING (run_id, track_id) WHERE entry_number = 1),
way_ AS (SELECT run_id, min_by(map_x, k) AS wx, min_by(map_y, k) AS wy, max_by(map_x, k) AS lx, count(*) AS n FROM early_ WHERE k <= 30 GROUP BY run_id),
way AS (SELECT *, CASE WHEN n < 2 THEN CASE WHEN wx >= 209.25 THEN 1 ELSE -1 END WHEN lx >= wx THEN 1 ELSE -1 END AS st FROM way_),
spots_ AS (SELECT * FROM (VALUES (0, 75.0, 263.0), (1, 75.0, 53.0), (2, 290.0, 263.0), (3, 397.0, 263.0)) v(pod, px, py)),
sided_ AS (SELECT run_id, st, pod, CASE WHEN px > wx THEN 1 ELSE -1 END AS side, row_number() OVER (PARTITION BY run_id, px > wx ORDER BY abs(py - wy) DESC, pod) AS r FROM way, spots_),
turns_of_ AS (SELECT run_id, pod, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN side = st THEN 2 * r - 1 ELSE 2 * r END) AS entry_number FROM sided_),
doorway AS (SELECT c.run_id, c.track_id, c.entry_number, t.pod AS pod_idx FROM chosen c LEFT JOIN turns_of_ t ON t.run_id = c.run_id AND t.entry_number = c.entry_number)"""


@add(Q.query("SELECT * FROM doorway", Q.TEAM, _DOORWAY))
def G3_assign_by_doorway(spark, d):
    p = pos(spark, d)
    return pods.assign_by_doorway(p, team(p), ROOM.pods)


RADIUS = 60.0
_CENTRES = pods.work_centres(ROOM, RADIUS)

# Each run has a room of its own, whose upper wall is shorter, and its tracks' first positions as points to hold.  In a convex
# room a circle fits where it is its radius away from the line of each wall.
_OWN_ROOMS = """own_room AS (SELECT run_id, 450.0 - 20 * (run_id % 7) AS rx, 22.0 + 20 * (run_id % 5) AS lx FROM runs),
own_pod AS (SELECT run_id, track_id AS pod_idx, arg_min(map_x, frame) AS x, arg_min(map_y, frame) AS y FROM positions GROUP BY ALL),
area_ AS (SELECT *, 428.0 * 316 AS c1, 450.0 * 316 AS c2, (rx - lx) * 316.0 AS c3, -22.0 * 316 AS c4 FROM own_room),
middle_ AS (SELECT run_id, rx, lx, (472.0 * 0 + (450 + rx) * 450 * 316 + (rx + lx) * (rx - lx) * 316 - (lx + 22) * 22 * 316) / (3 * (450.0 * 316 + (rx - lx) * 316 - 22 * 316)) AS mx,
  (316.0 * 450 * 316 + 632.0 * (rx - lx) * 316 - 316.0 * 22 * 316) / (3 * (450.0 * 316 + (rx - lx) * 316 - 22 * 316)) AS my FROM own_room),
walk AS (SELECT run_id, pod_idx, rx, lx, mx, my, least(greatest(x, 22.0 + 60), 450.0 - 60) AS x, least(greatest(y, 60.0), 256.0) AS y, 0 AS k FROM own_pod JOIN middle_ USING (run_id)
  UNION ALL SELECT run_id, pod_idx, rx, lx, mx, my, x + (mx - x) / sqrt(power(mx - x, 2) + power(my - y, 2)) * 3.0, y + (my - y) / sqrt(power(mx - x, 2) + power(my - y, 2)) * 3.0, k + 1 FROM walk
  WHERE k < 100 AND sqrt(power(mx - x, 2) + power(my - y, 2)) > 0 AND NOT (y >= 60 - 1e-9 AND 316 - y >= 60 - 1e-9
    AND ((450 - x) * 316 - (450 - rx) * y) / sqrt(316.0 * 316 + power(450 - rx, 2)) >= 60 - 1e-9 AND ((x - 22) * 316 - (lx - 22) * y) / sqrt(316.0 * 316 + power(lx - 22, 2)) >= 60 - 1e-9))"""


@add(Q.recursive("SELECT run_id, pod_idx, round(arg_max(x, k), 5) AS x, round(arg_max(y, k), 5) AS y FROM walk GROUP BY ALL", _OWN_ROOMS))
def G4_work_areas(spark, d):
    p = pos(spark, d)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    rooms = X.runs(p).select("run_id", F.array(corner(F.lit(22), 0), corner(F.lit(450), 0), corner(450 - 20 * (F.col("run_id") % 7), 316), corner(22 + 20 * (F.col("run_id") % 5), 316)).alias("boundary"))
    spots = p.groupBy("run_id", F.col("track_id").alias("pod_idx")).agg(F.min_by("map_x", "frame").alias("x"), F.min_by("map_y", "frame").alias("y"))
    return pods.work_areas(rooms, spots, RADIUS).select("run_id", "pod_idx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def _samples(spark, d):
    a = pods.assign_by_side(_vectors(spark, d), ROOM).select("run_id", "track_id", "pod_idx")
    rows = pos(spark, d).join(a, ["run_id", "track_id"])
    return rows.withColumn("in_area", pods.in_circle(F.col("map_x"), F.col("map_y"), F.col("pod_idx"), _CENTRES, RADIUS)).select(*K, "pod_idx", "map_x", "map_y", "in_area")


# The circles' centres of the fixed room: the pods, moved to be 60 away from its walls.
_cx, _cy = "[82, 82, 290, 390][pod_idx + 1]", "[256, 60, 256, 256][pod_idx + 1]"
_SAMPLES = f"samples AS (SELECT p.run_id, p.track_id, frame, pod_idx, map_x, map_y, coalesce((map_x - {_cx}) * (map_x - {_cx}) + (map_y - {_cy}) * (map_y - {_cy}) < {RADIUS * RADIUS}, false) AS in_area FROM positions p JOIN assigned USING (run_id, track_id))"
_CAPTURE = """hits_ AS (SELECT *, frame - row_number() OVER (PARTITION BY run_id, track_id ORDER BY frame) AS g FROM samples WHERE in_area),
first_ AS (SELECT run_id, track_id, min(a) AS capture_frame FROM (SELECT run_id, track_id, min(frame) AS a, count(*) AS n FROM hits_ GROUP BY run_id, track_id, g) WHERE n >= 6 GROUP BY ALL),
captures AS (SELECT a.run_id, a.pod_idx, a.track_id AS assigned_id, f.capture_frame, (f.capture_frame - c.first_frame) / 30.0 AS capture_time_sec FROM assigned a JOIN chosen c USING (run_id, track_id) LEFT JOIN first_ f USING (run_id, track_id) WHERE a.pod_idx IS NOT NULL)"""
_GC = (*_G, _SAMPLES, _CAPTURE)


def _captures(spark, d):
    return pods.captures(_samples(spark, d), team(pos(spark, d)), 30.0, 0.2)


@add(Q.query("SELECT run_id, track_id, frame, in_area FROM samples", *_G, _SAMPLES))
def G6_in_area(spark, d):
    return _samples(spark, d).select(*K, "in_area")


_NO_POINTS = "[]::STRUCT(x DOUBLE, y DOUBLE)[]"


def _cut(source: str, name: str, inside: str) -> str:
    """CTE: the polygons of `source` (column poly) cut to where `inside`, an expression of {p}, is not below 0."""
    p, q = "poly[k]", "poly[k % len(poly) + 1]"
    s, t = inside.format(p=p), inside.format(p=q)
    here = f"CASE WHEN {s} >= 0 THEN [{p}] ELSE {_NO_POINTS} END"
    there = f"CASE WHEN ({s} >= 0) <> ({t} >= 0) THEN [{{'x': {p}.x + ({s}) / (({s}) - ({t})) * ({q}.x - {p}.x), 'y': {p}.y + ({s}) / (({s}) - ({t})) * ({q}.y - {p}.y)}}] ELSE {_NO_POINTS} END"
    return f"{name} AS (SELECT * EXCLUDE (poly), flatten(list_transform(range(1, len(poly) + 1), lambda k: list_concat({here}, {there}))) AS poly FROM {source})"


# People in the room are squares of 80; the circle of 60 is a polygon of 64 points, cut to the square side by side, where it is and moved up and down.
_BLOCKED = ",\n".join([
    "circle_ AS (SELECT list_transform(range(64), lambda k: {'x': 60 * cos(2 * pi() * k / 64), 'y': 60 * sin(2 * pi() * k / 64)}) AS c)",
    "centre_ AS (SELECT * FROM (VALUES (0, 82.0, 256.0), (1, 82.0, 60.0), (2, 290.0, 256.0), (3, 390.0, 256.0)) v(pod_idx, cx, cy))",
    "near_ AS (SELECT p.run_id, p.frame, p.map_x AS b_x, p.map_y AS b_y, pod_idx, cx, cy, cy + m AS my, m FROM positions p, centre_, (SELECT unnest([0, 60, -60]) AS m) WHERE track_id = 99 AND abs(map_x - cx) <= 100 AND abs(map_y - cy - m) <= 100)",
    "whole_ AS (SELECT *, list_transform(c, lambda p: {'x': cx + p.x, 'y': my + p.y}) AS poly FROM near_, circle_)",
    _cut("whole_", "cut1_", "({p}.x - b_x + 40)"), _cut("cut1_", "cut2_", "(b_x + 40 - {p}.x)"), _cut("cut2_", "cut3_", "({p}.y - b_y + 40)"), _cut("cut3_", "cut4_", "(b_y + 40 - {p}.y)"),
    "share_ AS (SELECT * EXCLUDE (poly), coalesce(list_sum(list_transform(range(1, len(poly) + 1), lambda k: poly[k].x * poly[k % len(poly) + 1].y - poly[k % len(poly) + 1].x * poly[k].y)), 0) / (64 * 3600 * sin(2 * pi() / 64)) AS share FROM cut4_)",
    "blocked_ AS (SELECT s.run_id, s.frame, s.b_x, s.b_y, s.pod_idx, s.cx, s.cy, CASE WHEN s.cy + 120 <= 316 AND s.cx >= 82 AND s.cx <= 390 AND coalesce(u.share, 0) <= 1e-9 THEN 60 WHEN s.cy - 120 >= 0 AND s.cx >= 82 AND s.cx <= 390 AND coalesce(w.share, 0) <= 1e-9 THEN -60 ELSE 0 END AS dy FROM share_ s LEFT JOIN share_ u ON u.run_id = s.run_id AND u.frame = s.frame AND u.pod_idx = s.pod_idx AND u.m = 60 LEFT JOIN share_ w ON w.run_id = s.run_id AND w.frame = s.frame AND w.pod_idx = s.pod_idx AND w.m = -60 WHERE s.m = 0 AND s.share >= 0.1)",
])


@add(Q.query(f"SELECT s.run_id, s.track_id, s.frame, coalesce((sqrt(power(map_x - {_cx.replace('pod_idx', 's.pod_idx')}, 2) + power(map_y - {_cy.replace('pod_idx', 's.pod_idx')} - coalesce(dy, 0), 2)) < 60 OR coalesce(abs(map_x - b_x) < 40 AND abs(map_y - b_y) < 40, false)) AND map_x > 22 AND map_x < 450 AND map_y > 0 AND map_y < 316, false) AS in_area FROM samples s LEFT JOIN blocked_ b ON b.run_id = s.run_id AND b.frame = s.frame AND b.pod_idx = s.pod_idx", *_G, _SAMPLES, _BLOCKED))
def G5_dynamic_areas(spark, d):
    b = pos(spark, d).where("track_id = 99")
    corner = lambda dx, dy: F.struct((F.col("map_x") + dx).alias("x"), (F.col("map_y") + dy).alias("y"))
    blockers = b.select("run_id", "frame", "track_id", F.array(corner(-40, -40), corner(40, -40), corner(40, 40), corner(-40, 40)).alias("quad"))
    return pods.dynamic_membership(_samples(spark, d).drop("in_area"), blockers, ROOM, RADIUS).select(*K, "in_area")


@add(Q.query("SELECT run_id, pod_idx, assigned_id, capture_frame, round(capture_time_sec, 6) AS capture_time_sec FROM captures", *_GC))
def W7_captures(spark, d):
    return _captures(spark, d).withColumn("capture_time_sec", r6("capture_time_sec"))


@add(Q.query("SELECT run_id, coalesce(s, 1.0) AS score FROM runs LEFT JOIN (SELECT run_id, round_even(count(capture_frame) / count(*), 2) AS s FROM captures GROUP BY run_id) USING (run_id)", *_GC))
def A16_capture_score(spark, d):
    return pods.capture_scores(X.runs(pos(spark, d)), _captures(spark, d))


_T = "capture_time_sec"


@add(Q.query(f"SELECT run_id, coalesce(s, 0.0) AS score FROM runs LEFT JOIN (SELECT run_id, round(avg(p), 2) AS s FROM (SELECT run_id, assigned_id, round(avg(CASE WHEN {_T} IS NULL THEN 0.0 WHEN {_T} <= l THEN 1.0 WHEN {_T} - l >= l THEN 0.0 ELSE exp(-({_T} - l) / (l - ({_T} - l))) END), 2) AS p FROM (SELECT *, CASE pod_idx WHEN 0 THEN 2.0 ELSE 4.0 END AS l FROM captures) GROUP BY ALL) GROUP BY run_id) USING (run_id)", *_GC))
def A17_capture_time_score(spark, d):
    return pods.capture_time_scores(X.runs(pos(spark, d)), _captures(spark, d), (2.0, 4.0))


_HOLD = _DOORWAY + ",\nholding AS (SELECT p.run_id, p.track_id, frame, exp(-(power(map_x - px, 2) + power(map_y - py, 2)) / 5000.0) AS h FROM positions p JOIN doorway USING (run_id, track_id) JOIN spots_ ON pod = pod_idx)"


def _hold(spark, d):
    return pods.hold_samples(pos(spark, d), G3_assign_by_doorway(spark, d), ROOM.pods)


@add(Q.query("SELECT run_id, CASE WHEN n >= 4 THEN round(s, 2) ELSE 0.0 END AS score FROM runs LEFT JOIN (SELECT run_id, avg(m) AS s, count(*) AS n FROM (SELECT run_id, track_id, avg(h) AS m FROM holding GROUP BY ALL) GROUP BY run_id) USING (run_id)", Q.TEAM, _HOLD))
def A18_hold_score(spark, d):
    return pods.hold_scores(X.runs(pos(spark, d)), _hold(spark, d), 4)


@add(Q.query("SELECT run_id, frame, round(avg(m) OVER (PARTITION BY run_id ORDER BY frame), 6) AS hold_so_far FROM (SELECT run_id, frame, avg(h) AS m FROM holding GROUP BY ALL)", Q.TEAM, _HOLD))
def W10_hold_curve(spark, d):
    return pods.hold_curve(_hold(spark, d)).withColumn("hold_so_far", r6("hold_so_far"))


# ---- pairs -----------------------------------------------------------------

_PAIRS = """pairs AS MATERIALIZED (SELECT a.run_id, a.frame AS frame_a, a.track_id AS track_a, b.track_id AS track_b, a.confidence AS conf, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM detections a JOIN detections b ON a.run_id = b.run_id AND b.frame = a.frame + 1),
inter_ AS (SELECT *, greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1)) AS i, greatest(ax2, bx2) - least(ax1, bx1) AS hw, greatest(ay2, by2) - least(ay1, by1) AS hh, (ax1 + ax2 - bx1 - bx2) / 2 AS cdx, (ay1 + ay2 - by1 - by2) / 2 AS cdy FROM pairs),
sims AS MATERIALIZED (SELECT *, i / (3200 + 3200 - i) AS iou, (3200 + 3200 - i) AS u FROM inter_)"""


def _frame_pairs(spark, d):
    b = X.detections(spark, d).select(*K, *BOX, "confidence")
    rows = pairs.frame_pairs(b, b, 1)
    sims = pairs.similarities([F.col(f"{c}_a") for c in BOX], [F.col(f"{c}_b") for c in BOX], 1000.0, 800.0)
    return rows.select("run_id", "frame_a", F.col("track_id_a").alias("track_a"), F.col("track_id_b").alias("track_b"), "confidence_a", *[v.alias(k) for k, v in sims.items()], *[f"{c}_{e}" for c in BOX for e in "ab"])


@add(Q.query(f"SELECT run_id, frame_a, track_a, track_b, round(iou, 6) AS iou, round((iou - (hw * hh - u) / (hw * hh) + 1) / 2, 6) AS giou, round((iou - (cdx * cdx + cdy * cdy) / (hw * hw + hh * hh) + 1) / 2, 6) AS diou, round((iou - (cdx * cdx + cdy * cdy) / (hw * hw + hh * hh) + 1) / 2, 6) AS ciou, round(1 - sqrt(cdx * cdx + cdy * cdy) / {math.hypot(1000, 800)!r}, 6) AS centroid FROM sims", _PAIRS))
def J14_box_similarity(spark, d):
    return _frame_pairs(spark, d).select("run_id", "frame_a", "track_a", "track_b", *[r6(c).alias(c) for c in ("iou", "giou", "diou", "ciou", "centroid")])


@add(None)
def J15_pose_affinity(spark, d):
    k = pairs.with_anchors(X.keypoints(spark, d).select(*K, *BOX, "keypoints"), 0.5)
    rows = pairs.pair_affinity(pairs.frame_pairs(k, k).where("track_id_a < track_id_b"), pairs.pose_scale([F.col(f"{c}_a") for c in BOX]))
    return rows.select("run_id", F.col("frame_a").alias("frame"), "track_id_a", "track_id_b", r6("similarity").alias("similarity"), r6("reliability").alias("reliability"))


# Every tenth vector is the gallery's own, the query set those with an id that 100 divides, against all other rows.
_LENGTH = "sqrt(list_sum(list_transform(embedding, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))))"


@add(f"WITH e AS (SELECT vec_id, label, embedding, {_LENGTH} AS n FROM embeddings), g AS (SELECT * FROM e WHERE vec_id % 100 <> 0), q AS (SELECT * FROM e WHERE vec_id % 100 = 0) SELECT g.label, q.vec_id, round(min(greatest(0.0, 1 - list_sum(list_transform(list_zip(g.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (g.n * q.n))), 5) AS distance FROM g, q GROUP BY ALL")
def J16_gallery_distance(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    out = pairs.nearest_in_gallery(e.where("vec_id % 100 <> 0"), e.where("vec_id % 100 = 0"), "label", "vec_id")
    return out.withColumn("distance", F.round("distance", 5))


@add(None)
def J16_gallery_distance_whole(spark, d):
    # five times the queries against all other rows, for which SQL is slow on large tables
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    out = pairs.nearest_in_gallery(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "label", "vec_id")
    return out.withColumn("distance", F.round("distance", 5))


@add(Q.query("SELECT run_id, frame_a, track_a, track_b, round(1 - (1 - conf) * (1 + iou) / 2, 6) AS cost FROM sims", _PAIRS))
def J17_fused_cost(spark, d):
    return _frame_pairs(spark, d).select("run_id", "frame_a", "track_a", "track_b", r6(pairs.fused_cost(F.col("confidence_a"), F.col("iou"))).alias("cost"))


@add(Q.query(f"SELECT run_id, frame_a, track_a, track_b, round(greatest(0.0, least(1.0, ({math.pi / 2!r} - abs(acos(greatest(-1.0, least(1.0, -cdx / n))))) / {math.pi!r})) * 0.2 * conf, 6) AS bonus FROM (SELECT *, sqrt(cdx * cdx + cdy * cdy) + 1e-6 AS n FROM sims)", _PAIRS))
def J18_motion_consistency(spark, d):
    p = _frame_pairs(spark, d)
    dx, dy = (F.col("x1_b") + F.col("x2_b") - F.col("x1_a") - F.col("x2_a")) / 2, (F.col("y1_b") + F.col("y2_b") - F.col("y1_a") - F.col("y2_a")) / 2
    return p.select("run_id", "frame_a", "track_a", "track_b", r6(pairs.motion_consistency(F.lit(1.0), F.lit(0.0), dx, dy, 0.2, F.col("confidence_a"))).alias("bonus"))


_LINK = "links AS MATERIALIZED (SELECT run_id, frame_a, track_a, track_b FROM (SELECT *, row_number() OVER (PARTITION BY run_id, frame_a, track_a ORDER BY r DESC, track_b) AS ra, row_number() OVER (PARTITION BY run_id, frame_a, track_b ORDER BY r DESC, track_a) AS rb FROM (SELECT *, round(iou, 6) AS r FROM sims)) WHERE ra = 1 AND rb = 1 AND r >= 0.3)"


def _links(spark, d):
    p = _frame_pairs(spark, d).withColumn("iou", r6("iou"))
    return pairs.mutual_best(p, "iou", ["run_id", "frame_a"], "track_a", "track_b")


@add(Q.query("SELECT * FROM links", _PAIRS, _LINK))
def J19_mutual_best(spark, d):
    return _links(spark, d).select("run_id", "frame_a", "track_a", "track_b")


@add(Q.query("""SELECT 'left' AS side, run_id, frame, track_id FROM detections ANTI JOIN links ON links.run_id = detections.run_id AND links.frame_a = detections.frame AND links.track_a = detections.track_id
UNION ALL SELECT 'right', run_id, frame, track_id FROM detections ANTI JOIN links ON links.run_id = detections.run_id AND links.frame_a + 1 = detections.frame AND links.track_b = detections.track_id""", _PAIRS, _LINK))
def U2_unmatched(spark, d):
    rows, links = X.detections(spark, d).select(*K), _links(spark, d)
    left = links.select("run_id", F.col("frame_a").alias("frame"), F.col("track_a").alias("track_id"))
    right = links.select("run_id", (F.col("frame_a") + 1).alias("frame"), F.col("track_b").alias("track_id"))
    out = [pairs.unmatched(rows, m, ["run_id", "frame", "track_id"]).select(F.lit(side).alias("side"), "run_id", "frame", "track_id") for side, m in (("left", left), ("right", right))]
    return out[0].unionByName(out[1])


@add(Q.query("""SELECT 'both' AS kind, a.run_id, a.frame_a, a.track_a AS a, b.track_b AS c FROM links a JOIN links b ON a.run_id = b.run_id AND b.frame_a = a.frame_a + 1 AND b.track_a = a.track_b
UNION ALL SELECT 'only_a', run_id, frame_a, track_a, NULL FROM links a ANTI JOIN links b ON a.run_id = b.run_id AND b.frame_a = a.frame_a + 1 AND b.track_a = a.track_b
UNION ALL SELECT 'only_c', run_id, frame_a - 1, NULL, track_b FROM links b ANTI JOIN links a ON a.run_id = b.run_id AND b.frame_a = a.frame_a + 1 AND b.track_a = a.track_b""", _PAIRS, _LINK))
def U4_merged_matches(spark, d):
    links = _links(spark, d)
    ab = links.select("run_id", "frame_a", F.col("track_a").alias("a"), F.col("track_b").alias("b"))
    bc = links.select("run_id", (F.col("frame_a") - 1).alias("frame_a"), F.col("track_a").alias("b"), F.col("track_b").alias("c"))
    both, only_a, only_c = pairs.merged_matches(ab, bc, ["run_id", "frame_a"])
    none = F.lit(None).cast("int")
    parts = [both.withColumn("kind", F.lit("both")), only_a.withColumn("c", none).withColumn("kind", F.lit("only_a")), only_c.withColumn("a", none).withColumn("kind", F.lit("only_c"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "run_id", "frame_a", "a", "c")


def _fold(items: str, name: str, start: str, step: str) -> str:
    """Recursive CTE: a state over the list `items` of each run and frame, `step` being an expression of i (the item) and s (the state)."""
    return f"{name}_at AS (SELECT run_id, frame, items, 0 AS k, {start} AS s FROM {items} UNION ALL SELECT run_id, frame, items, k + 1, {step.replace('{i}', 'items[k + 1]')} FROM {name}_at WHERE k < len(items)),\n{name} AS (SELECT run_id, frame, s FROM {name}_at WHERE k = len(items))"


_IN_BOX = """seen_ AS (SELECT run_id, frame, track_id, list_filter(k, lambda p: p.score > 0) AS g FROM keypoints),
pose_ AS (SELECT *, list_avg(list_transform(g, lambda p: p.x)) AS px, list_avg(list_transform(g, lambda p: p.y)) AS py FROM seen_ WHERE len(g) > 0),
fits_ AS (SELECT b.run_id, b.frame, b.track_id AS box, p.track_id AS pose, sqrt(power(px - (x1 + x2) / 2, 2) + power(py - (y1 + y2) / 2, 2)) AS d FROM detections b JOIN pose_ p ON p.run_id = b.run_id AND p.frame = b.frame
  WHERE len(list_filter(g, lambda p: p.x <= b.x1 - 5 OR p.x >= b.x2 + 5 OR p.y <= b.y1 - 5 OR p.y >= b.y2 + 5)) = 0),
in_turn AS (SELECT run_id, frame, list({'box': box, 'pose': pose} ORDER BY box, d, pose) AS items FROM fits_ GROUP BY ALL)"""
_TAKE = _fold("in_turn", "taken", "[]::STRUCT(box INTEGER, pose INTEGER)[]", "CASE WHEN len(list_filter(s, lambda t: t.box = {i}.box OR t.pose = {i}.pose)) = 0 THEN list_append(s, {i}) ELSE s END")


@add(Q.recursive("SELECT run_id, frame, t.box, t.pose FROM (SELECT run_id, frame, unnest(s) AS t FROM taken)", _IN_BOX, _TAKE))
def J13_poses_in_boxes(spark, d):
    k = X.keypoints(spark, d)
    boxes = k.select("run_id", "frame", F.col("track_id").alias("box"), F.col("x1") - 5, F.col("y1") - 5, F.col("x2") + 5, F.col("y2") + 5).toDF("run_id", "frame", "box", *BOX)
    return pairs.poses_in_boxes(boxes, k.select("run_id", "frame", F.col("track_id").alias("pose"), "keypoints"))


_BEST_FIRST = "best_first AS (SELECT run_id, frame, list({'track_id': track_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY confidence DESC, track_id) AS items FROM detections WHERE confidence > 0.1 GROUP BY ALL)"
_OVER = "greatest(0.0, least(t.x2, {i}.x2) - greatest(t.x1, {i}.x1)) * greatest(0.0, least(t.y2, {i}.y2) - greatest(t.y1, {i}.y1))"
_APART = _fold("best_first", "apart", "[]::STRUCT(track_id INTEGER, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]", f"CASE WHEN len(list_filter(s, lambda t: {_OVER} / (6400 - {_OVER}) > 0.3)) = 0 THEN list_append(s, {{i}}) ELSE s END")


@add(Q.recursive("SELECT run_id, t.track_id, frame FROM (SELECT run_id, frame, unnest(s) AS t FROM apart)", _BEST_FIRST, _APART))
def T4_suppressed_boxes(spark, d):
    return pairs.suppressed(X.detections(spark, d).select(*K, *BOX, "confidence"), 0.1, 0.3).select(*K)


# Poses of which more than 5 of 26 points lie close are taken for one, so that some are.
_CLOSE = """extent_ AS (SELECT run_id, frame, track_id AS pose, k, CAST((rk * 7 + s * 13) % 100 AS DOUBLE) / 100 AS score, 0.3 * sqrt(power(list_max(list_transform(k, lambda p: p.x)) - list_min(list_transform(k, lambda p: p.x)), 2) + power(list_max(list_transform(k, lambda p: p.y)) - list_min(list_transform(k, lambda p: p.y)), 2)) AS reach FROM keypoints),
close_ AS (SELECT a.run_id, a.frame, a.pose, a.score, list({'rank': -b.score, 'pose': b.pose} ORDER BY -b.score, b.pose) FILTER (len(list_filter(range(1, 27), lambda j: sqrt(power(a.k[j].x - b.k[j].x, 2) + power(a.k[j].y - b.k[j].y, 2)) < a.reach)) > 5) AS close FROM extent_ a JOIN extent_ b ON a.run_id = b.run_id AND a.frame = b.frame GROUP BY ALL),
poses_first AS (SELECT run_id, frame, list({'pose': pose, 'rank': -score, 'around': CASE WHEN len(close) > 0 THEN close ELSE [{'rank': -score, 'pose': pose}] END} ORDER BY -score, pose) AS items FROM close_ GROUP BY ALL)"""
_LEADERS = _fold("poses_first", "led", "{'settled': []::INTEGER[], 'left': []::INTEGER[]}", "CASE WHEN list_contains(s.settled, {i}.pose) OR list_contains(s.settled, {i}.around[1].pose) THEN s ELSE {'settled': list_concat(s.settled, list_transform({i}.around, lambda x: x.pose)), 'left': list_append(s.left, {i}.around[1].pose)} END")


@add(Q.recursive('SELECT run_id, frame, unnest(s."left") AS pose FROM led', _CLOSE, _LEADERS))
def T5_suppressed_poses(spark, d):
    k = X.keypoints(spark, d, X.positions(spark, d, together=True)).select("run_id", "frame", F.col("track_id").alias("pose"), "keypoints", F.expr("CAST((rk * 7 + s * 13) % 100 AS DOUBLE) / 100").alias("score"))
    return pairs.suppressed_poses(k, 0.3, 5)


# The test side has every point moved by its number and its frame, and other points unseen.
@add(Q.query("""SELECT run_id, count(*) FILTER (n > 0) AS n_poses, CAST(sum(n) AS BIGINT) AS n_points, round(sum(e) / (2 * sum(n)), 6) AS mean_error FROM (SELECT run_id, len(g) AS n, coalesce(list_sum(list_transform(g, lambda j: (j - 1) % 5 + rk % 3)), 0) AS e
  FROM (SELECT run_id, rk, list_filter(range(1, 27), lambda j: k[j].score > 0.2 AND (j + rk) % 4 <> 0) AS g FROM keypoints WHERE rk % 5 <> 0)) GROUP BY run_id"""))
def C14_keypoint_error(spark, d):
    k = X.keypoints(spark, d)
    moved = F.transform("keypoints", lambda p, j: F.struct((p["x"] + j % 5).alias("x"), (p["y"] - F.col("rk") % 3).alias("y"), F.when((j + 1 + F.col("rk")) % 4 == 0, 0.0).otherwise(0.9).alias("score")))
    out = pairs.keypoint_errors(k.select(*K, "keypoints"), k.where("rk % 5 <> 0").select(*K, moved.alias("keypoints")), 0.2)
    return out.withColumn("mean_error", r6("mean_error"))


@add(Q.query("SELECT run_id, count(*) AS n_reference, count(*) FILTER (b >= 0.5) AS n_found, round(count(*) FILTER (b >= 0.5) / count(*), 6) AS recall FROM (SELECT r.run_id, r.frame, r.track_id, max(CASE WHEN t.run_id IS NOT NULL THEN 1 END * greatest(0.0, least(r.x2, t.x2 + 9) - greatest(r.x1, t.x1 + 9)) * greatest(0.0, least(r.y2, t.y2) - greatest(r.y1, t.y1)) / (6400 - greatest(0.0, least(r.x2, t.x2 + 9) - greatest(r.x1, t.x1 + 9)) * greatest(0.0, least(r.y2, t.y2) - greatest(r.y1, t.y1)))) AS b FROM detections r LEFT JOIN (SELECT * FROM detections WHERE rk % 5 <> 0) t ON t.run_id = r.run_id AND t.frame = r.frame GROUP BY ALL) GROUP BY run_id"))
def C14_box_recall(spark, d):
    b = X.detections(spark, d)
    test = b.where("rk % 5 <> 0").withColumn("x1", F.col("x1") + 9).withColumn("x2", F.col("x2") + 9)
    return pairs.box_recall(b.select(*K, *BOX), test.select(*K, *BOX)).withColumn("recall", r6("recall"))


# ---- transcripts -----------------------------------------------------------


def _segments(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    word = "transform(split(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', ' '), ' +'), w -> named_struct('word', w, 'start', 0D, 'end', 1D, 'score', CAST(CASE WHEN length(w) = 0 THEN NULL ELSE (length(w) % 10) / 10D END AS DOUBLE)))"
    return c.selectExpr("conv_id AS run_id", "CAST(turn AS INT) AS id", "CAST(turn * 5 AS DOUBLE) AS start", "CAST(turn * 5 + 4 AS DOUBLE) AS end", "text", f"{word} AS words")


_SEG = "seg_ AS (SELECT conv_id AS run_id, CAST(turn AS INT) AS id, CAST(turn * 5 AS DOUBLE) AS st, CAST(turn * 5 + 4 AS DOUBLE) AS en, string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', ' ', 'g'), ' +') AS words, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS toks FROM conversations), seg AS (SELECT *, list_avg(list_transform(list_filter(words, lambda w: length(w) > 0), lambda w: (length(w) % 10) / 10.0)) AS score FROM seg_)"


@add(f"WITH {_SEG} SELECT run_id, id, round(score, 6) AS score FROM seg")
def A7_alignment(spark, d):
    return _segments(spark, d).select("run_id", "id", r6(transcript.mean_score(F.col("words"))).alias("score"))


_RUNSEG = "rs AS (SELECT DISTINCT run_id, CASE WHEN run_id % 5 = 0 THEN NULL ELSE 20 END AS drill_start, 3000 AS total FROM seg), cand AS (SELECT seg.*, drill_start FROM seg JOIN rs USING (run_id) WHERE st >= (drill_start - 1) / 30.0 AND list_contains(toks, 'the')), pick AS (SELECT run_id, max(CASE WHEN score IS NULL OR score >= 0.4 THEN id END) AS good, max(id) AS any_id FROM cand GROUP BY run_id), chosen_ AS (SELECT rs.*, coalesce(good, any_id) AS mid, good FROM rs LEFT JOIN pick USING (run_id))"


@add(f"WITH {_SEG}, {_RUNSEG} SELECT c.run_id, CASE WHEN drill_start IS NULL THEN 1 ELSE drill_start END AS start_frame, CASE WHEN mid IS NULL THEN total ELSE greatest(drill_start, least(total, CAST(round_even((en + 0.5) * 30, 0) AS INT))) END AS end_frame, mid IS NULL AS end_uncertain, CASE WHEN drill_start IS NULL THEN 'no_entry_detected' WHEN mid IS NULL THEN 'no_clearance_phrase_found' WHEN good IS NOT NULL THEN 'selected_latest_passing_score_gate' ELSE 'selected_latest_below_score_gate' END AS reason, mid AS matched_id FROM chosen_ c LEFT JOIN seg ON seg.run_id = c.run_id AND seg.id = mid")
def A8_drill_window(spark, d):
    s = _segments(spark, d)
    runs = s.select("run_id").distinct().selectExpr("run_id", "CASE WHEN run_id % 5 = 0 THEN NULL ELSE 20 END AS drill_start", "3000 AS total_frames", "30D AS fps")
    return transcript.drill_windows(runs, s, ["the"])


@add(f"WITH {_SEG} SELECT t.run_id, t.t, CASE WHEN max_by(en, st) >= t.t THEN max_by(id, st) END AS id FROM (SELECT run_id, st + o AS t FROM seg, (SELECT unnest([-1.5, 2.25, 4.5]) AS o)) t LEFT JOIN seg ON seg.run_id = t.run_id AND st <= t.t GROUP BY t.run_id, t.t")
def J7_active_line(spark, d):
    s = _segments(spark, d)
    times = s.select("run_id", F.explode(F.array(F.col("start") - 1.5, F.col("start") + 2.25, F.col("start") + 4.5)).alias("t")).distinct()
    return transcript.active_lines(times, s)


@add(f"WITH {_SEG} SELECT run_id, id, st + 1.5 AS start, en + 1.5 AS \"end\", CAST(len(words) AS INT) AS n_words, 1.5 AS first_start FROM seg")
def P32_cleanup(spark, d):
    s = _segments(spark, d).withColumnRenamed("start", "b_").withColumnRenamed("end", "start").withColumnRenamed("b_", "end")
    out = transcript.cleaned(s, 1.5)
    return out.select("run_id", "id", "start", "end", F.size("words").alias("n_words"), F.expr("words[0].start").alias("first_start"))
