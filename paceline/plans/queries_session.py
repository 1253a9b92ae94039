"""Registered queries: timeline, records, entities and documents of every run; role evidence, birth points, map scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import doors, entry, pairs, roles, session, wall
from . import fixtures as X
from . import queries_entry as E
from . import queries_room as R
from . import sqltext as Q
from .fixtures import ROOM
from .queries_entry import K, pos, r6, team

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def parts(spark, d) -> dict:
    """The tables that a session is made of."""
    p = pos(spark, d)
    t = team(p)
    v = entry.entry_vectors(p, t, ROOM)
    turns, gaps, total = entry.vector_transitions(v), entry.pair_gaps(t, ROOM), entry.total_entry(t, ROOM)
    rows = R._banded(spark, d)
    return {"positions": p, "chosen": t, "vectors": v, "turns": turns, "gaps": gaps, "total": total, "adherence": wall.adherence(rows, 30.0), "excursions": wall.excursions(rows, 30.0)}


def _items(x):
    return session.timeline(x["chosen"], x["gaps"], x["vectors"], x["total"], x["excursions"])


def _flags(x):
    walls = x["excursions"].select("run_id", "flag_id", "type", F.lit("warning").alias("severity"), F.col("start_frame").alias("frame"), "end_frame", F.lit(None).cast("int").alias("entry_number"), "track_id", F.lit("").alias("message"), F.col("start_time").alias("time_sec"))
    rows = entry.entry_flags(x["vectors"], x["turns"], x["gaps"], x["total"], x["chosen"], ROOM)
    return session.linked(rows.unionByName(walls))


_S = "(CASE WHEN sign > 0 THEN 'A (+1)' WHEN sign < 0 THEN 'B (-1)' ELSE 'UNKNOWN' END)"
_ITEMS = f"""items AS (
SELECT run_id, 'entrance_entry_' || entry_number AS item_id, NULL AS metric_id, 'entry' AS kind, 'Entry ' || entry_number AS label, first_frame AS start_frame, NULL AS end_frame FROM chosen
UNION ALL SELECT run_id, 'entrance_pair_' || pair_number, 'entrance_hesitation', 'pair_gap', 'Pair ' || pair_number, from_frame, to_frame FROM gap_scores
UNION ALL SELECT run_id, 'entrance_vector_' || entry_number, 'entrance_vectors', 'vector', 'Vector ' || entry_number || ': ' || {_S}, start_frame, NULL FROM vectors
UNION ALL SELECT run_id, 'wall_excursion_' || track_id || '_' || n, 'move_along_wall', 'wall_excursion', replace(label, '_', ' '), start_frame, end_frame FROM excursions WHERE label <> 'safe' AND n_frames >= 15
UNION ALL SELECT run_id, 'total_entry_duration', 'total_time_of_entry', 'duration', 'Total Entry', start_frame, end_frame FROM total)"""
_LINKS = """links AS (
SELECT run_id, 'entrance_vector_unknown_' || entry_number AS flag_id, 'entrance_vectors' AS metric_id, 'entrance_vector_' || entry_number AS linked_item_id FROM vectors WHERE sign = 0
UNION ALL SELECT run_id, 'entrance_vector_direction_violation_' || transition_number, 'entrance_vectors', NULL FROM turns WHERE NOT alternates
UNION ALL SELECT run_id, 'entrance_pair_time_violation_' || pair_number, 'entrance_hesitation', 'entrance_pair_' || pair_number FROM gap_scores WHERE violation
UNION ALL SELECT run_id, 'entrance_total_entry_time_violation', 'total_time_of_entry', 'total_entry_duration' FROM total WHERE violation
UNION ALL SELECT run_id, 'wall_' || label || '_' || track_id || '_' || n, 'move_along_wall', 'wall_excursion_' || track_id || '_' || n FROM excursions WHERE label <> 'safe' AND n_frames >= 15)"""
_ALL = (Q.TEAM, Q.VECTORS, Q.transitions(False), Q.GAPS, Q.TOTAL, R._WALL, R._ADHERE, E._ISLANDS, R._EXC, _ITEMS, _LINKS)


@add(Q.query("SELECT i.run_id, item_id, i.metric_id, kind, label, start_frame, end_frame, round((start_frame - 1) / 30.0, 3) AS start_time, round((end_frame - 1) / 30.0, 3) AS end_time, coalesce(n, 0) AS n_flags, first_flag FROM items i LEFT JOIN (SELECT run_id, linked_item_id AS item_id, count(*) AS n, min(flag_id) AS first_flag FROM links GROUP BY ALL) USING (run_id, item_id)", *_ALL))
def R7_timeline(spark, d):
    x = parts(spark, d)
    out = session.with_flag_ids(_items(x), _flags(x))
    return out.select("*", F.size("flag_ids").cast("long").alias("n_flags"), F.get("flag_ids", F.lit(0)).alias("first_flag")).drop("flag_ids")


@add(Q.query("SELECT * FROM links", *_ALL))
def J12_flag_links(spark, d):
    return _flags(parts(spark, d)).select("run_id", "flag_id", "metric_id", "linked_item_id")


@add(Q.query("SELECT run_id, metric_id, coalesce(array_to_string(i, ','), '') AS items, coalesce(array_to_string(f, ','), '') AS flags FROM (SELECT run_id, metric_id, list_sort(list(item_id)) AS i FROM items WHERE metric_id IS NOT NULL GROUP BY ALL) FULL JOIN (SELECT run_id, metric_id, list_sort(list(flag_id)) AS f FROM links GROUP BY ALL) USING (run_id, metric_id)", *_ALL))
def A28_metric_lists(spark, d):
    x = parts(spark, d)
    out = session.per_metric(_items(x), _flags(x))
    return out.select("run_id", "metric_id", F.array_join("timeline_item_ids", ",").alias("items"), F.array_join("flag_ids", ",").alias("flags"))


_SUMS = """sums AS (
SELECT run_id, 'entrance_vectors' AS metric_id, 'vector_count' AS name, CAST(count(*) AS DOUBLE) AS value FROM vectors GROUP BY run_id
UNION ALL SELECT run_id, 'entrance_vectors', 'valid_vector_count', CAST(count(*) FILTER (sign <> 0) AS DOUBLE) FROM vectors GROUP BY run_id
UNION ALL SELECT v.run_id, 'entrance_vectors', 'transition_count', CAST(count(t.run_id) AS DOUBLE) FROM (SELECT DISTINCT run_id FROM vectors) v LEFT JOIN turns t ON t.run_id = v.run_id GROUP BY v.run_id
UNION ALL SELECT v.run_id, 'entrance_vectors', 'alternation_count', CAST(count(*) FILTER (t.alternates) AS DOUBLE) FROM (SELECT DISTINCT run_id FROM vectors) v LEFT JOIN turns t ON t.run_id = v.run_id GROUP BY v.run_id
UNION ALL SELECT run_id, 'entrance_hesitation', 'pair_count', CAST(count(*) AS DOUBLE) FROM gap_scores GROUP BY run_id
UNION ALL SELECT run_id, 'entrance_hesitation', 'violation_count', CAST(count(*) FILTER (violation) AS DOUBLE) FROM gap_scores GROUP BY run_id
UNION ALL SELECT run_id, 'total_time_of_entry', 'duration_sec', CAST(duration_sec AS DOUBLE) FROM total
UNION ALL SELECT run_id, 'total_time_of_entry', 'limit_sec', CAST(limit_sec AS DOUBLE) FROM total
UNION ALL SELECT run_id, 'total_time_of_entry', 'violates', CASE WHEN violation THEN 1.0 ELSE 0.0 END FROM total
UNION ALL SELECT a.run_id, 'move_along_wall', 'excursion_count', CAST(coalesce(any_value(x.n), 0) AS DOUBLE) FROM adherence a LEFT JOIN (SELECT run_id, count(*) AS n FROM excursions WHERE label <> 'safe' AND n_frames >= 15 GROUP BY run_id) x ON x.run_id = a.run_id GROUP BY a.run_id
UNION ALL SELECT run_id, 'move_along_wall', 'total_too_close_sec', 0.0 FROM adherence GROUP BY run_id
UNION ALL SELECT run_id, 'move_along_wall', 'total_too_far_sec', round(sum(round(n_too_far / 30.0, 3)), 3) FROM adherence GROUP BY run_id)"""


def _summaries(x):
    return session.summaries(x["vectors"], x["turns"], x["gaps"], x["total"], x["adherence"], x["excursions"])


@add(Q.query("SELECT run_id, metric_id, name, round(value, 6) AS value FROM sums", *_ALL, _SUMS))
def A29_metric_summaries(spark, d):
    return _summaries(parts(spark, d)).select("run_id", "metric_id", F.explode("summary").alias("name", "value")).withColumn("value", r6("value"))


def _records(x):
    runs = X.runs(x["positions"])
    scores = [
        ("entrance_vectors", entry.vector_scores(runs, entry.vector_transitions(x["vectors"], True))), ("entrance_hesitation", entry.hesitation_scores(runs, x["gaps"])),
        ("total_time_of_entry", x["total"].select("run_id", "score")), ("move_along_wall", wall.wall_scores(runs, x["adherence"])),
    ]
    rows = None
    for name, table in scores:
        part = table.select("run_id", F.lit(name).alias("metric_id"), "score")
        rows = part if rows is None else rows.unionByName(part)
    return session.metric_records(rows, _summaries(x), session.per_metric(_items(x), _flags(x)))


_RECORDS = """door_turns_ AS (SELECT run_id, lag(sign) OVER w <> sign AS alternates, lag(sign) OVER w AS before FROM vectors WHERE sign <> 0 WINDOW w AS (PARTITION BY run_id, door_index ORDER BY entry_number)),
recs AS (SELECT run_id, 'entrance_vectors' AS metric_id, 'Entrance Vectors' AS label, coalesce(round_even(s, 2), -1.0) AS score FROM runs LEFT JOIN (SELECT run_id, avg(CAST(alternates AS INT)) AS s FROM door_turns_ WHERE before IS NOT NULL GROUP BY run_id) USING (run_id)
UNION ALL SELECT run_id, 'entrance_hesitation', 'Entrance Hesitation', coalesce(round(s, 2), -1.0) FROM runs LEFT JOIN (SELECT run_id, avg(score) AS s FROM gap_scores GROUP BY run_id) USING (run_id)
UNION ALL SELECT run_id, 'total_time_of_entry', 'Total Entry Time', score FROM total
UNION ALL SELECT run_id, 'move_along_wall', 'Move Along Wall', coalesce(s, 0.0) FROM runs LEFT JOIN (SELECT run_id, round_even(avg(n_safe / n_seen), 2) AS s FROM adherence GROUP BY run_id) USING (run_id))"""


@add(Q.query("SELECT r.run_id, r.metric_id, label, score, coalesce(i.n, 0) AS n_items, coalesce(f.n, 0) AS n_flags, coalesce(s.n, 0) AS n_numbers FROM recs r LEFT JOIN (SELECT run_id, metric_id, count(*) AS n FROM items GROUP BY ALL) i ON i.run_id = r.run_id AND i.metric_id = r.metric_id LEFT JOIN (SELECT run_id, metric_id, count(*) AS n FROM links GROUP BY ALL) f ON f.run_id = r.run_id AND f.metric_id = r.metric_id LEFT JOIN (SELECT run_id, metric_id, count(*) AS n FROM sums GROUP BY ALL) s ON s.run_id = r.run_id AND s.metric_id = r.metric_id", *_ALL, _SUMS, _RECORDS))
def R8_metric_records(spark, d):
    rows = _records(parts(spark, d))
    return rows.select("run_id", "metric_id", "label", "score", F.size("timeline_item_ids").cast("long").alias("n_items"), F.size("flag_ids").cast("long").alias("n_flags"), F.coalesce(F.size("summary"), F.lit(0)).cast("long").alias("n_numbers"))


@add(Q.query("SELECT run_id, 'friend' AS side, track_id, entry_number, 'Entry ' || entry_number AS label FROM chosen UNION ALL SELECT DISTINCT run_id, 'inroom', 99, NULL, 'In-room' FROM positions WHERE track_id = 99", Q.TEAM))
def R9_entities(spark, d):
    p = pos(spark, d)
    return session.entities(team(p), X.inroom(p))


def _documents(spark, d):
    x = parts(spark, d)
    runs = X.runs(x["positions"]).withColumn("fps", F.lit(30.0))
    flags = _flags(x)
    return session.documents(runs, session.with_flag_ids(_items(x), flags), _records(x), flags, session.entities(x["chosen"], X.inroom(x["positions"])))


_COUNTS = "SELECT r.run_id, (SELECT count(*) FROM items i WHERE i.run_id = r.run_id) AS n_items, (SELECT count(*) FROM links l WHERE l.run_id = r.run_id) AS n_flags, (SELECT count(*) FROM recs c WHERE c.run_id = r.run_id) AS n_metrics, (SELECT count(*) FROM chosen c WHERE c.run_id = r.run_id) AS n_friends FROM runs r"


@add(Q.query(_COUNTS, *_ALL, _SUMS, _RECORDS))
def S16_session_documents(spark, d):
    size = lambda path: F.json_array_length(F.get_json_object("document", path)).cast("long")
    return _documents(spark, d).select("run_id", size("$.timeline.items").alias("n_items"), size("$.flags").alias("n_flags"), size("$.metrics").alias("n_metrics"), size("$.entities.friends").alias("n_friends"))


@add(Q.query("SELECT run_id, CASE run_id % 4 WHEN 1 THEN 'version 1.0' WHEN 2 THEN 'no flags' WHEN 3 THEN 'not a JSON object' END AS reason FROM runs"))
def S17_validated(spark, d):
    text = F.col("document")
    broken = F.when(F.col("run_id") % 4 == 1, F.replace(text, F.lit('"schema_version":"2.0"'), F.lit('"schema_version":"1.0"'))).when(F.col("run_id") % 4 == 2, F.replace(text, F.lit('"flags":['), F.lit('"other":['))).when(F.col("run_id") % 4 == 3, F.substring(text, 2, 100)).otherwise(text)
    return session.judged(_documents(spark, d).withColumn("document", broken)).select("run_id", "reason")


@add(Q.query("SELECT r.run_id, coalesce(s.n, 0) AS n_segments, CASE WHEN r.run_id % 3 = 0 THEN 7 WHEN r.run_id % 3 = 1 THEN 9 END AS start_frame, CASE WHEN r.run_id % 2 = 0 THEN 'expert' ELSE 'trainee' END AS role FROM runs r LEFT JOIN (SELECT conv_id AS run_id, count(*) AS n FROM conversations GROUP BY 1) s ON s.run_id = r.run_id"))
def S18_enriched(spark, d):
    runs = X.runs(pos(spark, d))
    sessions = runs.withColumn("document", F.when(F.col("run_id") % 3 == 0, '{"drill_window":{"start_frame":7}}').otherwise("{}"))
    windows = runs.where("run_id % 3 <> 2").withColumn("start_frame", F.lit(9))
    manifests = runs.withColumn("role", F.when(F.col("run_id") % 2 == 0, "expert").otherwise("trainee"))
    out = session.enriched(sessions, R._segments(spark, d), windows, manifests)
    return out.select("run_id", F.coalesce(F.size("segments"), F.lit(0)).cast("long").alias("n_segments"), F.get_json_object("drill_window", "$.start_frame").cast("int").alias("start_frame"), "manifest.role")


# ---- tracks ----------------------------------------------------------------

_DOORS = [G.scaled(p, 1.15) for p in ROOM.doors]
_PLACES = f"places AS (SELECT run_id, track_id, frame, CASE WHEN {Q.any_inside('map_x', 'map_y', ROOM.doors)} THEN 'entry' WHEN {Q.any_inside('map_x', 'map_y', _DOORS)} THEN 'entry_buffer' WHEN {Q.inside('map_x', 'map_y', ROOM.boundary)} THEN 'interior' ELSE 'outside' END AS location FROM positions)"
_EVIDENCE = """ev_ AS (SELECT *, sum(CAST(location IN ('entry', 'entry_buffer') AS INT)) OVER w AS near, sum(CAST(location <> 'interior' AS INT)) OVER w AS br FROM places WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame)),
ev2_ AS (SELECT *, sum(CAST(location = 'interior' AS INT)) OVER (PARTITION BY run_id, track_id, br ORDER BY frame) AS streak FROM ev_),
ev AS (SELECT run_id, track_id, count(*) FILTER (location = 'entry') AS n_entry, count(*) FILTER (location = 'entry_buffer') AS n_buffer, count(*) FILTER (location = 'interior') AS n_interior, max(streak) AS longest_interior,
  min(CASE WHEN location = 'entry' THEN frame END) AS ea, min(CASE WHEN streak >= 10 AND near = 0 THEN frame END) AS ia FROM ev2_ GROUP BY ALL)"""


@add(Q.query("SELECT run_id, track_id, n_entry, n_buffer, n_interior, longest_interior, CASE WHEN ea IS NULL AND ia IS NULL THEN NULL WHEN ia IS NULL OR ea <= ia THEN 'entry' ELSE 'inroom' END AS role, least(ea, ia) AS locked_frame FROM ev", _PLACES, _EVIDENCE))
def A26_role_evidence(spark, d):
    where = G.birth_location(F.col("map_x"), F.col("map_y"), ROOM.boundary, ROOM.doors)
    return roles.role_evidence(pos(spark, d).select(*K, where.alias("location")))


_CONFIRMED = """spans_ AS (SELECT *, frame - row_number() OVER (PARTITION BY run_id, track_id ORDER BY frame) AS span FROM ev2_),
hit_ AS (SELECT *, row_number() OVER (PARTITION BY run_id, track_id, span ORDER BY frame) - CAST(span = min(span) OVER (PARTITION BY run_id, track_id) AS INT) AS hits FROM spans_),
locked AS (SELECT run_id, track_id, min(CASE WHEN location = 'entry' THEN frame END) AS ea, min(CASE WHEN streak >= 3 AND near = 0 AND hits >= 3 THEN frame END) AS ia, arg_min(location, frame) AS born FROM hit_ GROUP BY ALL)"""


@add(Q.query("SELECT l.run_id, l.track_id, CASE WHEN any_value(ea) IS NULL AND any_value(ia) IS NULL THEN CASE any_value(born) WHEN 'entry' THEN 'entry_candidate' WHEN 'interior' THEN 'inroom_candidate' ELSE 'unknown' END WHEN any_value(ia) IS NULL OR any_value(ea) <= any_value(ia) THEN 'entry' ELSE 'inroom' END AS role, any_value(least(ea, ia)) AS locked_frame, min(CASE WHEN h.frame >= least(ea, ia) AND hits >= 3 THEN h.frame END) AS first_output FROM locked l JOIN hit_ h USING (run_id, track_id) GROUP BY l.run_id, l.track_id", _PLACES, _EVIDENCE, _CONFIRMED))
def A26_confirmed_roles(spark, d):
    where = G.birth_location(F.col("map_x"), F.col("map_y"), ROOM.boundary, ROOM.doors)
    return roles.confirmed_roles(pos(spark, d).select(*K, where.alias("location")))


def _usable(ks) -> str:
    return f"list_filter([{', '.join(f'k[{i + 1}]' for i in ks)}], lambda p: p.score >= 0.8 AND p.x BETWEEN x1 AND x2 AND p.y BETWEEN y1 + 40 AND y2)"


def _mean(c: str) -> str:
    return ", ".join(f"list_avg(list_transform({g}, lambda p: p.{c}))" for g in ("feet", "ankles", "knees"))


@add(Q.query(f"SELECT run_id, track_id, frame, round(coalesce({_mean('x')}, (x1 + x2) / 2), 6) AS x, round(coalesce({_mean('y')}, y2), 6) AS y FROM (SELECT *, {_usable((20, 21, 22, 23, 24, 25))} AS feet, {_usable((15, 16))} AS ankles, {_usable((13, 14))} AS knees FROM keypoints)"))
def P17_birth_anchor(spark, d):
    box = [F.col("x1"), F.col("y1") + 40, F.col("x2"), F.col("y2")]
    k = X.keypoints(spark, d).withColumn("a", pairs.birth_anchor(F.col("keypoints"), box, 0.8))
    return k.select(*K, r6("a.x").alias("x"), r6("a.y").alias("y"))


@add(Q.query("SELECT d.run_id, d.track_id, d.frame, x1, CAST(len(k) AS INT) AS n_keypoints, ox, dx FROM detections d LEFT JOIN (SELECT run_id, track_id, frame, k FROM keypoints WHERE rk % 5 <> 0) p ON p.run_id = d.run_id AND p.track_id = d.track_id AND p.frame = d.frame LEFT JOIN gaze g ON g.run_id = d.run_id AND g.track_id = d.track_id AND g.frame = d.frame"))
def J1_track_details(spark, d):
    k = X.keypoints(spark, d).where("rk % 5 <> 0").select(*K, "keypoints")
    out = pairs.track_details(X.detections(spark, d).select(*K, *R.BOX), k, X.gaze(spark, d))
    return out.select(*K, "x1", F.when(F.col("keypoints").isNotNull(), F.size("keypoints")).alias("n_keypoints"), "ox", "dx")


def _walls() -> str:
    return "walls AS (SELECT run_id, track_id AS wall_id, sqrt(power(max(map_x) - min(map_x), 2) + power(max(map_y) - min(map_y), 2)) AS px, CAST(count(*) - 40 AS DOUBLE) / 10 AS len FROM positions GROUP BY ALL)"


@add(Q.query("SELECT run_id, wall_id, round(px / len, 6) AS scale, round(sum(px / len * px) OVER w / sum(px) OVER w, 6) AS run_scale, round((px / len) / (sum(px / len * px) OVER w / sum(px) OVER w), 6) AS ratio FROM walls WHERE px > 0 AND len > 0 WINDOW w AS (PARTITION BY run_id)", _walls()))
def A27_map_scale(spark, d):
    w = pos(spark, d).groupBy("run_id", F.col("track_id").alias("wall_id")).agg(F.min("map_x").alias("x1"), F.min("map_y").alias("y1"), F.max("map_x").alias("x2"), F.max("map_y").alias("y2"), ((F.count(F.lit(1)) - 40) / 10).alias("real_length"))
    return wall.map_scales(w).select("run_id", "wall_id", r6("scale").alias("scale"), r6("run_scale").alias("run_scale"), r6("ratio").alias("ratio"))


# A room around each run's positions: a door on its left wall and one at its upper right corner.
_AXES = """room_ AS (SELECT run_id, min(map_x) AS x0, min(map_y) AS y0, max(map_x) AS x1, max(map_y) AS y1 FROM positions GROUP BY run_id),
axes AS (SELECT run_id, 0 AS door_index, 'STRAIGHT' AS door_type, x0 + 20.0 AS cx, y0 + 155.0 AS cy, 0.0 AS ax, 1.0 AS ay, 0.0 AS bx, -1.0 AS by_, 1.0 AS nx, 0.0 AS ny FROM room_
UNION ALL SELECT run_id, 1, 'CORNER', x1 - 25.0, y0 + 15.0, 0.0, 1.0, -1.0, 0.0, 0.0, 1.0 FROM room_)"""


@add(Q.query("SELECT * FROM axes", _AXES))
def P23_door_axes(spark, d):
    p = pos(spark, d).groupBy("run_id").agg(F.min("map_x").alias("x0"), F.min("map_y").alias("y0"), F.max("map_x").alias("x1"), F.max("map_y").alias("y1"))
    box = lambda a, b, c, e: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (c, b), (c, e), (a, e))])
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    rooms = p.select("run_id", box(x0, y0, x1, y1).alias("boundary"))
    holes = F.array(box(x0, y0 + 120, x0 + 40, y0 + 190), box(x1 - 50, y0, x1, y0 + 30))
    found = doors.door_axes(p.select("run_id", F.posexplode(holes).alias("door_index", "polygon")), rooms)
    parts = {"cx": "centre.x", "cy": "centre.y", "ax": "way_a.x", "ay": "way_a.y", "bx": "way_b.x", "by_": "way_b.y", "nx": "inward.x", "ny": "inward.y"}
    return found.select("run_id", "door_index", "door_type", *[(F.round(c, 6) + 0.0).alias(n) for n, c in parts.items()])
