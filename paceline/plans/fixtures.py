"""Tables of the library's schemas derived from the given tables.

Positions come from `lineitem`: five tracks per run, frames in date order with
gaps, paths that bounce through a room.  Boxes, gaze and the rest follow from
positions.  Everything is whole-number arithmetic, so that SQL gives equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rooms import Room

ROOM = Room(
    boundary=((22, 0), (450, 0), (450, 316), (22, 316)),
    pods=((75, 263), (75, 53), (290, 263), (397, 263)),
    doors=(((22, 120), (60, 120), (60, 190), (22, 190)), ((200, 0), (260, 0), (260, 40), (200, 40))),
    hesitation_threshold=1.0,
)

#: The same views in SQL (one WITH list without the keyword).
SQL = """
base_ AS (SELECT l_suppkey AS s, l_linenumber AS ln, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rk FROM lineitem),
positions AS MATERIALIZED (SELECT s // 5 AS run_id, CASE WHEN s % 5 = 0 THEN 99 ELSE s % 5 END AS track_id, rk + (s * s * 17 + s * 53) % 240 AS frame,
  CAST(22 + abs((rk * 3 + s * 97) % 856 - 428) AS DOUBLE) AS map_x, CAST(abs((rk * 2 + s * 61) % 632 - 316) AS DOUBLE) AS map_y, rk, s FROM base_ WHERE ln <> 7),
detections AS MATERIALIZED (SELECT *, 2 * map_x - 20 AS x1, 2 * map_y - 60 AS y1, 2 * map_x + 20 AS x2, 2 * map_y + 20 AS y2, CAST((rk * 7 + s * 13) % 100 AS DOUBLE) / 100 AS confidence,
  CASE WHEN track_id = 99 THEN 'inroom' WHEN s % 3 = 0 THEN NULL ELSE 'entry' END AS identity_role, track_id = 99 AS is_inroom, (track_id <> 99 AND rk >= 4) AS is_entry FROM positions),
friends AS (SELECT * FROM positions WHERE track_id <> 99),
spans AS (SELECT run_id, track_id, count(*) AS n_samples, min(frame) AS first_frame, max(frame) AS last_frame FROM friends GROUP BY ALL),
entrants AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_frame, track_id) AS entry_number FROM spans),
runs AS (SELECT DISTINCT run_id FROM positions),
gaze AS (SELECT run_id, track_id, frame, (x1 + x2) / 2 AS ox, y1 AS oy, CAST((rk + s) % 5 - 2 AS DOUBLE) AS dx, CAST((rk * 3 + s) % 5 - 2 AS DOUBLE) AS dy FROM detections WHERE rk % 17 <> 0),
keypoints AS (SELECT run_id, track_id, frame, list_transform(range(26), lambda k: {'x': x1 + (k * 7 + rk) % 40, 'y': y1 + (k * 5 + s) % 80, 'score': CAST((k * 3 + rk) % 10 AS DOUBLE) / 10}) AS k, x1, y1, x2, y2, s, rk FROM detections)
"""


def positions(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """run_id, track_id, frame, map_x, map_y and the counters rk and s; track 99 is in the room.

    `together`: a run's rows come to one task while they are narrow, so that what is
    made of them by run, track or frame needs no other shuffle.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_suppkey div 5 AS run_id", "l_suppkey AS s", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    by = "run_id, s" if together else "s"
    ranked = (lines.repartition("run_id") if together else lines).selectExpr("run_id", "s", "l_linenumber AS ln", f"row_number() OVER (PARTITION BY {by} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rk")
    return ranked.where("ln <> 7").selectExpr(
        "run_id", "CAST(CASE WHEN s % 5 = 0 THEN 99 ELSE s % 5 END AS INT) AS track_id", "CAST(rk + (s * s * 17 + s * 53) % 240 AS INT) AS frame",
        "CAST(22 + abs((rk * 3 + s * 97) % 856 - 428) AS DOUBLE) AS map_x", "CAST(abs((rk * 2 + s * 61) % 632 - 316) AS DOUBLE) AS map_y", "rk", "s",
    )


def detections(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Positions (`rows`, if they are there already) with a box, a confidence, a role (null for every third track) and flags."""
    return (positions(spark, sf_dir) if rows is None else rows).selectExpr(
        "*", "2 * map_x - 20 AS x1", "2 * map_y - 60 AS y1", "2 * map_x + 20 AS x2", "2 * map_y + 20 AS y2", "CAST((rk * 7 + s * 13) % 100 AS DOUBLE) / 100 AS confidence",
        "CASE WHEN track_id = 99 THEN 'inroom' WHEN s % 3 = 0 THEN NULL ELSE 'entry' END AS identity_role", "track_id = 99 AS is_inroom", "(track_id <> 99 AND rk >= 4) AS is_entry",
        "CASE WHEN track_id = 99 THEN 'interior' ELSE 'entry_buffer' END AS birth_location",
    )


def gaze(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """run_id, track_id, frame, ox, oy, dx, dy; some of no length, every 17th missing."""
    return detections(spark, sf_dir, rows).where("rk % 17 <> 0").selectExpr("run_id", "track_id", "frame", "(x1 + x2) / 2 AS ox", "y1 AS oy", "CAST((rk + s) % 5 - 2 AS DOUBLE) AS dx", "CAST((rk * 3 + s) % 5 - 2 AS DOUBLE) AS dy")


#: 26 of x, y, score.
KEYPOINTS = "transform(sequence(0, 25), k -> named_struct('x', x1 + (k * 7 + rk) % 40, 'y', y1 + (k * 5 + s) % 80, 'score', CAST((k * 3 + rk) % 10 AS DOUBLE) / 10))"


def with_keypoints(rows: DataFrame) -> DataFrame:
    """Detections with their keypoints (26 of x, y, score), in the order that they have (an explode would lose it)."""
    return rows.selectExpr("*", f"{KEYPOINTS} AS keypoints")


def keypoints(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """run_id, track_id, frame, keypoints (26 of x, y, score) and the box."""
    rows = detections(spark, sf_dir, rows)
    return rows.selectExpr("run_id", "track_id", "frame", "x1", "y1", "x2", "y2", "s", "rk", f"explode(array({KEYPOINTS})) AS keypoints")  # exploded, so that it is computed once


def inroom(rows: DataFrame) -> DataFrame:
    return rows.where("track_id = 99").select("run_id", "track_id").distinct()


def runs(rows: DataFrame) -> DataFrame:
    return rows.select("run_id").distinct()
