"""Registered queries that run as streams: events arrive in portions, and each portion's run goes on from the checkpoint of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import live, ordered
from .folders import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PORTIONS = 4
#: How far events may be out of order, and the pause after which a run or track has ended: no run pauses so long.
LATE, IDLE = "1 hour", "400 days"


def add(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


#: As JSON has no timestamps of its own, they are written to the microsecond.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def arriving(spark, rows: DataFrame, form, last: dict, kind: str = "parquet") -> DataFrame:
    """`form` of a stream of `rows` (with run_id and ts), which arrive by time in PORTIONS.

    A last row of run -1 and the values of `last`, long after all others, moves the
    watermark past them; it must be one that `form` doesn't filter out.
    """
    own, folder = ordered.session(spark), shared_folder(spark, "live")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cuts = rows.select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", [k / PORTIONS for k in range(1, PORTIONS)], 0.01) if span.a else []
    out, late = f"{folder}/out", None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        at = F.unix_micros("ts")
        part = rows.where((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True)))
        if high is None and span.a:
            names = {k: F.lit(v) for k, v in last.items()} | {"run_id": F.lit(-1), "ts": F.lit(span.b) + F.expr("INTERVAL 5 YEARS")}
            part = part.unionByName(spark.range(1).select(*[names.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))
        part.write.mode("append").options(**FORMATS).format(kind).save(f"{folder}/in")
        late = form(live.detections(own, f"{folder}/in", LATE, 1000, kind, _columns(rows)))
        ordered.drain(late, out, f"{folder}/checkpoint")
    return ordered.drained(spark, out, _columns(late)).where("run_id >= 0")


_EVENTS = "SELECT user_id % 5 AS run_id, user_id AS track_id, CAST(event_id AS INT) AS frame, ts, value > 20 AS in_area, value > 40 AS is_entry FROM events"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@add(_EVENTS)
def M1_detections(spark, d):
    rows = _events(spark, d).selectExpr("user_id % 5 AS run_id", "user_id AS track_id", "CAST(event_id AS INT) AS frame", "ts", "value > 20 AS in_area", "value > 40 AS is_entry")
    return arriving(spark, rows, lambda s: s, {}, "json").withColumn("ts", F.col("ts").cast(rows.schema["ts"].dataType))


# Frames are a track's events in order of time, every seventh event missing.
_FRAMES = "SELECT user_id % 5 AS run_id, user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS frame, ts, value > 20 AS in_area, value > 40 AS is_entry, event_id FROM events"


def _frames(spark, d):
    return spark.sql("SELECT * EXCEPT (event_id) FROM (" + _FRAMES.replace("FROM events", "FROM {events}") + ") WHERE event_id % 7 <> 0", events=_events(spark, d))


@add(f"""WITH f AS (SELECT * FROM ({_FRAMES}) WHERE event_id % 7 <> 0),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS g FROM f WHERE in_area)
SELECT run_id, track_id, frame, CAST(0 AS INT) AS streak FROM f WHERE NOT coalesce(in_area, false)
UNION ALL SELECT run_id, track_id, frame, CAST(row_number() OVER (PARTITION BY track_id, g ORDER BY frame) AS INT) FROM g""")
def M4_area_streaks(spark, d):
    return arriving(spark, _frames(spark, d), lambda s: live.area_streaks(s, IDLE, by_time=True), {"track_id": -1})


_STOP = "SELECT run_id, track_id, frame FROM (SELECT user_id % 5 AS run_id, user_id AS track_id, CAST(event_id AS INT) AS frame, min(CASE WHEN value > 400 THEN event_id END) OVER (PARTITION BY user_id % 5) AS f FROM events) WHERE f IS NULL OR frame <= f + 200"


@add(_STOP)
def M3_until_stop_live(spark, d):
    rows = _events(spark, d).selectExpr("user_id % 5 AS run_id", "user_id AS track_id", "CAST(event_id AS INT) AS frame", "ts", "value > 400 AS is_entry")
    return arriving(spark, rows, lambda s: live.until_stop(s, 200, IDLE, by_time=True).select("run_id", "track_id", "frame"), {})


_BIRTHS = "SELECT user_id % 5 AS run_id, CAST(event_id AS INT) AS frame, ts, CASE event_id % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'entry_buffer' WHEN 2 THEN 'interior' ELSE 'outside' END AS location, CAST(user_id % 10 AS DOUBLE) / 10 AS confidence FROM events"


@add(f"SELECT run_id, frame, location FROM (SELECT *, min(CASE WHEN location = 'entry' AND confidence >= 0.5 THEN frame END) OVER (PARTITION BY run_id) AS f FROM ({_BIRTHS})) WHERE location = 'interior' OR (location IN ('entry', 'entry_buffer') AND confidence >= 0.5 AND (f IS NULL OR frame < f + 300))")
def M5_accepted_births_live(spark, d):
    rows = spark.sql(_BIRTHS.replace("FROM events", "FROM {events}"), events=_events(spark, d))
    return arriving(spark, rows, lambda s: live.accepted_births(s, 300, 0.5, IDLE, by_time=True).select("run_id", "frame", "location"), {"location": "interior", "confidence": 1.0})
