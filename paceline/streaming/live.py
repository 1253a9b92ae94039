"""Live detections: first entries, streaks in an area, presence by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import Step, in_order

SCHEMA = "run_id long, track_id long, frame int, ts timestamp, in_area boolean, is_entry boolean"


def detections(spark: SparkSession, path: str, late: str = "10 seconds", files_per_batch: int = 1, kind: str = "parquet", schema: str = SCHEMA) -> DataFrame:
    """A stream of Parquet or JSON files with a watermark on the event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path).withWatermark("ts", late)


def first_entries(rows: DataFrame) -> DataFrame:
    """run_id, first_frame: for update mode."""
    return rows.where("is_entry").groupBy("run_id").agg(F.min("frame").alias("first_frame"))


def presence(rows: DataFrame, width: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Detections per run and window (tumbling, or sliding where `slide` is given), each (run, frame, track) once."""
    unique = rows.dropDuplicatesWithinWatermark(["run_id", "frame", "track_id"]) if rows.isStreaming else rows.dropDuplicates(["run_id", "frame", "track_id"])
    return unique.groupBy("run_id", F.window("ts", width, slide) if slide else F.window("ts", width)).count().select("run_id", F.col("window.start").alias("start"), "count")


def sessions(rows: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """Spans in which a track was seen without a pause of `gap`."""
    return rows.groupBy("run_id", "track_id", F.session_window("ts", gap)).count().select("run_id", "track_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "count")


def _in_turn(rows: DataFrame, keys: list[str], step: Step, schema: str, kinds: str, idle: str, by_time: bool) -> DataFrame:
    """`step` over a stream's rows of each key: in order of time (`ordered.in_order`), or as they arrive, each micro-batch by frame.

    State of a key goes after `idle` without rows, of event time or of processing time.
    """
    if by_time:
        return in_order(rows, keys, step, schema, kinds, ["ts", "frame"], idle)
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def arrive(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new, out = step(key, tuple(state.get) if state.exists else None, pd.concat(parts).sort_values("frame", kind="stable"))
        state.update(new)
        state.setTimeoutDuration(ms)
        yield out

    return rows.groupBy(*keys).applyInPandasWithState(arrive, schema, kinds, "append", GroupStateTimeout.ProcessingTimeTimeout)


def area_streaks(rows: DataFrame, idle: str = "1 minute", by_time: bool = False) -> DataFrame:
    """run_id, track_id, frame, streak: consecutive frames in the area so far, per track.

    A missing frame or one outside breaks the streak; rows of one frame count once (in
    the area if one is).  A stream takes a track's rows as they arrive, where a frame
    not after the last one is late and counts nothing, or `by_time`; it forgets the
    track after `idle` without rows.
    """
    if not rows.isStreaming:
        one = rows.groupBy("run_id", "track_id", "frame").agg(F.coalesce(F.bool_or("in_area"), F.lit(False)).alias("in_"))
        track = Window.partitionBy("run_id", "track_id").orderBy("frame")
        breaks = (~F.col("in_") | (F.lag("frame", 1, -2).over(track) != F.col("frame") - 1)).cast("int")
        span = one.withColumn("span_", F.sum(breaks).over(track))
        streak = F.count_if("in_").over(Window.partitionBy("run_id", "track_id", "span_").orderBy("frame")).cast("int")
        return span.select("run_id", "track_id", "frame", streak.alias("streak"))

    def step(key: tuple, state: tuple | None, table: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last, streak = state or (-2, 0)
        inside = table.assign(in_area=table["in_area"].eq(True)).groupby("frame", sort=True)["in_area"].any()
        inside = inside[inside.index > last]
        if not len(inside):
            return (last, streak), pd.DataFrame(columns=["run_id", "track_id", "frame", "streak"])
        frames, flags = inside.index.to_numpy(), inside.to_numpy()
        broken = ~flags
        broken[1:] |= frames[1:] != frames[:-1] + 1
        broken[0] |= frames[0] != last + 1
        counted = np.where(flags, 1, 0).cumsum()
        starts = np.maximum.accumulate(np.where(broken, np.arange(len(frames)), -1))
        before = np.concatenate([[0], counted])
        streaks = np.where(starts < 0, counted + streak, counted - before[np.maximum(starts, 0)])
        streaks = np.where(flags, streaks, 0)
        out = pd.DataFrame({"run_id": key[0], "track_id": key[1], "frame": frames, "streak": streaks})
        return (int(frames[-1]), int(streaks[-1])), out

    return _in_turn(rows, ["run_id", "track_id"], step, "run_id long, track_id long, frame int, streak int", "last int, streak int", idle, by_time)


def _by_run(rows: DataFrame, first: Column, keep: Callable[[pd.DataFrame, int], pd.Series], join: Callable[[Column, Column], Column], idle: str, by_time: bool) -> DataFrame:
    """Rows of each run that pass a test against the run's first frame where `first` holds (-1: none yet).

    A batch takes that frame by a join; a stream keeps it in the run's state, which goes
    after `idle` without rows, and takes a run's rows as they arrive or `by_time`.
    """
    marked = rows.withColumn("first_", F.coalesce(first, F.lit(False)))
    if not rows.isStreaming:
        starts = marked.where("first_").groupBy("run_id").agg(F.min("frame").alias("start_"))
        return rows.join(starts, "run_id", "left").where(join(F.col("frame"), F.coalesce("start_", F.lit(-1)))).select(*rows.columns)
    names = rows.columns

    def step(key: tuple, state: tuple | None, table: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        start = state[0] if state else -1
        seen = table.loc[table["first_"], "frame"]
        if start < 0 and len(seen):
            start = int(seen.min())
        return (start,), table.loc[keep(table, start), names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _in_turn(marked, ["run_id"], step, schema, "start int", idle, by_time)


def until_stop(rows: DataFrame, frames: int, idle: str = "1 hour", by_time: bool = False) -> DataFrame:
    """Rows of each run up to `frames` frames after its first entry; all of them while nobody has entered.

    A run of a stream ends after `idle` without rows; to go `by_time` the rows need `ts`.
    """
    return _by_run(
        rows, F.col("is_entry"), lambda t, start: (t["frame"] <= start + frames) | (start < 0),
        lambda frame, start: (start < 0) | (frame <= start + frames), idle, by_time,
    )


def accepted_births(births: DataFrame, frames: int, least_score: float, idle: str = "1 hour", by_time: bool = False) -> DataFrame:
    """Births (run_id, frame, location, confidence) that may begin a track.

    Interior ones always may; those in an entry or its buffer need the score and
    must come before `frames` frames have passed since the first one in an entry.
    A run of a stream ends after `idle` without births; to go `by_time` they need `ts`.
    """
    good = births.where((F.col("location") == "interior") | (F.col("location").isin("entry", "entry_buffer") & (F.col("confidence") >= least_score)))
    return _by_run(
        good, F.col("location") == "entry", lambda t, start: (t["location"] == "interior") | (start < 0) | (t["frame"] < start + frames),
        lambda frame, start: (F.col("location") == "interior") | (start < 0) | (frame < start + frames), idle, by_time,
    )
