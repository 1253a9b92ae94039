"""Streams against their batch form: shuffled micro-batches, late rows, restarts, and state that goes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from paceline.streaming import live, ordered

SCHEMA = "run_id long, track_id long, frame int, ts timestamp, in_area boolean, is_entry boolean"


def rows_of(seed, n=120, runs=3):
    """Frames of a few tracks, a tenth of a second apart, with gaps and repeated rows."""
    rng, out = random.Random(seed), []
    for run in range(runs):
        for track in (1, 2):
            for f in range(n):
                if rng.random() < 0.9:
                    row = (run, track, f, 1000 + f * 100, rng.random() < 0.8 if f % 11 else None, run > 0 and f > 40 + 10 * run and rng.random() < 0.2)
                    out += [row] * (2 if rng.random() < 0.05 else 1)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "run_id long, track_id long, frame int, ms long, in_area boolean, is_entry boolean").select("run_id", "track_id", "frame", F.timestamp_millis("ms").alias("ts"), "in_area", "is_entry")


def files(spark, rows, folder, seed, most_late, n_files=6):
    """Files whose rows are disordered by up to `most_late` ms, and last a row of another run that moves the watermark on."""
    rng = random.Random(seed)
    by = sorted(rows, key=lambda r: r[3] + rng.uniform(0, most_late))
    size = -(-len(by) // n_files)
    for k in range(n_files):
        table(spark, by[k * size : (k + 1) * size]).coalesce(1).write.mode("append").parquet(folder)
    for k in range(2):  # long after: rows, then idle runs, are done with
        table(spark, [(99, 9, 10**6 + k, 10**9 * (k + 1), True, False)]).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def own(spark):
    return ordered.session(spark)


def run(stream, tmp_path, name, after=None):
    ordered.drain(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"), after)


@pytest.mark.parametrize("name, live_form, batch_form", [
    ("streaks", lambda r: live.area_streaks(r, "20 seconds", by_time=True), live.area_streaks),
    ("stop", lambda r: live.until_stop(r, 9, "20 seconds", by_time=True).select("run_id", "track_id", "frame"), lambda r: live.until_stop(r, 9).select("run_id", "track_id", "frame")),
])
def test_shuffled_batches_equal_the_batch_form(own, tmp_path, name, live_form, batch_form):
    rows = rows_of(7)
    folder = str(tmp_path / "in")
    files(own, rows, folder, 3, 4000)
    seen = []
    stream = live_form(live.detections(own, folder, "5 seconds"))
    run(stream, tmp_path, name, seen.append)
    got = ordered.drained(own, str(tmp_path / f"{name}-out"), stream.schema.simpleString()[7:-1].replace(":", " ")).where("run_id <> 99")
    want = batch_form(table(own, rows))
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert len(seen) > 3 and len(got) == len(want) and set(got) ^ set(want) == set()


def test_state_is_gone_after_the_watermark(own, tmp_path):
    folder = str(tmp_path / "in")
    files(own, rows_of(2), folder, 1, 3000, 3)
    stream = live.until_stop(live.detections(own, folder, "5 seconds"), 9, "20 seconds", by_time=True)
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    by_batch = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    keys = own.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "c")).select("key.run_id").distinct().collect()
    assert max(by_batch) > 0 and [r.run_id for r in keys] in ([], [99])


def test_rows_behind_the_watermark_are_dropped(own, tmp_path):
    folder = str(tmp_path / "in")
    for k, rows in enumerate(([(1, 1, f, 1 + f * 1000, True, False) for f in range(30)], [(1, 1, 100, 100_000, True, False)], [(1, 1, 200, 200_000, True, False)], [(1, 1, 50, 50_000, True, True)], [(99, 9, 1, 10**9, True, False)])):
        time.sleep(1.1 * (k > 0))  # files are taken by their times
        table(own, rows).coalesce(1).write.mode("append").parquet(folder)
    stream = live.until_stop(live.detections(own, folder, "5 seconds"), 9, "10 minutes", by_time=True).select("run_id", "frame")
    run(stream, tmp_path, "late")
    got = ordered.drained(own, str(tmp_path / "late-out"), "run_id long, frame int").where("run_id = 1")
    assert sorted(r.frame for r in got.collect()) == [*range(30), 100, 200]


def test_a_run_that_paused_begins_anew(own, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, 1, f, 1 + f * 1000, True, f == 3) for f in range(10)] + [(1, 1, f, 10**6 + f * 1000, True, False) for f in range(20, 25)]
    for part in (rows, [(99, 9, 1, 10**9, True, False)]):
        table(own, part).coalesce(1).write.mode("append").parquet(folder)
    stream = live.until_stop(live.detections(own, folder, "5 seconds"), 2, "1 minute", by_time=True).select("run_id", "frame")
    run(stream, tmp_path, "pause")
    got = ordered.drained(own, str(tmp_path / "pause-out"), "run_id long, frame int").where("run_id = 1")
    assert sorted(r.frame for r in got.collect()) == [0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 24]


def test_a_stream_that_was_killed_goes_on_where_it_was(own, tmp_path):
    rows = rows_of(5)
    folder = str(tmp_path / "in")
    files(own, rows, folder, 4, 3000)
    stream = live.area_streaks(live.detections(own, folder, "5 seconds"), "20 seconds", by_time=True)

    def die(number):
        if number == 2:
            raise RuntimeError("killed after its rows were written, before the batch was committed")

    with pytest.raises(Exception, match="killed"):
        run(stream, tmp_path, "kill", die)
    seen = []
    run(live.area_streaks(live.detections(own, folder, "5 seconds"), "20 seconds", by_time=True), tmp_path, "kill", seen.append)
    got = ordered.drained(own, str(tmp_path / "kill-out"), "run_id long, track_id long, frame int, streak int").where("run_id <> 99")
    assert seen[0] == 2 and sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in live.area_streaks(table(own, rows)).collect())


def test_births_of_a_stream(own, tmp_path):
    schema = "run_id long, frame int, ts timestamp, location string, confidence double"
    rng = random.Random(9)
    rows = [(run, f, 1000 + f * 100, rng.choice(["entry", "entry_buffer", "interior", "outside"]), rng.random()) for run in range(4) for f in range(60)]
    births = own.createDataFrame(rows, "run_id long, frame int, ms long, location string, confidence double").select("run_id", "frame", F.timestamp_millis("ms").alias("ts"), "location", "confidence")
    folder = str(tmp_path / "in")
    for k in range(3):
        births.where(F.abs(F.hash("frame", "run_id") % 3) == k).coalesce(1).write.mode("append").parquet(folder)
    own.createDataFrame([(99, 1, 10**9, "interior", 1.0)], "run_id long, frame int, ms long, location string, confidence double").select("run_id", "frame", F.timestamp_millis("ms").alias("ts"), "location", "confidence").coalesce(1).write.mode("append").parquet(folder)
    stream = live.accepted_births(live.detections(own, folder, "10 seconds", schema=schema), 20, 0.5, "20 seconds", by_time=True)
    run(stream, tmp_path, "births")
    got = ordered.drained(own, str(tmp_path / "births-out"), schema).where("run_id <> 99")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in live.accepted_births(births, 20, 0.5).collect())
