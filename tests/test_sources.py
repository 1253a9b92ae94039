"""Files in the caches' own formats, and streams against batches."""

import json

from pyspark.sql import functions as F

from paceline.sources import caches
from paceline.streaming import live


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_csv_caches(spark, tmp_path):
    run = tmp_path / "run1"
    put(run, "v_PositionCache.txt", "Frame,Track,MAPX,mapY\n1,2,3.5,4\nx,2,1,1\n2,2,,1\n")
    got = caches.read_positions(spark, str(tmp_path / "*/*_PositionCache.txt")).collect()
    assert [tuple(r) for r in got] == [("run1", 1, 2, 3.5, 4.0)]
    put(run, "v_ThreatClearanceCache.txt", "inroom_id,immediate_frame,contact_end_frame,clearing_friend\n99,-1,-1,-1\n100,5,9,2\n")
    got = caches.read_clearance(spark, str(run / "*_ThreatClearanceCache.txt")).orderBy("inroom_id").collect()
    assert [tuple(r)[1:] for r in got] == [(99, None, None, None), (100, 5, 9, 2)]
    put(run, "v_PodCache.txt", "pod_idx,assigned_id,capture_time_sec,capture_frame\n0,,,\n1,3,2.5,80\n")
    got = caches.read_pods(spark, str(run / "*_PodCache.txt")).orderBy("pod_idx").collect()
    assert [(r.captured, r.assigned) for r in got] == [(False, False), (True, True)]
    put(run, "v_Metrics.csv", "metric_name,score\na,0.5\nb,\nc,zz\n")
    assert sorted((r.metric, r.score) for r in caches.read_scores(spark, str(run / "*_Metrics.csv")).collect()) == [("a", 0.5), ("b", 0.0)]
    put(run, "v_GazeCache.txt", "frame,id,ox,oy,dx,dy\n1,2,1,1,0,1\n1,2\n")
    assert caches.read_gaze(spark, str(run / "*_GazeCache.txt")).count() == 1


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    put(tmp_path / "a", "v_PositionCache.txt", "frame,id,mapX,mapY\n1,2,3,4\n")
    put(tmp_path / "b", "v_PositionCache.txt", "mapY,MapX,track_id,frame\n4,3,2,1\n5,6\n\n")
    got = caches.read_positions(spark, str(tmp_path / "*/*_PositionCache.txt")).orderBy("run_id").collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, 3.0, 4.0), ("b", 1, 2, 3.0, 4.0)]


def test_coverage_and_polygons(spark, tmp_path):
    put(tmp_path / "r", "v_RoomCoverageCache.txt", "frame,coverage_fraction\n1,0.5\n2,1.5\n\nfirst_non_enemy_frame,1\ntime_to_full_seconds,2.5\nfinal_fraction,1.0\n")
    curve, summary = caches.read_coverage(spark, str(tmp_path / "r/*.txt"))
    assert [(r.frame, r.fraction) for r in curve.orderBy("frame").collect()] == [(1, 0.5), (2, 1.0)]
    assert summary.first().time_to_full == 2.5
    put(tmp_path / "p", "polys.txt", "# doors\n0,0, 1,0, 1,1\n1,2\n0 0 1 0 1 1 0\n")
    got = caches.read_polygons(spark, str(tmp_path / "p/polys.txt")).collect()
    assert [len(r.polygon) for r in got] == [3]


def test_tracker_and_manifests(spark, tmp_path):
    obj = {"id": 3, "bbox": [1, 2, 3, 4], "confidence": 0.9, "keypoints": [[1, 2]], "keypoint_scores": [0.5], "is_entry": True}
    put(tmp_path / "runA", "v_TrackerOutput.json", json.dumps([{"frame": 1, "objects": [obj, {"id": 4, "bbox": [1, 2]}, {"bbox": [1, 2, 3, 4]}]}, {"frame": 2, "objects": []}]))
    got = caches.read_detections(spark, str(tmp_path / "*/*_TrackerOutput.json")).collect()
    assert [(r.run_id, r.frame, r.track_id, r.x2, r.keypoints[0].score, r.is_entry) for r in got] == [("runA", 1, 3, 3.0, 0.5, True)]
    put(tmp_path / "runA", "RunInfo.json", "{}")
    runs = caches.read_runs(spark, str(tmp_path / "*/RunInfo.json"))
    assert (runs.first().run_id, runs.first().role) == ("runA", "trainee")
    meta = spark.createDataFrame([("runB", 60.0)], "run_id string, fps double")
    assert caches.with_fps(runs, meta).first().fps == 30.0


def test_stream_equals_batch(spark, tmp_path):
    flags = [True, True, False, True, True, True, None, True, True]
    rows = [(1, 2, f, f"2024-01-01 00:00:{f:02d}", inside, f > 3) for f, inside in enumerate(flags, 1) if inside is not None]
    table = spark.createDataFrame(rows, "run_id long, track_id long, frame int, t string, in_area boolean, is_entry boolean").withColumn("ts", F.to_timestamp("t")).drop("t").select("run_id", "track_id", "frame", "ts", "in_area", "is_entry")
    for k, part in enumerate((table.where("frame <= 4"), table.where("frame > 4"))):
        part.coalesce(1).write.mode("append" if k else "overwrite").parquet(str(tmp_path / "in"))
    stream = live.detections(spark, str(tmp_path / "in"))
    query = live.area_streaks(stream).writeStream.format("memory").queryName("streaks").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted((r.frame, r.streak) for r in spark.table("streaks").collect()) == [(1, 1), (2, 2), (3, 0), (4, 1), (5, 2), (6, 3), (8, 1), (9, 2)]
    query = live.first_entries(live.detections(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("first").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert spark.table("first").collect() == live.first_entries(table).collect()
    query = live.until_stop(live.detections(spark, str(tmp_path / "in")), 2).writeStream.format("memory").queryName("stopped").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    kept = sorted(r.frame for r in spark.table("stopped").collect())
    assert kept == sorted(r.frame for r in live.until_stop(table, 2).collect()) == [1, 2, 3, 4, 5, 6]


def test_accepted_births(spark):
    rows = [(1, 3, "entry_buffer", 0.9), (1, 5, "entry", 0.9), (1, 5, "entry", 0.1), (1, 7, "entry", 0.9), (1, 8, "entry", 0.9), (1, 9, "interior", 0.0), (1, 6, "outside", 0.9), (2, 50, "entry_buffer", 0.6)]
    births = spark.createDataFrame(rows, "run_id long, frame int, location string, confidence double")
    assert sorted((r.run_id, r.frame) for r in live.accepted_births(births, 3, 0.5).collect()) == [(1, 3), (1, 5), (1, 7), (1, 9), (2, 50)]


def test_tracker_files_are_written_row_by_row(spark, tmp_path):
    """One JSON array per run, compressed or not; what `widened` adds passes no shuffle and no sort."""
    rows = spark.createDataFrame([(1, 5, 2, 1.0), (1, 5, 1, 2.0), (1, 4, 1, 3.0), (2, 9, 7, 4.0), (1, 4, 1, 5.0)], "run_id long, frame int, track_id int, x1 double").selectExpr("*", "x1 AS y1", "x1 AS x2", "x1 AS y2").repartition(3)
    plans = []

    def widened(r):
        out = r.withColumn("confidence", F.col("x1") / 10)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    caches.write_detections(rows, str(tmp_path / "a"), "gzip", widened)
    caches.write_detections(rows, str(tmp_path / "b"))
    assert plans[0].index("confidence") < plans[0].index("Window")  # above the window and so above its shuffle
    assert len(list((tmp_path / "a").glob("*/*.txt.gz"))) == 2
    first = json.loads("".join(p.read_text() for p in (tmp_path / "b").glob("run_id=1/*.txt")))
    assert [(f["frame"], [o["id"] for o in f["objects"]]) for f in first] == [(4, [1, 1]), (5, [1, 2])]
    want = sorted((str(r.run_id), r.frame, r.track_id, r.x1) for r in rows.collect())
    for name, ends, scale in (("a", "*/*.txt.gz", 0.1), ("b", "*/*.txt", None)):
        got = caches.read_detections(spark, str(tmp_path / name / ends)).collect()
        assert sorted((r.run_id, r.frame, r.track_id, r.x1) for r in got) == want
        assert all(r.confidence == (r.x1 / 10 if scale else None) for r in got)


def test_positions_pass_one_shuffle(spark):
    """What is made of positions by run, track or frame needs no shuffle besides that of the lines."""
    from paceline.plans import fixtures

    SF = "/root/testdata/sf0.001"
    p = fixtures.detections(spark, SF, fixtures.positions(spark, SF, together=True))
    plan = p.groupBy("run_id", "frame").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
