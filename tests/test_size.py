"""What large tables need: few shuffles, of few columns, with the results of the plain way."""

from pyspark.sql import functions as F

from paceline.operators import gaze

SF = "/root/testdata/sf0.001"
ROOM = ((0, 0), (60, 0), (60, 40), (0, 40))


def exchanges(rows) -> int:
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_newly_seen_shuffles_gaze_only(spark):
    looks = spark.range(600).selectExpr("id % 3 AS run_id", "CAST(id % 4 AS INT) AS track_id", "CAST((id * 37) % 150 AS INT) AS frame", "CAST((id * 7) % 61 AS DOUBLE) AS ox", "CAST((id * 11) % 41 AS DOUBLE) AS oy", "CAST(id % 5 - 2 AS DOUBLE) AS dx", "CAST((id * 3) % 7 - 3 AS DOUBLE) AS dy").repartition(5)
    want = {}
    for r in gaze.seen_cells(looks, ROOM, 15.0, 1.0).collect():
        want[r.run_id, r.first_frame] = want.get((r.run_id, r.first_frame), 0) + 1
    new = gaze.newly_seen(looks, ROOM, 15.0, 1.0)
    assert exchanges(new) == 1  # before it is run, after which the plan is told twice
    assert {(r.run_id, r.frame): r.n_ for r in new.collect()} == want
    assert exchanges(gaze.newly_seen(looks.repartition("run_id").withColumn("ox", F.col("ox") + 1), ROOM, 15.0, 1.0)) == 1


def test_contact_shuffles_wrists_only(spark):
    from paceline.plans import queries_room as R

    rows = gaze.contact(gaze.touching_pairs(*R._sides(spark, SF)), R.X.gaze(spark, SF), R.ANGLE, R.X.keypoints(spark, SF))
    lines = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    cut = next(k for k, line in enumerate(lines) if "AS wrists_" in line)  # below the join
    assert not any("keypoints" in line for line in lines[:cut]) and any("Join" in line for line in lines[:cut])
    assert rows.columns == ["run_id", "frame", "friend_id", "inroom_id", *R.BOX, "looks", "reaches"]


def test_pair_affinity_is_that_of_the_maps(spark):
    from paceline.operators import pairs
    from paceline.plans import fixtures

    k = fixtures.keypoints(spark, SF).where("frame < 90 or run_id % 2 = 1").selectExpr("run_id", "track_id", "frame", "x1", "y1", "x2", "y2", "transform(keypoints, (p, i) -> named_struct('x', p.x, 'y', p.y, 'score', CASE WHEN (i + frame) % 3 = 0 OR frame % 11 = 0 THEN 0D ELSE p.score END)) AS keypoints")
    box = ("x1", "y1", "x2", "y2")
    scale = pairs.pose_scale([F.col(f"{c}_a") for c in box])
    maps = k.withColumn("m", pairs.anchors(F.col("keypoints"), 0.5)).drop("keypoints")
    s, r = pairs.pose_affinity(F.col("m_a"), F.col("m_b"), scale)
    keys = ("run_id", "frame_a", "track_id_a", "track_id_b")
    want = pairs.frame_pairs(maps, maps).where("track_id_a < track_id_b").select(*keys, s, r)
    flat = pairs.with_anchors(k, 0.5)
    got = pairs.pair_affinity(pairs.frame_pairs(flat, flat).where("track_id_a < track_id_b"), scale).select(*keys, "similarity", "reliability")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_close_poses_stay_in_their_run(spark):
    """Poses of unequal lengths against a plain loop; keypoints pass no join."""
    import math
    import random

    from paceline.operators import pairs
    from paceline.plans import queries_room as R

    dice = random.Random(3)
    rows = [(run, frame, pose, dice.random(), [(None if dice.random() < 0.1 else float(dice.randint(0, 9)), float(dice.randint(0, 9)), 1.0) for _ in range(dice.randint(1, 8))]) for run in (1, 2) for frame in range(12) for pose in range(dice.randint(1, 5))]
    poses = spark.createDataFrame(rows, "run_id long, frame int, pose int, score double, keypoints array<struct<x:double,y:double,score:double>>").repartition(3)

    def near(a, b, least):
        span = [max(v) - min(v) if (v := [p[k] for p in a if p[k] is not None]) else math.nan for k in (0, 1)]
        hits = sum(math.dist(p[:2], q[:2]) < 0.6 * math.hypot(*span) for p, q in zip(a, b) if None not in (p[0], q[0]))
        return hits > (len(a) // 2 if least is None else least)

    for least in (None, 2):
        want = {(r, f, p): sorted((-s2, p2) for r2, f2, p2, s2, k2 in rows if (r2, f2) == (r, f) and near(k, k2, least)) for r, f, p, _, k in rows}
        got = {(r.run_id, r.frame, r.pose): sorted(map(tuple, r.close or [])) for r in pairs.close_poses(poses, 0.6, least).collect()}
        assert got == want and any(len(v) > 1 for v in want.values())
    lines = R.T5_suppressed_poses(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Join" in line for line in lines[next(k for k, line in enumerate(lines) if "FlatMapGroupsInArrow" in line) :])


def test_circle_shares_are_those_of_the_clipped_circle(spark):
    """Convex quads in both directions, apart, around the circle and within it, rotated and not."""
    import math
    import random

    import numpy as np

    from paceline.functions import geometry as G

    dice, rows = random.Random(5), []
    for k in range(120):
        turn, w, h, x, y = dice.random() * 7 * (k % 3 > 0), dice.uniform(1, 90), dice.uniform(1, 90), dice.uniform(-60, 60), dice.uniform(-60, 60)
        quad = [(x + a * w * math.cos(turn) - b * h * math.sin(turn), y + a * w * math.sin(turn) + b * h * math.cos(turn)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        rows.append((k, quad[:: 1 - 2 * (k % 2)], dice.uniform(-20, 20), dice.uniform(-20, 20)))
    table = spark.createDataFrame(rows, "k int, quad array<struct<x:double,y:double>>, x double, y double")
    want = {r.k: r.s for r in table.select("k", G.circle_share(F.col("quad"), F.col("x"), F.col("y"), 30.0).alias("s")).collect()}
    got = G.circle_shares(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), 30.0, block=50)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert min(want.values()) == 0.0 and max(want.values()) > 0.999


def test_rows_with_keypoints_keep_their_order(spark):
    """What `write_detections` sorts while it is narrow is not sorted again with its keypoints."""
    from paceline.plans import fixtures

    rows = fixtures.detections(spark, SF, fixtures.positions(spark, SF, together=True)).selectExpr("*", "lag(frame) OVER (PARTITION BY run_id ORDER BY frame, track_id) AS before_")
    wide = fixtures.with_keypoints(rows).sortWithinPartitions("run_id", "frame", "track_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Sort [run_id") == 2  # for the two windows
