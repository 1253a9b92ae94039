"""Choices that hang on those before them, as folds in columns, against plain Python."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.operators import frames, pairs, pods
from paceline.plans.rooms import Room

ROOM = Room(boundary=((0, 0), (200, 0), (200, 120), (120, 120), (120, 60), (0, 60)), pods=((10, 50), (190, 10), (60, 30), (150, 110)))


def test_a_chain_of_poses_leaves_both_ends(spark):
    pose = lambda dx: [{"x": float(10 * k + dx), "y": float(10 * k)} for k in range(6)]
    rows = [(1, 1, k, 0.9 - 0.1 * k, pose(3 * k)) for k in range(4)]
    poses = spark.createDataFrame(rows, "run_id int, frame int, pose int, score double, keypoints array<struct<x:double,y:double>>")
    # reach is 3.5, so each is close to its neighbours only; 1 gives way to 0, 2 is free, 3 gives way to 2
    assert sorted(r.pose for r in pairs.suppressed_poses(poses).collect()) == [0, 2]


def test_boxes_left_in_a_frame(spark):
    rng = random.Random(1)
    rows = [(1, t, f, rng.randint(0, 60), rng.randint(0, 60), rng.choice([0.05, 0.5, 0.7, 0.7])) for f in range(40) for t in range(rng.randint(0, 9))]
    boxes = spark.createDataFrame([(r, t, f, float(x), float(y), x + 20.0, y + 30.0, c) for r, t, f, x, y, c in rows], "run_id int, track_id int, frame int, x1 double, y1 double, x2 double, y2 double, confidence double")
    want = []
    for f in range(40):
        kept = []
        for r in sorted((x for x in rows if x[2] == f and x[5] > 0.1), key=lambda x: (-x[5], x[1])):
            inter = [max(0, 20 - abs(r[3] - k[3])) * max(0, 30 - abs(r[4] - k[4])) for k in kept]
            if all(i / (1200 - i) <= 0.3 for i in inter):
                kept.append(r)
        want += [(f, r[1]) for r in kept[:3]]
    got = pairs.suppressed(boxes, 0.1, 0.3, top=3)
    assert sorted((r.frame, r.track_id) for r in got.collect()) == sorted(want) and got.columns == boxes.columns


def test_boxes_take_poses_in_turn(spark):
    point = lambda x, s=1.0: [{"x": float(x), "y": 5.0, "score": s}, {"x": 500.0, "y": 5.0, "score": 0.0}]
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 20.0, 10.0), (1, 1, 1, 2.0, 0.0, 22.0, 10.0), (1, 1, 2, 90.0, 0.0, 99.0, 10.0)], "run_id int, frame int, box int, x1 double, y1 double, x2 double, y2 double")
    poses = spark.createDataFrame([(1, 1, 7, point(10)), (1, 1, 8, point(18)), (1, 1, 9, point(95, 0.0))], "run_id int, frame int, pose int, keypoints array<struct<x:double,y:double,score:double>>")
    assert sorted((r.box, r.pose) for r in pairs.poses_in_boxes(boxes, poses).collect()) == [(0, 7), (1, 8)]


def test_keypoint_errors(spark):
    p = lambda *v: [{"x": float(x), "y": float(y), "score": s} for x, y, s in v]
    kind = "run_id int, frame int, track_id int, keypoints array<struct<x:double,y:double,score:double>>"
    a = spark.createDataFrame([(1, 1, 1, p((0, 0, 1.0), (5, 5, 1.0), (9, 9, 0.1))), (1, 2, 1, p((0, 0, 1.0))), (2, 1, 1, p((1, 1, 0.0)))], kind)
    b = spark.createDataFrame([(1, 1, 1, p((3, 1, 1.0), (5, 7, 1.0), (0, 0, 1.0))), (1, 3, 1, p((0, 0, 1.0))), (2, 1, 1, p((1, 1, 1.0)))], kind)
    got = {r.run_id: (r.n_poses, r.n_points, r.mean_error) for r in pairs.keypoint_errors(a, b, 0.3).collect()}
    assert got == {1: (1, 2, 1.5), 2: (0, 0, None)}


def test_smoothing_over_parts(spark):
    rng = random.Random(3)
    track = [(f, rng.uniform(0, 50), rng.uniform(0, 50)) for f in sorted(rng.sample(range(1500), 900))]
    rows = spark.createDataFrame([(1, 2, f, x, y) for f, x, y in track] + [(1, 3, 5, 1.0, 2.0)], "run_id long, track_id int, frame int, map_x double, map_y double").repartition(3)
    want, last = {}, track[0][1:]
    for f, x, y in track:
        w = min(0.3, max(0.1, 1 - math.dist((x, y), last) / 5))
        last = (w * x + (1 - w) * last[0], w * y + (1 - w) * last[1])
        want[f] = last
    got = {(r.track_id, r.frame): (r.map_x, r.map_y) for r in frames.smoothed(rows).collect()}
    assert got[3, 5] == (1.0, 2.0) and len(got) == 901
    assert all(got[2, f] == pytest.approx(v, abs=1e-9) for f, v in want.items())


def test_work_areas_of_tables_and_of_one_room(spark):
    rooms = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in ROOM.boundary])], "run_id int, boundary array<struct<x:double,y:double>>")
    spots = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(ROOM.pods)], "run_id int, pod_idx int, x double, y double")
    got = {r.pod_idx: (r.x, r.y) for r in pods.work_areas(rooms, spots, 20.0).collect()}
    for k, want in enumerate(pods.work_centres(ROOM, 20.0)):
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_pods_of_a_room_without_doors(spark):
    # starts near the wall y = 0 at x = 30 and walks up; the doorway is (30, 0)
    schema = "run_id int, track_id int, entry_number int, start_x double, start_y double, dx double, dy double, door_index int, sign int"
    vectors = spark.createDataFrame([(1, t, t, 30.0, 2.0, 0.0, 9.0, -1, 0) for t in (1, 2, 3, 4, 5)] + [(2, 1, 1, 30.0, 2.0, None, None, -1, 0)], schema)
    cx, cy = G.centroid(ROOM.boundary)
    length, (wx, wy, ws) = G.outline_length(ROOM.boundary), (30.0, 0.0, 30.0)
    sides = {1: [], -1: []}
    for k, (x, y) in enumerate(ROOM.pods):
        px, py, s = G.on_outline(x, y, ROOM.boundary)
        side = 1 if (cx - wx) * (py - wy) - (cy - wy) * (px - wx) >= 0 else -1
        sides[side].append(((s - ws if side == -1 else ws - s) % length, k))
    order = {s: [k for _, k in sorted(v, key=lambda x: -x[0])] for s, v in sides.items()}
    start = 1 if (cx - 30) * 9.0 - (cy - 2) * 0.0 >= 0 else -1
    got = {(r.run_id, r.track_id): r.pod_idx for r in pods.assign_by_side(vectors, ROOM).collect()}
    assert [got[1, t] for t in (1, 2, 3, 4, 5)] == [*pods.turn_order(order[start], order[-start]), None]
    assert got[2, 1] == (order[-1] or order[1])[0]
    grouped = dataclasses.replace(ROOM, pod_groups=("A", "A", "B", "A"))
    far = sorted((0, 1, 3), key=lambda k: -math.dist(ROOM.pods[k], (30, 0)))
    along = lambda k: (ROOM.pods[k][1] - 0) / math.dist(ROOM.pods[k], (30, 0))
    first = pods.turn_order(far, [2]) if max(map(along, far)) >= along(2) else pods.turn_order([2], far)
    got = {(r.run_id, r.track_id): r.pod_idx for r in pods.assign_by_group(vectors, grouped).collect()}
    assert [got[1, t] for t in (1, 2, 3, 4)] == first
    assert [got[1, t] for t in (1, 2, 3, 4)] and pods.assign_by_group(vectors, dataclasses.replace(ROOM, pod_groups=("A", "x", "B", "A"))).count() == 6


def test_blocked_areas_give_way(spark):
    room = Room(boundary=((0, 0), (200, 0), (200, 200), (0, 200)), pods=((100, 100),))
    quad = lambda x, y, h: [{"x": float(a), "y": float(b)} for a, b in ((x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h))]
    blockers = spark.createDataFrame([(1, 1, 9, quad(100, 85, 12)), (1, 2, 9, quad(100, 100, 60)), (1, 3, 9, quad(180, 180, 5)), (1, 4, 8, quad(100, 85, 12)), (1, 4, 9, quad(100, 100, 60))], "run_id int, frame int, track_id int, quad array<struct<x:double,y:double>>")
    got = {r.frame: (r.dy, len(r.quads)) for r in pods.moved_areas(blockers, room, 20.0).collect()}
    assert got == {1: (20.0, 1), 2: (0.0, 1), 4: (20.0, 2)}
    samples = spark.createDataFrame([(1, f, 1, pod, x, y) for f, pod, x, y in ((1, 0, 100.0, 130.0), (1, 0, 100.0, 95.0), (1, 0, 100.0, 70.0), (2, 0, 150.0, 150.0), (3, 0, 100.0, 110.0), (3, None, 100.0, 110.0), (5, 0, 100.0, 125.0))], "run_id int, frame int, track_id int, pod_idx int, map_x double, map_y double")
    got = sorted((r.frame, r.map_y, str(r.pod_idx), r.in_area) for r in pods.dynamic_membership(samples, blockers, room, 20.0).collect())
    assert got == [(1, 70.0, "0", False), (1, 95.0, "0", True), (1, 130.0, "0", True), (2, 150.0, "0", True), (3, 110.0, "0", True), (3, 110.0, "None", False), (5, 125.0, "0", False)]


def test_clipping_and_areas(spark):
    square = lambda h, x=0.0: F.array(*[F.struct(F.lit(x + a * h).alias("x"), F.lit(float(b * h)).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    row = spark.range(1).select(G.polygon_area(G.clipped(square(1.0), square(1.0, 1.5))).alias("part"), G.polygon_area(G.clipped(square(1.0), square(1.0, 9.0))).alias("none"), G.polygon_area(F.reverse(square(2.0))).alias("back")).first()
    assert (row.part, row.none, row.back) == (1.0, 0.0, -16.0)


def _anchors(points, least):
    found = {}
    for name, ks in pairs.ANCHORS.items():
        sure = [points[k] for k in ks if points[k][2] > least]
        if sure:
            found[name] = (*(sum(c) / len(sure) for c in zip(*sure, strict=True)), len(sure))
    for missing, other in (("shoulder", "neck"), ("neck", "shoulder")):
        if missing not in found and other in found:
            found[missing] = (*found[other][:3], 1)
    return found


def test_affinity_of_two_poses(spark):
    rng = random.Random(8)
    poses = [[(rng.uniform(0, 60), rng.uniform(0, 90), rng.choice([0.2, 0.6, 0.9])) for _ in range(26)] for _ in range(6)]
    poses.append([(0.0, 0.0, 0.1)] * 26)
    kind = "k int, keypoints array<struct<x:double,y:double,score:double>>"
    rows = spark.createDataFrame([(k, [{"x": x, "y": y, "score": s} for x, y, s in p]) for k, p in enumerate(poses)], kind).withColumn("a", pairs.anchors(F.col("keypoints"), 0.5))
    both = rows.select(F.col("k").alias("i"), F.col("a").alias("p")).join(rows.select(F.col("k").alias("j"), F.col("a").alias("q")), F.expr("i < j"))
    s, r = pairs.pose_affinity(F.col("p"), F.col("q"), F.lit(80.0))
    for row in both.select("i", "j", s.alias("s"), r.alias("r")).collect():
        p, q, total, weights = _anchors(poses[row.i], 0.5), _anchors(poses[row.j], 0.5), 0.0, 0.0
        for name, priority in pairs.PRIORITY.items():
            if name in p and name in q:
                near = math.exp(-(((p[name][0] - q[name][0]) / 80) ** 2 + ((p[name][1] - q[name][1]) / 80) ** 2) / (2 * 0.35**2))
                weight = priority * max(0.05, (p[name][2] + q[name][2]) / 2) * min(1.0, 0.35 + 0.15 * min(p[name][3], q[name][3]))
                total, weights = total + near * weight, weights + weight
        want = (total / weights if weights else 0.0, min(1.0, 2 * weights / sum(pairs.PRIORITY.values())))
        assert (row.s, row.r) == pytest.approx(want)
