"""Small hand-made cases of the movement operators."""

import pytest
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.functions import scores as S
from paceline.operators import entry, frames, gaze, pods, roles, wall
from paceline.plans.rooms import Room, door_axes

ROOM = Room(boundary=((0, 0), (100, 0), (100, 80), (0, 80)), pods=((10, 10), (90, 10), (10, 70), (90, 70)), doors=(((40, 0), (60, 0), (60, 10), (40, 10)),))


def positions(spark, tracks):
    rows = [(1, t, f, float(x), float(y)) for t, points in tracks.items() for f, x, y in points]
    return spark.createDataFrame(rows, "run_id int, track_id int, frame int, map_x double, map_y double")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_straight_and_corner_doors():
    assert door_axes(ROOM.boundary, ROOM.doors[0]).kind == "STRAIGHT"
    corner = door_axes(ROOM.boundary, ((0, 0), (10, 0), (10, 10), (0, 10)))
    assert corner.kind == "CORNER"
    assert {corner.p_a, corner.p_b} == {(1.0, 0.0), (0.0, 1.0)}
    assert door_axes(((0, 0), (1, 0)), ROOM.doors[0]) is None


def test_entrants_tie_and_team_size(spark):
    p = positions(spark, {3: [(5, 0, 0), (6, 0, 0)], 1: [(5, 0, 0), (6, 0, 0)], 2: [(1, 0, 0)]})
    got = [(r.track_id, r.entry_number) for r in roles.entrants(p, None, 2).orderBy("entry_number").collect()]
    assert got == [(1, 1), (3, 2)]
    assert roles.entrants(p, None, 0).count() == 3


def test_fewer_than_two_entrants(spark):
    p = positions(spark, {1: [(1, 50, 5), (2, 50, 6)]})
    chosen = roles.entrants(p, None, 4)
    runs = p.select("run_id").distinct()
    assert entry.hesitation_scores(runs, entry.pair_gaps(chosen, ROOM)).first().score == -1.0
    assert entry.total_entry(chosen, ROOM).first().score == 0.0


def test_missing_frame_splits_a_run(spark):
    p = positions(spark, {1: [(1, 0, 0), (2, 0, 0), (4, 0, 0)]})
    got = sorted((r.start_frame, r.end_frame) for r in frames.islands(p).collect())
    assert got == [(1, 2), (4, 4)]


def test_penalty_at_the_limit(spark):
    r = one(spark, S.time_penalty(F.lit(2.0), F.lit(2.0)).alias("a"), S.time_penalty(F.lit(0.0), F.lit(0.0)).alias("b"), S.time_penalty(F.lit(0.0), F.lit(1.0)).alias("c"))
    assert (r.a, r.b, r.c) == (0.0, 0.0, 1.0)


def test_cone_touching_an_edge_shares_no_area(spark):
    cone = [F.lit(float(v)) for v in (0, 0, 10, -10, 10, 10)]
    r = one(spark, G.triangle_meets_box(cone, [F.lit(float(v)) for v in (10, -5, 20, 5)]).alias("touch"), G.triangle_meets_box(cone, [F.lit(float(v)) for v in (9, -5, 20, 5)]).alias("meet"))
    assert (r.touch, r.meet) == (False, True)
    r = one(spark, G.boxes_touch([F.lit(float(v)) for v in (0, 0, 1, 1)], [F.lit(float(v)) for v in (1, 1, 2, 2)]).alias("t"))
    assert r.t


def test_zero_gaze_is_seen_but_clears_nothing(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 2.0, 2.0), (1, 1, 2, 50.0, 50.0, 52.0, 52.0)], "run_id int, frame int, track_id int, x1 double, y1 double, x2 double, y2 double")
    looks = spark.createDataFrame([(1, 1, 2, 51.0, 51.0, 0.0, 0.0)], "run_id int, frame int, track_id int, ox double, oy double, dx double, dy double")
    seen = {r.track_id: r.seen for r in gaze.seen_teammates(boxes, looks, 60.0).collect()}
    assert seen == {1: True, 2: False}
    pairs = boxes.where("track_id = 1").select("run_id", "frame", F.lit(99).alias("inroom_id"), F.lit(2).alias("friend_id"), "x1", "y1", "x2", "y2")
    assert not gaze.contact(pairs, looks, 60.0).first().looks


def test_contact_run_of_exactly_the_least_length(spark):
    rows = [(1, 99, 1, f, f == 3, True) for f in (1, 2, 3)] + [(1, 99, 2, f, True, True) for f in (1, 2)]
    got = gaze.contact_runs(spark.createDataFrame(rows, "run_id int, inroom_id int, friend_id int, frame int, reaches boolean, looks boolean"), 3, 1, 2).collect()
    assert [(r.friend_id, r.start_frame, r.end_frame) for r in got] == [(1, 3, 3)]


def test_turn_order_passes_over_an_empty_side():
    assert pods.turn_order([1], [2, 3, 4]) == [1, 2, 3, 4]
    assert pods.turn_order([], [2, 3]) == [2, 3]


def test_doorway_assignment_matches_turns(spark):
    p = positions(spark, {t: [(t, 50, 5), (t + 1, 51, 5)] for t in (1, 2, 3, 4, 5)})
    got = {r.track_id: r.pod_idx for r in pods.assign_by_doorway(p, roles.entrants(p, None, 0), ROOM.pods).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 0, 5: None}


def test_overlap_share(spark):
    def share(x, y):
        quad = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((-10, -10), (10, -10), (10, 10), (-10, 10))])
        return spark.range(1).select(G.circle_share(quad, F.lit(float(x)), F.lit(float(y)), 1.0).alias("s"), G.circle_share(F.reverse(quad), F.lit(float(x)), F.lit(float(y)), 1.0).alias("r")).first()

    for at, want in (((0, 0), 1.0), ((10, 0), 0.5), ((30, 0), 0.0)):
        got = share(*at)
        assert got.s == pytest.approx(want, abs=0.01 if want == 0.5 else 1e-12) and got.r == pytest.approx(got.s, abs=1e-12)


def test_few_length_samples_give_null(spark):
    rows = spark.createDataFrame([(1, 1, 5.0)] * 4 + [(1, 2, v) for v in (5.0, 5.0, 5.0, 5.0, 5.0, 90.0)], "run_id int, track_id int, length double")
    got = {r.track_id: r.length for r in wall.robust_lengths(rows).collect()}
    assert got == {1: None, 2: 5.0}


def test_smoothing_goes_on_over_a_gap(spark):
    p = positions(spark, {1: [(1, 0, 0), (2, 4, 0), (20, 8, 0)]})
    got = [r.map_x for r in frames.smoothed(p).orderBy("frame").collect()]
    assert got == pytest.approx([0, 0.8, 1.52])


def test_results_do_not_depend_on_partitioning(spark):
    p = positions(spark, {t: [(t * 3 + k, 40 + k + t, 2 + k) for k in range(20)] for t in (1, 2, 3)})
    chosen = roles.entrants(p, None, 0)
    a = entry.entry_vectors(p, chosen, ROOM).orderBy("track_id").collect()
    b = entry.entry_vectors(p.repartition(7), chosen, ROOM).orderBy("track_id").collect()
    assert [(r.track_id, r.side, round(r.dx, 6)) for r in a] == [(r.track_id, r.side, round(r.dx, 6)) for r in b]


def test_every_ray_and_pixel_counts_towards_coverage(spark):
    rng = __import__("random").Random(6)
    rays = [(run, 1, f, rng.uniform(0, 20), rng.uniform(0, 12), float(rng.randint(-2, 2)), float(rng.randint(-2, 2))) for run in (1, 2) for f in range(40)]
    looks = spark.createDataFrame(rays, "run_id int, track_id int, frame int, ox double, oy double, dx double, dy double")
    room = [(0.0, 0.0), (20.0, 0.0), (20.0, 8.0), (12.0, 12.0), (0.0, 12.0)]
    want = {}
    for r in gaze.seen_cells(looks, room, 15.0, 1.0).collect():
        want[r.run_id, r.first_frame] = want.get((r.run_id, r.first_frame), 0) + 1
    for frames_in_slice in (3, 512):
        assert {(r.run_id, r.frame): r.n_ for r in gaze.newly_seen(looks, room, 15.0, 1.0, frames_in_slice).collect()} == want
    assert len(gaze.cell_grid(room, 1.0)[0]) == gaze.room_cells(room, 1.0)

    from paceline.plans import queries_room as R

    d = "/root/testdata/sf0.001"
    team = R.X.gaze(spark, d).where("track_id <> 99 and (dx <> 0 or dy <> 0)").count()
    assert R._mapgaze(spark, d).count() == team > 0
    assert R.PIXEL == 1.0


def test_nearest_of_the_whole_gallery(spark):
    import numpy as np
    from paceline.operators import pairs
    from paceline.plans import queries_room as R

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    want = {}
    for q in (r for r in rows if r.vec_id % 10 == 0):
        y = np.array(q.embedding, float)
        for g in (r for r in rows if r.vec_id % 10):
            x = np.array(g.embedding, float)
            want[g.label, q.vec_id] = min(want.get((g.label, q.vec_id), 9.0), max(0.0, 1 - x @ y / np.sqrt((x @ x) * (y @ y))))
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    blocks = pairs.nearest_in_gallery(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "label", "vec_id", 40)
    met = pairs.nearest_in_gallery(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "label", "vec_id", 40, most_bytes=0)
    for got in (R.J16_gallery_distance_whole(spark, d), blocks, met):
        assert {(r.label, r.vec_id): r.distance for r in got.collect()} == pytest.approx(want, abs=1e-5)


def test_door_axes_of_tables_and_of_settings(spark):
    from paceline.operators import doors
    from paceline.plans.rooms import door_axes

    room = ((0.0, 0.0), (100.0, 0.0), (100.0, 60.0), (40.0, 80.0), (0.0, 60.0))
    holes = [((0.0, 20.0), (5.0, 20.0), (5.0, 30.0), (0.0, 30.0)), ((92.0, 0.0), (100.0, 0.0), (100.0, 6.0), (92.0, 6.0)), ((50.0, 70.0), (60.0, 68.0), (60.0, 75.0)), ((1.0, 1.0),)]
    points = lambda ps: [{"x": x, "y": y} for x, y in ps]
    kinds = "array<struct<x:double,y:double>>"
    rooms = spark.createDataFrame([(1, points(room))], f"run_id int, boundary {kinds}")
    table = spark.createDataFrame([(1, k, points(h)) for k, h in enumerate(holes)], f"run_id int, door_index int, polygon {kinds}")
    got = {r.door_index: r for r in doors.door_axes(table, rooms).collect()}
    want = {k: door_axes(room, h) for k, h in enumerate(holes)}
    assert want[3] is None and set(got) == {0, 1, 2} and (want[0].kind, want[1].kind) == ("STRAIGHT", "CORNER")
    assert want[0].n_in == pytest.approx((1, 0)) and want[0].p_a == pytest.approx((0, 1))
    assert want[1].p_a == pytest.approx((0, 1)) and want[1].p_b == pytest.approx((-1, 0))
    for k, r in got.items():
        w = want[k]
        assert r.door_type == w.kind
        for a, b in ((r.centre, w.centre), (r.way_a, w.p_a), (r.way_b, w.p_b), (r.inward, w.n_in)):
            assert tuple(a) == pytest.approx(b)


def test_close_poses_leave_their_best(spark):
    from paceline.operators import pairs

    pose = lambda dx: [{"x": float(10 * k + dx), "y": float(10 * k)} for k in range(6)]
    rows = [(1, 1, 0, 0.5, pose(0)), (1, 1, 1, 0.9, pose(1)), (1, 1, 2, 0.7, pose(2.5)), (1, 1, 3, 0.1, pose(300)), (1, 2, 0, 0.5, pose(0)), (1, 2, 1, 0.5, pose(0))]
    poses = spark.createDataFrame(rows, "run_id int, frame int, pose int, score double, keypoints array<struct<x:double,y:double>>")
    left = sorted((r.frame, r.pose) for r in pairs.suppressed_poses(poses).collect())
    # reach is 0.05 * hypot(50, 50) = 3.5: 0, 1 and 2 lie close; equal scores leave the first
    assert left == [(1, 1), (1, 3), (2, 0)]
    assert pairs.suppressed_poses(poses, top=1).count() == 2


def test_a_track_is_smoothed_whole_at_any_length(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 700, 1500):
        t = np.sort(rng.choice(4 * n, n, replace=False)).astype(float)
        v = rng.normal(0, 10, (n, 2))
        scale = float(np.clip(10 * np.log(1000 / n), 0.1, 100))
        kernel = np.exp(-((t[:, None] - t[None]) ** 2) / (2 * scale**2))
        want = kernel @ np.linalg.solve(kernel + np.eye(n), v - v.mean(0)) + v.mean(0)
        p = positions(spark, {1: [(int(f), float(x), float(y)) for f, (x, y) in zip(t, v, strict=True)]})
        got = np.array([(r.map_x, r.map_y) for r in frames.gaussian_smoothed(p).orderBy("frame").collect()])
        assert np.allclose(got, want, atol=1e-6)
