"""Ties that sums of rounded numbers miss in the last digits."""

import itertools
import math

from paceline.operators import pods
from paceline.plans.fixtures import ROOM


def test_start_towards_the_centroid_is_a_tie(spark):
    """The step of 180 and 120 from (47, 32) points at the centroid (236, 158) of a room without doors."""
    room = type(ROOM)(boundary=ROOM.boundary, pods=ROOM.pods)
    rows = [(k, 1, 1, 47.0, 32.0, dx, dy) for k, (dx, dy) in enumerate([(180.0, 120.0), (180.00000000000003, 119.99999999999999), (179.99999999999997, 120.00000000000001), (180.001, 120.0)])]
    vectors = spark.createDataFrame(rows, "run_id int, track_id int, entry_number int, start_x double, start_y double, dx double, dy double")
    got = {r.run_id: r.pod_idx for r in pods.assign_by_side(vectors, room).collect()}
    assert got[0] == got[1] == got[2] != got[3]


def test_mean_capture_time_in_any_order(spark):
    """The persons' scores 0.2, 0.42, 0.47 and 0.85 have a mean between two hundredths: their order does not choose."""
    limit = 2.0
    late = {p: limit * (1 + (x := -math.log(p)) / (1 + x)) for p in (0.2, 0.42, 0.47, 0.85)}
    rows = [(run, track, 1, late[p]) for run, order in enumerate(itertools.permutations(late)) for track, p in enumerate(order)]
    captured = spark.createDataFrame(rows, "run_id int, assigned_id int, pod_idx int, capture_time_sec double").coalesce(1)
    got = pods.capture_time_scores(captured.select("run_id").distinct(), captured, (limit, limit)).collect()
    assert len(got) == 24 and {r.score for r in got} == {0.49}
