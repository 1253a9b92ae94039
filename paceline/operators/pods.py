"""Points to hold: assignment, work areas, capture and holding."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scores as S
from ..plans.rooms import Room
from . import frames


def turn_order(first: Sequence[int], second: Sequence[int]) -> list[int]:
    """Who gets what when two lists take turns and one that has run out is passed over."""
    a, b, out = list(first), list(second), []
    while a or b:
        side = a if a else b
        out.append(side.pop(0))
        a, b = b, a
    return out


def _by_depth(room: Room, pods: Sequence[int], centre: tuple[float, float]) -> list[int]:
    return sorted(pods, key=lambda k: -math.dist(room.pods[k], centre))


def _orders(room: Room) -> list[tuple[int, int, int, int]]:
    """(door, starting side, entry number, pod) of every door and side: whole numbers of a room, a few dozen rows."""
    rows = []
    for d, door in enumerate(room.axes()):
        along = {}
        for k, (x, y) in enumerate(room.pods):
            n = math.dist((x, y), door.centre)
            v = ((x - door.centre[0]) / n, (y - door.centre[1]) / n) if n > 1e-9 else (0.0, 0.0)
            along[k] = 1 if v[0] * door.p_a[0] + v[1] * door.p_a[1] >= v[0] * door.p_b[0] + v[1] * door.p_b[1] else -1
        sides = {s: _by_depth(room, [k for k in along if along[k] == s], door.centre) for s in (1, -1)}
        for start in (1, -1):
            rows += [(d, start, place, pod) for place, pod in enumerate(turn_order(sides[start], sides[-start]), 1)]
    return rows


def assign_by_side(vectors: DataFrame, room: Room) -> DataFrame:
    """run_id, track_id, entry_number, pod_idx: pods alternate between the door's sides, from the first entrant's side on, deepest first.

    `vectors`: the entrants with door_index and sign.  Entrants beyond the pods get null.
    Without doors the room's outline decides (`assign_by_outline`).
    """
    if not room.axes():
        return assign_by_outline(vectors, room)
    table = vectors.sparkSession.createDataFrame(_orders(room), "door_index int, start_ int, entry_number int, pod_idx int")
    first = vectors.where("entry_number = 1").select("run_id", "door_index", F.when(F.col("sign") == 0, 1).otherwise(F.col("sign")).alias("start_"))
    rows = vectors.select("run_id", "track_id", "entry_number").join(first, "run_id")
    return rows.join(table, ["door_index", "start_", "entry_number"], "left").select("run_id", "track_id", "entry_number", "pod_idx")


def assign_by_group(vectors: DataFrame, room: Room) -> DataFrame:
    """As `assign_by_side`, with the pods' own groups A and B as the two sides.

    The group whose pods lie best in the first entrant's direction starts; where
    one group is empty the pods go by depth alone.  Depth is the distance from the
    door's centre, without doors from the point of the outline nearest to the first
    entrant.  Groups that don't name A or B for every pod count for nothing.
    """
    groups = {g: [k for k, x in enumerate(room.pod_groups) if x.strip().upper() == g] for g in "AB"}
    if sum(map(len, groups.values())) != len(room.pods):
        return assign_by_side(vectors, room)
    if not room.axes():
        return _groups_without_doors(vectors, room, groups)
    doors, rows = room.axes(), []
    for d, door in enumerate(doors):
        deep = {g: _by_depth(room, ks, door.centre) for g, ks in groups.items()}
        both = _by_depth(room, groups["A"] + groups["B"], door.centre)
        for start, other in (("A", "B"), ("B", "A")):
            order = turn_order(deep[start], deep[other]) if groups["A"] and groups["B"] else both
            rows += [(d, start, place, pod) for place, pod in enumerate(order, 1)]
    table = vectors.sparkSession.createDataFrame(rows, "door_index int, start_ string, entry_number int, pod_idx int")
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))

    def alignment(group: str) -> Column:
        per_door = []
        for door in doors:
            values = [F.lit(-1e9)]
            for k in groups[group]:
                far = math.dist(room.pods[k], door.centre)
                if far > 1e-6:
                    ux, uy = (room.pods[k][0] - door.centre[0]) / far, (room.pods[k][1] - door.centre[1]) / far
                    values.append((F.col("dx") * ux + F.col("dy") * uy) / n)
            per_door.append(F.greatest(*values) if len(values) > 1 else values[0])
        return F.when(n > 1e-9, F.get(F.array(*per_door), F.col("door_index"))).otherwise(0.0)

    first = vectors.where("entry_number = 1").select("run_id", "door_index", F.when(alignment("A") >= alignment("B"), "A").otherwise("B").alias("start_"))
    rows = vectors.select("run_id", "track_id", "entry_number").join(first, "run_id")
    return rows.join(table, ["door_index", "start_", "entry_number"], "left").select("run_id", "track_id", "entry_number", "pod_idx")


def _turns(each: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pods of two sides in turns: `each` has run_id, pod_, side_ and start_ (1 or -1) and r_ (place on its side).

    A pod of the starting side comes after as many of the other as have had their turn,
    and the other way round, so a side that has run out is passed over.
    """
    mine, theirs = (F.count_if(c).over(Window.partitionBy("run_id")) for c in (F.col("side_") == F.col("start_"), F.col("side_") != F.col("start_")))
    place = F.when(F.col("side_") == F.col("start_"), F.col("r_") + F.least(F.col("r_") - 1, theirs)).otherwise(F.col("r_") + F.least(F.col("r_"), mine))
    table = each.select("run_id", place.cast("int").alias("entry_number"), F.col("pod_").alias("pod_idx"))
    return vectors.select("run_id", "track_id", "entry_number").join(table, ["run_id", "entry_number"], "left").select("run_id", "track_id", "entry_number", "pod_idx")


def _first_on_outline(vectors: DataFrame, room: Room) -> DataFrame:
    """run_id, start_x, start_y, dx, dy of the first entrant and door_ (x, y, s): the outline's point nearest to where it began, and how far along the outline that is."""
    first = vectors.where("entry_number = 1").select("run_id", "start_x", "start_y", "dx", "dy")
    return first.withColumn("door_", G.along_boundary(F.col("start_x"), F.col("start_y"), room.boundary))


def assign_by_outline(vectors: DataFrame, room: Room) -> DataFrame:
    """As `assign_by_side` for a room without doors.

    The doorway is the outline's point nearest to the first entrant's start.  The line
    from there to the room's centroid parts the pods (each by its nearest point of the
    outline) into two sides; those come first that lie furthest from the doorway along
    the outline, on the side that the first entrant turns to.  Without a direction that
    is the second side.
    """
    length, middle = G.outline_length(room.boundary), G.centroid(room.boundary)
    spots = [(k, *G.on_outline(x, y, room.boundary)) for k, (x, y) in enumerate(room.pods)]
    first = _first_on_outline(vectors, room)
    turn = (middle[0] - F.col("start_x")) * F.col("dy") - (middle[1] - F.col("start_y")) * F.col("dx")
    # a start towards the centroid is a tie, which sums of the same numbers may miss in the last digits
    scale = F.abs((middle[0] - F.col("start_x")) * F.col("dy")) + F.abs((middle[1] - F.col("start_y")) * F.col("dx"))
    first = first.withColumn("start_", F.when(turn >= -1e-9 * scale, 1).otherwise(-1))
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(s).alias("s")) for k, x, y, s in spots])
    each = first.withColumn("p_", F.explode(items))
    cross = (middle[0] - F.col("door_.x")) * (F.col("p_.y") - F.col("door_.y")) - (middle[1] - F.col("door_.y")) * (F.col("p_.x") - F.col("door_.x"))
    each = each.withColumn("side_", F.when(cross >= 0, 1).otherwise(-1))
    way = F.when(F.col("side_") == -1, F.col("p_.s") - F.col("door_.s")).otherwise(F.col("door_.s") - F.col("p_.s"))
    deep = Window.partitionBy("run_id", "side_").orderBy(F.desc(F.round(F.pmod(way, F.lit(length)), 9)), "p_.k")
    return _turns(each.withColumn("r_", F.row_number().over(deep)).withColumn("pod_", F.col("p_.k")), vectors)


def _groups_without_doors(vectors: DataFrame, room: Room, groups: dict[str, list[int]]) -> DataFrame:
    first = _first_on_outline(vectors, room)
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(1 if k in groups["A"] else -1).alias("side")) for k, (x, y) in enumerate(room.pods)])
    each = first.withColumn("p_", F.explode(items)).withColumn("side_", F.col("p_.side"))
    ux, uy = F.col("p_.x") - F.col("door_.x"), F.col("p_.y") - F.col("door_.y")
    far, n = F.hypot(ux, uy), F.hypot("dx", "dy")
    along = F.when(far > 1e-6, (ux * F.col("dx") + uy * F.col("dy")) / (far * n))
    best = {g: F.coalesce(F.max(F.when(F.col("side_") == v, along)).over(Window.partitionBy("run_id")), F.lit(-1e9)) for g, v in (("A", 1), ("B", -1))}
    starts = F.when((n > 1e-9) & (best["A"] < best["B"]), -1).otherwise(1)
    each = each.withColumn("far_", far).withColumn("start_", starts)
    deep = Window.partitionBy("run_id", "side_").orderBy(F.desc("far_"), "p_.k")
    return _turns(each.withColumn("r_", F.row_number().over(deep)).withColumn("pod_", F.col("p_.k")), vectors)


def assign_by_doorway(positions: DataFrame, chosen: DataFrame, pods: Sequence[tuple[float, float]], samples: int = 30) -> DataFrame:
    """run_id, track_id, entry_number, pod_idx by the first entrant's first samples.

    Its first position is the doorway; pods right and left of it take turns, the
    ones furthest from it in y first, from the side that its mean step in x points to.
    """
    w = Window.partitionBy("run_id", "track_id").orderBy("frame")
    early = positions.join(chosen.where("entry_number = 1").select("run_id", "track_id"), ["run_id", "track_id"]).withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= samples)
    # the mean of the steps is (last - first) / (n - 1)
    door = early.groupBy("run_id").agg(F.min_by("map_x", "k_").alias("door_x"), F.min_by("map_y", "k_").alias("door_y"), F.max_by("map_x", "k_").alias("last_x"), F.count(F.lit(1)).alias("n_"))
    mean_x = sum(p[0] for p in pods) / len(pods)
    door = door.withColumn("start_", F.when(F.col("n_") < 2, F.when(F.col("door_x") >= mean_x, 1).otherwise(-1)).when(F.col("last_x") >= F.col("door_x"), 1).otherwise(-1))
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for k, (x, y) in enumerate(pods)])
    each = door.withColumn("p_", F.explode(items))
    side = F.when(F.col("p_.x") > F.col("door_x"), 1).otherwise(-1)
    deep = Window.partitionBy("run_id", "side_").orderBy(F.desc(F.abs(F.col("p_.y") - F.col("door_y"))), "p_.k")
    each = each.withColumn("side_", side).withColumn("r_", F.row_number().over(deep))
    return _turns(each.withColumn("pod_", F.col("p_.k")), chosen)


#: A work circle moves towards the room's centre in steps of this share of its radius, so many times at most.
STEP_SHARE, MOST_STEPS = 0.05, 100


def work_areas(rooms: DataFrame, pods: DataFrame, radius: float) -> DataFrame:
    """run_id, pod_idx, x, y: centres of the pods' work circles, moved into the bounds of their room and from there by steps towards its centre until they fit.

    `rooms`: run_id, boundary (array of struct<x,y>); `pods`: run_id, pod_idx, x, y.
    """
    side = lambda pick, c: pick(F.transform("boundary", lambda p: p[c]))
    rows = pods.select("run_id", "pod_idx", "x", "y").join(rooms.select("run_id", "boundary"), "run_id").withColumn("middle", G.column_centroid(F.col("boundary")))
    into = lambda v, c: F.least(F.greatest(v, side(F.array_min, c) + radius), side(F.array_max, c) - radius)
    start = F.struct(into(F.col("x"), "x").alias("x"), into(F.col("y"), "y").alias("y"))

    def step(c: Column, _: Column) -> Column:
        fits = G.point_in_polygon(c["x"], c["y"], F.col("boundary")) & (G.boundary_distance(c["x"], c["y"], F.col("boundary")) >= radius - 1e-9)
        dx, dy = F.col("middle.x") - c["x"], F.col("middle.y") - c["y"]
        n = F.hypot(dx, dy)
        moved = F.struct((c["x"] + dx / n * radius * STEP_SHARE).alias("x"), (c["y"] + dy / n * radius * STEP_SHARE).alias("y"))
        return F.when(fits | (n <= 0), c).otherwise(moved)

    centre = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, step)
    return rows.withColumn("c_", centre).select("run_id", "pod_idx", F.col("c_.x").alias("x"), F.col("c_.y").alias("y"))


def work_centres(room: Room, radius: float) -> list[tuple[float, float]]:
    """`work_areas` of one known room."""
    poly = np.array(room.boundary, float)
    low, high, middle = poly.min(0), poly.max(0), np.array(G.centroid(room.boundary))

    def fits(c: np.ndarray) -> bool:
        inside, nearest = False, math.inf
        for (ax, ay), (bx, by) in zip(poly, np.roll(poly, -1, 0), strict=True):
            if (ay > c[1]) != (by > c[1]) and c[0] < (bx - ax) * (c[1] - ay) / ((by - ay) or 1e-12) + ax:
                inside = not inside
            d = np.array([bx - ax, by - ay])
            t = float(np.clip(((c - (ax, ay)) @ d) / max(d @ d, 1e-12), 0, 1))
            nearest = min(nearest, float(np.hypot(*(c - (ax, ay) - t * d))))
        return inside and nearest >= radius - 1e-9

    out = []
    for p in room.pods:
        c = np.minimum(np.maximum(np.array(p, float), low + radius), high - radius)
        for _ in range(MOST_STEPS):
            step = middle - c
            if fits(c) or not np.hypot(*step):
                break
            c = c + step / np.hypot(*step) * radius * STEP_SHARE
        out.append((float(c[0]), float(c[1])))
    return out


def in_circle(x: Column, y: Column, pod: Column, centres: Sequence[tuple[float, float]], radius: float) -> Column:
    """Whether a point is inside the work circle of its pod."""
    cx, cy = (F.get(F.array(*[F.lit(c[k]) for c in centres]), pod) for k in (0, 1))
    return F.coalesce((x - cx) * (x - cx) + (y - cy) * (y - cy) < radius * radius, F.lit(False))


def moved_areas(blockers: DataFrame, room: Room, radius: float, threshold: float = 0.1) -> DataFrame:
    """run_id, frame, pod_idx, dy, quads of the pods whose work circle is blocked in a frame.

    `blockers`: run_id, frame, track_id, quad (array of four struct<x,y>).  One that
    covers at least `threshold` of a circle blocks it: the circle goes up by its
    radius, else down, where it then is within the room's bounds and clear of that
    blocker (`dy`), and the blocker's own area counts as well (`quads`).  People in a
    frame are taken by track; a later move replaces an earlier one and its quads.
    """
    centres = work_centres(room, radius)
    low, high = [min(p[k] for p in room.boundary) for k in (0, 1)], [max(p[k] for p in room.boundary) for k in (0, 1)]
    spots = F.array(*[F.struct(F.lit(k).alias("pod"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(centres)])
    share = F.pandas_udf(lambda x, y, *corners: pd.Series(G.circle_shares(np.stack([v.to_numpy(float) for v in corners], 1).reshape(-1, 4, 2), x.to_numpy(float), y.to_numpy(float), radius)), "double")
    corners = [F.get("quad", F.lit(k))[c] for k in range(4) for c in ("x", "y")]
    side = lambda pick, c: pick(F.transform("quad", lambda p: p[c]))
    rows = blockers.withColumns({f"{n}_{c}_": side(pick, c) for n, pick in (("low", F.array_min), ("high", F.array_max)) for c in "xy"})
    rows = rows.select("run_id", "frame", "track_id", "quad", *[f"{n}_{c}_" for n in ("low", "high") for c in "xy"], F.explode(spots).alias("c"))

    def covered(x: Column, y: Column) -> Column:
        apart = (F.col("low_x_") > x + radius) | (F.col("high_x_") < x - radius) | (F.col("low_y_") > y + radius) | (F.col("high_y_") < y - radius)
        return F.when(apart, 0.0).otherwise(share(x, y, *corners))

    if threshold > 0:  # those that are apart go before their shares are asked for
        rows = rows.where((F.col("low_x_") <= F.col("c.x") + radius) & (F.col("high_x_") >= F.col("c.x") - radius) & (F.col("low_y_") <= F.col("c.y") + radius) & (F.col("high_y_") >= F.col("c.y") - radius))
    rows = rows.where(covered(F.col("c.x"), F.col("c.y")) >= threshold)

    def clear(dy: float) -> Column:
        x, y = F.col("c.x"), F.col("c.y") + dy
        within = (x - radius >= low[0]) & (x + radius <= high[0]) & (y - radius >= low[1]) & (y + radius <= high[1])
        return within & (covered(x, y) <= 1e-9)

    move = F.when(clear(radius), radius).when(clear(-radius), -radius)
    rows = rows.select("run_id", "frame", F.col("c.pod").alias("pod_idx"), F.struct("track_id", move.alias("move"), "quad").alias("b"))
    each = rows.groupBy("run_id", "frame", "pod_idx").agg(F.sort_array(F.collect_list("b")).alias("bs"))  # the few people of one frame
    start = F.struct(F.lit(0.0).alias("dy"), F.array().cast(blockers.select(F.array("quad").alias("q")).schema["q"].dataType).alias("quads"))

    def fold(a: Column, b: Column) -> Column:
        new, more = F.struct(b["move"].alias("dy"), F.array(b["quad"]).alias("quads")), F.struct(a["dy"].alias("dy"), F.concat(a["quads"], F.array(b["quad"])).alias("quads"))
        return F.when(b["move"].isNotNull(), new).otherwise(more)

    return each.withColumn("m_", F.aggregate("bs", start, fold)).select("run_id", "frame", "pod_idx", "m_.dy", "m_.quads")


def dynamic_membership(samples: DataFrame, blockers: DataFrame, room: Room, radius: float, threshold: float = 0.1) -> DataFrame:
    """`samples` (run_id, frame, track_id, pod_idx, map_x, map_y) with in_area for work areas that give way to people in the room (`moved_areas`).

    Areas are found once for each run, frame and pod; a sample asks whether it is in
    the circle where that has gone to, or in a blocker's area, and within the bounds.
    """
    low, high = [min(p[k] for p in room.boundary) for k in (0, 1)], [max(p[k] for p in room.boundary) for k in (0, 1)]
    x, y = F.col("map_x"), F.col("map_y")
    centres = work_centres(room, radius)
    cx, cy = (F.get(F.array(*[F.lit(c[k]) for c in centres]), F.col("pod_idx")) for k in (0, 1))
    rows = samples.join(moved_areas(blockers, room, radius, threshold), ["run_id", "frame", "pod_idx"], "left")
    inside = F.hypot(x - cx, y - cy - F.coalesce("dy", F.lit(0.0))) < radius
    held = F.coalesce(F.exists("quads", lambda q: G.strictly_inside(x, y, q)), F.lit(False))
    bounds = (x > low[0]) & (x < high[0]) & (y > low[1]) & (y < high[1])
    return rows.select(*samples.columns, F.coalesce((inside | held) & bounds, F.lit(False)).alias("in_area"))


def captures(samples: DataFrame, chosen: DataFrame, fps: float, hold_seconds: float) -> DataFrame:
    """run_id, pod_idx, assigned_id, capture_frame, capture_time_sec.

    Capture is the first frame of the first streak in the area of enough frames;
    a missing frame breaks a streak.  `samples` has in_area and pod_idx; time
    counts from the track's first frame (`chosen`).
    """
    least = max(1, round(hold_seconds * fps))
    runs = frames.islands(samples.where("in_area"))
    first = runs.where(F.col("n_frames") >= least).groupBy("run_id", "track_id").agg(F.min("start_frame").alias("capture_frame"))
    pods = samples.where("pod_idx is not null").select("run_id", "track_id", "pod_idx").distinct()
    rows = pods.join(first, ["run_id", "track_id"], "left").join(chosen.select("run_id", "track_id", "first_frame"), ["run_id", "track_id"])
    return rows.select("run_id", "pod_idx", F.col("track_id").alias("assigned_id"), "capture_frame", ((F.col("capture_frame") - F.col("first_frame")) / F.lit(fps)).alias("capture_time_sec"))


def capture_scores(runs: DataFrame, captured: DataFrame) -> DataFrame:
    share = captured.groupBy("run_id").agg((F.count("capture_frame") / F.count(F.lit(1))).alias("score"))
    return runs.select("run_id").join(share, "run_id", "left").select("run_id", F.coalesce(F.bround("score", 2), F.lit(1.0)).alias("score"))


def capture_time_scores(runs: DataFrame, captured: DataFrame, limits: Sequence[float]) -> DataFrame:
    """Mean over persons (to two places) of the mean of their pods' scores (to two places); 0 without any."""
    table = F.array(*[F.lit(float(x)) for x in limits or (0.0,)])
    limit = F.coalesce(F.get(table, F.col("pod_idx")), F.element_at(table, -1))
    t = F.col("capture_time_sec")
    score = F.when(t.isNull(), 0.0).when(t <= limit, 1.0).otherwise(S.time_penalty(t - limit, limit))
    persons = captured.where("assigned_id is not null").groupBy("run_id", "assigned_id").agg(F.round(F.round(F.avg(score), 2) * 100).cast("long").alias("p_"))
    # a sum of whole hundredths is the same in any order; a mean between two of them goes to the one that its binary value is nearer to
    means = persons.groupBy("run_id").agg((F.round(F.sum("p_") / (F.count("p_") * 100.0) * 100) / 100).alias("score"))
    return runs.select("run_id").join(means, "run_id", "left").select("run_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def hold_samples(positions: DataFrame, assigned: DataFrame, pods: Sequence[tuple[float, float]]) -> DataFrame:
    """Positions of tracks with a pod and the hold score of each."""
    rows = positions.join(assigned.where("pod_idx is not null").select("run_id", "track_id", "pod_idx"), ["run_id", "track_id"])
    px, py = (F.get(F.array(*[F.lit(float(p[k])) for p in pods]), F.col("pod_idx")) for k in (0, 1))
    return rows.withColumn("hold", S.hold(F.hypot(F.col("map_x") - px, F.col("map_y") - py)))


def hold_scores(runs: DataFrame, samples: DataFrame, n_pods: int) -> DataFrame:
    """Mean of the tracks' means; 0 for fewer tracks than pods."""
    tracks = samples.groupBy("run_id", "track_id").agg(F.avg("hold").alias("h_"))
    means = tracks.groupBy("run_id").agg(F.avg("h_").alias("score"), F.count(F.lit(1)).alias("n_"))
    return runs.select("run_id").join(means, "run_id", "left").select("run_id", F.when(F.col("n_") >= n_pods, F.round("score", 2)).otherwise(0.0).alias("score"))


def hold_curve(samples: DataFrame) -> DataFrame:
    """run_id, frame, the mean so far of the frames' mean hold scores."""
    per = samples.groupBy("run_id", "frame").agg(F.avg("hold").alias("h_"))
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("run_id", "frame", F.avg("h_").over(w).alias("hold_so_far"))
