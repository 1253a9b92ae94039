"""Who looks at what: cones, contact, clearance and coverage.

Pairs are made within one frame of one run; (run_id, frame) is the join key, so a
long run spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scores as S

BOX = ("x1", "y1", "x2", "y2")
FRAME = ("run_id", "frame")
_T = ("t0x", "t0y", "t1x", "t1y", "t2x", "t2y")


def gaze_vector(keypoints: Column) -> Column:
    """struct<ox,oy,dx,dy>: from the middle of the ears (or one ear) through the eyes (both, else the nose, else one), a unit step."""

    def point(k: int) -> Column:
        p = F.get(keypoints, F.lit(k))
        return F.when(p["score"] > 0.3, F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def middle(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))

    nose, eye_l, eye_r, ear_l, ear_r = (point(k) for k in range(5))
    o = F.coalesce(middle(eye_l, eye_r), nose, eye_l, eye_r)
    e = F.coalesce(middle(ear_l, ear_r), ear_l, ear_r)
    dx, dy = o["x"] - e["x"], o["y"] - e["y"]
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n > 0, F.struct(o["x"].alias("ox"), o["y"].alias("oy"), (dx / n).alias("dx"), (dy / n).alias("dy")))


def with_cone(gaze: DataFrame, half_angle: float, length: float = G.CONE_LENGTH) -> DataFrame:
    """`gaze` with the corners of its cone and `blank` for a gaze of no length."""
    cols = G.cone(*(F.col(c) for c in ("ox", "oy", "dx", "dy")), half_angle, length)
    return gaze.select("*", *[c.alias(n) for c, n in zip(cols, _T, strict=True)], ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("blank"))


def sees(box: Sequence[str] = BOX) -> Column:
    return G.triangle_meets_box([F.col(c) for c in _T], [F.col(c) for c in box])


def wrists_of(keypoints: Column) -> Column:
    """The two wrists of a list of more than ten keypoints, null for a shorter one."""
    return F.when(F.size(keypoints) > 10, F.slice(keypoints, 10, 2))


def wrist_inside(keypoints: Column, box: Sequence[Column]) -> Column:
    """Whether a wrist with a score is in the box; needs more than ten keypoints."""
    return any_inside(wrists_of(keypoints), box)


def any_inside(points: Column, box: Sequence[Column]) -> Column:
    """Whether a point with a score is in the box; not for a null list."""
    return F.coalesce(F.exists(points, lambda p: (p["score"] > 0) & (p["x"] >= box[0]) & (p["x"] <= box[2]) & (p["y"] >= box[1]) & (p["y"] <= box[3])), F.lit(False))


def touching_pairs(threats: DataFrame, friends: DataFrame) -> DataFrame:
    """run_id, frame, inroom_id, friend_id and the threat's box for pairs whose boxes touch."""
    a = threats.select(*FRAME, F.col("track_id").alias("inroom_id"), *BOX)
    b = friends.select(*FRAME, F.col("track_id").alias("friend_id"), *[F.col(c).alias(f"f_{c}") for c in BOX])
    return a.join(b, [*FRAME]).where(G.boxes_touch([F.col(c) for c in BOX], [F.col(f"f_{c}") for c in BOX])).select(*FRAME, "inroom_id", "friend_id", *BOX)


def contact(pairs: DataFrame, gaze: DataFrame, visual_angle: float, wrists: DataFrame | None = None) -> DataFrame:
    """Pairs with `looks` (the friend's cone meets the threat's box) and `reaches` (a wrist of the friend is in it).

    `wrists`: run_id, frame, track_id, keypoints; without it nobody reaches.
    """
    looks = gaze.select(*FRAME, F.col("track_id").alias("friend_id"), "ox", "oy", "dx", "dy")
    # the cone is made after the shuffle, of fewer numbers
    rows = with_cone(pairs.join(looks, [*FRAME, "friend_id"], "left"), visual_angle / 2).withColumn("looks", F.coalesce(sees(), F.lit(False))).drop(*_T, "blank", "ox", "oy", "dx", "dy")
    if wrists is None:
        return rows.withColumn("reaches", F.lit(False))
    # only the wrists are shuffled
    rows = rows.join(wrists.select(*FRAME, F.col("track_id").alias("friend_id"), wrists_of(F.col("keypoints")).alias("wrists_")), [*FRAME, "friend_id"], "left")
    return rows.withColumn("reaches", any_inside(F.col("wrists_"), [F.col(c) for c in BOX])).drop("wrists_")


def contact_runs(rows: DataFrame, frames: int = 30, wrist_frames: int = 7, gaze_frames: int = 15) -> DataFrame:
    """For each pair its first run of consecutive frames that is long enough with enough wrist and gaze frames.

    start_frame is the first frame at which both counts are met, end_frame the run's last.
    """
    pair = ["run_id", "inroom_id", "friend_id"]
    w = Window.partitionBy(*pair).orderBy("frame")
    rows = rows.withColumn("island_", F.col("frame") - F.row_number().over(w))
    inside = Window.partitionBy(*pair, "island_").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("w_", F.sum(F.col("reaches").cast("int")).over(inside)).withColumn("g_", F.sum(F.col("looks").cast("int")).over(inside))
    met = F.min(F.when((F.col("w_") >= wrist_frames) & (F.col("g_") >= gaze_frames), F.col("frame")))
    runs = rows.groupBy(*pair, "island_").agg(F.count(F.lit(1)).alias("n_"), met.alias("start_frame"), F.max("frame").alias("end_frame")).where((F.col("n_") >= frames) & F.col("start_frame").isNotNull())
    return runs.groupBy(*pair).agg(F.min(F.struct("end_frame", "start_frame")).alias("r_")).select(*pair, "r_.start_frame", "r_.end_frame")


def clearance(threats: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, inroom_id, start_frame, end_frame, friend_id: the best contact run of every threat, null where it has none."""
    best = runs.groupBy("run_id", "inroom_id").agg(F.min(F.struct("start_frame", "end_frame", "friend_id")).alias("b_")).select("run_id", "inroom_id", "b_.*")
    return threats.select("run_id", F.col("track_id").alias("inroom_id")).distinct().join(best, ["run_id", "inroom_id"], "left")


def clearance_scores(runs: DataFrame, cleared: DataFrame) -> DataFrame:
    share = cleared.groupBy("run_id").agg((F.count("end_frame") / F.count(F.lit(1))).alias("score"))
    return runs.select("run_id").join(share, "run_id", "left").select("run_id", F.coalesce(F.bround("score", 2), F.lit(1.0)).alias("score"))


def seen_teammates(boxes: DataFrame, gaze: DataFrame, coverage_angle: float) -> DataFrame:
    """run_id, frame, track_id, seen: whether any other of the team's cones meets the box (a gaze of no length sees all)."""
    cones = with_cone(gaze, coverage_angle / 2).select(*FRAME, F.col("track_id").alias("viewer"), *_T, "blank")
    pairs = boxes.select(*FRAME, "track_id", *BOX).join(cones, [*FRAME]).where((F.col("viewer") != F.col("track_id")) & (F.col("blank") | sees()))
    hits = pairs.select(*FRAME, "track_id").distinct().withColumn("seen", F.lit(True))
    return boxes.select(*FRAME, "track_id").join(hits, [*FRAME, "track_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def teammate_coverage(rows: DataFrame) -> DataFrame:
    """run_id, track_id (null: the whole team), present, unseen, score."""
    out = rows.rollup("run_id", "track_id").agg(F.count(F.lit(1)).alias("present"), F.count_if(~F.col("seen")).alias("unseen")).where("run_id is not null")
    return out.withColumn("score", 1 - F.col("unseen") / F.col("present"))


def teammate_curve(rows: DataFrame) -> DataFrame:
    """run_id, frame, coverage so far."""
    per = rows.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("p_"), F.count_if("seen").alias("s_"))
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*FRAME, (F.sum("s_").over(w) / F.sum("p_").over(w)).alias("coverage"))


def active_threats(boxes: DataFrame, threats: DataFrame, cleared: DataFrame) -> DataFrame:
    """Boxes of threats that are not cleared yet, in frames with a member of the team."""
    present = boxes.join(threats, ["run_id", "track_id"], "left_anti").select(*FRAME).distinct()
    rows = boxes.join(threats, ["run_id", "track_id"], "left_semi").join(present, [*FRAME], "left_semi")
    ends = cleared.select("run_id", F.col("inroom_id").alias("track_id"), F.col("end_frame").alias("cleared_"))
    return rows.join(ends, ["run_id", "track_id"], "left").where(F.col("cleared_").isNull() | (F.col("frame") < F.col("cleared_"))).drop("cleared_")


def watched_threats(active: DataFrame, gaze: DataFrame, visual_angle: float) -> DataFrame:
    """run_id, frame, track_id (the threat), watched: whether any of the team looks at it."""
    cones = with_cone(gaze, visual_angle / 2).select(*FRAME, *_T, "blank")
    hits = active.select(*FRAME, "track_id", *BOX).join(cones, [*FRAME]).where(F.col("blank") | sees()).select(*FRAME, "track_id").distinct().withColumn("watched", F.lit(True))
    return active.select(*FRAME, "track_id").join(hits, [*FRAME, "track_id"], "left").withColumn("watched", F.coalesce("watched", F.lit(False)))


def threat_scores(runs: DataFrame, watched: DataFrame, empty: float = 1.0) -> DataFrame:
    """run_id, present, covered, score: frames with an active threat in which one is looked at."""
    per = watched.groupBy(*FRAME).agg(F.bool_or("watched").alias("w_"))
    out = per.groupBy("run_id").agg(F.count(F.lit(1)).alias("present"), F.count_if("w_").alias("covered"))
    out = runs.select("run_id").join(out, "run_id", "left").fillna(0, ["present", "covered"])
    return out.withColumn("score", F.when(F.col("present") > 0, F.col("covered") / F.col("present")).otherwise(empty))


def threat_curve(watched: DataFrame) -> DataFrame:
    """run_id, frame, coverage so far of the frames with an active threat."""
    per = watched.groupBy(*FRAME).agg(F.bool_or("watched").cast("int").alias("w_"))
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*FRAME, (F.sum("w_").over(w) / F.count(F.lit(1)).over(w)).alias("coverage"))


def seen_cells(gaze: DataFrame, boundary: Sequence[tuple[float, float]], half_angle: float, step: float) -> DataFrame:
    """run_id, cx, cy, first_frame of every grid cell of the room whose centre some cone holds.

    `gaze` is in map space.  A cone only meets the cells of its bounding box; each
    task keeps the first frame per cell before the shuffle.
    """
    xs, ys = [p[0] for p in boundary], [p[1] for p in boundary]
    length = 1.5 * math.hypot(max(xs) - min(xs), max(ys) - min(ys))
    rows = with_cone(gaze.where((F.col("dx") != 0) | (F.col("dy") != 0)), half_angle, length)
    tx, ty = [F.col(c) for c in _T[::2]], [F.col(c) for c in _T[1::2]]

    def cells(values: list[Column], low: float, high: float) -> Column:
        a = F.greatest(F.floor((F.least(*values) - low) / step), F.lit(0)).cast("int")
        b = F.least(F.floor((F.greatest(*values) - low) / step), F.lit(math.ceil((high - low) / step) - 1)).cast("int")
        return F.when(a <= b, F.sequence(a, b))

    rows = rows.withColumn("cx", F.explode(cells(tx, min(xs), max(xs)))).withColumn("cy", F.explode(cells(ty, min(ys), max(ys))))
    x, y = min(xs) + (F.col("cx") + 0.5) * step, min(ys) + (F.col("cy") + 0.5) * step
    turns = [(tx[(k + 1) % 3] - tx[k]) * (y - ty[k]) - (ty[(k + 1) % 3] - ty[k]) * (x - tx[k]) for k in range(3)]
    inside = ((turns[0] >= 0) & (turns[1] >= 0) & (turns[2] >= 0)) | ((turns[0] <= 0) & (turns[1] <= 0) & (turns[2] <= 0))
    return rows.where(inside & G.point_in_polygon(x, y, boundary)).groupBy("run_id", "cx", "cy").agg(F.min("frame").alias("first_frame"))


def on_map(rows: DataFrame, h: Column | Sequence[float]) -> DataFrame:
    """Gaze rows in map space: origin and the point one step ahead go through the homography; rows of no direction are left out."""
    rows = rows.where((F.col("dx") != 0) | (F.col("dy") != 0)).withColumn("o_", G.project(F.col("ox"), F.col("oy"), h)).withColumn("a_", G.project(F.col("ox") + F.col("dx"), F.col("oy") + F.col("dy"), h))
    return rows.select("run_id", "track_id", "frame", F.col("o_.x").alias("ox"), F.col("o_.y").alias("oy"), (F.col("a_.x") - F.col("o_.x")).alias("dx"), (F.col("a_.y") - F.col("o_.y")).alias("dy"))


def room_cells(boundary: Sequence[tuple[float, float]], step: float) -> int:
    """Cells whose centre is in the room."""
    xs, ys = [p[0] for p in boundary], [p[1] for p in boundary]
    n = 0
    for i in range(math.ceil((max(xs) - min(xs)) / step)):
        for k in range(math.ceil((max(ys) - min(ys)) / step)):
            x, y, inside = min(xs) + (i + 0.5) * step, min(ys) + (k + 0.5) * step, False
            for ax, ay, bx, by in G.edges(boundary):
                if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / ((ay - by) or 1e-12) + bx:
                    inside = not inside
            n += inside
    return n


def cell_grid(boundary: Sequence[tuple[float, float]], step: float) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the cell centres that are in the room."""
    xs, ys = [p[0] for p in boundary], [p[1] for p in boundary]
    i, k = np.meshgrid(np.arange(math.ceil((max(xs) - min(xs)) / step)), np.arange(math.ceil((max(ys) - min(ys)) / step)), indexing="ij")
    x, y = min(xs) + (i.ravel() + 0.5) * step, min(ys) + (k.ravel() + 0.5) * step
    inside = np.zeros(len(x), bool)
    for ax, ay, bx, by in G.edges(boundary):
        inside ^= ((by > y) != (ay > y)) & (x < (ax - bx) * (y - by) / ((ay - by) or 1e-12) + bx)
    return x[inside], y[inside]


#: Cells times cones that are looked at in one go.
_AT_ONCE = 1 << 16


def newly_seen(gaze: DataFrame, boundary: Sequence[tuple[float, float]], half_angle: float, step: float, block: int = 512) -> DataFrame:
    """run_id, frame, n_: the cells of the room that a run sees first in that frame (frames with none left out).

    The counts of `seen_cells`, for fine grids.  A run's cones go in order of frames, up
    to `block` at a time, through the cells that it has not seen yet.  A task holds one
    run's gaze and cells at a time; no cells are shuffled, and gaze that is together by
    run already stays where it is.
    """
    xs, ys = [p[0] for p in boundary], [p[1] for p in boundary]
    length = 1.5 * math.hypot(max(xs) - min(xs), max(ys) - min(ys))
    rows = gaze.where((F.col("dx") != 0) | (F.col("dy") != 0)).select(*FRAME, *[F.col(c).cast("double").alias(c) for c in ("ox", "oy", "dx", "dy")])
    gx, gy = cell_grid(boundary, step)
    c, s = math.cos(math.radians(half_angle)), math.sin(math.radians(half_angle))

    def found(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("frame").to_numpy(), kind="stable")
        frames = table.column("frame").to_numpy()[order]
        ox, oy, dx, dy = (table.column(k).to_numpy()[order, None] for k in ("ox", "oy", "dx", "dy"))
        n = np.sqrt(dx * dx + dy * dy)
        ux, uy = dx / n, dy / n
        t = (ox, oy, ox + (c * ux - s * uy) * length, oy + (s * ux + c * uy) * length, ox + (c * ux + s * uy) * length, oy + (c * uy - s * ux) * length)  # as in functions.geometry.cone
        new, x, y, k = np.zeros(len(frames), np.int64), gx, gy, 0
        while k < len(frames) and len(x):
            cut = slice(k, k + max(1, min(block, _AT_ONCE // len(x))))
            tx, ty = [v[cut] for v in t[::2]], [v[cut] for v in t[1::2]]
            turns = [(tx[j] - tx[i]) * (y - ty[i]) - (ty[j] - ty[i]) * (x - tx[i]) for i, j in ((0, 1), (1, 2), (2, 0))]
            low, high = np.minimum(np.minimum(turns[0], turns[1]), turns[2]), np.maximum(np.maximum(turns[0], turns[1]), turns[2])
            hit = (low >= 0) | (high <= 0)
            some = hit.any(0)
            if some.any():
                new[cut] = np.bincount(hit[:, some].argmax(0), minlength=len(hit))
                x, y = x[~some], y[~some]
            k = cut.stop
        _, start = np.unique(frames, return_index=True)
        counts = np.add.reduceat(new, start)
        out = table.select(list(FRAME)).take(pa.array(order[start[counts > 0]]))
        return out.append_column("n_", pa.array(counts[counts > 0], pa.int64()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("run_id").applyInArrow(found, f"run_id {kinds['run_id']}, frame {kinds['frame']}, n_ long")


def coverage_curve(frames: DataFrame, cells: DataFrame, n_cells: int) -> DataFrame:
    """run_id, frame, fraction (to two places) for every frame of `frames` (run_id, frame)."""
    return counted_curve(frames, cells.groupBy("run_id", F.col("first_frame").alias("frame")).agg(F.count(F.lit(1)).alias("n_")), n_cells)


def counted_curve(frames: DataFrame, new: DataFrame, n_cells: int) -> DataFrame:
    """As `coverage_curve`, from run_id, frame, n_ (`newly_seen`)."""
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.select("run_id", "frame").distinct().join(new, [*FRAME], "left")
    return rows.select(*FRAME, F.round(F.coalesce(F.sum("n_").over(w), F.lit(0)) / F.lit(n_cells), 2).alias("fraction"))


def coverage_summary(curve: DataFrame, first: DataFrame, fps: float) -> DataFrame:
    """run_id, time_to_full, final_fraction, first_frame; `first`: run_id, first_frame of the team's first gaze."""
    out = curve.groupBy("run_id").agg(F.min(F.when(F.col("fraction") >= 1.0, F.col("frame"))).alias("full_"), F.max_by("fraction", "frame").alias("final_fraction"))
    return out.join(first, "run_id", "left").select("run_id", F.round((F.col("full_") - F.col("first_frame")) / F.lit(fps), 2).alias("time_to_full"), "final_fraction", "first_frame")


def coverage_time_score(time_to_full: Column, limit: Column) -> Column:
    """1 within the limit, falling beyond it, 0 if the room was never covered."""
    return F.when(time_to_full.isNull(), 0.0).when(time_to_full <= limit, 1.0).otherwise(S.time_penalty(time_to_full - limit, limit))


def rebased_curve(curve: DataFrame, start: DataFrame, fps: float) -> DataFrame:
    """run_id, t, fraction: the curve from the team's entry on (`start`: run_id, first_frame), in seconds."""
    rows = curve.join(start, "run_id").where(F.col("frame") >= F.col("first_frame"))
    return rows.select("run_id", ((F.col("frame") - F.col("first_frame")) / F.lit(fps)).alias("t"), "fraction")


def per_threat(watched: DataFrame) -> DataFrame:
    """run_id, track_id, present, covered: frames in which each threat was active, and looked at."""
    return watched.groupBy("run_id", "track_id").agg(F.count(F.lit(1)).alias("present"), F.count_if("watched").alias("covered"))
