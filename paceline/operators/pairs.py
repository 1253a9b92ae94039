"""Pairs of boxes, poses and embeddings within a frame or between two frames."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

BOX = ("x1", "y1", "x2", "y2")

# Body groups of the 26-keypoint layout and how much each counts.
ANCHORS = {"head_core": (17, 0, 1, 2, 3, 4), "neck": (18,), "shoulder": (5, 6), "hip": (11, 12, 19), "knee": (13, 14), "foot": (15, 16, 20, 21, 22, 23, 24, 25)}
PRIORITY = {"head_core": 1.45, "neck": 1.25, "shoulder": 1.15, "hip": 1.05, "knee": 0.95, "foot": 0.85}


def similarities(a: Sequence[Column], b: Sequence[Column], width: float = 1.0, height: float = 1.0) -> dict[str, Column]:
    """iou, giou, diou, ciou and centroid of two boxes; giou to ciou are brought from [-1, 1] to [0, 1]."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    iou = inter / union
    hull_w, hull_h = F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    hull = hull_w * hull_h
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    centre = (dx * dx + dy * dy) / (hull_w * hull_w + hull_h * hull_h)
    v = F.atan((b[2] - b[0]) / (b[3] - b[1])) - F.atan((a[2] - a[0]) / (a[3] - a[1]))
    v = v * v * (4 / math.pi**2)
    alpha = v / (1 - iou + v + F.lit(1e-12))
    return {
        "iou": iou,
        "giou": (iou - (hull - union) / hull + 1) / 2,
        "diou": (iou - centre + 1) / 2,
        "ciou": (iou - centre - alpha * v + 1) / 2,
        "centroid": 1 - F.sqrt(dx * dx + dy * dy) / math.hypot(width, height),
    }


def frame_pairs(left: DataFrame, right: DataFrame, shift: int = 0) -> DataFrame:
    """Rows of `left` with those of `right` `shift` frames later in the same run; columns get the ends _a and _b."""
    a = left.select("run_id", F.col("frame").alias("frame_a"), *[F.col(c).alias(f"{c}_a") for c in left.columns if c not in ("run_id", "frame")])
    b = right.select("run_id", F.col("frame").alias("frame_b"), *[F.col(c).alias(f"{c}_b") for c in right.columns if c not in ("run_id", "frame")]).withColumn("frame_a", F.col("frame_b") - shift)
    return a.join(b, ["run_id", "frame_a"])


def _totals(keypoints: Column, least_score: float) -> Column:
    """array<struct<key, t<x,y,s,n>>> of the body groups: sums over their sure keypoints."""
    groups = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(k) for k in ks]).alias("ks")) for name, ks in ANCHORS.items()])
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def add(t: Column, p: Column) -> Column:
        grown = F.struct((t["x"] + p["x"]).alias("x"), (t["y"] + p["y"]).alias("y"), (t["s"] + p["score"]).alias("s"), (t["n"] + 1).alias("n"))
        return F.when(p["score"] > least_score, grown).otherwise(t)

    return F.transform(groups, lambda g: F.struct(g["name"].alias("key"), F.aggregate(F.transform(g["ks"], lambda k: F.get(keypoints, k)), zero, add).alias("t")))


def anchors(keypoints: Column, least_score: float) -> Column:
    """map<group, struct<x,y,confidence,support>> of the body groups with a sure keypoint; neck and shoulder stand in for each other."""
    totals = _totals(keypoints, least_score)

    def mean(e: Column) -> Column:
        t = e["t"]
        return F.struct(e["key"].alias("key"), F.struct((t["x"] / t["n"]).alias("x"), (t["y"] / t["n"]).alias("y"), (t["s"] / t["n"]).alias("confidence"), t["n"].alias("support")).alias("value"))

    found = F.map_from_entries(F.transform(F.filter(totals, lambda e: e["t"]["n"] > 0), mean))

    def stand_in(m: Column, missing: str, other: str) -> Column:
        o = F.try_element_at(m, F.lit(other))
        value = F.struct(o["x"].alias("x"), o["y"].alias("y"), o["confidence"].alias("confidence"), F.lit(1).alias("support"))
        return F.when(F.map_contains_key(m, missing) | ~F.map_contains_key(m, other), m).otherwise(F.map_concat(m, F.create_map(F.lit(missing), value)))

    return S.let(S.let(found, lambda m: stand_in(m, "shoulder", "neck")), lambda m: stand_in(m, "neck", "shoulder"))


def pose_scale(box: Sequence[Column]) -> Column:
    w, h = F.greatest(box[2] - box[0], F.lit(1.0)), F.greatest(box[3] - box[1], F.lit(1.0))
    return F.greatest(h, w * 0.75, F.lit(1.0))


def with_anchors(poses: DataFrame, least_score: float) -> DataFrame:
    """`poses` with a column for each body group in place of keypoints: the structs of `anchors`, null where there is none.

    They are found once for a pose here, not looked up in a map once for each pair.
    """
    rows = poses.withColumn("t_", F.explode(F.array(_totals(F.col("keypoints"), least_score))))  # exploded, so that it is computed once
    sums = {g: F.get("t_", F.lit(k))["t"] for k, g in enumerate(ANCHORS)}
    value = lambda t, n: F.when(t["n"] > 0, F.struct((t["x"] / t["n"]).alias("x"), (t["y"] / t["n"]).alias("y"), (t["s"] / t["n"]).alias("confidence"), n.alias("support")))
    found = {g: value(t, t["n"]) for g, t in sums.items()}
    for missing, other in (("shoulder", "neck"), ("neck", "shoulder")):
        found[missing] = F.coalesce(value(sums[missing], sums[missing]["n"]), value(sums[other], F.lit(1)))
    return rows.select(*[c for c in poses.columns if c != "keypoints"], *[c.alias(g) for g, c in found.items()])


def _term(p: Column, q: Column, priority: float, scale: Column, sigma: float) -> tuple[Column, Column]:
    """Similarity and weight of a body group's anchors; the weight is 0 where one side lacks it."""
    dx, dy = (p["x"] - q["x"]) / F.greatest(scale, F.lit(1.0)), (p["y"] - q["y"]) / F.greatest(scale, F.lit(1.0))
    similarity = F.exp(-(dx * dx + dy * dy) / max(2 * sigma * sigma, 1e-6))
    support = F.least(F.lit(1.0), 0.35 + 0.15 * F.least(p["support"], q["support"]))
    # least and greatest pass over nulls, so a group that one side lacks is left out by itself
    weight = F.when(p.isNotNull() & q.isNotNull(), priority * F.greatest(F.lit(0.05), (p["confidence"] + q["confidence"]) / 2) * support).otherwise(0.0)
    return similarity, weight


def _affinity(terms: Sequence[Column], weights: Sequence[Column], total: Column) -> tuple[Column, Column]:
    return F.when(total > 0, sum(terms[1:], terms[0]) / total).otherwise(0.0), F.least(F.lit(1.0), 2 * total / sum(PRIORITY.values()))


def pose_affinity(a: Column, b: Column, scale: Column, sigma: float = 0.35) -> tuple[Column, Column]:
    """(similarity, reliability) of two anchor maps: Gaussian in the scaled distance, weighted by confidence and support."""
    found = [_term(F.try_element_at(a, F.lit(g)), F.try_element_at(b, F.lit(g)), priority, scale, sigma) for g, priority in PRIORITY.items()]
    weights = [w for _, w in found]
    return _affinity([F.coalesce(s * w, F.lit(0.0)) for s, w in found], weights, sum(weights[1:], weights[0]))


def pair_affinity(rows: DataFrame, scale: Column, sigma: float = 0.35) -> DataFrame:
    """`rows` with similarity and reliability (`pose_affinity`) of the ends _a and _b of the columns of `with_anchors`, step by step, so that nothing is computed twice."""
    columns = rows.columns
    found = {g: _term(F.col(f"{g}_a"), F.col(f"{g}_b"), priority, scale, sigma) for g, priority in PRIORITY.items()}
    rows = rows.withColumns({f"{g}_s_": s for g, (s, _) in found.items()} | {f"{g}_w_": w for g, (_, w) in found.items()})
    weights = [F.col(f"{g}_w_") for g in PRIORITY]
    rows = rows.withColumn("total_", sum(weights[1:], weights[0]))
    similarity, reliability = _affinity([F.coalesce(F.col(f"{g}_s_") * F.col(f"{g}_w_"), F.lit(0.0)) for g in PRIORITY], weights, F.col("total_"))
    return rows.select(*columns, similarity.alias("similarity"), reliability.alias("reliability"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def recent_gallery(features: DataFrame, last: int) -> DataFrame:
    """The last `last` features of each track (by frame): the size of a gallery is a setting of the tracker."""
    w = Window.partitionBy("run_id", "track_id").orderBy(F.desc("frame"))
    return features.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= last).drop("r_")


def gallery_distance(gallery: DataFrame, queries: DataFrame, keys: Sequence[str], track: str, query: str) -> DataFrame:
    """track, query, distance: the smallest cosine distance of each query to a track's gallery, within `keys`."""
    pairs = gallery.select(*keys, track, F.col("embedding").alias("g_")).join(queries.select(*keys, query, F.col("embedding").alias("q_")), list(keys))
    return pairs.groupBy(track, query).agg(F.min(cosine_distance(F.col("g_"), F.col("q_"))).alias("distance"))


#: Queries of up to so many bytes are sent to all tasks; more of them meet the gallery block by block.
SENT_BYTES = 64 << 20


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1 (NaN for one of no length)."""
    x = np.stack(vectors.to_list()).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest_in_gallery(gallery: DataFrame, queries: DataFrame, track: str, query: str, block: int = 2048, most_bytes: int = SENT_BYTES) -> DataFrame:
    """track, query, distance: the smallest cosine distance of each query to a track's whole gallery.

    Both have `query` (an id) and embedding.  Null embeddings meet nothing.  The
    gallery stays where it is while the queries fit into `most_bytes` (counted before
    they are sent): each task keeps the smallest distance per track and query.  Beyond
    that, blocks of about `block` rows, dealt by hash of the id, meet each other once,
    and each pair of blocks gives one row per track and query.
    """
    gallery, queries = (x.where("embedding is not null") for x in (gallery, queries))
    kinds = f"`{track}` {gallery.schema[track].dataType.simpleString()}, `{query}` {queries.schema[query].dataType.simpleString()}, distance double"
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size.n * (size.d or 0) * 8 <= most_bytes:
        few = queries.select(query, "embedding").toPandas()
        sent = gallery.sparkSession.sparkContext.broadcast((few[query].to_numpy(), _unit(few["embedding"]) if len(few) else np.zeros((0, 1))))

        def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best: dict = {}
            for part in parts:
                for k in range(0, len(part), block):
                    cut = part.iloc[k : k + block]
                    if len(ids):
                        near = pd.DataFrame(np.maximum(0.0, 1 - _unit(cut["embedding"]) @ q.T)).groupby(cut[track].to_numpy(), dropna=False).min()
                        for key, row in zip(near.index.tolist(), near.to_numpy(), strict=True):
                            best[key] = np.fmin(best[key], row) if key in best else row
                    if len(best) * len(ids) > 4_000_000:
                        yield told(best, ids)
                        best = {}
            if best:
                yield told(best, ids)

        def told(best: dict, ids: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({track: np.repeat(list(best), len(ids)), query: np.tile(ids, len(best)), "distance": np.concatenate(list(best.values()))})

        return gallery.select(track, "embedding").mapInPandas(fold, kinds).groupBy(track, query).agg(F.min("distance").alias("distance"))
    n_blocks = [max(1, -(-gallery.count() // block)), max(1, -(-size.n // block))]
    g, q = (x.withColumn(a, F.pmod(F.xxhash64(query), F.lit(n)).cast("int")) for x, a, n in zip((gallery, queries), ("g_", "q_"), n_blocks, strict=True))
    g = g.select(track, "embedding", "g_", F.explode(F.sequence(F.lit(0), F.lit(n_blocks[1] - 1))).alias("q_"))
    q = q.select(query, "embedding", "q_", F.explode(F.sequence(F.lit(0), F.lit(n_blocks[0] - 1))).alias("g_"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({track: [], query: [], "distance": np.zeros(0)})
        distance = pd.DataFrame(np.maximum(0.0, 1 - _unit(a["embedding"]) @ _unit(b["embedding"]).T)).groupby(a[track].to_numpy(), dropna=False).min()
        return pd.DataFrame({track: np.repeat(distance.index.to_numpy(), len(b)), query: np.tile(b[query].to_numpy(), len(distance)), "distance": distance.to_numpy().ravel()})

    pairs = g.groupBy("g_", "q_").cogroup(q.groupBy("g_", "q_")).applyInPandas(nearest, kinds)
    return pairs.groupBy(track, query).agg(F.min("distance").alias("distance"))


def fused_cost(distance: Column, iou: Column) -> Column:
    """Appearance similarity times the mean of 1 and the overlap, as a cost."""
    return 1 - (1 - distance) * (1 + iou) / 2


def scored_cost(cost: Column, confidence: Column) -> Column:
    """A similarity (1 - cost) times the detection's confidence, as a cost."""
    return 1 - (1 - cost) * confidence


def motion_consistency(vx: Column, vy: Column, dx: Column, dy: Column, weight: float, score: Column) -> Column:
    """(pi/2 - angle)/pi between a track's motion and the step to a box, between 0 and 1, weighted; 0 for no step."""
    n = F.sqrt(dx * dx + dy * dy) + 1e-6
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vx * dx / n + vy * dy / n))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (math.pi / 2 - F.abs(F.acos(cosine))) / math.pi)) * weight * score


def mutual_best(pairs: DataFrame, similarity: str, keys: Sequence[str], a: str, b: str, least: float = 0.3, floor: float = 0.0, box: str | None = None) -> DataFrame:
    """Pairs in which each is the other's best (ties by id), of at least `least`; `box` of at least `floor` where named."""
    wa = Window.partitionBy(*keys, a).orderBy(F.desc(similarity), b)
    wb = Window.partitionBy(*keys, b).orderBy(F.desc(similarity), a)
    rows = pairs.withColumn("ra_", F.row_number().over(wa)).withColumn("rb_", F.row_number().over(wb)).where("ra_ = 1 and rb_ = 1").drop("ra_", "rb_")
    rows = rows.where(F.col(similarity) >= least)
    return rows if box is None else rows.where(F.col(box) >= floor)


def unmatched(rows: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(matches.select(*keys).distinct(), list(keys), "left_anti")


def merged_matches(ab: DataFrame, bc: DataFrame, keys: Sequence[str] = ("run_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, c) through a common b, and what is left of a and of c."""
    joined = ab.join(bc, [*keys, "b"]).select(*keys, "a", "c")
    return joined, ab.select(*keys, "a").distinct().join(joined, [*keys, "a"], "left_anti"), bc.select(*keys, "c").distinct().join(joined, [*keys, "c"], "left_anti")


def poses_in_boxes(boxes: DataFrame, poses: DataFrame) -> DataFrame:
    """run_id, frame, box, pose: boxes in order take the nearest pose (by centroid) that lies wholly inside and is still free.

    `boxes`: run_id, frame, box (number), x1..y2; `poses`: run_id, frame, pose, keypoints.
    Candidates come from a join within the frame; taking turns is a fold over a frame's few pairs.
    """
    good = F.filter("keypoints", lambda p: p["score"] > 0)
    n = F.size(good)
    mean = lambda c: F.aggregate(good, F.lit(0.0), lambda a, p: a + p[c]) / n
    flat = poses.select("run_id", "frame", "pose", good.alias("k_"), mean("x").alias("px"), mean("y").alias("py")).where(F.size("k_") > 0)
    pairs = boxes.join(flat, ["run_id", "frame"]).where(F.forall("k_", lambda p: (p["x"] > F.col("x1")) & (p["x"] < F.col("x2")) & (p["y"] > F.col("y1")) & (p["y"] < F.col("y2"))))
    pairs = pairs.select("run_id", "frame", "box", "pose", F.hypot(F.col("px") - (F.col("x1") + F.col("x2")) / 2, F.col("py") - (F.col("y1") + F.col("y2")) / 2).alias("d"))

    by_frame = pairs.groupBy("run_id", "frame").agg(F.sort_array(F.collect_list(F.struct("box", "d", "pose"))).alias("pairs"))
    none = F.array().cast(f"array<struct<box:{pairs.schema['box'].dataType.simpleString()},pose:{pairs.schema['pose'].dataType.simpleString()}>>")

    def take(taken: Column, p: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["box"] == p["box"]) | (t["pose"] == p["pose"]))
        return F.when(free, F.concat(taken, F.array(F.struct(p["box"].alias("box"), p["pose"].alias("pose"))))).otherwise(taken)

    return by_frame.select("run_id", "frame", F.explode(F.aggregate("pairs", none, take)).alias("t")).select("run_id", "frame", "t.box", "t.pose")


def suppressed(boxes: DataFrame, least_score: float, most_iou: float, top: int = 100) -> DataFrame:
    """Boxes left after non-max suppression in each frame, `top` at most (a top-k report per picture).

    A fold over a frame's boxes, best first (then by track): one is left unless it overlaps one that was.
    """
    row = F.struct(*boxes.columns)
    by_frame = boxes.where(F.col("confidence") > least_score).groupBy("run_id", "frame").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "track_id", row.alias("row")))).alias("items"))

    def overlaps(a: Column, b: Column) -> Column:
        inter = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
        return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-12)) > most_iou

    keep = lambda kept, b: F.when(F.exists(kept, lambda a: overlaps(a["row"], b["row"])), kept).otherwise(F.concat(kept, F.array(b)))
    left = F.aggregate("items", F.slice("items", 1, 0), keep)
    return by_frame.select(F.explode(F.slice(left, 1, top)).alias("b")).select("b.row.*")


def _close_pairs(rows: pa.Table, share: float, least_joints: int | None) -> pa.Table:
    """run_id, frame, pose, score_, other_ of the close poses (`close_poses`) in the frames of one run."""
    rows = rows.take(pa.array(np.argsort(rows.column("frame").to_numpy(), kind="stable")))
    frames, points = rows.column("frame").to_numpy(), rows.column("points").combine_chunks()
    size = np.array(points.value_lengths().fill_null(0))
    flat, place = points.flatten(), np.arange(size.max(initial=0)) < size[:, None]
    xy = np.full((2, *place.shape), np.nan)  # a point that one side lacks is near nothing
    for k, c in enumerate("xy"):
        xy[k][place] = pc.struct_field(flat, c).to_numpy(zero_copy_only=False)
    known = ~np.isnan(xy)
    span = np.where(known, xy, -np.inf).max(2, initial=-np.inf) - np.where(known, xy, np.inf).min(2, initial=np.inf)
    reach, least = np.hypot(*span) * share, np.floor(size / 2 if least_joints is None else np.full(len(size), float(least_joints)))
    found = []
    for d in range(len(frames)):
        at = np.flatnonzero(frames[: len(frames) - d] == frames[d:])
        if not len(at):
            break
        apart = np.hypot(*(xy[:, at] - xy[:, at + d]))
        for own, other in ((at, at + d), (at + d, at))[: 1 + (d > 0)]:
            near = (apart < reach[own, None]).sum(1) > least[own]
            found.append((own[near], other[near]))
    own, other = (pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1))
    left, right = rows.select(["run_id", "frame", "pose"]).take(own), rows.select(["score", "pose"]).take(other)
    return left.append_column("score_", right.column("score")).append_column("other_", right.column("pose"))


def close_poses(poses: DataFrame, share: float = 0.05, least_joints: int | None = None) -> DataFrame:
    """`poses` with `close`: the poses of the frame of which more joints than the least lie near this one's.

    Near is within `share` of the diagonal of this pose's extent; the least is half of
    the joints unless given.  A pose is close to itself.  A task holds one run's poses;
    poses that are together by run already (repartition("run_id"), best while they have
    few columns) stay where they are.
    """
    kinds = {c: poses.schema[c].dataType.simpleString() for c in ("run_id", "frame", "pose", "score")}
    xy = F.transform("keypoints", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    rows = poses.where("run_id is not null and frame is not null").select("run_id", "frame", "pose", "score", xy.alias("points"))
    pairs = rows.groupBy("run_id").applyInArrow(lambda t: _close_pairs(t, share, least_joints), f"run_id {kinds['run_id']}, frame {kinds['frame']}, pose {kinds['pose']}, score_ {kinds['score']}, other_ {kinds['pose']}")
    lists = pairs.groupBy("run_id", "frame", "pose").agg(F.collect_list(F.struct((-F.col("score_")).alias("rank"), F.col("other_").alias("pose"))).alias("close"))
    return poses.join(lists, ["run_id", "frame", "pose"], "left")


def suppressed_poses(poses: DataFrame, share: float = 0.05, least_joints: int | None = None, top: int = 30) -> DataFrame:
    """run_id, frame, pose of the poses left in each frame: of poses that lie close together the best is left (`top` of a frame at most).

    A fold over a frame's poses, best first: one that isn't settled yet gives way to the
    best of those close to it; if that is free it is left, and all of them are settled.
    """
    item = F.struct((-F.col("score")).alias("rank"), "pose", "close")
    by_frame = close_poses(poses, share, least_joints).groupBy("run_id", "frame").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = poses.schema["pose"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("settled"), F.array().cast(f"array<struct<rank:double,pose:{kind}>>").alias("leaders"))

    def choose(state: Column, p: Column) -> Column:
        own = F.array(F.struct(p["rank"].alias("rank"), p["pose"].alias("pose")))
        around = F.when(F.size(p["close"]) > 0, p["close"]).otherwise(own)
        leader = F.array_min(around)
        free = ~F.array_contains(state["settled"], p["pose"]) & ~F.array_contains(state["settled"], leader["pose"])
        grown = F.struct(F.concat(state["settled"], F.transform(around, lambda x: x["pose"])).alias("settled"), F.concat(state["leaders"], F.array(leader)).alias("leaders"))
        return F.when(free, grown).otherwise(state)

    leaders = F.sort_array(F.aggregate("items", start, choose, lambda s: s["leaders"]))
    return by_frame.select("run_id", "frame", F.explode(F.slice(leaders, 1, top)).alias("l")).select("run_id", "frame", "l.pose")


def keypoint_errors(reference: DataFrame, test: DataFrame, least_score: float = 0.0) -> DataFrame:
    """run_id, n_poses, n_points, mean_error: mean absolute difference of the coordinates of the same pose's keypoints on both sides.

    Both: run_id, frame, track_id, keypoints (array of struct<x,y,score>).  A point
    counts where its score is above `least_score` on both sides.
    """
    pairs = reference.select("run_id", "frame", "track_id", F.col("keypoints").alias("a_")).join(test.select("run_id", "frame", "track_id", F.col("keypoints").alias("b_")), ["run_id", "frame", "track_id"])
    seen = F.filter(F.arrays_zip("a_", "b_"), lambda p: (p["a_"]["score"] > least_score) & (p["b_"]["score"] > least_score))
    error = F.aggregate(seen, F.lit(0.0), lambda s, p: s + F.abs(p["a_"]["x"] - p["b_"]["x"]) + F.abs(p["a_"]["y"] - p["b_"]["y"]))
    rows = pairs.select("run_id", error.alias("e_"), F.size(seen).alias("n_"))
    out = rows.groupBy("run_id").agg(F.count_if(F.col("n_") > 0).alias("n_poses"), F.sum("n_").cast("long").alias("n_points"), F.sum("e_").alias("e_"))
    return out.select("run_id", "n_poses", "n_points", (F.col("e_") / F.nullif(2 * F.col("n_points"), F.lit(0))).alias("mean_error"))


def box_recall(reference: DataFrame, test: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """run_id, n_reference, n_found, recall: boxes of `reference` that some box of `test` in the frame overlaps enough."""
    pairs = frame_pairs(reference, test)
    iou = similarities([F.col(f"{c}_a") for c in BOX], [F.col(f"{c}_b") for c in BOX])["iou"]
    best = pairs.groupBy("run_id", F.col("frame_a").alias("frame"), F.col("track_id_a").alias("track_id")).agg(F.max(iou).alias("best_"))
    rows = reference.select("run_id", "frame", "track_id").join(best, ["run_id", "frame", "track_id"], "left")
    out = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_reference"), F.count_if(F.col("best_") >= least_iou).alias("n_found"))
    return out.withColumn("recall", F.col("n_found") / F.col("n_reference"))


def birth_anchor(keypoints: Column, box: Sequence[Column], least_score: float, ankles: Sequence[int] = (15, 16)) -> Column:
    """Point on the floor where a track begins: the mean of its feet, else ankles, else knees, else the bottom centre of the box.

    Only keypoints of a good score inside the box count; a list of fewer points than a group names has fewer to count.
    """
    x1, y1, x2, y2 = box

    def mean(indices: Sequence[int]) -> Column:
        known = F.filter(F.array(*[F.get(keypoints, F.lit(k)) for k in indices]), lambda p: (p["score"] >= least_score) & p["x"].between(x1, x2) & p["y"].between(y1, y2))
        total = lambda c: F.aggregate(known, F.lit(0.0), lambda a, p: a + p[c]) / F.size(known)
        return F.when(F.size(known) > 0, F.struct(total("x").alias("x"), total("y").alias("y")))

    feet = (20, 21, 22, 23, 24, 25)
    return F.coalesce(mean(feet), mean(ankles), mean((13, 14)), F.struct(((x1 + x2) / 2).alias("x"), y2.alias("y")))


def track_details(boxes: DataFrame, keypoints: DataFrame, gaze: DataFrame) -> DataFrame:
    """Boxes with the keypoints and gaze of the same run, track and frame, null where there are none."""
    return boxes.join(keypoints, ["run_id", "track_id", "frame"], "left").join(gaze, ["run_id", "track_id", "frame"], "left")
