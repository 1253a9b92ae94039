"""Session documents: timeline items, flag links, metric records and entities of every run.

The tables of the entry and wall rules are turned into items of one layout (run_id,
item_id, metric_id, kind, label, frames, times), linked with the flags raised
against them and folded into one nested document per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

# Fixed values of the session format.
LABELS = {"entrance_vectors": "Entrance Vectors", "entrance_hesitation": "Entrance Hesitation", "total_time_of_entry": "Total Entry Time", "move_along_wall": "Move Along Wall"}
FLAG_METRIC = {
    "pair_time_violation": "entrance_hesitation", "vector_unknown": "entrance_vectors", "vector_direction_violation": "entrance_vectors",
    "total_entry_time_violation": "total_time_of_entry", "wall_too_close": "move_along_wall", "wall_too_far": "move_along_wall",
}
REQUIRED = ("session", "video", "timeline", "metrics", "flags")
MAJOR = "2"


def _named(prefix: str, number: str) -> Column:
    return F.concat(F.lit(prefix), F.col(number).cast("string"))


def _items(rows: DataFrame, item_id: Column, metric: str | None, kind: str, label: Column, start: str, end: str | None, fps: float) -> DataFrame:
    stop = F.col(end) if end else F.lit(None)
    return rows.select(
        "run_id", item_id.alias("item_id"), F.lit(metric).cast("string").alias("metric_id"), F.lit(kind).alias("kind"), label.alias("label"),
        F.col(start).cast("long").alias("start_frame"), stop.cast("long").alias("end_frame"),
        S.frame_time(F.col(start), F.lit(fps)).alias("start_time"), S.frame_time(stop.cast("long"), F.lit(fps)).alias("end_time"),
    )


def timeline(chosen: DataFrame, gaps: DataFrame, vectors: DataFrame, total: DataFrame, excursions: DataFrame | None = None, fps: float = 30.0) -> DataFrame:
    """Items of all kinds; points (entries, vectors) have no end_frame."""
    sign = F.when(F.col("sign") == 0, F.lit("")).when(F.col("sign") > 0, F.lit(" (+1)")).otherwise(F.lit(" (-1)"))
    out = _items(chosen, _named("entrance_entry_", "entry_number"), None, "entry", _named("Entry ", "entry_number"), "first_frame", None, fps)
    out = out.unionByName(_items(gaps, _named("entrance_pair_", "pair_number"), "entrance_hesitation", "pair_gap", _named("Pair ", "pair_number"), "from_frame", "to_frame", fps))
    out = out.unionByName(_items(vectors, _named("entrance_vector_", "entry_number"), "entrance_vectors", "vector", F.concat(_named("Vector ", "entry_number"), F.lit(": "), F.col("side"), sign), "start_frame", None, fps))
    if excursions is not None:
        out = out.unionByName(_items(excursions, F.concat_ws("_", F.lit("wall_excursion"), F.col("track_id").cast("string"), F.col("n").cast("string")), "move_along_wall", "wall_excursion", F.replace("label", F.lit("_"), F.lit(" ")), "start_frame", "end_frame", fps))
    return out.unionByName(_items(total, F.lit("total_entry_duration"), "total_time_of_entry", "duration", F.lit("Total Entry"), "start_frame", "end_frame", fps))


def linked(flags: DataFrame) -> DataFrame:
    """Flags with their metric_id and linked_item_id: the item that each was raised against.

    Ids of pair and wall flags end in the number of their item; a flag on a vector goes
    to that of its entry number, which a flag on two entries of one side does not have.
    """
    kind = F.col("type")
    item = (
        F.when(kind == "pair_time_violation", F.concat(F.lit("entrance_pair_"), F.regexp_extract("flag_id", r"_(\d+)$", 1)))
        .when(kind.isin("vector_unknown", "vector_direction_violation"), F.concat(F.lit("entrance_vector_"), F.col("entry_number").cast("string")))
        .when(kind == "total_entry_time_violation", F.lit("total_entry_duration"))
        .when(kind.isin("wall_too_close", "wall_too_far"), F.regexp_replace("flag_id", "^wall_too_(close|far)_", "wall_excursion_"))
    )
    metric = F.coalesce(*[F.when(kind == t, F.lit(m)) for t, m in FLAG_METRIC.items()])
    return flags.select("*", metric.alias("metric_id"), item.alias("linked_item_id"))


def with_flag_ids(items: DataFrame, flags: DataFrame) -> DataFrame:
    """Items with flag_ids, the sorted ids of the flags linked to each."""
    per = flags.where("linked_item_id is not null").groupBy("run_id", F.col("linked_item_id").alias("item_id")).agg(F.sort_array(F.collect_set("flag_id")).alias("flag_ids"))
    empty = F.array().cast("array<string>")
    return items.join(per, ["run_id", "item_id"], "left").withColumn("flag_ids", F.coalesce("flag_ids", empty))


def per_metric(items: DataFrame, flags: DataFrame) -> DataFrame:
    """run_id, metric_id, timeline_item_ids, flag_ids: sorted lists."""
    both = items.select("run_id", "metric_id", "item_id", F.lit(None).cast("string").alias("flag_id")).unionByName(flags.select("run_id", "metric_id", F.lit(None).cast("string").alias("item_id"), "flag_id")).where("metric_id is not null")
    return both.groupBy("run_id", "metric_id").agg(F.sort_array(F.collect_set("item_id")).alias("timeline_item_ids"), F.sort_array(F.collect_set("flag_id")).alias("flag_ids"))


def summaries(vectors: DataFrame, transitions: DataFrame, gaps: DataFrame, total: DataFrame, adherence: DataFrame | None = None, excursions: DataFrame | None = None) -> DataFrame:
    """run_id, metric_id, summary (a map of numbers): counts, violations and totals behind each metric."""

    def fold(rows: DataFrame, metric: str, **numbers: Column) -> DataFrame:
        out = rows.groupBy("run_id").agg(*[v.cast("double").alias(k) for k, v in numbers.items()])
        return out.select("run_id", F.lit(metric).alias("metric_id"), F.create_map(*[x for k in numbers for x in (F.lit(k), F.coalesce(F.col(k), F.lit(0.0)))]).alias("summary"))

    turns = vectors.select("run_id", F.lit(1).alias("v_"), F.when(F.col("sign") != 0, 1).alias("valid_"), F.lit(None).cast("int").alias("t_"), F.lit(None).cast("int").alias("alt_"))
    turns = turns.unionByName(transitions.select("run_id", F.lit(None).cast("int").alias("v_"), F.lit(None).cast("int").alias("valid_"), F.lit(1).alias("t_"), F.when(F.col("alternates"), 1).alias("alt_")))
    out = fold(turns, "entrance_vectors", vector_count=F.count("v_"), valid_vector_count=F.count("valid_"), transition_count=F.count("t_"), alternation_count=F.count("alt_"))
    out = out.unionByName(fold(gaps, "entrance_hesitation", pair_count=F.count(F.lit(1)), violation_count=F.count_if("violation")))
    out = out.unionByName(fold(total, "total_time_of_entry", duration_sec=F.max("duration_sec"), limit_sec=F.max("limit_sec"), violates=F.max(F.col("violation").cast("int"))))
    if adherence is not None and excursions is not None:
        walls = adherence.select("run_id", "too_close_sec", "too_far_sec", F.lit(None).cast("int").alias("x_")).unionByName(excursions.select("run_id", F.lit(None).cast("double").alias("too_close_sec"), F.lit(None).cast("double").alias("too_far_sec"), F.lit(1).alias("x_")))
        out = out.unionByName(fold(walls, "move_along_wall", excursion_count=F.count("x_"), total_too_close_sec=F.round(F.sum("too_close_sec"), 3), total_too_far_sec=F.round(F.sum("too_far_sec"), 3)))
    return out


def metric_records(scores: DataFrame, summary: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per run and metric: metric_id, label, score, summary, timeline_item_ids, flag_ids."""
    label = F.coalesce(*[F.when(F.col("metric_id") == k, F.lit(v)) for k, v in LABELS.items()], F.col("metric_id"))
    empty = F.array().cast("array<string>")
    rows = scores.join(summary, ["run_id", "metric_id"], "left").join(lists, ["run_id", "metric_id"], "left")
    return rows.select("run_id", "metric_id", label.alias("label"), "score", "summary", F.coalesce("timeline_item_ids", empty).alias("timeline_item_ids"), F.coalesce("flag_ids", empty).alias("flag_ids"))


def entities(chosen: DataFrame, inroom: DataFrame) -> DataFrame:
    """run_id, side (friend or in-room), track_id, entry_number (null for in-room), label."""
    friends = chosen.select("run_id", F.lit("friend").alias("side"), F.col("track_id").cast("long").alias("track_id"), F.col("entry_number").cast("long").alias("entry_number"), _named("Entry ", "entry_number").alias("label"))
    others = inroom.select("run_id", F.lit("inroom").alias("side"), F.col("track_id").cast("long").alias("track_id"), F.lit(None).cast("long").alias("entry_number"), F.lit("In-room").alias("label"))
    return friends.unionByName(others)


def documents(runs: DataFrame, items: DataFrame, records: DataFrame, flags: DataFrame, people: DataFrame) -> DataFrame:
    """run_id, document: one JSON text per run (`runs`: run_id and whatever describes the session).

    A run has a few hundred items at most (entrants, gaps, excursions), so its lists fit a row.
    """

    def listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("run_id", *order)]
        place = F.struct(*order)  # lists with maps can't be sorted whole
        packed = rows.select("run_id", place.alias("place"), F.struct(*order, *rest).alias("row"))
        ranked = packed.withColumn("n_", F.row_number().over(Window.partitionBy("run_id").orderBy("place")))
        by_place = ranked.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("n_", "row"))).alias("m_"))
        return by_place.select("run_id", F.transform(F.sequence(F.lit(1), F.size("m_")), lambda k: F.element_at("m_", k)).alias(name))

    timeline_, flags_ = listed(items, "items_", "start_frame", "kind", "item_id"), listed(flags, "flags_", "flag_id")
    metrics_, people_ = listed(records, "metrics_", "metric_id"), listed(people, "people_", "side", "track_id")
    out = runs
    for part in (timeline_, flags_, metrics_, people_):
        out = out.join(part, "run_id", "left")
    described = F.struct(*runs.columns)
    side = lambda s: F.filter("people_", lambda p: p["side"] == s)
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    document = F.struct(
        F.lit("2.0").alias("schema_version"), described.alias("session"), F.create_map(F.lit("video_basename"), F.col("run_id").cast("string")).alias("video"),
        F.struct(none(F.col("items_"), timeline_.schema["items_"].dataType).alias("items")).alias("timeline"), none(F.col("metrics_"), metrics_.schema["metrics_"].dataType).alias("metrics"),
        none(F.col("flags_"), flags_.schema["flags_"].dataType).alias("flags"), F.struct(side("friend").alias("friends"), side("inroom").alias("enemies")).alias("entities"),
    )
    return out.select("run_id", F.to_json(document).alias("document"))


def judged(sessions: DataFrame, document: str = "document") -> DataFrame:
    """Sessions with `reason`: null for a supported version with all required parts, else why not."""
    top = F.from_json(document, "map<string,string>")
    version = F.coalesce(F.try_element_at(top, F.lit("schema_version")), F.lit(""))
    reason = F.when(top.isNull(), "not a JSON object").when(F.element_at(F.split(version, r"\."), 1) != MAJOR, F.concat(F.lit("version "), version))
    for k in REQUIRED:
        reason = reason.when(~F.map_contains_key(top, k), f"no {k}")
    return sessions.withColumn("reason", reason)


def validated(sessions: DataFrame, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """The good sessions, and the rejected ones with their reason."""
    rows = judged(sessions, document)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def enriched(sessions: DataFrame, transcripts: DataFrame, windows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Sessions with segments, drill window and manifest of their run; a window in the document wins over a separate one."""
    said = transcripts.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "start", "end", "text"))).alias("segments"))
    window = windows.select("run_id", F.to_json(F.struct(*[c for c in windows.columns if c != "run_id"])).alias("window_"))
    manifest = manifests.select("run_id", F.struct(*[c for c in manifests.columns if c != "run_id"]).alias("manifest"))
    out = sessions.join(said, "run_id", "left").join(window, "run_id", "left").join(manifest, "run_id", "left")
    return out.withColumn("drill_window", F.coalesce(F.get_json_object("document", "$.drill_window"), F.col("window_"))).drop("window_")
