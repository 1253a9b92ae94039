"""Readers and writers of the run caches: small CSV, text and JSON files per run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACKER = "array<struct<frame:int,objects:array<struct<id:int,bbox:array<double>,confidence:double,class:int,ankle_based_point:array<double>,current_map_pos:array<double>,map_velocity:array<double>,keypoints:array<array<double>>,keypoint_scores:array<double>,identity_role:string,birth_location:string,is_inroom:boolean,is_entry:boolean>>>>"


def run_of(path: Column) -> Column:
    """The folder of a file: one folder is one run."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^run_id=", "")


def latest(files: DataFrame) -> DataFrame:
    """The newest of each run's rows (run_id, path, modified), of equal times the last path."""
    w = Window.partitionBy("run_id").orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def files(spark: SparkSession, path: str) -> DataFrame:
    """run_id, path, modified, text of every file that matches."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(run_of(F.col("_metadata.file_path")).alias("run_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest file of each run."""
    return latest(files(spark, path))


def _tracker_files(spark: SparkSession, path: str) -> DataFrame:
    """run_id, path, value and frames_ (null where the file is no array of frames)."""
    text = spark.read.text(path, wholetext=True).select(run_of(F.col("_metadata.file_path")).alias("run_id"), F.col("_metadata.file_path").alias("path"), "value")
    return text.withColumn("frames_", F.when(F.substring(F.trim("value"), 1, 1) == "[", F.from_json("value", TRACKER)))


def unread_detections(spark: SparkSession, path: str) -> DataFrame:
    """run_id, path, reason of the tracker files that `read_detections` gets nothing from: empty, cut off, or no array of frames."""
    bad = _tracker_files(spark, path).where("frames_ is null or (size(frames_) = 1 and frames_[0] is null)")
    start = F.substring(F.trim("value"), 1, 1)
    return bad.select("run_id", "path", F.when(F.trim("value") == "", "empty").when(start != "[", "no array").otherwise("cut off or malformed").alias("reason"))


def write_detections(rows: DataFrame, path: str, compression: str = "none", widened: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One JSON array of frames per run, each frame with its objects by id: the form that `read_detections` reads, also where it is compressed.

    `rows`: run_id, frame, track_id, x1 to y2, and of confidence, class, ankle, map_pos,
    map_velocity (struct<x,y>), keypoints (array of struct<x,y,score>), identity_role,
    birth_location, is_inroom, is_entry those that it has.  An object is a line; its
    place in its frame and run says what goes before and after it, so that no task
    holds a run.  `widened` adds columns after the rows are in order, so that only what
    they are made of is shuffled and sorted.
    """
    order = ("run_id", "frame", "track_id")
    w, frame = Window.partitionBy("run_id").orderBy(*order[1:]), F.struct("frame")
    rows = rows.withColumns({"before_": F.lag(frame).over(w), "after_": F.lead(frame).over(w)})
    rows = rows if widened is None else widened(rows)
    has = set(rows.columns)
    pair = lambda c: F.array(F.col(c)["x"], F.col(c)["y"])
    fields = [F.col("track_id").alias("id"), F.array("x1", "y1", "x2", "y2").alias("bbox")]
    fields += [F.col(c) for c in ("confidence", "class", "identity_role", "birth_location", "is_inroom", "is_entry") if c in has]
    fields += [pair(c).alias(name) for c, name in (("ankle", "ankle_based_point"), ("map_pos", "current_map_pos"), ("map_velocity", "map_velocity")) if c in has]
    if "keypoints" in has:
        fields += [F.transform("keypoints", lambda p: F.array(p["x"], p["y"])).alias("keypoints"), F.transform("keypoints", lambda p: p["score"]).alias("keypoint_scores")]
    opening = F.concat(F.when(F.col("before_").isNull(), "[").otherwise(","), F.lit("{"), F.coalesce(F.concat(F.lit('"frame":'), F.col("frame").cast("string"), F.lit(",")), F.lit("")), F.lit('"objects":['))
    closing = F.when(F.col("after_").isNull(), "]}]").when(F.col("after_").eqNullSafe(frame), "").otherwise("]}")
    value = F.concat(F.when(F.col("before_").eqNullSafe(frame), ",").otherwise(opening), F.to_json(F.struct(*fields)), closing)
    lines = rows.select(*order, value.alias("value")).sortWithinPartitions(*order)  # the order that they have
    lines.select("run_id", "value").write.partitionBy("run_id").mode("overwrite").option("compression", compression).text(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per run, frame and object of the tracker's JSON files (arrays of frames); objects without an id or four box numbers are left out, files that can't be read are `unread_detections`."""
    frames = _tracker_files(spark, path).select("run_id", F.explode("frames_").alias("f")).select("run_id", "f.frame", F.explode("f.objects").alias("o"))
    good = frames.where(F.col("o.id").isNotNull() & (F.size("o.bbox") == 4))
    box = [F.get("o.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]
    point = lambda c: F.struct(F.get(f"o.{c}", F.lit(0)).alias("x"), F.get(f"o.{c}", F.lit(1)).alias("y"))
    keypoints = F.zip_with("o.keypoints", "o.keypoint_scores", lambda p, s: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"), s.alias("score")))
    return good.select(
        "run_id", "frame", F.col("o.id").alias("track_id"), *box, "o.confidence", "o.class", point("ankle_based_point").alias("ankle"), point("current_map_pos").alias("map_pos"), point("map_velocity").alias("map_velocity"),
        keypoints.alias("keypoints"), "o.identity_role", "o.birth_location", "o.is_inroom", "o.is_entry",
    )


def _fields(spark: SparkSession, path: str, names: dict[str, Sequence[str]]) -> DataFrame:
    """run_id and the named fields (text, trimmed) of every line, each file by its own header.

    A field is the first of its names that the header has, without regard to case; null
    where there is none, or where the line is too short.
    """
    lines = F.split(F.regexp_replace("text", "^\ufeff", ""), "\r?\n")
    whole = files(spark, path).select("run_id", lines.alias("lines"))
    header = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda h: F.lower(F.trim(h)))
    rows = whole.select("run_id", header.alias("header"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).where(F.trim("line") != "")
    rows = rows.withColumn("fields", F.split("line", ","))
    place = {n: F.coalesce(*[F.nullif(F.array_position("header", a.lower()), F.lit(0)) for a in aliases]) for n, aliases in names.items()}
    return rows.select("run_id", *[F.trim(F.get("fields", place[n].cast("int") - 1)).alias(n) for n in names])


def _csv(spark: SparkSession, path: str, names: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Number columns by any of their header names, null where they can't be read."""
    rows = _fields(spark, path, {n: a for n, (a, _) in names.items()})
    return rows.select("run_id", *[F.col(n).try_cast("double").cast(kind).alias(n) for n, (_, kind) in names.items()])


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, {"frame": (["frame"], "int"), "track_id": (["id", "track_id", "track"], "int"), "map_x": (["mapX"], "double"), "map_y": (["mapY"], "double")}).dropna()


def read_gaze(spark: SparkSession, path: str) -> DataFrame:
    """Gaze rows; lines that are short or can't be read are dropped."""
    names = {"frame": (["frame"], "int"), "track_id": (["id", "track_id"], "int")} | {c: ([c], "double") for c in ("ox", "oy", "dx", "dy")}
    return _csv(spark, path, names).dropna()


def read_clearance(spark: SparkSession, path: str) -> DataFrame:
    """Clearance rows; -1 is null."""
    names = {"inroom_id": (["inroom_id"], "int"), "start_frame": (["immediate_frame"], "int"), "end_frame": (["contact_end_frame"], "int"), "friend_id": (["clearing_friend"], "int")}
    rows = _csv(spark, path, names).where("inroom_id is not null")
    return rows.select("run_id", "inroom_id", *[F.nullif(c, F.lit(-1)).alias(c) for c in ("start_frame", "end_frame", "friend_id")])


def read_pods(spark: SparkSession, path: str) -> DataFrame:
    names = {"pod_idx": (["pod_idx"], "int"), "assigned_id": (["assigned_id"], "int"), "capture_time_sec": (["capture_time_sec"], "double"), "capture_frame": (["capture_frame"], "int")}
    rows = _csv(spark, path, names).where("pod_idx is not null")
    return rows.withColumns({"captured": F.col("capture_frame").isNotNull(), "assigned": F.col("assigned_id").isNotNull()})


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """run_id, metric, score: a blank score is 0, one that can't be read is left out."""
    rows = _fields(spark, path, {"metric": ["metric_name"], "s": ["score"]}).withColumn("s", F.coalesce("s", F.lit("")))
    return rows.select("run_id", "metric", F.when(F.col("s") == "", 0.0).otherwise(F.col("s").try_cast("double")).alias("score")).where("metric is not null and score is not null")


def read_coverage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The curve (run_id, frame, fraction) and the summary of two-part coverage files; fractions within 0 and 1."""
    parts = spark.read.text(path, wholetext=True).select(run_of(F.col("_metadata.file_path")).alias("run_id"), F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n", 2).alias("p"))
    lines = lambda k: parts.select("run_id", F.explode(F.split(F.coalesce(F.get("p", F.lit(k)), F.lit("")), "\n")).alias("l")).select("run_id", F.split("l", ",").alias("c"))
    curve = lines(0).select("run_id", F.get("c", F.lit(0)).try_cast("int").alias("frame"), F.get("c", F.lit(1)).try_cast("double").alias("f"))
    curve = curve.where("frame is not null and f is not null").select("run_id", "frame", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "f")).alias("fraction"))
    pairs = lines(1).select("run_id", F.trim(F.get("c", F.lit(0))).alias("k"), F.get("c", F.lit(1)).try_cast("double").alias("v"))
    # the newer name first
    keys = {"first_frame": ["first_non_entry_frame", "first_non_enemy_frame"], "time_to_full": ["time_to_full_seconds"], "final_fraction": ["final_fraction"]}
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    summary = pairs.groupBy("run_id").agg(*[F.coalesce(*[value(k) for k in names]).alias(new) for new, names in keys.items()])
    # without a final fraction, the curve's last one
    last = curve.groupBy("run_id").agg(F.max_by("fraction", "frame").alias("last_"))
    summary = summary.join(last, "run_id", "left").withColumn("final_fraction", F.coalesce("final_fraction", "last_")).drop("last_")
    return curve, summary


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs by their manifests: role `trainee`, id and title the folder's name where they are missing."""
    schema = "schema_version int, run_id string, role string, title string, video_basename string, created_at timestamp, analysis_file string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("folder", run_of(F.col("_metadata.file_path")))
    return rows.withColumns({"role": F.coalesce("role", F.lit("trainee")), "run_id": F.coalesce("run_id", "folder"), "title": F.coalesce("title", "folder")})


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """run_id (the folder), fps and the video's names of the metadata files."""
    schema = "schema_version int, fps double, video_path string, video_basename string, produced_at timestamp, engine_version string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(run_of(F.col("_metadata.file_path")).alias("run_id"), "fps", "video_path", "video_basename", "produced_at")


def with_fps(runs: DataFrame, metadata: DataFrame, fallback: float = 30.0) -> DataFrame:
    return runs.join(metadata.select("run_id", "fps"), "run_id", "left").withColumn("fps", F.when(F.col("fps") > 0, F.col("fps")).otherwise(fallback))


NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """run_id, line and the numbers of each line that is no comment."""
    rows = files(spark, path).select("run_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "value")).where(~F.startswith(F.trim("value"), F.lit("#")))
    return rows.select("run_id", "line", "value", F.transform(F.regexp_extract_all("value", F.lit(NUMBER), 1), lambda v: v.cast("double")).alias("n"))


def _points(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(n) - 2, F.lit(2)), lambda k: F.struct(F.get(n, k).alias("x"), F.get(n, k + 1).alias("y")))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """run_id, polygon: array<struct<x,y>> of each line of nothing but numbers, three points or more; # starts a comment."""
    rows = _numbers(spark, path).where(F.regexp_like("value", F.lit(r"^[-+0-9eE., \t]+$")) & (F.size("n") >= 6) & (F.size("n") % 2 == 0))
    return rows.select("run_id", _points(F.col("n")).alias("polygon"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """run_id, idx, x, y (whole numbers) of each line's first two numbers, in order; shorter lines are left out."""
    rows = _numbers(spark, path).where(F.size("n") >= 2)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("line")) - 1
    return rows.select("run_id", place.alias("idx"), F.col("n")[0].cast("int").alias("x"), F.col("n")[1].cast("int").alias("y"))


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """run_id, boundary of each file: all its numbers in pairs, whether on one line or many; three points at least."""
    n = F.transform(F.regexp_extract_all(F.regexp_replace("text", r"(?m)^\s*#.*$", ""), F.lit(NUMBER), 1), lambda v: F.floor(v.cast("double")).cast("double"))
    rows = files(spark, path).select("run_id", n.alias("n")).where((F.size("n") >= 6) & (F.size("n") % 2 == 0))
    return rows.select("run_id", _points(F.col("n")).alias("boundary"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """run_id, pixel_x, pixel_y, map_x, map_y of each line of four numbers; files of fewer than four such lines are left out."""
    n = F.transform(F.split(F.regexp_replace("value", "#.*$", ""), ","), lambda v: F.trim(v).try_cast("double"))
    rows = files(spark, path).select("run_id", "path", F.explode(F.split("text", "\r?\n")).alias("value")).select("run_id", "path", n.alias("n")).where(F.size("n") >= 4)
    names = ("pixel_x", "pixel_y", "map_x", "map_y")
    rows = rows.select("run_id", "path", *[F.get("n", F.lit(k)).alias(c) for k, c in enumerate(names)]).dropna(subset=list(names))
    return rows.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("path"))).where("n_ >= 4").select("run_id", *names)


def read_rooms(spark: SparkSession, path: str) -> DataFrame:
    """run_id, boundary, pods (cut to whole numbers) and team_size (the number of pods where it is missing or not positive)."""
    outline = lambda c: F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("x"), F.get(p, F.lit(1)).cast("int").alias("y")))
    parsed = F.from_json("text", "Boundary array<array<double>>, POD array<array<double>>, team_size string")
    rows = files(spark, path).select("run_id", parsed.alias("c"))
    given = F.col("c.team_size").try_cast("double").cast("int")
    return rows.select("run_id", outline(F.col("c.Boundary")).alias("boundary"), outline(F.col("c.POD")).alias("pods"), F.when(given > 0, given).otherwise(F.coalesce(F.size("c.POD"), F.lit(0))).alias("team_size"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """run_id, id, start, end, text, words of every segment of the transcript files."""
    schema = "segments array<struct<id:int,start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double,score:double>>>>"
    return files(spark, path).select("run_id", F.explode(F.from_json("text", schema)["segments"]).alias("s")).select("run_id", "s.*")


def read_drill_windows(spark: SparkSession, path: str) -> DataFrame:
    """run_id, start_frame, end_frame, reason of the sidecar files."""
    return files(spark, path).select("run_id", F.from_json("text", "start_frame int, end_frame int, reason string").alias("w")).select("run_id", "w.*").where("start_frame is not null")


def effective_windows(sessions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """run_id, start_frame, end_frame, source: the window in the session's own document (`document`, JSON), else the sidecar's."""
    own = F.from_json(F.get_json_object("document", "$.drill_window"), "start_frame int, end_frame int")
    rows = sessions.select("run_id", own.alias("own")).join(sidecars.select("run_id", F.struct("start_frame", "end_frame").alias("side")), "run_id", "left")
    has = F.col("own.start_frame").isNotNull()
    best = F.when(has, F.col("own")).otherwise(F.col("side"))
    return rows.select("run_id", best["start_frame"].alias("start_frame"), best["end_frame"].alias("end_frame"), F.when(has, "embedded").when(F.col("side").isNotNull(), "sidecar").alias("source"))


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Session XML files: (run_id, video, room, start_time, role, title), and (run_id, reason) of those that are rejected.

    The role is `trainee` and the title the video's name where they are missing.
    """
    get = lambda e: F.trim(F.get(F.xpath("x", F.lit(e)), F.lit(0)))
    entry = lambda k: get(f"//general/identifier[catalog/text()='{k}']/entry/text()")
    plain = F.regexp_replace(F.regexp_replace("text", r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"<(/?)\w+:", "<$1")
    rows = files(spark, path).select("run_id", plain.alias("x")).select("run_id", get("//technical/location/text()").alias("video"), entry("space_metadata_file").alias("room"), entry("start_time").alias("start_"), F.lower(entry("role")).alias("role"), entry("title").alias("title"))
    start = F.col("start_").try_cast("int")
    reason = (
        F.when(F.col("video").isNull(), "no location").when(F.col("start_").isNull(), "no start_time").when(start.isNull(), "start_time is no number").when(F.col("room").isNull(), "no space_metadata_file")
        .when(F.col("role").isNotNull() & ~F.col("role").isin("expert", "trainee"), "role is neither expert nor trainee")
    )
    rows = rows.withColumn("reason", reason)
    stem = F.regexp_replace(F.element_at(F.split("video", "/"), -1), r"\.[^.]*$", "")
    good = rows.where("reason is null").select("run_id", "video", "room", start.alias("start_time"), F.coalesce("role", F.lit("trainee")).alias("role"), F.coalesce(F.nullif("title", F.lit("")), stem).alias("title"))
    return good, rows.where("reason is not null").select("run_id", "reason")


#: Columns of each cache file: the format's own name by that of the table.
POSITIONS = {"frame": "frame", "track_id": "id", "map_x": "mapX", "map_y": "mapY"}
GAZE = {"frame": "frame", "track_id": "id", "ox": "ox", "oy": "oy", "dx": "dx", "dy": "dy"}
CLEARANCE = {"inroom_id": "inroom_id", "start_frame": "immediate_frame", "end_frame": "contact_end_frame", "friend_id": "clearing_friend"}
PODS = {"pod_idx": "pod_idx", "assigned_id": "assigned_id", "capture_time_sec": "capture_time_sec", "capture_frame": "capture_frame"}
SCORES = {"metric": "metric_name", "score": "score"}


def _fixed(c: Column, form: str) -> Column:
    """A number as text of a fixed form, without group signs."""
    return F.call_function("format_number", c, F.lit(form))


def write_csv(rows: DataFrame, path: str, names: dict[str, str] = POSITIONS) -> None:
    """One folder per run with a file in the format's own columns, by frame and id (or the first column); nulls stay empty."""
    order = [c for c in ("frame", "track_id") if c in names] or [next(iter(names))]
    ranked = rows.select("run_id", *names).repartition("run_id").sortWithinPartitions("run_id", *order)
    ranked.select("run_id", *[F.col(c).alias(own) for c, own in names.items()]).write.partitionBy("run_id").option("header", True).mode("overwrite").csv(path)


def write_clearance(rows: DataFrame, path: str) -> None:
    """Null frames and ids are written as -1."""
    write_csv(rows.fillna(-1, ["start_frame", "end_frame", "friend_id"]), path, CLEARANCE)


def write_pods(rows: DataFrame, path: str) -> None:
    """Capture times to two places; nulls stay empty."""
    write_csv(rows.withColumn("capture_time_sec", _fixed(F.col("capture_time_sec"), "0.00")), path, PODS)


def write_coverage(curve: DataFrame, summary: DataFrame, path: str) -> None:
    """Two-part files: the curve (run_id, frame, fraction), a blank line, then the summary's keys and values."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("frame", "fraction"))), lambda p: F.concat_ws(",", p["frame"].cast("string"), _fixed(p["fraction"], "0.00")))
    table = curve.groupBy("run_id").agg(F.concat_ws("\n", F.array(F.lit("frame,coverage_fraction")), lines).alias("table_"))
    text = lambda c, form: F.coalesce(_fixed(F.col(c), form), F.lit(""))
    keys = F.concat_ws("\n", F.concat(F.lit("first_non_enemy_frame,"), text("first_frame", "0")), F.concat(F.lit("time_to_full_seconds,"), text("time_to_full", "0.00")), F.concat(F.lit("final_fraction,"), text("final_fraction", "0.00")))
    rows = table.join(summary, "run_id", "left").select("run_id", F.concat("table_", F.lit("\n\n"), keys, F.lit("\n")).alias("value"))
    rows.repartition("run_id").write.partitionBy("run_id").mode("overwrite").text(path)
