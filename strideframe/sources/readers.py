"""Readers of the JSON and text files that pose, detection and labelling systems write; every video in one job."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANDMARK = "struct<name:string,x:double,y:double,z:double,visibility:double>"
POSES = f"video string, frame_count int, frames array<struct<image_path:string,timestamp_seconds:double,detection_score:double,landmarks:array<{LANDMARK}>>>"
MANIFEST = "video string, fps double, interval_seconds double, total_frames int, saved_frames int, frames array<struct<frame_index:bigint,timestamp_seconds:double,relative_path:string,saved_index:bigint>>"

TASKS = 16  # a core, that read many small files


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """While files are listed: a few tasks a core take the folders, not a task for each of up to 10,000 folders."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_poses(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Landmarks, one row each: video_id, frame_index, ts, detection_score, image_path, pos, name, x, y, z, visibility. One row with null pos for a frame without."""
    raw = spark.read.schema(POSES).option("recursiveFileLookup", recursive).json(path, multiLine=True)
    frames = raw.select(F.col("video").alias("video_id"), F.posexplode("frames").alias("frame_index", "f"))
    marks = frames.select("video_id", F.col("frame_index").cast("bigint").alias("frame_index"), F.col("f.timestamp_seconds").alias("ts"), F.coalesce("f.detection_score", F.lit(0.0)).alias("detection_score"), "f.image_path", F.posexplode_outer("f.landmarks").alias("pos", "p"))
    return marks.select("video_id", "frame_index", "ts", "detection_score", "image_path", "pos", "p.name", "p.x", "p.y", "p.z", F.when(F.col("p").isNotNull(), F.coalesce("p.visibility", F.lit(0.0))).alias("visibility"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifest.json files below a folder, a row a frame; the interval is the given one, else the mean step (where the frame rate, 30 if absent, is positive), else 1."""
    with listing(spark):
        raw = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(path, multiLine=True)
    n = F.size("frames")
    step = (F.element_at("frames", -1)["timestamp_seconds"] - F.element_at("frames", 1)["timestamp_seconds"]) / F.greatest(F.lit(1), n - 1)
    interval = F.coalesce("interval_seconds", F.when((n > 1) & (F.coalesce("fps", F.lit(30.0)) > 0), step), F.lit(1.0))
    return raw.select(F.col("video").alias("video_id"), "fps", interval.alias("interval_seconds"), "total_frames", "saved_frames", F.posexplode("frames").alias("ordinal", "f")).select("video_id", "fps", "interval_seconds", "total_frames", "saved_frames", "ordinal", "f.*")


def read_holds(spark: SparkSession, path: str) -> DataFrame:
    """Holds of name-keyed objects: file, hold_ord, hold_id, x, y, normalized, hold_type."""
    kind = "map<string,struct<x:double,y:double,coords:array<double>,normalized:boolean,hold_type:string>>"
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.map_entries(F.from_json("value", kind))).alias("hold_ord", "e"))
    v = F.col("e.value")
    return raw.select("file", "hold_ord", F.col("e.key").alias("hold_id"), F.coalesce(v["x"], F.get(v["coords"], F.lit(0))).alias("x"), F.coalesce(v["y"], F.get(v["coords"], F.lit(1))).alias("y"), F.coalesce(v["normalized"], F.lit(False)).alias("normalized"), F.coalesce(v["hold_type"], F.lit("auto")).alias("hold_type"))


def hold_position(x: Column, center: Column) -> Column:
    """x, where it is 0 or absent the centre, else 0."""
    return F.coalesce(F.when(x != 0, x), F.when(center != 0, center), F.lit(0.0))


def read_features(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of files that hold a list, or an object with ``features`` or ``rows``. ``row``: the fields, as DDL."""
    with listing(spark):
        raw = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path)  # opens a small file in a third of the time of whole text
    text = raw.select(F.input_file_name().alias("file"), F.col("content").cast("string").alias("value")).coalesce(TASKS * spark.sparkContext.defaultParallelism)  # not a task for every 32 files
    fields = ",".join(f"{n}:{t}" for n, t in (f.strip().rsplit(" ", 1) for f in row.split(",")))
    item = f"struct<{fields}>"
    boxed = F.from_json("value", f"struct<features:array<{item}>,rows:array<{item}>>")
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>"))
    return text.select("file", F.explode(F.coalesce(listed, boxed["features"], boxed["rows"])).alias("r")).select("file", "r.*")


def read_routes(spark: SparkSession, path: str, features: str) -> DataFrame:
    """A route a folder: grade.txt and features, with holds and steps where there are any. Folders whose grade is missing, unreadable or outside 0 to 10 are dropped."""
    folder = lambda df: df.withColumn("route", F.regexp_extract("file", "([^/]+)/[^/]+$", 1))
    text = lambda name: folder(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))
    grades = text("grade.txt").select("route", F.expr("try_cast(trim(value) AS double)").alias("grade")).where(F.col("grade").between(0, 10))
    item = f"array<struct<{','.join(f'{n}:{t}' for n, t in (f.strip().rsplit(' ', 1) for f in features.split(',')))}>>"
    rows = text("pose_features.json").select("route", F.from_json("value", item).alias("frames"))
    other = lambda name, column: text(name).select("route", F.col("value").alias(column))
    out = grades.join(rows.hint("merge"), "route").join(other("holds.json", "holds").hint("merge"), "route", "left").join(other("step_efficiency.json", "steps").hint("merge"), "route", "left")
    angle = F.get(F.filter(F.transform("frames", lambda f: f["wall_angle"]), lambda a: a.isNotNull()), F.lit(0)) if "wall_angle" in features else F.lit(None).cast("double")
    return out.withColumn("wall_angle", angle)


def read_label_text(spark: SparkSession, path: str, classes: dict[int, str]) -> DataFrame:
    """Detector labels, ``class x y w h`` a line; blank and broken lines are skipped, unknown classes are ``unknown``."""
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.expr(f"try_cast(p[{i}] AS double)")
    names = F.create_map(*[F.lit(x) for kv in sorted(classes.items()) for x in kv])
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("file"), parts.alias("p")).where(F.size("p") >= 5)
    rows = raw.select("file", F.expr("try_cast(p[0] AS int)").alias("class_id"), *[number(i).alias(n) for i, n in enumerate(("x_center", "y_center", "width", "height"), 1)]).where("class_id IS NOT NULL AND height IS NOT NULL")
    return rows.withColumn("hold_type", F.coalesce(F.element_at(names, F.col("class_id")), F.lit("unknown")))


def read_frame_labels(spark: SparkSession, path: str, classes: dict[int, str]) -> DataFrame:
    """split, video_id, frame_index and the labels of each line of what ``write_frame_labels`` wrote; broken lines are skipped, unknown classes are ``unknown``."""
    rows = spark.read.schema("split string, video_id long, frame_index long, lines string").json(path)
    parts = rows.select("split", "video_id", "frame_index", F.explode(F.split("lines", "\n")).alias("value")).select("*", F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 5)
    number = lambda i, kind="double": F.expr(f"try_cast(p[{i}] AS {kind})")
    out = parts.select("split", "video_id", "frame_index", number(0, "int").alias("class_id"), *[number(i).alias(n) for i, n in enumerate(("x_center", "y_center", "width", "height"), 1)]).where("class_id IS NOT NULL AND height IS NOT NULL")
    names = F.create_map(*[F.lit(x) for kv in sorted(classes.items()) for x in kv])
    return out.withColumn("hold_type", F.coalesce(F.element_at(names, F.col("class_id")), F.lit("unknown")))


def list_videos(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of video files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "modificationTime")
    return files.where(F.col("path").rlike(r"(?i)\.(mp4|mov|mkv|avi)$"))


def expired(files: DataFrame, days: int, now: Column | None = None, prefix: str | None = None, most: int | None = None) -> DataFrame:
    """Files older than so many days, the oldest first; the list only, nothing is removed."""
    if days <= 0:
        raise ValueError("days must be positive")
    out = files.where(F.col("modificationTime") < (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)))
    if prefix:
        out = out.where(F.col("path").startswith(prefix))
    return out.orderBy("modificationTime", "path").limit(most) if most else out


def check_sessions(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with the names of the fields at fault."""
    c = F.col
    bad = {
        "height": ~((c("climber_height") > 0) & (c("climber_height") <= 250)), "wingspan": ~((c("climber_wingspan") > 0) & (c("climber_wingspan") <= 300)),
        "flexibility": ~c("climber_flexibility").between(0, 1), "imu_quaternion": F.size("imu_quaternion") != 4, "imu_euler": F.size("imu_euler") != 3,
    }
    known = {"height": "climber_height", "wingspan": "climber_wingspan", "flexibility": "climber_flexibility", "imu_quaternion": "imu_quaternion", "imu_euler": "imu_euler"}
    faults = F.array_compact(F.array(*[F.when(c(known[n]).isNotNull() & b, F.lit(n)) for n, b in bad.items()]))
    marked = sessions.withColumn("faults", faults)
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)
