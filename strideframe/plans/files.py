"""Queries over readers and writers: a view is written in each file format to the shared folder and read back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strideframe.functions.tables import shared_folder
from strideframe.plans import body as b
from strideframe.plans import fixtures as fx
from strideframe.plans.fixtures import sql
from strideframe.sources import readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents(df: DataFrame, path: str, name: str) -> str:
    """One text file a video, ``video_id=.../name``, from rows of video_id and value, one a video.

    In a shared folder of the file system tasks write the files where they belong, as the committer would move each of them
    in turn. On other storage Spark writes the parts; they are renamed where they lie."""
    spark = df.sparkSession
    at = urlsplit(path)
    if at.scheme == "file":
        root = unquote(at.path)
        os.makedirs(root, exist_ok=True)

        def write(rows: Iterator[Row]) -> None:
            for row in rows:
                folder = f"{root}/video_id={'__HIVE_DEFAULT_PARTITION__' if row.video_id is None else row.video_id}"
                os.makedirs(folder, exist_ok=True)
                part = f"{folder}/.{name}-{uuid.uuid4().hex}"  # an attempt that fails leaves no half of a file
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write((row.value or "") + "\n")
                os.replace(part, f"{folder}/{name}")

        df.select("video_id", "value").repartition("video_id").foreachPartition(write)
        return path
    df.repartition("video_id").write.partitionBy("video_id").text(path)
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(jvm.Path(f"{path}/video_id=*/part-*")):  # one a video
        fs.rename(part.getPath(), jvm.Path(part.getPath().getParent(), name))
    return path


def video_of(column: str = "file"):
    return F.regexp_extract(column, r"video_id=([^/]+)/", 1).cast("bigint")


@query("pose_reader", sql("pose_frames landmarks", "SELECT CAST(video_id AS VARCHAR) AS video_id, frame_index, round(ts, 6) AS ts, 0.5::DOUBLE AS detection_score, 'f' || frame_index || '.jpg' AS image_path, pos, name, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CASE WHEN pos = 3 THEN 0 ELSE round(visibility, 6) END::DOUBLE AS visibility FROM landmarks"))
def pose_reader(spark, sf_dir):
    """Pose files, some visibilities missing."""
    rows = fx.landmarks(spark, sf_dir)
    point = F.struct("pos", "name", "x", "y", "z", F.when(F.col("pos") != 3, F.col("visibility")).alias("visibility"))
    frames = rows.groupBy("video_id", "frame_index").agg(F.min("ts").alias("ts"), F.sort_array(F.collect_list(point)).alias("landmarks"))
    frame = F.struct("frame_index", F.concat(F.lit("f"), "frame_index", F.lit(".jpg")).alias("image_path"), F.col("ts").alias("timestamp_seconds"), F.lit(0.5).alias("detection_score"), "landmarks")
    docs = frames.groupBy("video_id").agg(F.sort_array(F.collect_list(frame)).alias("frames"))
    value = F.to_json(F.struct(F.col("video_id").cast("string").alias("video"), F.size("frames").alias("frame_count"), "frames"))
    path = documents(docs.select("video_id", value.alias("value")), folder(spark, "poses"), "pose_results.json")
    return b.rounded(readers.read_poses(spark, path))


@query("manifest_reader", sql("contact_events contact_rows", "SELECT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN video_id % 2 = 0 THEN 25::DOUBLE END AS fps, CASE WHEN video_id % 3 = 0 THEN 0.5::DOUBLE WHEN max(frame_index) OVER v > 0 THEN round(max(ts) OVER v / max(frame_index) OVER v, 6) ELSE 1 END AS interval_seconds, CAST(count(*) OVER v AS INTEGER) AS total_frames, CAST(NULL AS INTEGER) AS saved_frames, CAST(frame_index AS INTEGER) AS ordinal, frame_index, round(ts, 6) AS timestamp_seconds, 'f' || frame_index AS relative_path, CAST(NULL AS BIGINT) AS saved_index FROM contact_rows WINDOW v AS (PARTITION BY video_id)"))
def manifest_reader(spark, sf_dir):
    """Manifests below a folder, found by name; every third gives its interval."""
    frame = F.struct("frame_index", F.col("ts").alias("timestamp_seconds"), F.concat(F.lit("f"), "frame_index").alias("relative_path"))
    docs = fx.contact_rows(spark, sf_dir).groupBy("video_id").agg(F.sort_array(F.collect_list(frame)).alias("frames"))
    v = F.col("video_id")
    value = F.to_json(F.struct(v.cast("string").alias("video"), F.when(v % 2 == 0, 25.0).alias("fps"), F.when(v % 3 == 0, 0.5).alias("interval_seconds"), F.size("frames").alias("total_frames"), "frames"))
    path = documents(docs.select("video_id", value.alias("value")), folder(spark, "manifests"), "manifest.json")
    return b.rounded(readers.read_manifests(spark, path))


@query("hold_reader", sql("holds", "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY hold_ord) - 1 AS INTEGER) AS hold_ord, hold_id, round(x, 6) AS x, round(y, 6) AS y, false AS normalized, CASE WHEN hold_type = 'volume' THEN 'auto' ELSE hold_type END AS hold_type FROM holds"))
def hold_reader(spark, sf_dir):
    """Holds by name, written by the sink of hold documents; volumes without a type."""
    rows = fx.holds(spark, sf_dir).withColumn("hold_type", F.when(F.col("hold_type") != "volume", F.col("hold_type")))
    path = documents(sinks.hold_documents(rows), folder(spark, "holds"), "holds.json")
    return b.rounded(readers.read_holds(spark, path).select(video_of().alias("video_id"), "hold_ord", "hold_id", "x", "y", "normalized", "hold_type"))


@query("hold_positions", "SELECT p_partkey, round(CASE WHEN p_partkey % 3 > 0 AND CAST(p_size AS DOUBLE) <> 0 THEN CAST(p_size AS DOUBLE) / 50 WHEN p_partkey % 5 > 0 THEN p_partkey::DOUBLE / 1000 ELSE 0 END, 6) AS x FROM part")
def hold_positions(spark, sf_dir):
    """Every third hold has no x of its own (0 or none), every fifth no centre."""
    p = fx.read(spark, sf_dir, "part")
    x = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("double") / 50).when(F.col("p_partkey") % 2 == 0, 0.0)
    center = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") / 1000.0)
    return p.select("p_partkey", F.round(readers.hold_position(x, center), 6).alias("x"))


@query("feature_reader", sql("contact_events contact_rows", "SELECT video_id, frame_index, round(com_x, 6) AS com_x, left_hand_contact_hold FROM contact_rows"))
def feature_reader(spark, sf_dir):
    """A bare list, or an object with features or rows, by turns."""
    rows = fx.contact_rows(spark, sf_dir)
    items = F.sort_array(F.collect_list(F.struct("frame_index", "com_x", "left_hand_contact_hold"))).alias("items")
    v, docs = F.col("video_id") % 3, rows.groupBy("video_id").agg(items)
    value = F.when(v == 0, F.to_json("items")).when(v == 1, F.to_json(F.struct(F.col("items").alias("features")))).otherwise(F.to_json(F.struct(F.col("items").alias("rows"))))
    path = documents(docs.select("video_id", value.alias("value")), folder(spark, "features"), "pose_features.json")
    out = readers.read_features(spark, path, "frame_index bigint, com_x double, left_hand_contact_hold string")
    return b.rounded(out.select(video_of().alias("video_id"), "frame_index", "com_x", "left_hand_contact_hold"))


@query("route_corpus", "SELECT c_nationkey AS video_id, CAST(c_nationkey % 14 AS DOUBLE) AS grade, CAST(count(*) AS INTEGER) AS frames, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE 90::DOUBLE + c_nationkey % 4 END AS wall_angle, c_nationkey % 2 = 0 AS has_holds FROM customer GROUP BY c_nationkey HAVING c_nationkey % 14 <= 10 AND c_nationkey % 7 <> 5")
def route_corpus(spark, sf_dir):
    """A folder a route (customers of a nation stand for its frames) of grade, features and perhaps holds; some grades can't be read or are too high."""
    c, v = fx.read(spark, sf_dir, "customer").withColumn("video_id", F.col("c_nationkey")), F.col("video_id")
    frame = F.struct(F.col("c_custkey").alias("n"), (F.col("c_acctbal").cast("double") / 1000).alias("com_x"), F.when(v % 4 != 0, 90.0 + v % 4).alias("wall_angle"))
    routes = c.groupBy("video_id").agg(F.sort_array(F.collect_list(frame)).alias("frames")).select("video_id", F.to_json("frames").alias("frames"))
    path = folder(spark, "routes")
    parts = {
        "grade.txt": routes.select("video_id", F.when(v % 7 == 5, "V?").otherwise((v % 14).cast("string")).alias("value")), "pose_features.json": routes.select("video_id", F.col("frames").alias("value")),
        "holds.json": routes.where(v % 2 == 0).select("video_id", F.lit("{}").alias("value")),
    }
    for name, part in parts.items():
        documents(part, f"{path}/{name.split('.')[0]}", name)
    out = readers.read_routes(spark, path, "n bigint, com_x double, wall_angle double")
    return out.select(F.regexp_extract("route", "video_id=(.+)", 1).cast("bigint").alias("video_id"), "grade", F.size("frames").alias("frames"), "wall_angle", F.col("holds").isNotNull().alias("has_holds"))


@query("label_text", sql("detections", "SELECT CASE label WHEN 'jug' THEN 0 WHEN 'crimp' THEN 1 ELSE 7 END AS class_id, round(x_center, 6) AS x_center, round(y_center, 6) AS y_center, round(width, 6) AS width, round(height, 6) AS height, CASE WHEN label IN ('jug', 'crimp') THEN label ELSE 'unknown' END AS hold_type FROM detections"))
def label_text(spark, sf_dir):
    """Detector labels as text, with blank and broken lines between, and back."""
    path = folder(spark, "labels")
    kind = F.when(F.col("label") == "jug", 0).when(F.col("label") == "crimp", 1).otherwise(7)
    lines = sinks.label_lines(fx.detections(spark, sf_dir).withColumn("class_id", kind))
    noise = fx.read(spark, sf_dir, "nation").select(F.explode(F.array(F.lit(""), F.lit("broken"), F.lit("1 2 3"))).alias("value"))
    lines.union(noise).write.text(path)
    return readers.read_label_text(spark, path, {0: "jug", 1: "crimp"}).drop("file")


def clips(spark, sf_dir) -> str:
    """Files with the names of videos, and others."""
    lengths = fx.pose_frames(spark, sf_dir).groupBy("video_id").agg(F.max("frame_index").cast("string").alias("value"))
    path = documents(lengths.where(F.col("video_id") % 2 == 0), folder(spark, "clips"), "clip.MP4")
    documents(lengths.where(F.col("video_id") % 2 == 1), f"{path}/more", "clip.avi")
    documents(lengths, f"{path}/notes", "notes.txt")
    return path


@query("video_inventory", sql("pose_frames", "SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'clip.MP4' ELSE 'clip.avi' END AS name, CAST(length(CAST(max(frame_index) AS VARCHAR)) + 1 AS BIGINT) AS length FROM pose_frames GROUP BY video_id"))
def video_inventory(spark, sf_dir):
    """S9."""
    return readers.list_videos(spark, clips(spark, sf_dir)).select(video_of("path").alias("video_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@query("expired_files", sql("pose_frames", "SELECT DISTINCT video_id, days FROM pose_frames, (SELECT unnest([30]) AS days) UNION ALL SELECT DISTINCT video_id, 7 FROM pose_frames WHERE video_id % 2 = 1"))
def expired_files(spark, sf_dir):
    """As seen from next month, of all files and of those below a prefix; today nothing has expired."""
    path = clips(spark, sf_dir)
    files = readers.list_videos(spark, path)
    later = F.current_timestamp() + F.expr("interval 31 days")
    parts = [readers.expired(files, 30, later).withColumn("days", F.lit(30)), readers.expired(files.withColumn("path", F.regexp_extract("path", "(more/.*)", 1)), 7, later, "more/").withColumn("days", F.lit(7)), readers.expired(files, 1).withColumn("days", F.lit(1))]
    return parts[0].union(parts[1]).union(parts[2]).select(video_of("path").alias("video_id"), "days")


_FAULTS = "list_filter([CASE WHEN NOT (h > 0 AND h <= 250) THEN 'height' END, CASE WHEN NOT (w > 0 AND w <= 300) THEN 'wingspan' END, CASE WHEN NOT (f BETWEEN 0 AND 1) THEN 'flexibility' END, CASE WHEN q <> 4 THEN 'imu_quaternion' END, CASE WHEN e <> 3 THEN 'imu_euler' END], lambda x: x IS NOT NULL)"


@query("session_checks", f"SELECT c_custkey, array_to_string({_FAULTS}, ',') AS faults FROM (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 30 AS h, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_acctbal AS DOUBLE) / 25 END AS w, (c_custkey % 13)::DOUBLE / 10 AS f, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 3 + 3 END AS q, c_custkey % 2 + 3 AS e FROM customer)")
def session_checks(spark, sf_dir):
    """Customers as sessions; valid ones have no faults."""
    c, k = fx.read(spark, sf_dir, "customer"), F.col("c_custkey")
    money, numbers = F.col("c_acctbal").cast("double"), lambda n: F.transform(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")), lambda i: i.cast("double"))
    sessions = c.select("c_custkey", (money / 30).alias("climber_height"), F.when(k % 7 != 0, money / 25).alias("climber_wingspan"), (k % 13 / 10.0).alias("climber_flexibility"), F.when(k % 5 != 0, numbers(k % 3 + 3)).alias("imu_quaternion"), numbers(k % 2 + 3).alias("imu_euler"))
    good, bad = readers.check_sessions(sessions)
    return good.select("c_custkey", F.lit("").alias("faults")).union(bad.select("c_custkey", F.concat_ws(",", "faults")))


@query("table_sinks", sql(b.BASE, "SELECT form, video_id, count(*) AS frames, round(sum(com_x), 4) AS com_x FROM body, (SELECT unnest(['json', 'parquet']) AS form) GROUP BY ALL"))
def table_sinks(spark, sf_dir):
    """Features by video as Parquet and as JSON, and back."""
    rows = b.bodies(spark, sf_dir).select("video_id", "frame_index", "com_x")
    out = None
    for form in ("parquet", "json"):
        path = folder(spark, form)
        sinks.write_by_video(rows, path, form)
        back = spark.read.schema("frame_index bigint, com_x double, video_id bigint").format(form).load(path).groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("com_x"), 4).alias("com_x")).withColumn("form", F.lit(form))
        out = back if out is None else out.unionByName(back)
    return out


@query("route_documents", "SELECT c_nationkey AS video_id, count(*) AS total, string_agg('route_' || c_custkey, ',' ORDER BY c_custkey) AS routes FROM customer GROUP BY c_nationkey")
def route_documents(spark, sf_dir):
    """Route groups as one document a video, and back; customers of a nation stand for a wall's routes."""
    rows = fx.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("video_id"), F.struct(F.col("c_custkey").alias("number"), F.concat(F.lit("route_"), "c_custkey").alias("route_id"), F.col("c_mktsegment").alias("colour")).alias("route"))
    path = documents(sinks.route_documents(rows.select("video_id", "route.*"), "number"), folder(spark, "routes"), "routes.json")
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "struct<routes:array<struct<number:bigint,route_id:string,colour:string>>,total_routes:bigint>").alias("d"))
    return text.select(video_of().alias("video_id"), F.col("d.total_routes").alias("total"), F.concat_ws(",", F.col("d.routes.route_id")).alias("routes"))


@query("prediction_documents", "SELECT doc_id % 20 AS video_id, doc_id AS frame_index, round((doc_id % 97)::DOUBLE / 97, 6) AS efficiency_score, CASE WHEN quality = 1 THEN 'left_hand' ELSE 'none' END AS next_action, quality AS next_action_class FROM labels")
def prediction_documents(spark, sf_dir):
    """Predictions as one document a video, and back."""
    q = F.col("quality").cast("int")
    rows = fx.read(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("video_id"), F.col("doc_id").alias("frame_index"), (F.col("doc_id") % 97 / 97.0).alias("efficiency_score"), F.when(q == 1, "left_hand").otherwise("none").alias("next_action"), q.alias("next_action_class"))
    path = documents(sinks.prediction_documents(rows, "boosted"), folder(spark, "predictions"), "predictions.json")
    item = "struct<frame_index:bigint,efficiency_score:double,next_action:string,next_action_class:int>"
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.from_json("value", f"struct<video:string,model_type:string,predictions:array<{item}>>").alias("d"))
    return b.rounded(text.select(F.col("d.video").cast("bigint").alias("video_id"), F.explode("d.predictions").alias("p")).select("video_id", "p.*"))


@query("frame_labels", sql("detections", ", f AS (SELECT DISTINCT video_id, frame_index FROM detections WHERE label IN ('jug', 'crimp')), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS place, count(*) OVER (PARTITION BY video_id) AS n FROM f), s AS (SELECT *, CASE WHEN place < CAST(floor(n * 0.7) AS INT) THEN 'train' WHEN place < CAST(floor(n * 0.7) AS INT) + CAST(floor(n * 0.15) AS INT) THEN 'val' ELSE 'test' END AS split FROM k) SELECT split, d.video_id, d.frame_index, d.label AS hold_type, count(*) AS n, CAST(sum(CAST(round(x_center * 1000000) AS BIGINT)) AS BIGINT) AS x, CAST(sum(CAST(round(height * 1000000) AS BIGINT)) AS BIGINT) AS h FROM detections d JOIN s USING (video_id, frame_index) WHERE label IN ('jug', 'crimp') GROUP BY ALL"))
def frame_labels(spark, sf_dir):
    """Label lines of many frames a file, and back."""
    from strideframe.operators import labels

    path = folder(spark, "frame-labels")
    sinks.write_frame_labels(labels.export_lines(fx.detections(spark, sf_dir), ("jug", "crimp")), path)
    rows = readers.read_frame_labels(spark, path, {0: "jug", 1: "crimp"})
    return rows.groupBy("split", "video_id", "frame_index", "hold_type").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(F.col(c) * 1_000_000).cast("bigint")).alias(n) for c, n in (("x_center", "x"), ("height", "h"))])


@query("frame_label_files", sql("detections", "SELECT video_id, frame_index, count(*) AS n FROM detections WHERE label IN ('jug', 'crimp') GROUP BY ALL"))
def frame_label_files(spark, sf_dir):
    """One label file a frame, and back."""
    from strideframe.operators import labels

    path = folder(spark, "frames")
    sinks.write_label_files(labels.export_lines(fx.detections(spark, sf_dir), ("jug", "crimp")), path)
    rows = readers.read_label_text(spark, path, {0: "jug", 1: "crimp"})
    return rows.groupBy(video_of().alias("video_id"), F.regexp_extract("file", r"frame_index=([0-9]+)/", 1).cast("bigint").alias("frame_index")).agg(F.count(F.lit(1)).alias("n"))
