"""Views over the driver's tables in the shapes that the operators take, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.params import LANDMARKS, LIMBS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pose_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: the label is the video, the order of ids within it the frame."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("video_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"), F.col("embedding").cast("array<double>").alias("e"))
    return e.withColumn("ts", F.col("frame_index") / 25.0)


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda k, n: F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), (0.5 + F.col("e")[4 * k]).alias("x"), (0.5 + F.col("e")[4 * k + 1]).alias("y"), F.col("e")[4 * k + 2].alias("z"), F.least(F.lit(1.0), 0.3 + 4 * F.abs(F.col("e")[4 * k + 3])).alias("visibility"))
    rows = pose_frames(spark, sf_dir).select("video_id", "frame_index", "ts", F.explode(F.array(*[point(k, n) for k, n in enumerate(LANDMARKS)])).alias("p"))
    return rows.select("video_id", "frame_index", "ts", "p.*")


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("STANDARD", "jug", "PROMO", "crimp", "SMALL", "sloper", "LARGE", "pinch", "ECONOMY", "foot_only")]), F.col("p_type")), F.lit("volume"))
    price = F.col("p_retailprice").cast("double")
    return p.select(
        (F.col("p_partkey") % 10).alias("video_id"), F.col("p_partkey").alias("hold_ord"), F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("hold_id"),
        (F.col("p_size").cast("double") / 50.0).alias("x"), (F.round(price - F.floor(price / 100) * 100, 4) / 100.0).alias("y"), kind.alias("hold_type"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detections. They carry no number: copies of a row are as good as each other."""
    x = read(spark, sf_dir, "lineitem")
    price, tax, discount = (F.col(c).cast("double") for c in ("l_extendedprice", "l_tax", "l_discount"))
    return x.select(
        (F.col("l_orderkey") % 50).alias("video_id"), (F.col("l_orderkey") % 40).alias("frame_index"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("det_id"),
        ((price - F.floor(price / 1000) * 1000) / 1000.0).alias("x_center"), ((F.col("l_partkey") % 1000) / 1000.0).alias("y_center"),
        (0.02 + tax).alias("width"), (0.02 + discount).alias("height"), (0.5 + tax * 5.0).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "jug").when(F.col("l_returnflag") == "N", "hold").otherwise("crimp").alias("label"),
    )


def tracked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as objects that jitter over 40 frames and are missed in one of five; twenty to a video."""
    p = read(spark, sf_dir, "part")
    key, price, f = F.col("p_partkey"), F.col("p_retailprice").cast("double"), F.col("frame_index")
    rows = p.withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.lit(39)))).where((key + f) % 5 != 0)
    return rows.select(
        F.floor(key / 20).cast("bigint").alias("video_id"), f.cast("bigint").alias("frame_index"), key.alias("object_id"),
        (F.col("p_size") / 50.0 + ((key * 7 + f * 13) % 11 - 5) * 0.001).alias("x_center"),
        ((price - F.floor(price / 100) * 100) / 100.0 + ((key * 5 + f * 17) % 13 - 6) * 0.001).alias("y_center"),
        F.lit(0.05).alias("width"), F.lit(0.05).alias("height"), (0.5 + ((key + f) % 50) / 100.0).alias("confidence"),
        F.lit("hold").alias("label"), F.lit(None).cast("string").alias("hold_type"),
    )


def contact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as contact rows: each event sets one limb's hold; holds stay until the limb's next event."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select(F.col("user_id").alias("video_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"), "event_id", "event_type", (F.col("event_id") % 4).alias("limb"), F.col("value").cast("double").alias("value"), "props", *[F.last(F.when(F.col("event_id") % 4 == k, F.col("event_type")), True).over(w).alias(f"{p}_contact_hold") for k, p in enumerate(LIMBS)])
    flags = [x for p in LIMBS for x in (F.when(F.col(f"{p}_contact_hold").isNotNull(), "hold").otherwise("none").alias(f"{p}_contact_type"), F.col(f"{p}_contact_hold").isNotNull().cast("int").alias(f"{p}_contact_on"))]
    return e.select(
        "video_id", "frame_index", "event_id", "event_type", (F.col("frame_index") / 25.0).alias("ts"), ((F.col("value") - F.floor(F.col("value") / 10) * 10) / 10).alias("com_x"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 100).alias("com_y"), *[f"{p}_contact_hold" for p in LIMBS], *flags,
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climbers' sizes, one row a video of ``pose_frames``."""
    v = read(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("video_id")).distinct()
    third = F.when(F.col("video_id") % 3 != 0, F.col("video_id") / 10.0)
    return v.select("video_id", (150.0 + 5 * F.col("video_id")).alias("climber_height"), (155.0 + 5 * F.col("video_id")).alias("climber_wingspan"), third.alias("climber_flexibility"))


# -- the same for DuckDB, as common table expressions -------------------------------------------------

NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in LANDMARKS) + "]"
CTE = {
    "pose_frames": "SELECT vec_id, CAST(label AS BIGINT) AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_index, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS DOUBLE) / 25 AS ts, CAST(embedding AS DOUBLE[]) AS e FROM embeddings",
    "landmarks": f"SELECT video_id, frame_index, ts, k AS pos, {NAMES_SQL}[k + 1] AS name, 0.5::DOUBLE + e[4*k+1] AS x, 0.5::DOUBLE + e[4*k+2] AS y, e[4*k+3] AS z, least(1::DOUBLE, 0.3::DOUBLE + 4 * abs(e[4*k+4])) AS visibility FROM pose_frames, (SELECT CAST(range AS INTEGER) AS k FROM range(14))",
    "wide": "SELECT video_id, frame_index, min(ts) AS ts, avg(visibility) AS detection_score, count(*) AS landmark_count, " + ", ".join(f"max({c}) FILTER (name = '{n}') AS {n}_{c}" for n in LANDMARKS for c in ("x", "y", "z", "visibility")) + " FROM landmarks GROUP BY ALL",
    "holds": """SELECT p_partkey % 10 AS video_id, p_partkey AS hold_ord, concat('H', CAST(p_partkey AS VARCHAR)) AS hold_id, CAST(p_size AS DOUBLE) / 50 AS x,
      round(CAST(p_retailprice AS DOUBLE) - floor(CAST(p_retailprice AS DOUBLE) / 100) * 100, 4) / 100 AS y,
      CASE p_type WHEN 'STANDARD' THEN 'jug' WHEN 'PROMO' THEN 'crimp' WHEN 'SMALL' THEN 'sloper' WHEN 'LARGE' THEN 'pinch' WHEN 'ECONOMY' THEN 'foot_only' ELSE 'volume' END AS hold_type FROM part""",
    "detections": """SELECT l_orderkey % 50 AS video_id, l_orderkey % 40 AS frame_index, l_orderkey, l_linenumber, l_partkey, l_suppkey,
      (CAST(l_extendedprice AS DOUBLE) - floor(CAST(l_extendedprice AS DOUBLE) / 1000) * 1000) / 1000 AS x_center, (l_partkey % 1000)::DOUBLE / 1000 AS y_center,
      0.02::DOUBLE + CAST(l_tax AS DOUBLE) AS width, 0.02::DOUBLE + CAST(l_discount AS DOUBLE) AS height, 0.5::DOUBLE + CAST(l_tax AS DOUBLE) * 5 AS confidence,
      CASE l_returnflag WHEN 'A' THEN 'jug' WHEN 'N' THEN 'hold' ELSE 'crimp' END AS label FROM lineitem""",
    "contact_events": "SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS frame_index FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "contact_rows": "SELECT user_id AS video_id, frame_index, event_id, event_type, frame_index::DOUBLE / 25 AS ts, (CAST(value AS DOUBLE) - floor(CAST(value AS DOUBLE) / 10) * 10) / 10 AS com_x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS com_y, "
    + ", ".join(f"last_value(CASE WHEN event_id % 4 = {k} THEN event_type END IGNORE NULLS) OVER w AS {p}_contact_hold, CASE WHEN last_value(CASE WHEN event_id % 4 = {k} THEN event_type END IGNORE NULLS) OVER w IS NULL THEN 'none' ELSE 'hold' END AS {p}_contact_type, CASE WHEN last_value(CASE WHEN event_id % 4 = {k} THEN event_type END IGNORE NULLS) OVER w IS NULL THEN 0 ELSE 1 END AS {p}_contact_on" for k, p in enumerate(LIMBS))
    + " FROM contact_events WINDOW w AS (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "sessions": "SELECT DISTINCT CAST(label AS BIGINT) AS video_id, 150::DOUBLE + 5 * label AS climber_height, 155::DOUBLE + 5 * label AS climber_wingspan, CASE WHEN label % 3 <> 0 THEN label::DOUBLE / 10 END AS climber_flexibility FROM embeddings",
}


def sql(names: str, body: str) -> str:
    """``body`` after the named common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names.split()) + "\n" + body.strip()
