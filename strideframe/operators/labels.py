"""Labelling pools and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.ranks import medians
from strideframe.functions.tables import stored
from strideframe.functions.blocks import by_frame


def annotation_counts(annotations: DataFrame, splits: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """Of every split and type its annotations, zero included."""
    grid = annotations.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split")).select("split", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("hold_type"))
    n = annotations.groupBy("split", "hold_type").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n.hint("merge"), ["split", "hold_type"], "left").select("split", "hold_type", F.coalesce("n", F.lit(0)).alias("n"))


def label_summary(labels: DataFrame, key: str = "session_id") -> DataFrame:
    """Positive and negative labels; the given colour, else the commonest among the positive (the first seen of equals)."""
    positive = F.coalesce(F.col("is_hold"), F.lit(False)) & F.col("hold_type").isNotNull()
    marked = labels.withColumn("_p", positive)
    totals = marked.groupBy(key).agg(F.sum(F.col("_p").cast("bigint")).alias("positive"), F.sum((~F.col("_p")).cast("bigint")).alias("negative"), F.max("given_colour").alias("_given"))
    colours = marked.where(F.col("_p") & F.col("colour").isNotNull()).groupBy(key, "colour").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    modal = colours.groupBy(key).agg(F.min_by(F.col("colour"), F.struct(-F.col("_n"), F.col("_first"))).alias("_modal"))
    return totals.join(modal.hint("merge"), key, "left").select(key, "positive", "negative", F.coalesce("_given", "_modal").alias("hold_colour"))


def pool(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Count and last time of each entry, the newest first."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("latest")).orderBy(F.desc("latest"), key)


def key_frame_pool(frames: DataFrame, metadata: DataFrame, key: str = "video_id", time: str = "created_at") -> DataFrame:
    """Of each video of the pool its selected frames, first frame and metadata, the newest first. frames: key, path, chosen;
    metadata: key, time, hold_colour, route_difficulty, a row for each video of the pool; those without chosen frames count 0."""
    chosen = frames.where("chosen").groupBy(key).agg(F.count(F.lit(1)).alias("selected_frames"), F.min("path").alias("first_frame"))
    rows = metadata.select(key, time, "hold_colour", "route_difficulty").join(chosen.hint("merge"), key, "left")
    return rows.withColumn("selected_frames", F.coalesce("selected_frames", F.lit(0))).orderBy(F.desc_nulls_last(time), key)


def pool_totals(pool: DataFrame) -> DataFrame:
    """One row: videos and selected frames of a key-frame pool."""
    return pool.agg(F.count(F.lit(1)).alias("video_count"), F.coalesce(F.sum("selected_frames"), F.lit(0)).alias("frame_count"))


def progress(frames: DataFrame, key: str = "session_id") -> DataFrame:
    """frames, labelled frames, segments and whole percent."""
    out = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.sum((F.col("segments") > 0).cast("bigint")).alias("labelled"), F.sum("segments").alias("segments"))
    return out.withColumn("percent", F.when(F.col("frames") > 0, (F.col("labelled") * 100 / F.col("frames")).cast("int")).otherwise(0))


def status_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latest(events: DataFrame, keys: list[str], time: list[str], payload: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*time)).alias("_p")).select(*keys, "_p.*")


def export_lines(labels: DataFrame, classes: tuple[str, ...], shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """video_id, frame_index, split, lines: label lines grouped by frame; unknown types are left out; splits go by frame order."""
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    rows = labels.withColumn("_c", F.element_at(ids, F.col("label"))).where("_c IS NOT NULL")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "_c", "x_center", "y_center", "width", "height")
    frames = rows.withColumn("_line", line).groupBy("video_id", "frame_index").agg(F.array_join(F.sort_array(F.collect_list("_line")), "\n").alias("lines"))
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    at = F.row_number().over(by_frame()) - 1
    split = F.when(at < (n * shares[0]).cast("int"), "train").when(at < (n * shares[0]).cast("int") + (n * shares[1]).cast("int"), "val").otherwise("test")
    return frames.select("video_id", "frame_index", split.alias("split"), "lines")


FAMILIES = ("angle", "velocity", "speed", "accel", "jerk", "distance", "contact", "com")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, family, n, low, high, mean, median and sample deviation of each numeric column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("u")).select("u.*").where("value IS NOT NULL")
    long = stored(long, "values")
    family = F.coalesce(*[F.when(F.col("column").contains(f), f) for f in FAMILIES], F.lit("other"))
    out = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    out = out.join(stored(medians(long, ["column"], "value"), "medians").hint("merge"), "column")
    return out.select("column", family.alias("family"), "n", "low", "high", "mean", "median", F.when(F.col("n") > 1, F.col("std")).alias("std"))


def run_summary(frames: DataFrame, sample: int = 10) -> DataFrame:
    """Coverage of landmarks in percent, range of scores, and the first frames, of each video."""
    out = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), (100 * F.avg((F.col("landmark_count") > 0).cast("double"))).alias("coverage"), F.min("detection_score").alias("low"), F.max("detection_score").alias("high"))
    first = frames.withColumn("_k", F.row_number().over(by_frame())).where(F.col("_k") <= sample).groupBy("video_id").agg(F.sort_array(F.collect_list("frame_index")).alias("first_frames"))
    return out.join(first.hint("merge"), "video_id")
