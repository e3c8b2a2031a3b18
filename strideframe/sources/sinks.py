"""Writers: tables by video as Parquet or JSON, and detector label files' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_video(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """A folder a video. Rows are spread by video and a rebalance hint, so that a long video becomes several files."""
    df.hint("rebalance", "video_id").write.mode(mode).partitionBy("video_id").format(form).save(path)


def label_lines(labels: DataFrame) -> DataFrame:
    """value: ``class x y w h`` with six decimals."""
    return labels.select(F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "x_center", "y_center", "width", "height").alias("value"))


def write_label_text(labels: DataFrame, path: str, mode: str = "overwrite") -> None:
    label_lines(labels).write.mode(mode).text(path)


def hold_documents(holds: DataFrame) -> DataFrame:
    """video_id and value: a video's holds as one object by name, in their order."""
    entry = F.struct("hold_ord", F.col("hold_id").alias("key"), F.struct("x", "y", "hold_type").alias("value"))
    listed = F.sort_array(F.collect_list(entry))
    return holds.groupBy("video_id").agg(listed.alias("_h")).select("video_id", F.to_json(F.map_from_entries(F.transform("_h", lambda e: F.struct(e["key"], e["value"])))).alias("value"))


def route_documents(routes: DataFrame, order: str) -> DataFrame:
    """video_id and value: a video's routes with their number."""
    rest = [c for c in routes.columns if c not in ("video_id", order)]
    return routes.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("routes")).select("video_id", F.to_json(F.struct("routes", F.size("routes").alias("total_routes"))).alias("value"))


def prediction_documents(predictions: DataFrame, model_type: str) -> DataFrame:
    """video_id and value: a video's predictions in frame order, with the model's kind."""
    rest = [c for c in predictions.columns if c not in ("video_id", "frame_index")]
    grouped = predictions.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("frame_index", *rest))).alias("predictions"))
    return grouped.select("video_id", F.to_json(F.struct(F.col("video_id").cast("string").alias("video"), F.lit(model_type).alias("model_type"), "predictions")).alias("value"))


def write_frame_labels(exported: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The label lines of many frames in each file, a JSON line a frame, below their split; files by size, however many
    frames there are. ``exported``: as ``export_lines`` gives. ``readers.read_frame_labels`` reads them back."""
    exported.select("split", "video_id", "frame_index", "lines").hint("rebalance", "split").write.mode(mode).partitionBy("split").json(path)


def write_label_files(exported: DataFrame, path: str, mode: str = "overwrite") -> None:
    """For detectors that want it, one file of label lines a frame, below its split and video: as many files as frames."""
    exported.select("split", "video_id", "frame_index", "lines").repartition("video_id", "frame_index").write.mode(mode).partitionBy("split", "video_id", "frame_index").text(path)
