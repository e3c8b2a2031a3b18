"""Frames that look for holds in the tree are dealt over tasks, however few files they lie in."""

from pyspark.sql import functions as F

from strideframe.operators import hold_tree as ht


def test_frames_of_one_file_open_boxes_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ht, "FRAMES", 4)
    share = lambda c, n: (F.col(c) * 37 % n / n).cast("double")
    holds = spark.range(300).select(F.lit(1).alias("video_id"), F.col("id").alias("hold_ord"), F.col("id").cast("string").alias("hold_id"), share("id", 101).alias("x"), share("id", 89).alias("y"), F.lit("jug").alias("hold_type"))
    frames = spark.range(0, 10, 1, 1).select(F.lit(1).alias("video_id"), F.col("id").alias("_row"), share("id", 7).alias("x"), share("id", 5).alias("y"))

    def bounds(b):
        near, far = ht.near_and_far(b, F.col("x"), F.col("y"))
        return -far, -near

    got = ht.reached(frames, ht.hold_tree(holds, 1), ["_row"], bounds, 1).select("_row", F.spark_partition_id().alias("task")).collect()
    assert {r["_row"] for r in got} == set(range(10)) and len({r["task"] for r in got}) == 3
