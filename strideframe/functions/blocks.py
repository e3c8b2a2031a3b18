"""Windows over rows of one key that is split into blocks, so that one key with very many rows runs in many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strideframe.functions.ranks import hinted
from strideframe.functions.tables import stored

BLOCK = 1 << 16


def by_frame() -> WindowSpec:
    """Made on call: workers import these modules without a session."""
    return Window.partitionBy("video_id").orderBy("frame_index")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns behind a generator, so that the optimiser computes each once and does not copy it into every use."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select("*", made).select(*[c for c in df.columns if c not in columns], *[F.col(f"_made.{n}").alias(n) for n in columns])


def in_blocks(frames: DataFrame, work: Callable[[DataFrame], DataFrame], before: int, after: int = 0, length: int = BLOCK) -> DataFrame:
    """``work(frames)``, whose windows over ``by_frame()`` look at most so many rows back and ahead, block by block.

    A block is a run of ``length`` frame numbers. Rows that look beyond their block are worked out in a second, small set
    of the first and last rows of all blocks of a video, which is contiguous wherever they look. Both come from one
    shuffle of the frames by video and block. ``work`` may add and replace columns and drop rows, but for the keys."""
    edge = before + after
    block = F.struct("video_id", F.floor(F.col("frame_index") / length).alias("block"))
    placed = frames.withColumn("video_id", block)
    ahead = F.row_number().over(by_frame())
    follow = lambda n: F.lead("frame_index", n).over(by_frame()).isNull() if n else F.lit(False)
    placed = placed.select("*", ahead.alias("_ahead"), follow(edge).alias("_near_end"), follow(after).alias("_at_end"))
    beyond = (F.col("_ahead") <= before) | F.col("_at_end")
    plain = lambda df: df.withColumn("video_id", F.col("video_id.video_id"))
    inside = plain(work(placed).where(~beyond))
    edges = work(plain(placed.where((F.col("_ahead") <= edge) | F.col("_near_end")))).where(beyond)
    return inside.union(edges).drop("_ahead", "_near_end", "_at_end")


def numbered(frames: DataFrame, name: str = "_k", length: int = BLOCK) -> DataFrame:
    """Adds the frame's place in its video, from 0: counted by blocks, and shifted by the blocks before."""
    placed = stored(frames.withColumn("_block", F.floor(F.col("frame_index") / length)), "blocks")
    counts = placed.groupBy("video_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("video_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("video_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # one row a block
    own = F.row_number().over(Window.partitionBy("video_id", "_block").orderBy("frame_index")) - 1
    return placed.withColumn(name, own).join(hinted(before), ["video_id", "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")
