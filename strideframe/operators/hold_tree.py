"""The best holds of many frames: each video's holds packed into a shallow tree of boxes, searched level by level with bounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.blocks import settled
from strideframe.functions.ranks import hinted, running
from strideframe.functions.tables import stored

LEAF, FAN = 64, 64
PART = 100_000  # rows that one task sorts
FRAMES = 2_000  # that one task takes to the tree: each opens many boxes
BROADCAST = 2_000  # nodes: 128,000 holds or boxes at most
BOX = ("x0", "x1", "y0", "y1", "n")


@dataclass(frozen=True)
class HoldTree:
    """``leaves``: video_id, node, _holds. ``levels``, from the top: video_id, node, _nodes (node, box and number of holds). A video's root is node 0."""

    levels: list[DataFrame]
    leaves: DataFrame


def tiled(entries: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``tile``: strips of a video by x, cut by y into runs of ``size``. By ranks, so that outliers don't widen the tiles."""
    counted = stored(entries.groupBy("video_id").agg(F.count(F.lit(1)).alias("_all")), "sizes")
    largest, rows = counted.agg(F.coalesce(F.max("_all"), F.lit(0)), F.coalesce(F.sum("_all"), F.lit(0))).first()
    if largest <= size:
        return entries.withColumn("tile", F.lit(0).cast("bigint"))
    tiles, parts = F.ceil(F.col("_all") / size), -(-rows // PART)
    wide = hinted(counted.select("video_id", (F.ceil(tiles / F.ceil(F.sqrt(tiles))) * size).alias("_wide")))
    across = running(entries.withColumn("_one", F.lit(1)), ["video_id"], ["x", order], ["_one"], parts).join(wide, "video_id")
    strips = across.withColumn("_strip", F.floor(F.col("before__one") / F.col("_wide"))).drop("before__one", "_wide")
    along = running(strips, ["video_id", "_strip"], ["y", order], ["_one"], parts)
    return along.withColumn("tile", (F.col("_strip") * F.lit(1 << 32) + F.floor(F.col("before__one") / size)).cast("bigint")).drop("before__one", "_strip", "_one")


def hold_tree(holds: DataFrame, most: int, place: tuple[str, ...] = ("x", "y"), leaf: int = LEAF, fan: int = FAN) -> HoldTree:
    """The tree of a table of holds (video_id, hold_ord, hold_id, x, y, hold_type); those without coordinates are in none.

    Of holds that agree in ``place`` only the first ``most`` by hold_ord are kept: no frame can prefer another."""
    known = holds.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("video_id", "hold_ord", "hold_id", "x", "y", "hold_type")
    same = Window.partitionBy("video_id", *place).orderBy("hold_ord")
    kept = stored(known.withColumn("_same", F.row_number().over(same)).where(F.col("_same") <= most).drop("_same"), "holds")
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")]
    hold = F.struct("hold_ord", "hold_id", "x", "y", "hold_type")
    nodes = leaves = stored(tiled(kept, "hold_ord", leaf).groupBy("video_id", F.col("tile").alias("node")).agg(F.collect_list(hold).alias("_holds"), *box), "leaves")
    around = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n")]
    levels = []
    while nodes.where(F.col("node") != 0).limit(1).count():
        boxes = nodes.select("video_id", "node", *BOX, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
        packed = tiled(boxes, "node", fan).groupBy("video_id", "tile").agg(F.collect_list(F.struct("node", *BOX)).alias("_nodes"), *around)
        nodes = stored(packed.withColumnRenamed("tile", "node"), "nodes")
        levels.append(nodes.select("video_id", "node", "_nodes"))
    return HoldTree(levels[::-1], leaves.select("video_id", "node", "_holds"))


def sized(table: DataFrame) -> DataFrame:
    """A written table with a join hint by its number of rows."""
    return table.hint("broadcast" if table.count() <= BROADCAST else "merge")


def near_and_far(b: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Bounds of the distance between a point and what lies in box ``b``."""
    zero = F.lit(0.0)
    near = F.hypot(F.greatest(b["x0"] - x, x - b["x1"], zero), F.greatest(b["y0"] - y, y - b["y1"], zero))
    return near, F.hypot(F.greatest(x - b["x0"], b["x1"] - x), F.greatest(y - b["y0"], b["y1"] - y))


def bounded(rows: DataFrame, level: DataFrame, bounds: Callable[[Column], tuple[Column, Column]], need: int, how: str = "inner") -> DataFrame:
    """Rows beside the boxes of their node, those sure of most first, and their floor raised to what boxes sure of ``need`` holds have."""

    def one(b: Column) -> Column:
        low, up = bounds(b)
        return F.struct((-low).alias("low"), b["n"].alias("n"), up.alias("up"), b["node"].alias("node"))

    met = settled(rows.join(sized(level), ["video_id", "node"], how).drop("node"), _nodes=F.array_sort(F.transform("_nodes", one)))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(float("inf")).alias("low"))
    sure = F.aggregate("_nodes", start, lambda a, b: F.when(a["n"] >= need, a).otherwise(F.struct((a["n"] + b["n"]).alias("n"), b["low"].alias("low"))))
    return settled(met.withColumn("_sure", sure), _floor=F.when(F.col("_sure.n") >= need, F.greatest("_floor", -F.col("_sure.low"))).otherwise(F.col("_floor")))


def fits(up: Column) -> Column:
    """A bound may round below the score it bounds."""
    return up + F.abs(up) * 1e-9 + 1e-12 >= F.col("_floor")


def reached(frames: DataFrame, tree: HoldTree, ids: list[str], bounds: Callable[[Column], tuple[Column, Column]], need: int, floor: float = float("-inf")) -> DataFrame:
    """Each frame beside every leaf (``_holds``) that may hold one of its ``need`` best holds of a score of ``floor`` or more.

    ``bounds`` gives the least and greatest score of a box. Boxes sure of ``need`` holds set a frame's floor, and boxes
    that can't reach it are left. So a frame opens the boxes around its best holds, however many its video has."""
    columns = frames.columns
    rows = frames.repartition(-(-frames.count() // FRAMES) or 1).withColumn("node", F.lit(0).cast("bigint")).withColumn("_floor", F.lit(floor))
    for depth, level in enumerate(tree.levels):
        met = bounded(rows, level, bounds, need)
        rows = met.select(*columns, "_floor", F.explode(F.filter("_nodes", lambda b: fits(b["up"]))).alias("_b")).select(*columns, "_floor", F.col("_b.up").alias("_up"), F.col("_b.node").alias("node"))
        if depth:  # a frame has opened several boxes: the highest floor counts
            rows = rows.withColumn("_floor", F.max("_floor").over(Window.partitionBy("video_id", *ids))).where(fits(F.col("_up")))
        rows = rows.drop("_up")
    return rows.join(sized(tree.leaves), ["video_id", "node"]).drop("node", "_floor")


def reached_by_stream(frames: DataFrame, tree: HoldTree, bounds: Callable[[Column], tuple[Column, Column]], need: int) -> DataFrame:
    """The same for frames of a stream, which can't be counted, and whose boxes can't be looked at together: a box hands its
    floor down to those in it alone, so that some more are opened. ``_head`` marks one row of each frame, which every frame
    has; its ``_holds`` are null where the video has no tree."""
    columns = [*frames.columns, "_head"]
    rows = frames.select("*", F.lit(True).alias("_head"), F.lit(0).cast("bigint").alias("node"), F.lit(float("-inf")).alias("_floor"))
    for level in tree.levels:
        open_ = F.posexplode_outer(F.filter("_nodes", lambda b: fits(b["up"]))).alias("_at", "_b")
        rows = bounded(rows, level, bounds, need, "left").select(*columns, "_floor", open_)
        rows = rows.withColumn("_head", F.col("_head") & (F.coalesce("_at", F.lit(0)) == 0)).select(*columns, F.col("_b.node").alias("node"), "_floor")
    return rows.join(sized(tree.leaves), ["video_id", "node"], "left").drop("node", "_floor")
