"""The nearest holds of many points: a grid with each video's own cell size, and blocks or a tree of holds for the points it can't settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.ranks import hinted
from strideframe.functions.tables import stored
from strideframe.operators.hold_tree import hold_tree, near_and_far, reached

BLOCK = 512
PAIRS = 1 << 24  # of a point and a hold that are looked at one by one


def hold_blocks(holds: DataFrame, block: int = BLOCK) -> DataFrame:
    """Arrays of about ``block`` holds (hold_ord, hold_id, x, y, hold_type): video_id, _holds. No row grows with a video's holds."""
    sizes = hinted(holds.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks")))
    placed = holds.join(sizes, "video_id").withColumn("_block", F.pmod(F.xxhash64("hold_ord"), F.col("_blocks")))
    return stored(placed.groupBy("video_id", "_block").agg(F.collect_list(F.struct("hold_ord", "hold_id", "x", "y", "hold_type")).alias("_holds")), "hold_blocks").drop("_block")


def nearest(points: DataFrame, holds: DataFrame, ids: list[str], k: int = 1, farthest: float | None = None) -> DataFrame:
    """The ``k`` nearest holds of each point (video_id, ids, x, y): video_id, ids, rank, hold_ord, hold_id, hx, hy, d.

    Ties go to the earlier hold; distances over ``farthest`` are ties. Of holds in one place the first ``k`` alone can be
    among them, so copies of a hold neither shrink the cells nor fill them. A cell is as wide as a circle that holds some
    2 k + 4 holds. A point meets the holds of its cell and the eight around it; if ``k`` of them lie within a cell's
    width and nearer than ``farthest``, no other hold can come before them. The other points, if few, meet all holds of
    their video, a block at a time; if many, they open the boxes of a tree. Only the best ``k`` of a block or box become rows."""
    at = stored(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("video_id", *ids, "x", "y"), "points")
    kind = F.col("hold_type") if "hold_type" in holds.columns else F.lit(None).cast("string")
    known = holds.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("video_id", "hold_ord", "hold_id", "x", "y", kind.alias("hold_type"))
    same = F.row_number().over(Window.partitionBy("video_id", "x", "y").orderBy("hold_ord"))
    few = stored(known.withColumn("_same", same).where(F.col("_same") <= k).drop("_same"), "holds")
    hold = few.select("video_id", "hold_ord", "hold_id", F.col("x").alias("hx"), F.col("y").alias("hy"))
    wide, high, n = F.max("hx") - F.min("hx"), F.max("hy") - F.min("hy"), F.count(F.lit(1))
    want = F.lit((2 * k + 4) / 3.14159)
    cells = hinted(hold.groupBy("video_id").agg(F.greatest(F.sqrt(wide * high * want / n), F.greatest(wide, high) * want / n, F.lit(1e-9)).alias("_cell"), n.alias("_n")))
    cell = lambda c, d=0: (F.floor(F.col(c) / F.col("_cell")) + d).cast("bigint")
    near9 = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    spread = at.join(cells, "video_id").select("video_id", *ids, "x", "y", "_cell", near9).select("video_id", *ids, "x", "y", "_cell", cell("x", F.col("o.i")).alias("_cx"), cell("y", F.col("o.j")).alias("_cy"))
    placed = hold.join(cells, "video_id").select("video_id", "hold_ord", "hold_id", "hx", "hy", cell("hx").alias("_cx"), cell("hy").alias("_cy"))
    d = F.hypot(F.col("hx") - F.col("x"), F.col("hy") - F.col("y"))
    capped = F.col("d") if farthest is None else F.least(F.col("d"), F.lit(farthest))
    met = spread.join(placed.hint("merge"), ["video_id", "_cx", "_cy"]).withColumn("d", d).where(F.col("d") <= F.col("_cell"))
    by = Window.partitionBy("video_id", *ids)
    out = ["video_id", *ids, "rank", "hold_ord", "hold_id", "hx", "hy", "d"]
    best = lambda rows: rows.withColumn("rank", F.row_number().over(by.orderBy(capped, "hold_ord"))).where(F.col("rank") <= k).select(*out)
    ranked = stored(best(met), "near")
    inside = F.lit(True) if farthest is None else F.col("d") < farthest  # beyond it holds that were not met may be earlier
    settled = stored(ranked.where((F.col("rank") == k) & inside).select("video_id", *ids), "settled")
    left = stored(at.join(settled.hint("merge"), ["video_id", *ids], "left_anti"), "unsettled")
    pairs = left.join(cells, "video_id").agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    if not pairs[1]:  # those that are left are in videos without holds
        return ranked
    unreal = few.where(F.isnan("x") | F.isnan("y")).limit(1).count()  # has no box
    sure = ranked.join(settled.hint("merge"), ["video_id", *ids], "left_semi")
    if pairs[0] <= PAIRS or unreal:
        return sure.union(best(by_blocks(left, few, ids, k, farthest)))
    return sure.union(best(by_boxes(left, few, ids, k, farthest)))


def looked_at(rows: DataFrame, ids: list[str], k: int, farthest: float | None) -> DataFrame:
    """The best ``k`` of each row's ``_holds``."""
    far = F.transform("_holds", lambda h: (lambda dist: F.struct((dist if farthest is None else F.least(dist, F.lit(farthest))).alias("c"), h["hold_ord"].alias("hold_ord"), h["hold_id"].alias("hold_id"), h["x"].alias("hx"), h["y"].alias("hy"), dist.alias("d")))(F.hypot(h["x"] - F.col("x"), h["y"] - F.col("y"))))
    few = F.array(F.array_min(far)) if k == 1 else F.slice(F.array_sort(far), 1, k)
    return rows.select("video_id", *ids, F.explode(few).alias("h")).select("video_id", *ids, "h.*")


def by_blocks(points: DataFrame, holds: DataFrame, ids: list[str], k: int, farthest: float | None) -> DataFrame:
    """Each point beside the best of every block of its video's holds."""
    return looked_at(points.join(hold_blocks(holds).hint("merge"), "video_id"), ids, k, farthest)


def by_boxes(points: DataFrame, holds: DataFrame, ids: list[str], k: int, farthest: float | None) -> DataFrame:
    """Each point beside the best holds of the boxes that its ``k`` nearest lie in.

    Where fewer than ``k`` are nearer than ``farthest``, the others are the earliest of the rest, so among the first ``k`` of the video."""

    def bounds(b: Column) -> tuple[Column, Column]:
        near, far = near_and_far(b, F.col("x"), F.col("y"))
        return -far, -near

    met = looked_at(reached(points, hold_tree(holds, k), ids, bounds, k), ids, k, None)
    if farthest is None:
        return met
    early = F.row_number().over(Window.partitionBy("video_id").orderBy("hold_ord"))
    first = stored(holds.withColumn("_early", early).where(F.col("_early") <= k).groupBy("video_id").agg(F.collect_list(F.struct("hold_ord", "hold_id", "x", "y", "hold_type")).alias("_holds")), "first_holds")
    rest = looked_at(points.join(first.hint("merge"), "video_id"), ids, k, None)
    return met.union(rest).dropDuplicates(["video_id", *ids, "hold_ord"])
