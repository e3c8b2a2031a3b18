"""Density clusters by cells: exact, without a table of all near pairs.

Points lie in cells so small that any two in a cell are near each other. A cell with enough points is all core; the few
points of other cells are counted against the cells around. Cells, not points, are then linked: two cells with core points
are joined if any two core points of theirs are near. A few outermost points of each settle most of these questions, boxes
settle others. What is left matters only between cells that these links don't already bring together: there small cells are compared
point by point, and large cells that touch without being settled are halved, round by round. So the work grows with the
points, however dense they lie, and points of dense cells are read by cell and not joined with each other."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.ranks import hinted
from strideframe.functions.tables import components, stored

CELLS = 500_000  # that are broadcast to the points, some 100 bytes each; more are merged
SMALL = 64  # core points of a cell that are compared point by point
ROUNDS = 200  # halvings of a cell; each parts its box, down to equal points


def _distance(a: list[Column], b: list[Column]) -> Column:
    """One formula everywhere, so that every test of a pair agrees."""
    square = [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    return F.sqrt(sum(square[1:], square[0]))


def _axes(prefix: str, n: int) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(n)]


def neighbours(cells: DataFrame, keys: tuple[str, ...], n: int, reach: int, apart: float) -> DataFrame:
    """Pairs (a, b) of different cells, both ways, whose points can be near. Cells meet by blocks of ``reach`` cells."""
    coarse = lambda d=0: [(F.floor(F.col(f"cell.c{i}") / reach) + (F.col(f"o.{i}") if d else 0)).cast("bigint").alias(f"g{i}") for i in range(n)]
    group = [F.col(f"cell.{k}").alias(k) for k in keys]
    around = F.array(*[F.struct(*[F.lit(x).alias(str(i)) for i, x in enumerate(o)]) for o in product((-1, 0, 1), repeat=n)])
    spread = cells.select(F.col("cell"), F.explode(around).alias("o")).select(F.col("cell").alias("a"), *group, *coarse(1))
    home = cells.select(F.col("cell").alias("b"), *group, *coarse())
    gaps = [F.greatest(F.abs(F.col(f"a.c{i}") - F.col(f"b.c{i}")) - 1, F.lit(0)) for i in range(n)]
    met = spread.join(home.hint("merge"), [*keys, *[f"g{i}" for i in range(n)]])
    return met.where((F.col("a") != F.col("b")) & (sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= apart)).select("a", "b")


def _outline(n: int) -> list[Column]:
    """Number, box and the outermost points along each axis of points x0, x1, ..."""
    point = F.struct(*[F.col(f"x{i}") for i in range(n)])
    if n == 2:  # without rows in the buffers, so aggregated by hash
        outer = [o for f, by in ((F.min, F.min_by), (F.max, F.max_by)) for o in (F.struct(f("x0").alias("x0"), by("x1", "x0").alias("x1")), F.struct(by("x0", "x1").alias("x0"), f("x1").alias("x1")))]
    else:
        outer = [f(point, F.col(f"x{i}")) for i in range(n) for f in (F.min_by, F.max_by)]
    return [F.count(F.lit(1)).alias("n"), *[F.min(f"x{i}").alias(f"low{i}") for i in range(n)], *[F.max(f"x{i}").alias(f"high{i}") for i in range(n)], F.array(*outer).alias("outer")]


def _apart(n: int, eps: float) -> tuple[Column, Column]:
    """Of two parts ``_a`` and ``_b``: whether two outermost points are near, and whether the boxes are too far for any."""
    gap = [F.greatest(F.col(f"_a.low{i}") - F.col(f"_b.high{i}"), F.col(f"_b.low{i}") - F.col(f"_a.high{i}"), F.lit(0.0)) for i in range(n)]
    near = F.exists("_a.outer", lambda p: F.exists("_b.outer", lambda q: _distance([p[f"x{i}"] for i in range(n)], [q[f"x{i}"] for i in range(n)]) <= eps))
    return near, F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0])) > eps


def linked_cells(cores: DataFrame, pairs: DataFrame, eps: float, n: int) -> DataFrame:
    """Those of the pairs (a, b) of cells that have core points within ``eps``. ``cores``: cell, x0, x1, ..."""
    points = cores.withColumn("part", F.lit(0).cast("bigint"))
    open_ = pairs.select("a", "b", F.lit(0).cast("bigint").alias("pa"), F.lit(0).cast("bigint").alias("pb"))
    found = []
    for round_ in range(ROUNDS):
        boxes = stored(points.groupBy("cell", "part").agg(*_outline(n)), "boxes")
        side = lambda s: boxes.select(F.col("cell").alias(s), F.col("part").alias(f"p{s}"), F.struct("n", *[f"low{i}" for i in range(n)], *[f"high{i}" for i in range(n)], "outer").alias(f"_{s}"))  # noqa: E731, B023
        met = open_.join(side("a").hint("merge"), ["a", "pa"]).join(side("b").hint("merge"), ["b", "pb"])
        near, far = _apart(n, eps)
        few = (F.col("_a.n") <= SMALL) & (F.col("_b.n") <= SMALL)
        judged = stored(met.select("a", "pa", "b", "pb", F.when(near, "near").when(far, "far").when(few, "few").otherwise("open").alias("verdict")).where("verdict <> 'far'"), "judged")
        found.append(judged.where("verdict = 'near'").select("a", "b"))
        few_ = judged.where("verdict = 'few'")
        mine = lambda s: points.select(F.col("cell").alias(s), F.col("part").alias(f"p{s}"), *[F.col(f"x{i}").alias(f"{s}{i}") for i in range(n)])  # noqa: E731, B023
        compared = few_.join(mine("a").hint("merge"), ["a", "pa"]).join(mine("b").hint("merge"), ["b", "pb"])
        found.append(compared.where(_distance(_axes("a", n), _axes("b", n)) <= eps).select("a", "b"))
        settled = stored(found[-2].union(found[-1]).distinct(), "linked")
        found[-2:] = [settled]
        left = stored(judged.where("verdict = 'open'").join(settled.hint("merge"), ["a", "b"], "left_anti"), "open")
        if not left.limit(1).count():
            break
        # Halve the box of each part that is still in question, along every axis, at its middle.
        parts = left.select(F.col("a").alias("cell"), F.col("pa").alias("part")).union(left.select("b", "pb")).distinct()
        cut = parts.join(boxes.hint("merge"), ["cell", "part"]).select("cell", "part", *[((F.col(f"low{i}") + F.col(f"high{i}")) / 2).alias(f"mid{i}") for i in range(n)])
        bits = sum(((F.col(f"x{i}") > F.col(f"mid{i}")).cast("bigint") * (1 << i) for i in range(1, n)), (F.col("x0") > F.col("mid0")).cast("bigint"))
        halved = stored(points.join(stored(cut, "cut").hint("merge"), ["cell", "part"]).select("cell", F.col("part").alias("old"), F.xxhash64("part", bits).alias("part"), *[f"x{i}" for i in range(n)]), "halved")
        born = halved.select("cell", "old", "part").distinct()
        child = lambda s: born.select(F.col("cell").alias(s), F.col("old").alias(f"p{s}"), F.col("part").alias(f"n{s}"))  # noqa: E731, B023
        born = stored(born, "born")
        open_ = stored(left.join(child("a").hint("merge"), ["a", "pa"]).join(child("b").hint("merge"), ["b", "pb"]).select("a", "b", F.col("na").alias("pa"), F.col("nb").alias("pb")), "pairs")
        points = halved.drop("old")
    else:
        raise RuntimeError(f"cells were not settled in {ROUNDS} rounds")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def density_clusters(points: DataFrame, eps: float, least: int, id_col: str, keys: tuple[str, ...] = ("video_id",), axes: tuple[str, ...] = ("x_center", "y_center")) -> DataFrame:
    """Adds cluster: the smallest core id of the point's cluster, null for noise. A point is core with ``least`` points within eps, itself included.

    Core points that are near each other are in one cluster; a border point takes the lowest cluster near it. Points with
    an unknown coordinate are noise. Ids must not repeat."""
    n = len(axes)
    wide = eps / n**0.5 * (1 - 1e-9)  # of a cell: its diagonal is below eps
    apart = (eps / wide) ** 2 * (1 + 1e-9)  # square of the gap of cells, in cells, over which nothing is near
    reach = int(apart**0.5) + 1
    known = F.lit(True)
    for a in axes:
        known = known & F.col(a).isNotNull()
    cell = F.struct(*keys, *[F.floor(F.col(a) / wide).alias(f"c{i}") for i, a in enumerate(axes)])
    columns = points.columns
    points = stored(points.withColumn("_cell", F.when(known, cell)), "detections")  # with all their columns: read again below
    here, there = [f"x{i}" for i in range(n)], [f"y{i}" for i in range(n)]
    base = points.where(F.col("_cell").isNotNull()).select(F.col(id_col).alias("_id"), *[F.col(a).cast("double").alias(f"x{i}") for i, a in enumerate(axes)], F.col("_cell").alias("cell"))
    cells = stored(base.groupBy("cell").agg(F.min("_id").alias("low"), *_outline(n)), "cells")
    sparse = hinted(cells.where(F.col("n") < least).select("cell", "n"), CELLS)
    dense = hinted(cells.where(F.col("n") >= least).select("cell"), CELLS)
    pairs = stored(neighbours(cells.select("cell"), keys, n, reach, apart), "near_cells")
    near = _distance([F.col(c) for c in here], [F.col(c) for c in there]) <= eps
    # Points of cells with too few, each with the cells around it.
    loose = stored(base.join(sparse, "cell"), "loose")
    around = loose.select(F.col("cell").alias("a"), F.col("_id").alias("_mine"), *[F.col(x).alias(y) for x, y in zip(here, there, strict=True)]).join(pairs.hint("merge"), "a").drop("a").withColumnRenamed("b", "cell")
    around = stored(around, "around")
    met = hinted(around.select("cell").distinct(), CELLS)
    counted = base.join(met, "cell", "left_semi").join(around.hint("merge"), "cell").where(near).groupBy("_mine").agg(F.count(F.lit(1)).alias("_more"))
    few = loose.join(stored(counted, "counted").hint("merge").withColumnRenamed("_mine", "_id"), "_id").where(F.col("n") + F.col("_more") >= least).select("_id", *here, "cell")
    few = stored(few, "few_cores")
    outlined = ["cell", "low", "n", *[f"{s}{i}" for s in ("low", "high") for i in range(n)], "outer"]
    named = cells.where(F.col("n") >= least).select(*outlined, F.lit(True).alias("dense")).union(few.groupBy("cell").agg(F.min("_id").alias("low"), *_outline(n)).select(*outlined, F.lit(False)))
    named = stored(named, "core_cells")
    side = lambda s: named.select(F.col("cell").alias(s), F.struct(*outlined[1:]).alias(f"_{s}")).hint("merge")
    beside, far = _apart(n, eps)
    judged = pairs.where("a < b").join(side("a"), "a").join(side("b"), "b").where(~far).select("a", "b", F.col("_a.low").alias("la"), F.col("_b.low").alias("lb"), beside.alias("near"))
    judged = stored(judged, "core_pairs")
    labels = components(judged.where("near").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    # Pairs that no outermost points settle, of cells that are not together yet.
    of = lambda c: labels.select(F.col("node").alias(f"l{c}"), F.col("label").alias(f"_l{c}")).hint("merge")
    left = judged.where("NOT near").join(of("a"), "la", "left").join(of("b"), "lb", "left").select("a", "b", F.coalesce("_la", "la").alias("la"), F.coalesce("_lb", "lb").alias("lb"))
    left = stored(left.where("la <> lb"), "open_pairs")
    cluster = F.coalesce("label", "low")
    of_cell = stored(named.select("cell", "low", "dense").join(labels.hint("merge").withColumnRenamed("node", "low"), "low", "left").select("cell", "dense", cluster.alias("cluster")), "cell_clusters")
    if left.limit(1).count():
        open_cells = hinted(left.select(F.col("a").alias("cell")).union(left.select("b")).distinct(), CELLS)
        cores = base.join(dense, "cell", "left_semi").select("cell", *here).union(few.select("cell", *here)).join(open_cells, "cell", "left_semi").distinct()
        found = left.join(linked_cells(stored(cores, "cores"), left.select("a", "b"), eps, n).hint("merge"), ["a", "b"])
        labels = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        of_cell = of_cell.join(labels.hint("merge").withColumnRenamed("node", "cluster"), "cluster", "left").select("cell", "dense", F.coalesce("label", "cluster").alias("cluster"))
        of_cell = stored(of_cell, "cell_clusters")
    # A border point sees the core points of its own cell, all near, and those around.
    border = stored(loose.join(few.select("_id").hint("merge"), "_id", "left_anti"), "border")
    inside = border.join(of_cell.hint("merge"), "cell").select("_id", "cluster")
    seen = base.join(dense, "cell", "left_semi").select("_id", *here, "cell").union(few).join(met, "cell", "left_semi")
    outside = seen.join(around.hint("merge"), "cell").where(near).select(F.col("_mine").alias("_id"), "cell").distinct().join(border.select("_id").hint("merge"), "_id", "left_semi").join(of_cell.hint("merge"), "cell").select("_id", "cluster")
    lowest = inside.union(outside).groupBy("_id").agg(F.min("cluster").alias("cluster"))
    mine = few.select("_id", "cell").join(of_cell.hint("merge"), "cell").select("_id", "cluster").union(lowest).withColumnRenamed("_id", id_col)
    # Points of dense cells have their cell's cluster.
    whole = hinted(of_cell.where("dense").select(F.col("cell").alias("_cell"), "cluster"), CELLS)
    rest = points.join(sparse.select(F.col("cell").alias("_cell")), "_cell", "left_semi").join(stored(mine, "clusters").hint("merge"), id_col, "left")
    unknown = points.where(F.col("_cell").isNull()).withColumn("cluster", F.lit(None).cast(points.schema[id_col].dataType))
    return stored(points.join(whole, "_cell").select(*columns, "cluster").union(rest.select(*columns, "cluster")).union(unknown.select(*columns, "cluster")), "clustered")
