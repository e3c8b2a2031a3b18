"""Next-hold ranking and the move planner. Frames meet holds by grid cells, or by the boxes of a tree; only the best few become rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from strideframe.functions.blocks import settled
from strideframe.functions.geometry import clamp, distance, point_in_polygon, segment_distance
from strideframe.functions.tables import stored
from strideframe.operators.efficiency import scale, support_points
from strideframe.operators.hold_tree import FAN, LEAF, hold_tree, near_and_far, reached, reached_by_stream, sized
from strideframe.operators.nearby import nearest
from strideframe.params import LIMBS, PlannerParams


def hold_score(distance_: Column, hold_id: Column, used: Column) -> Column:
    free = F.when(F.coalesce(F.array_contains(used, hold_id), F.lit(False)), 0.0).otherwise(1.0)
    return 0.7 * (1 - F.least(distance_, F.lit(1.0))) + 0.3 * free


def next_holds(frames: DataFrame, holds: DataFrame, k: int = 3, held: str = "contact_hold") -> DataFrame:
    """The ``k`` best holds of every frame with a centre of mass: near, and not held (``held``: contact_hold or target).

    At most four holds are held and lose by it, so the best ``k`` are among the nearest ``k + 4``, and those are looked for in a grid."""
    known = frames.where(F.col("com_x").isNotNull() & F.col("com_y").isNotNull())
    kept = stored(known.select("video_id", "frame_index", "com_x", "com_y", *[F.col(f"{p}_{held}") for p in LIMBS]).withColumn("_row", F.monotonically_increasing_id()), "frames")
    near = nearest(kept.select("video_id", "_row", F.col("com_x").alias("x"), F.col("com_y").alias("y")), holds, ["_row"], k + len(LIMBS), 1.0)
    used = F.array(*[F.col(f"{p}_{held}") for p in LIMBS])
    rows = kept.drop("video_id").join(stored(near, "candidates").drop("rank").hint("merge"), "_row").withColumn("score", hold_score(F.col("d"), F.col("hold_id"), used))
    by = Window.partitionBy("video_id", "frame_index", "_row").orderBy(F.desc("score"), "hold_ord")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("video_id", "frame_index", "rank", "hold_id", "score")


def next_holds_in_row(frames: DataFrame, holds: DataFrame, k: int = 3, held: str = "contact_hold") -> DataFrame:
    """The same where a video has few holds: they stand beside each frame as one array."""
    used = F.array(*[F.col(f"{p}_{held}") for p in LIMBS])
    same = F.row_number().over(Window.partitionBy("video_id", "x", "y").orderBy("hold_ord"))
    few = holds.withColumn("_same", same).where(F.col("_same") <= k + len(LIMBS))  # of one place four may be held, and the others tie
    lists = few.groupBy("video_id").agg(F.collect_list(F.struct("hold_ord", "hold_id", "x", "y")).alias("_holds"))

    def rank(h: Column) -> Column:
        score = hold_score(F.hypot(F.col("com_x") - h["x"], F.col("com_y") - h["y"]), h["hold_id"], used)
        return F.struct((-score).alias("cost"), h["hold_ord"].alias("hold_ord"), h["hold_id"].alias("hold_id"))

    rows = frames.where(F.col("com_x").isNotNull() & F.col("com_y").isNotNull()).join(lists.hint("merge") if not frames.isStreaming else lists, "video_id")
    best = F.slice(F.array_sort(F.transform("_holds", rank)), 1, k)
    out = rows.select("video_id", "frame_index", F.posexplode(best).alias("rank", "b"))
    return out.select("video_id", "frame_index", (F.col("rank") + 1).alias("rank"), "b.hold_id", (-F.col("b.cost")).alias("score"))


MERGED = 1 << 17  # rows that are gathered before the best are kept


def best_of_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` rows of each _row that have the least cost, then hold_ord, in any order of the rows of a task: video_id, frame_index, rank, hold_id, score."""

    def best(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        rows = rows.sort_by([("_row", "ascending"), ("cost", "ascending"), ("hold_ord", "ascending"), ("hold_id", "ascending")])
        row = rows.column("_row").to_numpy()
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        return rows.filter(pa.array(place < k)), place[place < k] + 1

    parts, n, most = [], 0, MERGED
    for batch in batches:
        parts, n = [*parts, pa.Table.from_batches([batch])], n + batch.num_rows
        if n > most:
            parts = [best(pa.concat_tables(parts))[0]]
            n = parts[0].num_rows
            most = max(MERGED, 2 * n)
    if n:
        rows, rank = best(pa.concat_tables(parts))
        score = pa.array(-rows.column("cost").to_numpy())
        yield from pa.table([rows.column("video_id"), rows.column("frame_index"), pa.array(rank, pa.int32()), rows.column("hold_id"), score], names=["video_id", "frame_index", "rank", "hold_id", "score"]).to_batches()


def next_holds_by_boxes(frames: DataFrame, holds: DataFrame, k: int = 3, held: str = "contact_hold") -> DataFrame:
    """The same for a stream, which can't sort or look twice: frames open boxes of the tree of holds, and what its boxes give of a frame is merged in a task.

    Distances over 1 are ties, as unknown ones are, so the first few holds of a video stand beside each of its frames; the
    tree has the others. No row grows with a video's holds."""
    copies = holds.where(F.col("hold_id").isNotNull()).groupBy("video_id", "hold_id").count().agg(F.max("count")).first()[0] or 0
    need = k + len(LIMBS) * copies  # an id that is held may stand on several rows
    early = F.row_number().over(Window.partitionBy("video_id").orderBy("hold_ord"))
    kind = F.col("hold_type") if "hold_type" in holds.columns else F.lit(None).cast("string")
    ranked = stored(holds.select("video_id", "hold_ord", "hold_id", "x", "y", kind.alias("hold_type")).withColumn("_early", early), "ranked_holds")
    hold = F.struct("hold_ord", "hold_id", "x", "y", "hold_type")
    first = stored(ranked.where(F.col("_early") <= need).groupBy("video_id").agg(F.collect_list(hold).alias("_first")), "first_holds")
    others = ranked.where((F.col("_early") > need) & ~F.isnan("x") & ~F.isnan("y"))
    com = F.col("com_x"), F.col("com_y")

    def bounds(b: Column) -> tuple[Column, Column]:
        near, far = near_and_far(b, *com)
        return -far, -near

    used = F.array(*[F.col(f"{p}_{held}") for p in LIMBS]).alias("_used")
    known = frames.where(com[0].isNotNull() & com[1].isNotNull()).select("video_id", "frame_index", "com_x", "com_y", used, F.expr("uuid()").alias("_row"))
    placed = known.repartition("_row").join(sized(first), "video_id")
    rows = reached_by_stream(placed, hold_tree(others, need), bounds, need)

    def rank(h: Column) -> Column:
        score = hold_score(F.hypot(com[0] - h["x"], com[1] - h["y"]), h["hold_id"], F.col("_used"))
        return F.struct((-score).alias("cost"), h["hold_ord"].alias("hold_ord"), h["hold_id"].alias("hold_id"))

    none = F.slice("_first", 1, 0)
    mine = F.concat(F.coalesce("_holds", none), F.when(F.col("_head"), F.col("_first")).otherwise(none))
    rows = rows.select("_row", "video_id", "frame_index", F.explode(F.slice(F.array_sort(F.transform(mine, rank)), 1, k)).alias("b"))
    rows = rows.select("_row", "video_id", "frame_index", "b.*").repartition("_row")
    out = StructType([rows.schema["video_id"], rows.schema["frame_index"], StructField("rank", IntegerType()), rows.schema["hold_id"], StructField("score", DoubleType())])
    return rows.mapInArrow(lambda batches: best_of_rows(batches, k), out)


def reach_limit(params: PlannerParams) -> Column:
    ratio = clamp(0.9 + 0.2 * F.col("climber_wingspan") / F.col("climber_height"), 0.8, 1.2)
    span = F.when((F.col("climber_height") > 0) & F.col("climber_wingspan").isNotNull(), ratio).otherwise(1.0)
    return params.max_reach * span * F.coalesce(1 + 0.05 + 0.05 * F.col("climber_flexibility"), F.lit(1.0))


def plan_moves(frames: DataFrame, holds: DataFrame, params: PlannerParams = PlannerParams(), leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """The best moves of every frame: rank, limb, hold_id, efficiency, delta, violations, reasoning.

    The candidates are the best free holds by nearness, height over the centre and type, all of which a box of holds
    bounds, so each frame opens few boxes. Holds that are held are no candidates, so that many more are looked for.
    Holds without coordinates and frames without a centre give no moves; equal scores go to the earlier hold."""
    on = lambda p: F.coalesce(F.col(f"{p}_contact_on") != 0, F.lit(False))
    supports = sum((on(p).cast("int") for p in LIMBS[1:]), on(LIMBS[0]).cast("int"))
    used = F.array(*[F.when(on(p), F.col(f"{p}_contact_hold")) for p in LIMBS])
    com, com_y = (F.col("com_x"), F.col("com_y")), F.col("com_y")

    def bonus(kind: Column, y: Column, largest: bool) -> Column:
        jug = F.when((kind == "jug") & (F.col("_supports") < 3), params.jug_bonus).otherwise(0.0)
        far = F.when(kind.isin("crimp", "sloper") & (y < com_y - 0.15 * F.col("_scale")), params.reach_bonus).otherwise(0.0)
        return F.greatest(jug, far) if largest else jug + far

    def sample(h: Column) -> Column:
        score = 1 / (distance(com, (h["x"], h["y"])) / F.col("_scale") + 1e-6) + F.when(h["y"] < com_y, params.upward_bias * (com_y - h["y"])).otherwise(0.0) + F.coalesce(bonus(h["hold_type"], h["y"], True), F.lit(0.0))
        return F.struct((-score).alias("cost"), h["hold_ord"].alias("hold_ord"), h["hold_id"].alias("hold_id"), h["x"].alias("x"), h["y"].alias("y"), h["hold_type"].alias("hold_type"))

    needed = ["video_id", "frame_index", "com_x", "com_y", "body_scale", "hip_center_x", "hip_center_y", "climber_height", "climber_wingspan", "climber_flexibility", *[f"{p}_{c}" for p in LIMBS for c in ("x", "y", "target_x", "target_y", "contact_on", "contact_hold")]]
    slim = stored(frames.select(*needed).withColumn("_row", F.monotonically_increasing_id()), "frames")
    held = holds.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("video_id", "hold_id").agg(F.count(F.lit(1)).alias("n"))
    need = params.candidates + len(LIMBS) * (held.agg(F.max("n")).first()[0] or 0)  # an id in contact may stand on several rows
    up_by = lambda y: F.when(y < com_y, params.upward_bias * (com_y - y)).otherwise(0.0)
    most, least = max(0.0, params.jug_bonus, params.reach_bonus), min(0.0, params.jug_bonus, params.reach_bonus)

    def bounds(b: Column) -> tuple[Column, Column]:
        """Scores in box ``b``: by its nearest and farthest point and its top and bottom. A scale that is no length bounds nothing."""
        (near, far), ups, real = near_and_far(b, *com), (up_by(b["y0"]), up_by(b["y1"])), F.col("_scale") > 0
        low = 1 / (far / F.col("_scale") + 1e-6) + F.least(*ups) + least
        up = 1 / (near / F.col("_scale") + 1e-6) + F.greatest(*ups) + most
        return F.when(real, low).otherwise(float("-inf")), F.when(real, up).otherwise(float("inf"))

    placed = settled(slim.where(F.col("com_x").isNotNull() & F.col("com_y").isNotNull()), _scale=scale(), _supports=supports)
    rows = reached(placed, hold_tree(holds, need, ("x", "y", "hold_type"), leaf, fan), ["_row"], bounds, need)
    free = F.filter("_holds", lambda h: ~F.coalesce(F.array_contains(used, h["hold_id"]), F.lit(False)))
    rows = rows.withColumn("_c", F.slice(F.array_sort(F.transform(free, sample)), 1, params.candidates))
    keep = [c for c in rows.columns if c not in ("_holds", "_c")]
    first = Window.partitionBy("_row").orderBy("c.cost", "c.hold_ord")
    rows = rows.select(*keep, F.explode("_c").alias("c")).withColumn("_order", F.row_number().over(first) - 1).where(F.col("_order") < params.candidates)  # the best of each box, then of all
    rows = stored(rows.select(*keep, "_order", F.col("c.hold_ord").alias("hold_ord"), F.col("c.hold_id").alias("hold_id"), F.col("c.x").alias("hx"), F.col("c.y").alias("hy"), F.col("c.hold_type").alias("hold_type")), "moves")
    or_com = lambda c, axis: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.col(f"com_{axis}")).otherwise(F.col(c))
    target = (F.col("hx"), F.col("hy"))

    def limb(part: str) -> Column:
        near = distance(target, (or_com(f"left_{part}_x", "x"), or_com(f"left_{part}_y", "y"))) < distance(target, (or_com(f"right_{part}_x", "x"), or_com(f"right_{part}_y", "y")))
        return F.when(~on(f"left_{part}"), f"left_{part}").when(~on(f"right_{part}"), f"right_{part}").when(near, f"left_{part}").otherwise(f"right_{part}")

    rows = settled(rows, limb=F.when(F.col("hy") < com_y - 0.1 * F.col("_scale"), limb("hand")).otherwise(limb("foot")))
    points = [tuple(F.when(F.col("limb") == p, h).otherwise(q) for h, q in zip(target, pt, strict=True)) for p, pt in zip(LIMBS, support_points(), strict=True)]
    polygon = F.filter(F.array(*[F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))) for x, y in points]), lambda q: q.isNotNull())
    rows = settled(rows, _poly=polygon)
    rows = settled(rows, _turned=F.concat(F.slice("_poly", -1, 1), F.slice("_poly", 1, F.greatest(F.size("_poly") - 1, F.lit(0)))))
    edges = F.array_min(F.zip_with("_poly", "_turned", lambda a, b: segment_distance(com, (a["x"], a["y"]), (b["x"], b["y"]))))
    rows = settled(rows, _far=F.when(point_in_polygon(com, F.col("_poly")), 0.0).otherwise(edges))
    reach, limit, off = distance((F.col("hip_center_x"), F.col("hip_center_y")), target) / F.col("_scale"), reach_limit(params), F.col("_far") / F.col("_scale")
    violations = F.array_compact(F.array(
        F.when(F.size("_poly") < params.min_support, F.concat(F.lit("low_support_count_"), F.size("_poly").cast("string"))),
        F.when(reach > limit, F.format_string("reach_exceeded_%.2f_vs_%.2f", reach, limit)), F.when(off > params.polygon_tolerance, F.format_string("com_outside_polygon_%.2f", off)),
    ))
    rows = settled(rows, violations=violations)
    stability = F.exp(-params.stability_alpha * F.col("_far") / (F.col("_scale") + 1e-6))
    rows = rows.withColumn("efficiency", F.greatest(F.lit(0.0), 0.5 * stability + 1 - 0.1 * F.size("violations")))
    rows = rows.withColumn("delta", F.col("efficiency") - 0.5 + F.coalesce(bonus(F.col("hold_type"), F.col("hy"), False), F.lit(0.0)))
    critical = F.exists("violations", lambda v: v.contains("exceeded") | v.contains("low_support"))
    frame = Window.partitionBy("_row")
    rows = rows.withColumn("_bad", critical).withColumn("_some", F.max((~F.col("_bad")).cast("int")).over(frame)).where(~F.col("_bad") | (F.col("_some") == 0))
    rows = rows.withColumn("rank", F.row_number().over(frame.orderBy(F.desc("efficiency"), "_order"))).where(F.col("rank") <= params.top_k)
    why = F.concat_ws("; ", F.when(F.col("delta") > 0, F.format_string("Improves efficiency by %.2f", F.col("delta"))), F.when(F.col("hy") < com_y, "Upward progression"), F.when(F.col("hold_type").isNotNull(), F.concat(F.lit("Hold type: "), "hold_type")), F.when(F.size("violations") == 0, "No constraint violations"))
    return rows.select("video_id", "frame_index", "rank", "limb", "hold_id", "hold_type", "efficiency", "delta", "violations", F.when(why == "", "Candidate move").otherwise(why).alias("reasoning"))


def frame_report(frames: DataFrame, holds: DataFrame, frame_index: int | None = None, k: int = 5, height: float | None = None, wingspan: float | None = None, flexibility: float | None = None) -> DataFrame:
    """Of each video the given frame, or the last one: centre, contacts, the climber and the ``k`` best holds.

    A given height, wingspan or flexibility replaces the session's."""
    for name, value in (("height", height), ("wingspan", wingspan), ("flexibility", flexibility)):
        column = f"climber_{name}"
        if value is not None or column not in frames.columns:
            frames = frames.withColumn(column, F.lit(value).cast("double"))
    if frame_index is None:
        last = F.max("frame_index").over(Window.partitionBy("video_id"))
        rows = frames.withColumn("_last", last).where(F.col("frame_index") == F.col("_last")).drop("_last")
    else:
        rows = frames.where(F.col("frame_index") == frame_index)
    best = next_holds(rows, holds, k).groupBy("video_id", "frame_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "hold_id"))), lambda b: b["hold_id"]).alias("next_holds"))
    return rows.join(stored(best, "best").hint("merge"), ["video_id", "frame_index"], "left").select("video_id", "frame_index", "com_x", "com_y", "climber_height", "climber_wingspan", "climber_flexibility", *[f"{p}_contact_hold" for p in LIMBS], "next_holds")


def hit_rate(ranked: DataFrame, frames: DataFrame, k: int = 3) -> DataFrame:
    """Share of next contact holds that were among the ``k`` best of the frame before."""
    w = Window.partitionBy("video_id").orderBy("frame_index")
    moves = frames.select("video_id", "frame_index", *[F.lead(f"{p}_contact_hold").over(w).alias(f"n_{p}") for p in LIMBS], *[F.col(f"{p}_contact_hold").alias(f"c_{p}") for p in LIMBS])
    new = F.array_compact(F.array(*[F.when(F.col(f"n_{p}").isNotNull() & ~F.col(f"n_{p}").eqNullSafe(F.col(f"c_{p}")), F.col(f"n_{p}")) for p in LIMBS]))
    moves = moves.select("video_id", "frame_index", F.explode(new).alias("hold_id"))
    top = ranked.where(F.col("rank") <= k).select("video_id", "frame_index", "hold_id", F.lit(1).alias("hit"))
    return moves.join(top.hint("merge"), ["video_id", "frame_index", "hold_id"], "left").agg(F.count(F.lit(1)).alias("moves"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("hit_rate"))
