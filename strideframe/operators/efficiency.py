"""Step efficiency: components of each frame, step scores, bands, and the five-part score of recent frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.geometry import hull_distance
from strideframe.operators.segments import within
from strideframe.functions.blocks import by_frame, in_blocks
from strideframe.params import JOINTS, LIMBS, StepWeights



def scale() -> Column:
    return F.when(F.coalesce(F.col("body_scale"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("body_scale"))


def support_points() -> list[tuple[Column, Column]]:
    """Of each limb in contact its target, else itself; null otherwise."""
    out = []
    for p in LIMBS:
        on = F.coalesce(F.col(f"{p}_contact_on") != 0, F.lit(False))
        aimed = F.col(f"{p}_target_x").isNotNull() & F.col(f"{p}_target_y").isNotNull()
        out.append(tuple(F.when(on, F.when(aimed, F.col(f"{p}_target_{c}")).otherwise(F.col(f"{p}_{c}"))) for c in "xy"))
    return out


def frame_components(frames: DataFrame, weights: StepWeights = StepWeights(), wall_reference: float = 0.0) -> DataFrame:
    """stability, wall, smoothness and reach penalties, technique bonus and support points of each frame."""
    points = support_points()
    n = sum(((x.isNotNull() & y.isNotNull()).cast("int") for x, y in points[1:]), (points[0][0].isNotNull() & points[0][1].isNotNull()).cast("int"))
    dist = hull_distance((F.col("com_x"), F.col("com_y")), points)
    stability = F.when((n > 0) & F.col("com_x").isNotNull() & F.col("com_y").isNotNull(), F.exp(-weights.stability_alpha * dist / (scale() + 1e-6))).otherwise(0.0)
    reach = F.greatest(*[F.hypot(F.col(f"{p}_x") - F.col("hip_center_x"), F.col(f"{p}_y") - F.col("hip_center_y")) for p in LIMBS]) / scale()
    limit = weights.reach_threshold * (F.lit(1.0) + F.coalesce(0.05 + 0.05 * F.col("climber_flexibility"), F.lit(0.0)))
    bonus = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in frames.columns else F.lit(0.0)
    return frames.select(
        "*", n.alias("support_points"), stability.alias("stability"), F.greatest(F.lit(0.0), F.coalesce(F.col("com_perp_wall") - wall_reference, F.lit(0.0))).alias("wall_penalty"),
        F.coalesce(F.col("com_jerk") / (scale() + 1e-6), F.lit(0.0)).alias("jerk_penalty"), F.greatest(F.lit(0.0), F.coalesce(reach - limit, F.lit(0.0))).alias("reach_penalty"),
        (0.05 * bonus("technique_bicycle") + 0.05 * bonus("technique_back_flag") + 0.03 * bonus("technique_drop_knee")).alias("technique_bonus"),
    )


def step_scores(frames: DataFrame, steps: DataFrame, weights: StepWeights = StepWeights(), key: str = "step_id") -> DataFrame:
    """score and its means for every step of every video; not clamped. ``frames`` with contacts, derivatives and alignment."""
    by = Window.partitionBy("video_id", key).orderBy("frame_index")
    rows = within(frame_components(frames, weights), steps, key)
    changed = [(~F.struct(f"{p}_contact_type", f"{p}_contact_hold").eqNullSafe(F.lag(F.struct(f"{p}_contact_type", f"{p}_contact_hold")).over(by))).cast("int") for p in LIMBS]
    switches = F.when(F.row_number().over(by) > 1, sum(changed[1:], changed[0])).otherwise(0)
    com = F.col("com_x").isNotNull() & F.col("com_y").isNotNull()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    hop = F.when(com, F.hypot(F.col("com_x") - F.last(F.when(com, F.col("com_x")), True).over(before), F.col("com_y") - F.last(F.when(com, F.col("com_y")), True).over(before)))
    rows = rows.select("*", hop.alias("_hop"), (F.when(F.col("support_points") < 2, 1.0).otherwise(0.0) + 0.1 * switches).alias("support_penalty"))
    point, frame = F.struct("com_x", "com_y"), F.when(com, F.col("frame_index"))
    means = ("stability", "support_penalty", "wall_penalty", "jerk_penalty", "reach_penalty", "technique_bonus")
    out = rows.groupBy("video_id", key).agg(*[F.avg(c).alias(c) for c in means], F.sum("_hop").alias("_path"), F.count(frame).alias("_n"), F.min_by(point, frame).alias("_a"), F.max_by(point, frame).alias("_b"))
    net = F.hypot(F.col("_b.com_x") - F.col("_a.com_x"), F.col("_b.com_y") - F.col("_a.com_y"))
    out = out.withColumn("path_efficiency", F.when(F.col("_n") >= 2, net / (F.coalesce("_path", F.lit(0.0)) + 1e-6)).otherwise(0.0))
    score = weights.stability * F.col("stability") + weights.path * F.col("path_efficiency") - (weights.support * F.col("support_penalty") + weights.wall * F.col("wall_penalty") + weights.smoothness * F.col("jerk_penalty") + weights.reach * F.col("reach_penalty")) + F.col("technique_bonus")
    out = out.withColumn("score", score).withColumn("band", band(F.col("score")))
    return out.drop("_path", "_n", "_a", "_b")


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "moderate").when(score >= 0.2, "poor").otherwise("very_poor")


def rolling_score(frames: DataFrame, window: int = 5) -> DataFrame:
    """Adds the five parts and the score over each frame and the ``window - 1`` before it."""
    last, pairs = by_frame().rowsBetween(1 - window, 0), by_frame().rowsBetween(2 - window, 0)
    bend = [F.abs(F.col(j)) for j in JOINTS]
    joints = sum((F.coalesce(b, F.lit(0.0)) for b in bend[1:]), F.coalesce(bend[0], F.lit(0.0)))
    known = sum((b.isNotNull().cast("int") for b in bend[1:]), bend[0].isNotNull().cast("int"))
    same = [F.col(f"{p}_target").eqNullSafe(F.lag(f"{p}_target").over(by_frame())).cast("int") for p in LIMBS]

    def scored(rows: DataFrame) -> DataFrame:
        later = F.row_number().over(by_frame()) > 1
        rows = rows.select("*", joints.alias("_j"), known.alias("_jn"), F.when(later, sum(same[1:], same[0])).alias("_same"), F.when(later, F.lit(len(LIMBS))).alias("_all"))
        spread = F.var_pop("com_perp_wall").over(last)
        contact = F.sum("_same").over(pairs) / F.sum("_all").over(pairs) if window > 1 else F.lit(None).cast("double")
        return rows.select(
            "*", F.coalesce(F.avg("detection_score").over(last), F.lit(0.0)).alias("detection"), F.coalesce(1 - F.sum("_j").over(last) / (F.sum("_jn").over(last) * 180.0), F.lit(0.5)).alias("joint"),
            F.when(F.count("com_perp_wall").over(last) >= 2, 1 / (1 + spread / F.greatest(spread, F.lit(1e-6)))).otherwise(0.5).alias("com"), F.coalesce(contact, F.lit(0.5)).alias("contact"),
            F.coalesce(1 - F.col("hip_alignment_error") / 90.0, F.lit(0.5)).alias("hip"),
        ).drop("_j", "_jn", "_same", "_all")

    return in_blocks(frames, scored, max(1, window - 1)).withColumn("score", five_parts())


def five_parts() -> Column:
    return 0.3 * F.col("detection") + 0.2 * F.col("joint") + 0.2 * F.col("com") + 0.2 * F.col("contact") + 0.1 * F.col("hip")


def recent_score(frames: DataFrame, window: int = 5) -> DataFrame:
    """The five-part score of each video's last ``window`` frames."""
    back = Window.partitionBy("video_id").orderBy(F.desc("frame_index"))
    rows = frames.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= window)
    bend = [F.abs(F.col(j)) for j in JOINTS]
    joints = sum((F.coalesce(b, F.lit(0.0)) for b in bend[1:]), F.coalesce(bend[0], F.lit(0.0)))
    known = sum((b.isNotNull().cast("int") for b in bend[1:]), bend[0].isNotNull().cast("int"))
    same = [F.col(f"{p}_target").eqNullSafe(F.lag(f"{p}_target").over(by_frame())).cast("int") for p in LIMBS]
    later = F.row_number().over(by_frame()) > 1
    rows = rows.select("*", joints.alias("_j"), known.alias("_jn"), F.when(later, sum(same[1:], same[0])).alias("_same"), F.when(later, F.lit(len(LIMBS))).alias("_all"))
    spread = F.var_pop("com_perp_wall")
    out = rows.groupBy("video_id").agg(
        F.coalesce(F.avg("detection_score"), F.lit(0.0)).alias("detection"), F.coalesce(1 - F.sum("_j") / (F.sum("_jn") * 180.0), F.lit(0.5)).alias("joint"),
        F.when(F.count("com_perp_wall") >= 2, 1 / (1 + spread / F.greatest(spread, F.lit(1e-6)))).otherwise(0.5).alias("com"),
        F.coalesce(F.sum("_same") / F.sum("_all"), F.lit(0.5)).alias("contact"), F.coalesce(1 - F.max_by("hip_alignment_error", "frame_index") / 90.0, F.lit(0.5)).alias("hip"),
    )
    return out.withColumn("score", five_parts())
