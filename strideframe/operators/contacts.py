"""Contact states with hysteresis, technique tags, limb load and the overlay's numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strideframe.functions.blocks import by_frame, in_blocks, settled
from strideframe.functions.fold import Carried, Machine, fold
from strideframe.functions.geometry import clamp, hull_vertices
from strideframe.params import LIMBS, ContactParams

STATE = StructType([StructField("contact_on", IntegerType()), StructField("contact_type", StringType()), StructField("contact_hold", StringType())])


class ContactStep(Machine):
    """One limb's state: (on, frames since up to min_on, pending, type, hold). Inputs: limb, distance, speed, body scale, z, target."""

    def __init__(self, params: ContactParams = ContactParams()):
        self.p = params

    def entries(self):
        n = max(1, self.p.min_on)
        return [(False, 0, k, "none", None) for k in range(n)] + [(True, k, 0, Carried(3), Carried(4)) for k in range(n + 1)]

    def entry(self, state):
        on, since, pending, *_ = state
        return max(1, self.p.min_on) + since if on else pending

    def __call__(self, state, row):
        limb, dist, speed, scale, z, target = row
        p = self.p
        on, since, pending, kind, hold = state or (False, 0, 0, "none", None)
        scale = scale or 1.0
        still = speed is not None and speed <= p.v_hold * scale
        smear = "foot" in limb and dist is not None and z is not None and dist > p.smear_distance * scale and abs(z) <= p.smear_z and still
        near = dist is not None and dist <= p.r_on * scale and still
        away = dist is not None and dist >= p.r_off * scale
        if on:
            since = min(since + 1, max(1, p.min_on))
            if since >= p.min_on and away and not smear:
                on, since, pending, kind, hold = False, 0, 0, "none", None
            else:
                hold, kind = target or hold, "smear" if smear else "hold"
        elif near or smear:
            pending += 1
            if pending >= p.min_on:
                on, since, pending = True, 0, 0
                hold, kind = (None, "smear") if smear else (target, "hold")
        else:
            pending, kind, hold = 0, "none", None
        return (on, since, pending, kind, hold), (int(on), kind, hold)


def limb_rows(frames: DataFrame) -> DataFrame:
    """One row a frame and limb, from frames with nearest holds and speeds."""
    limb = F.explode(F.array(*[F.struct(F.lit(p).alias("limb"), F.col(f"{p}_distance").alias("distance"), F.col(f"{p}_speed").alias("speed"), F.col(f"{p}_z").alias("z"), F.col(f"{p}_target").alias("target")) for p in LIMBS]))
    return frames.select("video_id", "frame_index", "body_scale", limb.alias("l")).select("video_id", "frame_index", "body_scale", "l.*")


def contact_states(frames: DataFrame, params: ContactParams = ContactParams()) -> DataFrame:
    """video_id, frame_index, limb, contact_on, contact_type, contact_hold."""
    out = fold(limb_rows(frames), ["video_id", "limb"], ["frame_index"], ["limb", "distance", "speed", "body_scale", "z", "target"], STATE, ContactStep(params))
    return out.select("video_id", "frame_index", "limb", *STATE.names)


def with_contacts(frames: DataFrame, states: DataFrame) -> DataFrame:
    """Adds ``{limb}_contact_on``, ``_type``, ``_hold`` and the support count."""
    wide = states.groupBy("video_id", "frame_index").agg(*[F.max(F.when(F.col("limb") == p, F.col(c))).alias(f"{p}_{c}") for p in LIMBS for c in STATE.names])
    return frames.join(wide.hint("merge"), ["video_id", "frame_index"], "left").withColumn("support_count", support_count())


def support_count() -> Column:
    on = [F.coalesce((F.col(f"{p}_contact_on") != 0).cast("int"), F.lit(0)) for p in LIMBS]
    return sum(on[1:], on[0])


def signature() -> Column:
    return F.struct(*[F.col(f"{p}_contact_{c}") for p in LIMBS for c in ("type", "hold")])


def technique(frames: DataFrame) -> DataFrame:
    """bicycle, back_flag and drop_knee of each frame; an unknown speed counts as 0."""
    on = lambda p: F.coalesce(F.col(f"{p}_contact_on") != 0, F.lit(False))
    both = on("left_foot") & on("right_foot")
    same = F.col("left_foot_contact_hold").eqNullSafe(F.col("right_foot_contact_hold"))
    vx = lambda p: F.coalesce(F.col(f"{p}_vx"), F.lit(0.0))
    bicycle = F.when(both & same, F.greatest(F.lit(0.0), 1 - F.abs(vx("left_foot") + vx("right_foot")))).otherwise(0.0)
    side = lambda p: F.signum(F.col(f"{p}_x") - F.col("hip_center_x"))
    flag = F.when(F.coalesce((side("left_foot") == side("right_foot")) & (side("left_foot") != 0), F.lit(False)), 0.5).otherwise(0.0)
    drop = lambda s: F.least(F.lit(1.0), F.abs(F.col(f"{s}_foot_x") - F.col(f"{s}_knee_x")) / (F.abs(F.col("hip_center_x") - F.col(f"{s}_foot_x")) + 1e-6))
    knee = F.greatest(F.coalesce(drop("left"), F.lit(0.0)), F.coalesce(drop("right"), F.lit(0.0)))
    return frames.select("*", bicycle.alias("technique_bicycle"), flag.alias("technique_back_flag"), knee.alias("technique_drop_knee"))


def limb_load(frames: DataFrame) -> DataFrame:
    """``{limb}_load`` in 0 to 1, the largest scaled to 1, from contact, speed and visibility."""
    held = lambda p: F.coalesce(F.col(f"{p}_on_hold") != 0, F.lit(False)) | (F.coalesce(F.col(f"{p}_contact_on") != 0, F.lit(False)) if f"{p}_contact_on" in frames.columns else F.lit(False))
    raw = {}
    for p in LIMBS:
        base = F.when(held(p), 0.6).otherwise(0.2) + F.coalesce(F.least(F.col(f"{p}_speed") / 2.5, F.lit(0.3)), F.lit(0.0))
        raw[p] = clamp(F.greatest(base, F.coalesce(F.col(f"{p}_visibility") * 0.8, F.lit(0.0))), 0, 1)
    most = F.greatest(*raw.values())
    return frames.select("*", *[clamp(v / F.when(most == 0, 1.0).otherwise(most), 0, 1).alias(f"{p}_load") for p, v in raw.items()])


def overlay(frames: DataFrame, min_detection: float = 0.3) -> DataFrame:
    """Torso tilt and balance deviation of frames that are seen well enough."""
    seen = frames.where(F.col("detection_score") >= min_detection)
    mid = lambda part, c: (F.col(f"left_{part}_{c}") + F.col(f"right_{part}_{c}")) / 2
    angle = F.degrees(F.atan2(mid("hip", "y") - mid("shoulder", "y"), mid("hip", "x") - mid("shoulder", "x")))
    tilt = F.least(F.lit(1.0), F.abs(90 - F.abs(angle)) / 60)
    supports = F.filter(F.array(*[F.when(F.coalesce(F.col(f"{p}_on_hold") != 0, F.lit(False)), F.struct(F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"))) for p in LIMBS]), lambda q: q.isNotNull() & q["x"].isNotNull())
    out = seen.withColumn("_s", supports).withColumn("_v", F.when(F.size("_s") >= 3, hull_vertices(F.col("_s"))))
    mean = lambda c: F.aggregate("_v", F.lit(0.0), lambda a, q: a + q[c]) / F.size("_v")
    span = lambda c: F.array_max(F.transform("_v", lambda q: q[c])) - F.array_min(F.transform("_v", lambda q: q[c]))
    deviation = F.least(F.lit(1.0), F.hypot(F.col("com_x") - mean("x"), F.col("com_y") - mean("y")) / (0.25 * F.greatest(span("x"), span("y"))))
    out = out.withColumn("torso_tilt", tilt).withColumn("balance_deviation", F.when(F.size("_v") >= 3, deviation)).drop("_s", "_v")
    return out


def com_trail(frames: DataFrame, length: int = 12) -> DataFrame:
    """Of each frame with a known centre of mass the last ``length`` such points, oldest first."""
    known = settled(frames, com_x=F.col("com_x"), com_y=F.col("com_y")).where(F.col("com_x").isNotNull() & F.col("com_y").isNotNull())
    return in_blocks(known, lambda f: f.withColumn("com_trail", F.collect_list(F.struct("com_x", "com_y")).over(by_frame().rowsBetween(1 - length, 0))), length - 1)
