"""Velocity, acceleration, jerk and the derived per-frame series. All lags share one shuffle and sort, by blocks of a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.blocks import by_frame, in_blocks
from strideframe.params import LIMBS


def derivatives(frames: DataFrame, fps: float | Column = 25.0, points: tuple[str, ...] = ("com", *LIMBS)) -> DataFrame:
    """vx, vy, speed, ax, ay, accel, jx, jy, jerk of each point ``{p}_x, {p}_y``; null where a side is null."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))

    def lags(out: DataFrame) -> DataFrame:
        for old, new in (("{p}_{c}", "{p}_v{c}"), ("{p}_v{c}", "{p}_a{c}"), ("{p}_a{c}", "{p}_j{c}")):
            out = out.select("*", *[((F.col(old.format(p=p, c=c)) - F.lag(old.format(p=p, c=c)).over(by_frame())) * rate).alias(new.format(p=p, c=c)) for p in points for c in "xy"])
        return out

    size = lambda p, k: F.hypot(F.col(f"{p}_{k}x"), F.col(f"{p}_{k}y"))
    return in_blocks(frames, lags, 3).select("*", *[size(p, k).alias(f"{p}_{name}") for p in points for k, name in (("v", "speed"), ("a", "accel"), ("j", "jerk"))])


SELECTOR_JOINTS = ("left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist")


def selector_kinematics(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Velocity and acceleration of the six upper-body joints; zero where the point before is missing."""
    cols = [f"{j}_{c}" for j in SELECTOR_JOINTS for c in "xy"]
    there = F.row_number().over(by_frame()) > 1

    def lags(rows: DataFrame) -> DataFrame:
        out = rows.select("*", *[F.coalesce((F.col(c) - F.lag(c).over(by_frame())) * fps, F.lit(0.0)).alias(f"{c}_vel") for c in cols])
        return out.select("*", *[F.when(there & F.col(c).isNotNull(), (F.col(f"{c}_vel") - F.lag(f"{c}_vel", 1, 0.0).over(by_frame())) * fps).otherwise(0.0).alias(f"{c}_acc") for c in cols])

    return in_blocks(frames, lags, 2)


def first_hold_distances(frames: DataFrame, holds: DataFrame, n: int = 4) -> DataFrame:
    """Distance of each wrist to the first ``n`` holds in list order, padded with zero; a missing wrist counts as (0, 0)."""
    w = Window.partitionBy("video_id").orderBy("hold_ord")
    first = holds.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") < n).groupBy("video_id")
    lists = first.agg(*[F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"_h{k}{c}") for k in range(n) for c in "xy"])
    out = frames.join(lists.hint("merge"), "video_id", "left")
    far = lambda side, k: F.hypot(F.coalesce(F.col(f"{side}_wrist_x"), F.lit(0.0)) - F.col(f"_h{k}x"), F.coalesce(F.col(f"{side}_wrist_y"), F.lit(0.0)) - F.col(f"_h{k}y"))
    out = out.select("*", *[F.coalesce(far(side, k), F.lit(0.0)).alias(f"{side}_hold_{k}") for side in ("left", "right") for k in range(n)])
    return out.drop(*[f"_h{k}{c}" for k in range(n) for c in "xy"])


def normalise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, floor: float = 1e-8, add: bool = False) -> DataFrame:
    """Z-scores by population deviation fitted on ``fit_on``; one below ``floor`` counts as 1 (``add``: is added ``floor`` instead)."""
    stats = (fit_on if fit_on is not None else df).agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    spread = lambda c: F.col(f"_s_{c}") + floor if add else F.when(F.col(f"_s_{c}") < floor, 1.0).otherwise(F.col(f"_s_{c}"))
    joined = df.join(F.broadcast(stats))  # one row
    return joined.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"_m_{c}")) / spread(c)).alias(c) for c in columns])


def simple_contact(frames: DataFrame, fps: float = 30.0, speed: float = 0.05, visibility: float = 0.5) -> DataFrame:
    """Speed of each limb, and contact where it is slow and seen; an unknown speed is no contact."""
    out = derivatives(frames, fps, LIMBS)
    return out.select("*", *[(F.coalesce(F.col(f"{p}_speed") < speed, F.lit(False)) & (F.col(f"{p}_visibility") > visibility)).cast("int").alias(f"{p}_simple_contact") for p in LIMBS])
