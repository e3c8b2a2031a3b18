"""Per-frame body features: smoothing, angles, centre of mass, scale, nearest holds, wall alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strideframe.functions.blocks import by_frame, in_blocks
from strideframe.functions.fold import Smoothing, Total, fold
from strideframe.functions.geometry import distance
from strideframe.functions.ranks import hinted
from strideframe.functions.tables import stored
from strideframe.operators.nearby import nearest
from strideframe.operators.wall import device_angle
from strideframe.params import INCLINATIONS, JOINTS, LANDMARKS, MASS, TOUCHING, TRACKED

FRAME = ["video_id", "frame_index"]
SMOOTHED = StructType([StructField(f"s_{c}", DoubleType()) for c in ("x", "y", "z", "visibility")])


def smooth(landmarks: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Exponential smoothing by landmark position; starts anew after a frame without landmarks or with another number of them.
    An unknown value is unknown until the next start."""
    per_frame = landmarks.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    broken = ~(F.lag("frame_index").over(by_frame()).eqNullSafe(F.col("frame_index") - 1) & F.lag("n").over(by_frame()).eqNullSafe(F.col("n")))
    marked = in_blocks(per_frame, lambda f: f.select(*FRAME, broken.cast("bigint").alias("_b")), 1)
    runs = fold(marked, ["video_id"], ["frame_index"], ["_b"], StructType([StructField("run", LongType())]), Total()).drop("_b")
    joined = landmarks.join(stored(runs, "runs").hint("merge"), FRAME)
    return fold(joined, ["video_id", "pos"], ["frame_index"], ["run", "x", "y", "z", "visibility"], SMOOTHED, Smoothing(alpha)).drop("run")


def detection_score(landmarks: DataFrame, visibility: str = "visibility") -> DataFrame:
    return landmarks.groupBy(*FRAME).agg(F.coalesce(F.avg(visibility), F.lit(0.0)).alias("detection_score"))


def pivot(landmarks: DataFrame) -> DataFrame:
    """One row a frame: ``{name}_x``, ``_y``, ``_z``, ``_visibility`` (of repeated names the last), score and count."""
    point = F.struct("x", "y", "z", "visibility")
    named = [F.max_by(point, F.when(F.col("name") == n, F.col("pos"))).alias(n) for n in LANDMARKS]
    rows = landmarks.groupBy(*FRAME).agg(F.min("ts").alias("ts"), F.coalesce(F.avg("visibility"), F.lit(0.0)).alias("detection_score"), F.count(F.lit(1)).alias("landmark_count"), *named)
    return rows.select(*FRAME, "ts", "detection_score", "landmark_count", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in LANDMARKS for c in ("x", "y", "z", "visibility")])


def visible(frames: DataFrame, least: float = 0.2) -> DataFrame:
    """Pivoted frames without the places of landmarks that are seen less well; what is not known to be seen counts as seen."""
    hidden = lambda n: F.coalesce(F.col(f"{n}_visibility") < least, F.lit(False))
    return frames.withColumns({f"{n}_{c}": F.when(~hidden(n), F.col(f"{n}_{c}")) for n in LANDMARKS for c in "xyz"})


def _at(name: str) -> list[Column]:
    return [F.col(f"{name}_{c}") for c in "xyz"]


def joint_angle(a: str, b: str, c: str) -> Column:
    """Degrees at b; null if a point is missing or a side has no length."""
    u = [p - q for p, q in zip(_at(a), _at(b), strict=True)]
    v = [p - q for p, q in zip(_at(c), _at(b), strict=True)]
    dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
    nu, nv = F.sqrt(dot(u, u)), F.sqrt(dot(v, v))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (nu * nv)))
    return F.when((nu >= 1e-6) & (nv >= 1e-6), F.degrees(F.acos(cosine)))


def inclination(a: str, b: str) -> Column:
    dx, dy = F.col(f"{b}_x") - F.col(f"{a}_x"), F.col(f"{b}_y") - F.col(f"{a}_y")
    return F.when(~((F.abs(dx) < 1e-6) & (F.abs(dy) < 1e-6)), F.degrees(F.atan2(dy, dx)))


def centre_of_mass(axis: str) -> Column:
    there = [F.when(F.col(f"{n}_{axis}").isNotNull(), F.lit(w)) for n, w in MASS.items()]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in there[1:]), F.coalesce(there[0], F.lit(0.0)))
    parts = [F.coalesce(F.col(f"{n}_{axis}") * w, F.lit(0.0)) for n, w in MASS.items()]
    return F.when(total > 0, sum(parts[1:], parts[0]) / total)


def body_features(frames: DataFrame, sessions: DataFrame | None = None, wall_angle: Column | None = None) -> DataFrame:
    """Angles, inclinations, centre of mass, tracked limbs, scale, hips and wall alignment of pivoted frames.

    ``sessions`` (video_id, climber_height, climber_wingspan, climber_flexibility, ...) is one row a video."""
    if sessions is not None:
        frames = frames.join(hinted(sessions), "video_id", "left")
    height = F.col("climber_height") if sessions is not None else F.lit(None).cast("double")
    present = sum((F.col(f"{n}_x").isNotNull().cast("int") for n in LANDMARKS[1:]), F.col(f"{LANDMARKS[0]}_x").isNotNull().cast("int"))
    out = frames.select(
        "*",
        *[joint_angle(*j).alias(name) for name, j in JOINTS.items()],
        *[inclination(*i).alias(name) for name, i in INCLINATIONS.items()],
        centre_of_mass("x").alias("com_x"), centre_of_mass("y").alias("com_y"), present.alias("com_n"),
        *[F.col(f"{n}_{c}").alias(f"{limb}_{c}") for limb, n in TRACKED.items() if limb != n for c in ("x", "y", "z", "visibility")],
        distance((F.col("left_shoulder_x"), F.col("left_shoulder_y")), (F.col("right_shoulder_x"), F.col("right_shoulder_y"))).alias("body_scale"),
        ((F.col("left_hip_x") + F.col("right_hip_x")) / 2).alias("hip_center_x"), ((F.col("left_hip_y") + F.col("right_hip_y")) / 2).alias("hip_center_y"),
    )
    out = out.withColumn("body_scale_normalized", F.col("body_scale") * 170.0 / height)
    return out if wall_angle is None else wall_alignment(out, wall_angle)


def resolve_wall_angle(given: Column, quaternion: Column, angles: Column, seen: Column) -> Column:
    """The given angle, else the device's (from its quaternion or else its pitch, roll and yaw), else the one seen in the image."""
    return F.coalesce(given, device_angle(quaternion, angles)[0], seen)


def wall_alignment(frames: DataFrame, wall_angle: Column) -> DataFrame:
    d = F.abs(F.col("hip_line_inclination") - wall_angle) % 180
    r = F.radians(wall_angle)
    return frames.select(
        "*", F.least(d, 180 - d).alias("hip_alignment_error"),
        (F.col("com_x") * F.cos(r) + F.col("com_y") * F.sin(r)).alias("com_along_wall"),
        (-F.col("com_x") * F.sin(r) + F.col("com_y") * F.cos(r)).alias("com_perp_wall"),
    )


def nearest_holds(frames: DataFrame, holds: DataFrame, threshold: float = 0.05) -> DataFrame:
    """For each limb: target, distance, target_x, target_y, on_hold; ties go to the earlier hold. Frames are stored once; their limbs look for holds in a grid."""
    kept = stored(frames.withColumn("_row", F.monotonically_increasing_id()), "frames")
    limbs = F.explode(F.array(*[F.struct(F.lit(p).alias("limb"), F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for p, n in TOUCHING.items()])).alias("l")
    found = nearest(kept.select("video_id", "_row", limbs).select("video_id", "_row", "l.*"), holds, ["_row", "limb"])
    best = F.struct("hold_id", "d", "hx", "hy")
    wide = stored(found.groupBy("_row").agg(*[F.max(F.when(F.col("limb") == p, best)).alias(p) for p in TOUCHING]), "targets")
    new = [
        x for p in TOUCHING for x in (
            F.col(f"{p}.hold_id").alias(f"{p}_target"), F.col(f"{p}.d").alias(f"{p}_distance"), F.col(f"{p}.hx").alias(f"{p}_target_x"), F.col(f"{p}.hy").alias(f"{p}_target_y"),
            F.coalesce((F.col(f"{p}.d") <= threshold).cast("int"), F.lit(0)).alias(f"{p}_on_hold"),
        )
    ]
    return kept.join(wide.hint("merge"), "_row", "left").select(*frames.columns, *new)
