"""Wall angle from line segments, points and orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_angle(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines and the circular mean of their angles in [0, 180); lines without length are skipped. Lines: x1, y1, x2, y2."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.radians(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)))
    some = lines.where((dx != 0) | (dy != 0))
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.pmod(F.degrees(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))), F.lit(180.0)).alias("line_angle"))


def principal_axis(points: DataFrame, keys: list[str]) -> DataFrame:
    """axis_angle of at least three points, from their covariances."""
    out = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), (0.5 * F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y"))).alias("_a"))
    return out.select(*keys, "points", F.when(F.col("points") >= 3, F.pmod(F.degrees("_a"), F.lit(180.0))).alias("axis_angle"))


def fuse(line: Column, axis: Column, lines: Column) -> tuple[Column, Column, Column]:
    """Angle, confidence and method."""
    agree = F.abs(line - axis) < 15
    both, one = line.isNotNull() & axis.isNotNull(), line.isNotNull()
    angle = F.when(both & agree, (line + axis) / 2).when(one, line).otherwise(axis)
    confidence = F.when(both & agree, 0.9).when(both, 0.6).when(one & (lines >= 5), 0.7).when(one, 0.5).when(axis.isNotNull(), 0.4).otherwise(0.0)
    method = F.when(both & agree, "hough+pca").when(one, "hough").when(axis.isNotNull(), "pca").otherwise("none")
    return angle, confidence, method


def euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Pitch, roll and yaw in degrees of a quaternion."""
    sine = 2 * (w * y - z * x)
    pitch = F.when(F.abs(sine) >= 1, F.signum(sine) * 90.0).otherwise(F.degrees(F.asin(sine)))
    return pitch, F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def device_angle(quaternion: Column, angles: Column) -> tuple[Column, Column, Column]:
    """Angle, confidence and method from a device's quaternion (w, x, y, z), else its euler angles (pitch, roll, yaw)."""
    has_q, has_e = quaternion.isNotNull(), angles.isNotNull()
    ok_q, ok_e = F.coalesce(F.size(quaternion) == 4, F.lit(False)), F.coalesce(F.size(angles) == 3, F.lit(False))
    q = [F.get(quaternion, F.lit(i)) for i in range(4)]
    pitch, roll, _ = euler(*q)
    pitch = F.when(has_q & ok_q, pitch).when(~has_q & ok_e, F.get(angles, F.lit(0)))
    roll = F.when(has_q & ok_q, roll).when(~has_q & ok_e, F.get(angles, F.lit(1)))
    method = F.when(has_q, F.when(ok_q, "imu_sensor").otherwise("imu_error")).when(has_e, F.when(ok_e, "imu_sensor").otherwise("imu_error")).otherwise("imu_missing")
    return F.when(pitch.isNotNull(), F.least(F.abs(pitch), F.lit(180.0))), F.when(pitch.isNull(), 0.0).when(F.abs(roll) > 45, 0.7).otherwise(1.0), method
