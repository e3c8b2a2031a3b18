"""Queries over frames: features, kinematics, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators import contacts, features, kinematics
from strideframe.params import INCLINATIONS, JOINTS, LANDMARKS, LIMBS, MASS, TOUCHING, TRACKED, ContactParams
from strideframe.plans import fixtures as fx
from strideframe.plans.fixtures import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def frames(spark, sf_dir):
    return features.pivot(fx.landmarks(spark, sf_dir))


def bodies(spark, sf_dir):
    return features.body_features(frames(spark, sf_dir), fx.sessions(spark, sf_dir), F.lit(95.0))


def moving(spark, sf_dir):
    """Features with nearest holds and derivatives: one shuffle by video and frame for the pivot, one by video."""
    return kinematics.derivatives(features.nearest_holds(bodies(spark, sf_dir), fx.holds(spark, sf_dir)))


#: Contact parameters under which the views' limbs do touch holds (FIXTURES.md).
TOUCHY = ContactParams(v_hold=1.0, min_on=2)


def contacted(spark, sf_dir):
    slow = kinematics.derivatives(features.nearest_holds(bodies(spark, sf_dir), fx.holds(spark, sf_dir)), 1.0)
    return contacts.with_contacts(slow, contacts.contact_states(slow, TOUCHY))


COM = {c: "(" + " + ".join(f"{w} * {n}_{c}" for n, w in MASS.items()) + ")::DOUBLE / " + f"({' + '.join(str(w) for w in MASS.values())})::DOUBLE" for c in "xy"}
ANGLE = "degrees(acos(greatest(-1, least(1, (({a}_x-{b}_x)*({c}_x-{b}_x)+({a}_y-{b}_y)*({c}_y-{b}_y)+({a}_z-{b}_z)*({c}_z-{b}_z)) / (sqrt(({a}_x-{b}_x)**2+({a}_y-{b}_y)**2+({a}_z-{b}_z)**2) * sqrt(({c}_x-{b}_x)**2+({c}_y-{b}_y)**2+({c}_z-{b}_z)**2))))))"
BODY = (
    "SELECT *, abs(hip_line_inclination - 95) % 180 AS _d, com_x * cos(radians(95)) + com_y * sin(radians(95)) AS com_along_wall, -com_x * sin(radians(95)) + com_y * cos(radians(95)) AS com_perp_wall, body_scale * 170 / climber_height AS body_scale_normalized FROM (SELECT wide.*, climber_height, climber_wingspan, climber_flexibility, "
    + ", ".join([ANGLE.format(a=a, b=b, c=c) + f" AS {n}" for n, (a, b, c) in JOINTS.items()] + [f"degrees(atan2({b}_y - {a}_y, {b}_x - {a}_x)) AS {n}" for n, (a, b) in INCLINATIONS.items()])
    + f", {COM['x']} AS com_x, {COM['y']} AS com_y, 14 AS com_n, " + ", ".join(f"{n}_{c} AS {limb}_{c}" for limb, n in TRACKED.items() if limb != n for c in ("x", "y", "z", "visibility"))
    + ", sqrt((left_shoulder_x - right_shoulder_x)**2 + (left_shoulder_y - right_shoulder_y)**2) AS body_scale, (left_hip_x + right_hip_x) / 2 AS hip_center_x, (left_hip_y + right_hip_y) / 2 AS hip_center_y FROM wide LEFT JOIN sessions USING (video_id))"
)
fx.CTE["body"] = BODY
BASE = "pose_frames landmarks wide sessions body"
W = "OVER (PARTITION BY video_id ORDER BY frame_index)"


@query("com_speed", sql(BASE, f"SELECT video_id, round(avg(speed), 6) AS mean_com_speed, count(*) AS frames FROM (SELECT video_id, sqrt(((com_x - lag(com_x) {W}) * 25)**2 + ((com_y - lag(com_y) {W}) * 25)**2) AS speed FROM body) GROUP BY video_id"))
def com_speed(spark, sf_dir):
    """Mean speed of the centre of mass of each video."""
    d = kinematics.derivatives(features.body_features(frames(spark, sf_dir)), points=("com",))
    return d.groupBy("video_id").agg(F.round(F.avg("com_speed"), 6).alias("mean_com_speed"), F.count(F.lit(1)).alias("frames"))


FEATURES = ["detection_score", *JOINTS, *INCLINATIONS, "com_x", "com_y", *[f"{p}_{c}" for p in LIMBS for c in ("x", "y", "z", "visibility")], "body_scale", "body_scale_normalized", "hip_center_x", "hip_center_y", "com_along_wall", "com_perp_wall", "climber_height", "climber_wingspan", "climber_flexibility"]


@query("frame_features", sql(BASE, "SELECT video_id, frame_index, landmark_count, com_n, round(least(_d, 180 - _d), 6) AS hip_alignment_error, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM body"))
def frame_features(spark, sf_dir):
    """P2 to P9, P12 to P14."""
    return rounded(bodies(spark, sf_dir).withColumn("com_n", F.col("com_n")).select("video_id", "frame_index", "landmark_count", "com_n", "hip_alignment_error", *FEATURES))


@query("ema_smoothing", sql("pose_frames landmarks", """, series AS (SELECT video_id, pos, frame_index, x, y, z, visibility FROM landmarks), ema AS (
  SELECT video_id, pos, frame_index, x, y, z, visibility FROM series WHERE frame_index = 0
  UNION ALL SELECT s.video_id, s.pos, s.frame_index, 0.6::DOUBLE * s.x + 0.4::DOUBLE * e.x, 0.6::DOUBLE * s.y + 0.4::DOUBLE * e.y, 0.6::DOUBLE * s.z + 0.4::DOUBLE * e.z, 0.6::DOUBLE * s.visibility + 0.4::DOUBLE * e.visibility
  FROM ema e JOIN series s ON s.video_id = e.video_id AND s.pos = e.pos AND s.frame_index = e.frame_index + 1)
SELECT video_id, frame_index, pos, round(x, 6) AS s_x, round(y, 6) AS s_y, round(z, 6) AS s_z, round(visibility, 6) AS s_visibility FROM ema"""))
def ema_smoothing(spark, sf_dir):
    """P1."""
    return rounded(features.smooth(fx.landmarks(spark, sf_dir)).select("video_id", "frame_index", "pos", "s_x", "s_y", "s_z", "s_visibility"))


POINTS = ("com", *LIMBS)
LAGS = (
    ", v AS (SELECT *, " + ", ".join(f"({p}_{c} - lag({p}_{c}) {W}) * 25 AS {p}_v{c}" for p in POINTS for c in "xy") + " FROM body)"
    + ", a AS (SELECT *, " + ", ".join(f"({p}_v{c} - lag({p}_v{c}) {W}) * 25 AS {p}_a{c}" for p in POINTS for c in "xy") + " FROM v)"
    + ", j AS (SELECT *, " + ", ".join(f"({p}_a{c} - lag({p}_a{c}) {W}) * 25 AS {p}_j{c}" for p in POINTS for c in "xy") + " FROM a)"
)


@query("kinematics", sql(BASE, LAGS + " SELECT video_id, frame_index, " + ", ".join(f"round({p}_v{c}, 6) AS {p}_v{c}" for p in POINTS for c in "xy") + ", " + ", ".join(f"round(sqrt({p}_{k}x**2 + {p}_{k}y**2), 4) AS {p}_{n}" for p in POINTS for k, n in (("v", "speed"), ("a", "accel"), ("j", "jerk"))) + " FROM j"))
def kinematics_query(spark, sf_dir):
    """K1 to K3."""
    d = kinematics.derivatives(bodies(spark, sf_dir))
    return d.select("video_id", "frame_index", *[F.round(f"{p}_v{c}", 6).alias(f"{p}_v{c}") for p in POINTS for c in "xy"], *[F.round(f"{p}_{n}", 4).alias(f"{p}_{n}") for p in POINTS for n in ("speed", "accel", "jerk")])


SEL = [f"{j}_{c}" for j in kinematics.SELECTOR_JOINTS for c in "xy"]


@query("selector_features", sql(BASE + " holds", ", v AS (SELECT *, " + ", ".join(f"coalesce(({c} - lag({c}) {W}) * 30, 0) AS {c}_vel" for c in SEL) + " FROM body), h AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY hold_ord) - 1 AS k FROM holds), f AS (SELECT v.video_id, v.frame_index, "
  + ", ".join([f"max({c}_vel) AS {c}_vel" for c in SEL] + [f"max({c}_acc) AS {c}_acc" for c in SEL] + [f"coalesce(max(sqrt(({s}_wrist_x - h.x)**2 + ({s}_wrist_y - h.y)**2)) FILTER (k = {k}), 0) AS {s}_hold_{k}" for s in ("left", "right") for k in range(4)])
  + " FROM (SELECT *, " + ", ".join(f"CASE WHEN frame_index > 0 THEN ({c}_vel - lag({c}_vel) {W}) * 30 ELSE 0 END AS {c}_acc" for c in SEL) + " FROM v) v LEFT JOIN h ON h.video_id = v.video_id AND k < 4 GROUP BY v.video_id, v.frame_index)"
  + " SELECT video_id, frame_index, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in [f"{c}_vel" for c in SEL] + [f"{c}_acc" for c in SEL] + [f"{s}_hold_{k}" for s in ("left", "right") for k in range(4)]) + " FROM f"))
def selector_features(spark, sf_dir):
    """K4 to K6."""
    d = kinematics.first_hold_distances(kinematics.selector_kinematics(frames(spark, sf_dir)), fx.holds(spark, sf_dir))
    cols = [f"{c}_vel" for c in SEL] + [f"{c}_acc" for c in SEL] + [f"{s}_hold_{k}" for s in ("left", "right") for k in range(4)]
    return rounded(kinematics.normalise(d.select("video_id", "frame_index", *cols), cols))


NEAR = ", ".join(f"arg_min(h.hold_id, (sqrt((h.x - {n}_x)**2 + (h.y - {n}_y)**2), hold_ord)) AS {p}_target, min(sqrt((h.x - {n}_x)**2 + (h.y - {n}_y)**2)) AS {p}_distance, arg_min(h.x, (sqrt((h.x - {n}_x)**2 + (h.y - {n}_y)**2), hold_ord)) AS {p}_target_x, arg_min(h.y, (sqrt((h.x - {n}_x)**2 + (h.y - {n}_y)**2), hold_ord)) AS {p}_target_y" for p, n in TOUCHING.items())
fx.CTE["near"] = f"SELECT b.video_id, b.frame_index, {NEAR} FROM body b JOIN holds h ON h.video_id = b.video_id GROUP BY b.video_id, b.frame_index"
NEARED = BASE + " holds near"


@query("nearest_hold", sql(NEARED, "SELECT video_id, frame_index, " + ", ".join(f"{p}_target, round({p}_distance, 6) AS {p}_distance, round({p}_target_x, 6) AS {p}_target_x, round({p}_target_y, 6) AS {p}_target_y, CASE WHEN {p}_distance <= 0.05 THEN 1 ELSE 0 END AS {p}_on_hold" for p in LIMBS) + " FROM near"))
def nearest_hold(spark, sf_dir):
    """P10, P11."""
    out = features.nearest_holds(bodies(spark, sf_dir), fx.holds(spark, sf_dir))
    return rounded(out.select("video_id", "frame_index", *[f"{p}_{c}" for p in LIMBS for c in ("target", "distance", "target_x", "target_y", "on_hold")]))


@query("simple_contact", sql(BASE, "SELECT video_id, frame_index, " + ", ".join(f"CASE WHEN sqrt((({p}_x - lag({p}_x) {W}) * 30)**2 + (({p}_y - lag({p}_y) {W}) * 30)**2) < 0.05 AND {p}_visibility > 0.5 THEN 1 ELSE 0 END AS {p}_simple_contact, round(sqrt((({p}_x - lag({p}_x) {W}) * 30)**2 + (({p}_y - lag({p}_y) {W}) * 30)**2), 6) AS {p}_speed" for p in LIMBS) + " FROM body"))
def simple_contact(spark, sf_dir):
    """K7."""
    return rounded(kinematics.simple_contact(bodies(spark, sf_dir)).select("video_id", "frame_index", *[f"{p}_{c}" for p in LIMBS for c in ("simple_contact", "speed")]))


@query("contact_states")
def contact_states(spark, sf_dir):
    """Hysteresis with smears; a state machine, held against plain Python in the tests."""
    return contacted(spark, sf_dir).select("video_id", "frame_index", "support_count", *[f"{p}_contact_{c}" for p in LIMBS for c in ("on", "type", "hold")])


@query("technique")
def technique(spark, sf_dir):
    """C4 on inferred contacts."""
    return rounded(contacts.technique(contacted(spark, sf_dir)).select("video_id", "frame_index", "technique_bicycle", "technique_back_flag", "technique_drop_knee"))


RAW_LOAD = {p: f"least(1, greatest(0, greatest(CASE WHEN {p}_distance <= 0.05 THEN 0.6 ELSE 0.2 END::DOUBLE + coalesce(least(sqrt({p}_vx**2 + {p}_vy**2) / 2.5, 0.3::DOUBLE), 0), coalesce({p}_visibility * 0.8, 0))))" for p in LIMBS}


@query("limb_load", sql(NEARED, LAGS + ", r AS (SELECT video_id, frame_index, " + ", ".join(f"{v} AS {p}" for p, v in RAW_LOAD.items()) + " FROM v JOIN near USING (video_id, frame_index)) SELECT video_id, frame_index, " + ", ".join(f"round({p} / greatest({', '.join(LIMBS)}), 6) AS {p}_load" for p in LIMBS) + " FROM r"))
def limb_load(spark, sf_dir):
    """C5."""
    return rounded(contacts.limb_load(moving(spark, sf_dir)).select("video_id", "frame_index", *[f"{p}_load" for p in LIMBS]))


@query("overlay")
def overlay(spark, sf_dir):
    """Tilt and balance of well seen frames; supports are limbs within 0.15 of a hold."""
    wide = features.nearest_holds(bodies(spark, sf_dir), fx.holds(spark, sf_dir), 0.15)
    return rounded(contacts.overlay(wide).select("video_id", "frame_index", "torso_tilt", "balance_deviation"))


@query("com_trail", sql(BASE, f"SELECT video_id, frame_index, count(*) OVER w AS trail_length, round(sum(com_x) OVER w, 6) AS trail_x, round(sum(com_y) OVER w, 6) AS trail_y FROM body WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"))
def com_trail(spark, sf_dir):
    """C8, as the length and the sums of the trail."""
    out = contacts.com_trail(bodies(spark, sf_dir))
    total = lambda c: F.round(F.aggregate("com_trail", F.lit(0.0), lambda s, q: s + q[c]), 6)
    return out.select("video_id", "frame_index", F.size("com_trail").cast("bigint").alias("trail_length"), total("com_x").alias("trail_x"), total("com_y").alias("trail_y"))


_SHOWN = ", ".join(f"CASE WHEN {n}_visibility >= 0.5 THEN {n}_{c} END AS {n}_{c}" for n in LANDMARKS for c in "xy")
_WEIGHED = {c: "(" + " + ".join(f"coalesce({w} * {n}_{c}, 0)" for n, w in MASS.items()) + ") / (" + " + ".join(f"CASE WHEN {n}_{c} IS NULL THEN 0 ELSE {w} END" for n, w in MASS.items()) + ")" for c in "xy"}


@query("visible_overlay", sql("pose_frames landmarks wide", f""", s AS (SELECT video_id, frame_index, {_SHOWN} FROM wide WHERE detection_score >= 0.3)
SELECT video_id, frame_index, round({_WEIGHED["x"]}, 6) AS com_x, round({_WEIGHED["y"]}, 6) AS com_y,
  round(least(1, abs(90 - abs(degrees(atan2((left_hip_y + right_hip_y) / 2 - (left_shoulder_y + right_shoulder_y) / 2, (left_hip_x + right_hip_x) / 2 - (left_shoulder_x + right_shoulder_x) / 2)))) / 60), 6) AS torso_tilt FROM s"""))
def visible_overlay(spark, sf_dir):
    """Centre of mass and tilt of well seen frames by well seen landmarks alone."""
    seen = features.body_features(features.visible(frames(spark, sf_dir), 0.5))
    off = seen.withColumns({f"{p}_on_hold": F.lit(0) for p in LIMBS})
    return rounded(contacts.overlay(off).select("video_id", "frame_index", "com_x", "com_y", "torso_tilt"))
