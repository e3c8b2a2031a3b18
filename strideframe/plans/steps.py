"""Queries over segments, steps, efficiency and recommendations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from strideframe.functions.tables import stored
from strideframe.operators import efficiency, features, kinematics, recommend, segments
from strideframe.params import JOINTS, LIMBS, StepWeights
from strideframe.plans import body as b
from strideframe.plans import fixtures as fx
from strideframe.plans.fixtures import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
W = b.W


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def touching(spark, sf_dir):
    """Frames whose limbs are in contact while within 0.05 of a hold, with derivatives of the centre."""
    out = kinematics.derivatives(features.nearest_holds(b.bodies(spark, sf_dir), fx.holds(spark, sf_dir)), points=("com",))
    return stored(touches(out), "touching")  # read by several parts of what follows


def touches(out):
    return out.select("*", *[x for p in LIMBS for x in (F.col(f"{p}_on_hold").alias(f"{p}_contact_on"), F.when(F.col(f"{p}_on_hold") == 1, "hold").otherwise("none").alias(f"{p}_contact_type"), F.when(F.col(f"{p}_on_hold") == 1, F.col(f"{p}_target")).alias(f"{p}_contact_hold"))])


COM_J = f", c1 AS (SELECT *, (com_x - lag(com_x) {W}) * 25 AS com_vx, (com_y - lag(com_y) {W}) * 25 AS com_vy FROM body), c2 AS (SELECT *, (com_vx - lag(com_vx) {W}) * 25 AS com_ax, (com_vy - lag(com_vy) {W}) * 25 AS com_ay FROM c1), c3 AS (SELECT *, sqrt(((com_ax - lag(com_ax) {W}) * 25)**2 + ((com_ay - lag(com_ay) {W}) * 25)**2) AS com_jerk FROM c2)"
TOUCH = COM_J + ", touch AS (SELECT c3.*, " + ", ".join(f"{p}_target, {p}_target_x, {p}_target_y, CASE WHEN {p}_distance <= 0.05 THEN 1 ELSE 0 END AS {p}_contact_on, CASE WHEN {p}_distance <= 0.05 THEN {p}_target END AS {p}_contact_hold" for p in LIMBS) + " FROM c3 JOIN near USING (video_id, frame_index))"
MOTION = (
    ", motion AS (SELECT video_id, frame_index, ts, coalesce((" + " + ".join([f"abs(com_{c} - lag(com_{c}) {W})" for c in "xy"] + [f"abs({j} - lag({j}) {W}) / 180" for j in JOINTS]) + ") / 10, 0) AS motion_score, frame_index > 0 AND ("
    + " OR ".join(f"{p}_target IS DISTINCT FROM lag({p}_target) {W}" for p in LIMBS) + ") AS hold_changed FROM touch), scored AS (SELECT *, greatest(0, motion_score) + CASE WHEN hold_changed THEN 0.12::DOUBLE ELSE 0 END AS activity FROM motion), "
    + "limits AS (SELECT video_id, greatest(0.05::DOUBLE, CASE WHEN quantile_cont(activity, 0.75) <= 0.05 THEN max(activity) ELSE quantile_cont(activity, 0.75) END) AS threshold FROM scored GROUP BY video_id)"
)
SEGMENTS = f""", lab AS (SELECT s.*, CASE WHEN activity >= threshold THEN 'movement' ELSE 'rest' END AS label FROM scored s JOIN limits USING (video_id)),
flip AS (SELECT * FROM (SELECT *, lag(label) {W} AS before FROM lab) WHERE before IS NULL OR before <> label),
span AS (SELECT video_id, label, frame_index AS start_index, lead(frame_index) {W} AS nxt, coalesce(lead(frame_index) {W}, (SELECT max(frame_index) FROM lab l WHERE l.video_id = flip.video_id)) AS end_index FROM flip),
timed AS (SELECT span.*, start_index::DOUBLE / 25 AS start_time, end_index::DOUBLE / 25 AS end_time FROM span),
segs AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_index) - 1 AS BIGINT) AS segment_id, start_index, end_index, start_time, end_time, label FROM (SELECT *, max(CASE WHEN end_time - start_time >= 0.5 AND nxt IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS others FROM timed) WHERE end_time - start_time >= 0.5 OR (nxt IS NULL AND others = 0))"""
#: Motion of the adapter views flips nearly every frame, so the metrics are taken over fixed segments of ten frames.
TENS = ", tens AS (SELECT video_id, frame_index // 10 AS segment_id, min(frame_index) AS start_index, max(frame_index) AS end_index FROM touch GROUP BY ALL)"


def tens(frames):
    key = F.floor(F.col("frame_index") / 10).alias("segment_id")
    return frames.groupBy("video_id", key).agg(F.min("frame_index").alias("start_index"), F.max("frame_index").alias("end_index"))


def scored(spark, sf_dir):
    return segments.activity_scores(segments.motion(touching(spark, sf_dir)))


@query("motion_score", sql(b.NEARED, TOUCH + MOTION + " SELECT video_id, frame_index, round(motion_score, 6) AS motion_score, hold_changed, round(activity, 6) AS activity, round(threshold, 6) AS threshold FROM scored JOIN limits USING (video_id)"))
def motion_score(spark, sf_dir):
    """G1, G2."""
    s = scored(spark, sf_dir).select("video_id", "frame_index", "motion_score", "hold_changed", "activity")
    return b.rounded(s.join(segments.thresholds(s).hint("merge"), "video_id"))


@query("activity_segments", sql(b.NEARED, TOUCH + MOTION + SEGMENTS + " SELECT video_id, segment_id, start_index, end_index, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, label FROM segs"))
def activity_segments(spark, sf_dir):
    """G3 with the defaults."""
    s = scored(spark, sf_dir)
    return b.rounded(segments.activity_segments(s, segments.thresholds(s)))


@query("activity_segments_report", sql(b.NEARED, TOUCH + MOTION.replace("0.75", "0.70").replace("0.05::DOUBLE", "0.01::DOUBLE").replace("<= 0.05 THEN max", "<= 0.01 THEN max") + SEGMENTS.replace(">= 0.5", ">= 0.08") + " SELECT video_id, segment_id, start_index, end_index, label FROM segs"))
def activity_segments_report(spark, sf_dir):
    """G3 as the segment report calls it (70th percentile, least 0.01), for segments of two frames and more."""
    s = scored(spark, sf_dir)
    return segments.activity_segments(s, segments.thresholds(s, 70, 0.01), 0.08).select("video_id", "segment_id", "start_index", "end_index", "label")


@query("activity_segments_sustained")
def activity_segments_sustained(spark, sf_dir):
    """G3 where a label must last two frames; a state machine, tested against plain Python."""
    s = scored(spark, sf_dir)
    return b.rounded(segments.activity_segments(s, segments.thresholds(s), 0.08, sustain=2))


@query("contact_steps")
def contact_steps(spark, sf_dir):
    """G4, C6 on event contacts."""
    return b.rounded(segments.contact_steps(fx.contact_rows(spark, sf_dir)))


def _speedy(spark, sf_dir):
    return kinematics.derivatives(fx.contact_rows(spark, sf_dir), points=("com",))


@query("step_labels")
def step_labels(spark, sf_dir):
    """G5 on event contacts."""
    rows = _speedy(spark, sf_dir)
    return segments.label_steps(rows, segments.contact_steps(rows)).select("video_id", "step_id", "start_index", "end_index", "label")


@query("step_of_frame")
def step_of_frame(spark, sf_dir):
    """G6."""
    rows = fx.contact_rows(spark, sf_dir)
    return segments.step_of_frame(rows, segments.contact_steps(rows)).select("video_id", "frame_index", "step_id")


K = "(PARTITION BY video_id, segment_id ORDER BY frame_index)"


@query("segment_metrics", sql(b.NEARED, TOUCH + TENS + ", r AS (SELECT t.*, segment_id, sqrt((com_x - lag(com_x) OVER k)**2 + (com_y - lag(com_y) OVER k)**2) AS hop, " + ", ".join([f"abs({j} - lag({j}) OVER k) / (ts - lag(ts) OVER k) AS v_{j}" for j in JOINTS] + [f"CASE WHEN {p}_target <> lag({p}_target) OVER k THEN 1 ELSE 0 END AS c_{p}" for p in LIMBS])
  + " FROM touch t JOIN tens USING (video_id) WHERE t.frame_index BETWEEN start_index AND end_index WINDOW k AS " + K + ") SELECT video_id, segment_id, count(*) AS frame_count, round(max(ts) - min(ts), 6) AS duration, round(avg(detection_score), 6) AS mean_detection, CASE WHEN count(*) >= 2 THEN round(sum(hop), 6) END AS com_path, CASE WHEN count(*) >= 2 THEN round(sqrt((arg_max(com_x, frame_index) - arg_min(com_x, frame_index))**2 + (arg_max(com_y, frame_index) - arg_min(com_y, frame_index))**2), 6) END AS com_displacement, "
  + ", ".join([f"round(max({j}) - min({j}), 6) AS {j}_range, round(avg(v_{j}), 4) AS {j}_velocity" for j in JOINTS] + [f"CAST(sum(c_{p}) AS BIGINT) AS {p}_contact_changes" for p in LIMBS]) + " FROM r GROUP BY video_id, segment_id"))
def segment_metrics(spark, sf_dir):
    """G7 to G12, over segments of ten frames."""
    t = touching(spark, sf_dir)
    out = segments.segment_metrics(t, tens(t))
    return out.select(*[F.round(c, 4 if c.endswith("_velocity") else 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


# The distance to the hull, written out for up to four points.
def _hull_sql() -> str:
    p = [(f"p{i}x", f"p{i}y") for i in range(4)]
    dist = [f"sqrt((com_x - {x})**2 + (com_y - {y})**2)" for x, y in p]
    for i, j in combinations(range(4), 2):
        (ax, ay), (bx, by) = p[i], p[j]
        t = f"greatest(0, least(1, ((com_x-{ax})*({bx}-{ax})+(com_y-{ay})*({by}-{ay})) / nullif(({bx}-{ax})**2+({by}-{ay})**2, 0)))"
        dist.append(f"sqrt((com_x-({ax}+{t}*({bx}-{ax})))**2+(com_y-({ay}+{t}*({by}-{ay})))**2)")
    cross = lambda o, a, q: f"(({a[0]}-{o[0]})*({q[1]}-{o[1]})-({a[1]}-{o[1]})*({q[0]}-{o[0]}))"
    com, inside = ("com_x", "com_y"), []
    for i, j, k in combinations(range(4), 3):
        s = [cross(p[i], p[j], com), cross(p[j], p[k], com), cross(p[k], p[i], com)]
        inside.append(f"(abs({cross(p[i], p[j], p[k])}) > 1e-12 AND NOT (({' OR '.join(x + ' < 0' for x in s)}) AND ({' OR '.join(x + ' > 0' for x in s)})))")
    return f"CASE WHEN {' OR '.join(f'coalesce({x}, false)' for x in inside)} THEN 0 ELSE least({', '.join(dist)}) END"


EFF = (
    ", pts AS (SELECT *, " + ", ".join(f"CASE WHEN {p}_contact_on = 1 THEN {p}_target_{c} END AS p{i}{c}" for i, p in enumerate(LIMBS) for c in "xy") + " FROM touch), "
    + f"comp AS (SELECT pts.*, {' + '.join(f'{p}_contact_on' for p in LIMBS)} AS n_points, {_hull_sql()} AS far, greatest(0, com_perp_wall) AS wall_penalty, coalesce(com_jerk / (body_scale + 1e-6), 0) AS jerk_penalty, "
    + "greatest(0, greatest(" + ", ".join(f"sqrt(({p}_x - hip_center_x)**2 + ({p}_y - hip_center_y)**2)" for p in LIMBS) + ") / body_scale - 1.1::DOUBLE * (1 + coalesce(0.05::DOUBLE + 0.05::DOUBLE * climber_flexibility, 0))) AS reach_penalty FROM pts), "
    + "es AS (SELECT c.*, segment_id, CASE WHEN n_points = 0 THEN 0 ELSE exp(-4 * far / (body_scale + 1e-6)) END AS stability, CASE WHEN n_points < 2 THEN 1 ELSE 0 END + 0.1::DOUBLE * CASE WHEN row_number() OVER k > 1 THEN "
    + " + ".join(f"CASE WHEN {p}_contact_hold IS DISTINCT FROM lag({p}_contact_hold) OVER k THEN 1 ELSE 0 END" for p in LIMBS)
    + " ELSE 0 END AS support_penalty, sqrt((com_x - lag(com_x) OVER k)**2 + (com_y - lag(com_y) OVER k)**2) AS hop FROM comp c JOIN tens USING (video_id) WHERE c.frame_index BETWEEN start_index AND end_index WINDOW k AS " + K + ")"
)


@query("step_efficiency", sql(b.NEARED, TOUCH + TENS + EFF + ", g AS (SELECT video_id, segment_id, avg(stability) AS stability, avg(support_penalty) AS support_penalty, avg(wall_penalty) AS wall_penalty, avg(jerk_penalty) AS jerk_penalty, avg(reach_penalty) AS reach_penalty, CASE WHEN count(*) >= 2 THEN sqrt((arg_max(com_x, frame_index) - arg_min(com_x, frame_index))**2 + (arg_max(com_y, frame_index) - arg_min(com_y, frame_index))**2) / (sum(hop) + 1e-6) ELSE 0 END AS path_efficiency FROM es GROUP BY ALL), s AS (SELECT *, 0.35 * stability + 0.25 * path_efficiency - (0.2 * support_penalty + 0.1 * wall_penalty + 0.07 * jerk_penalty + 0.03 * reach_penalty) AS score FROM g) SELECT video_id, segment_id, round(stability, 6) AS stability, round(support_penalty, 6) AS support_penalty, round(wall_penalty, 6) AS wall_penalty, round(jerk_penalty, 4) AS jerk_penalty, round(reach_penalty, 6) AS reach_penalty, round(path_efficiency, 6) AS path_efficiency, round(score, 4) AS score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'moderate' WHEN score >= 0.2 THEN 'poor' ELSE 'very_poor' END AS band FROM s"))
def step_efficiency(spark, sf_dir):
    """E1 to E14, over steps of ten frames (no technique tags)."""
    t = touching(spark, sf_dir)
    out = efficiency.step_scores(t, tens(t), StepWeights(), "segment_id")
    r = lambda c, d=6: F.round(c, d).alias(c)
    return out.select("video_id", "segment_id", r("stability"), r("support_penalty"), r("wall_penalty"), r("jerk_penalty", 4), r("reach_penalty"), r("path_efficiency"), r("score", 4), "band")


@query("technique_efficiency")
def technique_efficiency(spark, sf_dir):
    """E1 to E13 with inferred contacts (C1) and technique tags (C4), over contact steps (G4) of those contacts."""
    from strideframe.operators import contacts

    rows = contacts.technique(b.contacted(spark, sf_dir))
    return b.rounded(efficiency.step_scores(rows, segments.contact_steps(rows)))


@query("recent_score", sql(b.NEARED, TOUCH + ", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index DESC) AS k FROM touch) WHERE k <= 5), q AS (SELECT *, "
  + " + ".join(f"abs({j})" for j in JOINTS) + " AS js, CASE WHEN k < 5 AND lag(k) " + W + " IS NOT NULL THEN " + " + ".join(f"CASE WHEN {p}_target IS NOT DISTINCT FROM lag({p}_target) {W} THEN 1 ELSE 0 END" for p in LIMBS) + f" END AS same, least(_d, 180 - _d) AS hip FROM r), p AS (SELECT video_id, avg(detection_score) AS detection, 1 - sum(js) / (count(*) * 8 * 180) AS joint, CASE WHEN count(*) >= 2 THEN 1 / (1 + var_pop(com_perp_wall) / greatest(var_pop(com_perp_wall), 1e-6)) ELSE 0.5 END AS com, coalesce(sum(same) / nullif(count(same) * 4, 0), 0.5) AS contact, 1 - arg_max(hip, frame_index) / 90 AS hip FROM q GROUP BY video_id) SELECT video_id, round(detection, 6) AS detection, round(joint, 6) AS joint, round(com, 6) AS com, round(contact, 6) AS contact, round(hip, 6) AS hip, round(0.3 * detection + 0.2 * joint + 0.2 * com + 0.2 * contact + 0.1 * hip, 6) AS score FROM p"))
def recent_score(spark, sf_dir):
    """E15."""
    return b.rounded(efficiency.recent_score(touching(spark, sf_dir)))


_LAST = "OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_PAIRS = "OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query("rolling_score", sql(b.NEARED, TOUCH + ", q AS (SELECT *, " + " + ".join(f"abs({j})" for j in JOINTS) + " AS js, CASE WHEN frame_index > 0 THEN " + " + ".join(f"CASE WHEN {p}_target IS NOT DISTINCT FROM lag({p}_target) {W} THEN 1 ELSE 0 END" for p in LIMBS) + f""" END AS same FROM touch),
p AS (SELECT video_id, frame_index, avg(detection_score) {_LAST} AS detection, 1 - sum(js) {_LAST} / (count(*) {_LAST} * 8 * 180) AS joint, CASE WHEN count(*) {_LAST} >= 2 THEN 1 / (1 + var_pop(com_perp_wall) {_LAST} / greatest(var_pop(com_perp_wall) {_LAST}, 1e-6)) ELSE 0.5 END AS com,
  coalesce(sum(same) {_PAIRS} / nullif(count(same) {_PAIRS} * 4, 0), 0.5) AS contact, 1 - least(_d, 180 - _d) / 90 AS hip FROM q)
SELECT video_id, frame_index, round(0.3 * detection + 0.2 * joint + 0.2 * com + 0.2 * contact + 0.1 * hip, 6) AS score FROM p"""))
def rolling_score(spark, sf_dir):
    """E15 at each frame."""
    return b.rounded(efficiency.rolling_score(touching(spark, sf_dir)).select("video_id", "frame_index", "score"))


def _next_sql(held: str, extra: str = "") -> str:
    return sql(b.NEARED, TOUCH + f", r AS (SELECT t.video_id, t.frame_index, hold_id, hold_ord, 0.7::DOUBLE * (1 - least(sqrt((com_x - x)**2 + (com_y - y)**2), 1)) + 0.3::DOUBLE * CASE WHEN hold_id IN ({', '.join(f'coalesce({p}_{held}, {chr(39)}{chr(39)})' for p in LIMBS)}) THEN 0 ELSE 1 END AS score FROM touch t JOIN holds h ON h.video_id = t.video_id {extra}), k AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY score DESC, hold_ord) AS rank FROM r)")


@query("next_holds", _next_sql("contact_hold") + " SELECT video_id, frame_index, CAST(rank AS INTEGER) AS rank, hold_id, round(score, 6) AS score FROM k WHERE rank <= 3")
def next_holds(spark, sf_dir):
    """R1."""
    return b.rounded(recommend.next_holds(touching(spark, sf_dir), fx.holds(spark, sf_dir)))


@query("next_holds_by_target", _next_sql("target") + " SELECT video_id, frame_index, CAST(rank AS INTEGER) AS rank, hold_id, round(score, 6) AS score FROM k WHERE rank <= 3")
def next_holds_by_target(spark, sf_dir):
    """R2."""
    return b.rounded(recommend.next_holds(touching(spark, sf_dir), fx.holds(spark, sf_dir), held="target"))


@query("plan_moves")
def plan_moves(spark, sf_dir):
    """R3 to R7; held against plain Python in the tests."""
    out = recommend.plan_moves(touching(spark, sf_dir), fx.holds(spark, sf_dir))
    return b.rounded(out.withColumn("violations", F.concat_ws(",", "violations")))


@query("frame_report", _next_sql("contact_hold") + " SELECT t.video_id, t.frame_index, round(com_x, 6) AS com_x, round(com_y, 6) AS com_y, " + ", ".join(f"{p}_contact_hold" for p in LIMBS) + ", (SELECT string_agg(hold_id, ',' ORDER BY rank) FROM k WHERE k.video_id = t.video_id AND k.frame_index = t.frame_index AND rank <= 5) AS next_holds, climber_height, 181::DOUBLE AS climber_wingspan, round(climber_flexibility, 6) AS climber_flexibility FROM touch t WHERE frame_index = (SELECT max(frame_index) FROM touch u WHERE u.video_id = t.video_id)")
def frame_report(spark, sf_dir):
    """R8, with a wingspan given for all."""
    return b.rounded(recommend.frame_report(touching(spark, sf_dir), fx.holds(spark, sf_dir), wingspan=181.0).withColumn("next_holds", F.concat_ws(",", "next_holds")))


@query("next_hold_hit_rate", _next_sql("contact_hold") + ", m AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT video_id, frame_index, lead({p}_contact_hold) {W} AS nxt, {p}_contact_hold AS cur FROM touch" for p in LIMBS) + ") WHERE nxt IS NOT NULL AND nxt IS DISTINCT FROM cur) SELECT count(*) AS moves, CAST(count(k.hold_id) AS BIGINT) AS hits, round(coalesce(count(k.hold_id)::DOUBLE / nullif(count(*), 0), 0), 6) AS hit_rate FROM m LEFT JOIN k ON k.video_id = m.video_id AND k.frame_index = m.frame_index AND k.hold_id = m.nxt AND rank <= 3")
def next_hold_hit_rate(spark, sf_dir):
    """M18."""
    t = touching(spark, sf_dir)
    return b.rounded(recommend.hit_rate(recommend.next_holds(t, fx.holds(spark, sf_dir)), t))
