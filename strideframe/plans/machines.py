"""SQL for the queries over state machines, planners and clusters: recursion over frames in place of state."""

from __future__ import annotations

from itertools import combinations

from strideframe.params import LIMBS, MASS, ROUTE_COLOURS  # noqa: F401
from strideframe.plans import body as b
from strideframe.plans import routes as rt
from strideframe.plans import steps as st
from strideframe.plans.fixtures import sql

W = b.W
SQL: dict[str, str] = {}

# -- contacts: one recursion step a frame and limb ------------------------------------------------------

_XY = {p: (f"{p}_x", f"{p}_y") for p in LIMBS}
SLOW = (
    ", slow AS MATERIALIZED (SELECT body.*, "
    + ", ".join(f"{p}_{c} - lag({p}_{c}) {W} AS {p}_v{c}" for p in ("com", *LIMBS) for c in "xy")
    + ", "
    + ", ".join(f"{p}_target, {p}_distance, {p}_target_x, {p}_target_y" for p in LIMBS)
    + " FROM body JOIN near USING (video_id, frame_index))"
)
LIMB_ROWS = ", limb_rows AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT video_id, frame_index, '{p}' AS limb, body_scale, {p}_target AS target,
        sqrt({p}_vx**2 + {p}_vy**2) <= 1.0 * body_scale AS still, {p}_distance AS distance, abs({p}_z) AS z FROM slow"""
    for p in LIMBS
) + """), touchy AS MATERIALIZED (
  SELECT video_id, frame_index, limb, target, coalesce(smear, false) AS smear, coalesce(near, false) AS near, distance >= 0.28 * body_scale AS away
  FROM (SELECT *, limb LIKE '%foot' AND distance > 0.25 * body_scale AND z <= 0.03 AND still AS smear, distance <= 0.22 * body_scale AND still AS near FROM limb_rows))"""
STATES = """, machine AS (
  SELECT DISTINCT video_id, limb, CAST(-1 AS BIGINT) AS frame_index, false AS held, 0 AS since, 0 AS pending, 'none' AS kind, CAST(NULL AS VARCHAR) AS hold FROM touchy
  UNION ALL
  SELECT r.video_id, r.limb, r.frame_index,
    CASE WHEN m.held THEN NOT (m.since + 1 >= 2 AND r.away AND NOT r.smear) ELSE (r.near OR r.smear) AND m.pending + 1 >= 2 END,
    CASE WHEN NOT m.held THEN 0 WHEN m.since + 1 >= 2 AND r.away AND NOT r.smear THEN 0 ELSE m.since + 1 END,
    CASE WHEN m.held THEN 0 WHEN r.near OR r.smear THEN CASE WHEN m.pending + 1 >= 2 THEN 0 ELSE m.pending + 1 END ELSE 0 END,
    CASE WHEN m.held THEN CASE WHEN m.since + 1 >= 2 AND r.away AND NOT r.smear THEN 'none' WHEN r.smear THEN 'smear' ELSE 'hold' END
         WHEN (r.near OR r.smear) AND m.pending + 1 >= 2 THEN CASE WHEN r.smear THEN 'smear' ELSE 'hold' END ELSE 'none' END,
    CASE WHEN m.held THEN CASE WHEN m.since + 1 >= 2 AND r.away AND NOT r.smear THEN NULL ELSE coalesce(r.target, m.hold) END
         WHEN (r.near OR r.smear) AND m.pending + 1 >= 2 AND NOT r.smear THEN r.target END
  FROM machine m JOIN touchy r ON r.video_id = m.video_id AND r.limb = m.limb AND r.frame_index = m.frame_index + 1
), states AS MATERIALIZED (SELECT video_id, frame_index, """ + ", ".join(
    f"max(CASE WHEN limb = '{p}' AND held THEN 1 WHEN limb = '{p}' THEN 0 END) AS {p}_contact_on, max(CASE WHEN limb = '{p}' THEN kind END) AS {p}_contact_type, max(CASE WHEN limb = '{p}' THEN hold END) AS {p}_contact_hold"
    for p in LIMBS
) + " FROM machine WHERE frame_index >= 0 GROUP BY ALL)"
CONTACTED = SLOW + LIMB_ROWS + STATES
_ON = " + ".join(f"{p}_contact_on" for p in LIMBS)

SQL["contact_states"] = sql(b.NEARED, CONTACTED + f"""
SELECT video_id, frame_index, {_ON} AS support_count, {", ".join(f"{p}_contact_{c}" for p in LIMBS for c in ("on", "type", "hold"))} FROM states""")

SIDE = "sign({p}_x - hip_center_x)"
DROP = "least(1, abs({s}_foot_x - {s}_knee_x) / (abs(hip_center_x - {s}_foot_x) + 1e-6))"
TECHNIQUE = f""", technique AS MATERIALIZED (SELECT slow.*, states.* EXCLUDE (video_id, frame_index),
  CASE WHEN left_foot_contact_on = 1 AND right_foot_contact_on = 1 AND left_foot_contact_hold IS NOT DISTINCT FROM right_foot_contact_hold
       THEN greatest(0, 1 - abs(coalesce(left_foot_vx, 0) + coalesce(right_foot_vx, 0))) ELSE 0 END::DOUBLE AS technique_bicycle,
  CASE WHEN {SIDE.format(p="left_foot")} = {SIDE.format(p="right_foot")} AND {SIDE.format(p="left_foot")} <> 0 THEN 0.5 ELSE 0 END::DOUBLE AS technique_back_flag,
  greatest({DROP.format(s="left")}, {DROP.format(s="right")})::DOUBLE AS technique_drop_knee
  FROM slow JOIN states USING (video_id, frame_index))"""
SQL["technique"] = sql(b.NEARED, CONTACTED + TECHNIQUE + """
SELECT video_id, frame_index, round(technique_bicycle, 6) AS technique_bicycle, technique_back_flag, round(technique_drop_knee, 6) AS technique_drop_knee FROM technique""")


def _corner(o: int, a: int, c: tuple[str, str] | int) -> str:
    qx, qy = c if isinstance(c, tuple) else (f"p{c}x", f"p{c}y")
    return f"((p{a}x - p{o}x) * ({qy} - p{o}y) - (p{a}y - p{o}y) * ({qx} - p{o}x))"


def _inside(k: int) -> str:
    i, j, m = (x for x in range(4) if x != k)
    q = (f"p{k}x", f"p{k}y")
    s = [_corner(i, j, q), _corner(j, m, q), _corner(m, i, q)]
    return f"(abs({_corner(i, j, m)}) > 1e-12 AND NOT (({' OR '.join(x + ' < 0' for x in s)}) AND ({' OR '.join(x + ' > 0' for x in s)})))"


_MID = "(left_{part}_{c} + right_{part}_{c}) / 2"
SQL["overlay"] = sql(b.NEARED, ", o AS (SELECT body.*, " + ", ".join(f"{p}_distance <= 0.15 AS h{i}, {p}_x AS p{i}x, {p}_y AS p{i}y" for i, p in enumerate(LIMBS)) + f""" FROM body JOIN near USING (video_id, frame_index) WHERE detection_score >= 0.3),
v AS (SELECT *, {" + ".join(f"h{i}::INT" for i in range(4))} AS n, {", ".join(f"h{i} AND NOT (h0 AND h1 AND h2 AND h3 AND {_inside(i)}) AS v{i}" for i in range(4))} FROM o),
l AS (SELECT *, list_filter([{", ".join(f"CASE WHEN v{i} THEN p{i}x END" for i in range(4))}], lambda x: x IS NOT NULL) AS xs, list_filter([{", ".join(f"CASE WHEN v{i} THEN p{i}y END" for i in range(4))}], lambda x: x IS NOT NULL) AS ys FROM v)
SELECT video_id, frame_index,
  round(least(1, abs(90 - abs(degrees(atan2({_MID.format(part="hip", c="y")} - {_MID.format(part="shoulder", c="y")}, {_MID.format(part="hip", c="x")} - {_MID.format(part="shoulder", c="x")})))) / 60), 6) AS torso_tilt,
  CASE WHEN n >= 3 AND len(xs) >= 3 THEN round(least(1, sqrt((com_x - list_avg(xs))**2 + (com_y - list_avg(ys))**2) / (0.25 * greatest(list_max(xs) - list_min(xs), list_max(ys) - list_min(ys)))), 6) END AS balance_deviation
FROM l""")

# -- steps of contacts ----------------------------------------------------------------------------------


def _steps(rows: str, name: str) -> str:
    """Steps over ``rows`` (contact columns, ts, contiguous frames from 0)."""
    differs = " + ".join(f"CASE WHEN {p}_contact_type IS DISTINCT FROM lag({p}_contact_type) {W} OR {p}_contact_hold IS DISTINCT FROM lag({p}_contact_hold) {W} THEN 1 ELSE 0 END" for p in LIMBS)
    return f""", {name}_marked AS MATERIALIZED (SELECT video_id, frame_index, ts, frame_index > 0 AND ({differs}) = 1 AND ({_ON}) >= 2 AS candidate, lead(frame_index) {W} IS NULL AS last FROM {rows}),
{name}_run AS (
  SELECT video_id, frame_index, ts, last, frame_index AS open_index, ts AS open_ts, false AS some, false AS cut, frame_index AS from_index FROM {name}_marked WHERE frame_index = 0
  UNION ALL
  SELECT m.video_id, m.frame_index, m.ts, m.last, CASE WHEN c THEN m.frame_index ELSE m.open_index END, CASE WHEN c THEN m.ts ELSE m.open_ts END, m.some OR c, c, m.open_index
  FROM (SELECT k.*, r.open_index, r.open_ts, r.some, k.candidate AND (k.frame_index - r.open_index >= 5 OR NOT r.some) AND greatest(0, k.ts - r.open_ts) <= 4 AS c
        FROM {name}_run r JOIN {name}_marked k ON k.video_id = r.video_id AND k.frame_index = r.frame_index + 1) m
), {name} AS MATERIALIZED (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS BIGINT) AS step_id, from_index AS start_index, frame_index AS end_index, from_index::DOUBLE / 25 AS start_time, ts AS end_time
  FROM {name}_run WHERE cut OR last)"""


EVENTS = "contact_events contact_rows"
EVENT_STEPS = ", cr AS MATERIALIZED (SELECT * FROM contact_rows)" + _steps("cr", "steps")
SQL["contact_steps"] = sql(EVENTS, EVENT_STEPS + " SELECT video_id, step_id, start_index, end_index, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM steps")
SQL["step_of_frame"] = sql(EVENTS, EVENT_STEPS + " SELECT c.video_id, c.frame_index, max(step_id) AS step_id FROM cr c LEFT JOIN steps s ON s.video_id = c.video_id AND c.frame_index BETWEEN s.start_index AND s.end_index GROUP BY ALL")
SQL["step_labels"] = sql(EVENTS, EVENT_STEPS + f""", sp AS (SELECT *, sqrt(((com_x - lag(com_x) {W}) * 25)**2 + ((com_y - lag(com_y) {W}) * 25)**2) AS com_speed, {_ON} AS support FROM cr),
f AS (SELECT s.video_id, s.step_id, s.start_index, s.end_index, coalesce(avg(com_speed), 0) AS speed, max(CASE WHEN frame_index = start_index THEN support END) AS s0, max(CASE WHEN frame_index = end_index THEN support END) AS s1, max(CASE WHEN frame_index = end_index THEN com_y END) AS y1
      FROM steps s JOIN sp c ON c.video_id = s.video_id AND c.frame_index BETWEEN s.start_index AND s.end_index GROUP BY ALL)
SELECT video_id, step_id, start_index, end_index, CASE WHEN speed < 0.01 AND s0 >= 3 THEN 'rest' WHEN y1 < 0.3 AND speed < 0.02 AND s1 >= 3 THEN 'finish' WHEN s1 > s0 THEN 'reach' WHEN s0 = s1 AND speed < 0.03 THEN 'stabilize' WHEN speed > 0.08 THEN 'dynamic_move' ELSE 'movement' END AS label FROM f""")

SUSTAINED = """, labelled AS MATERIALIZED (SELECT s.video_id, s.frame_index, s.ts, CASE WHEN activity >= threshold THEN 'movement' ELSE 'rest' END AS label FROM scored s JOIN limits USING (video_id)),
turns AS (
  SELECT video_id, frame_index, label, label AS current, 0 AS up, 0 AS down, frame_index AS begin FROM labelled WHERE frame_index = 0
  UNION ALL
  SELECT video_id, frame_index, label, CASE WHEN flip THEN label ELSE current END, up, down, CASE WHEN flip THEN frame_index - 1 END FROM (
    SELECT *, label <> current AND greatest(up, down) >= 2 AS flip FROM (
      SELECT l.video_id, l.frame_index, l.label, t.current, CASE WHEN l.label = 'movement' THEN t.up + 1 ELSE 0 END AS up, CASE WHEN l.label = 'movement' THEN 0 ELSE t.down + 1 END AS down
      FROM turns t JOIN labelled l ON l.video_id = t.video_id AND l.frame_index = t.frame_index + 1))
), flip AS (SELECT video_id, begin AS frame_index, label FROM turns WHERE begin IS NOT NULL), lab AS (SELECT * FROM labelled), """
SQL["activity_segments_sustained"] = sql(b.NEARED, st.TOUCH + st.MOTION + SUSTAINED + st.SEGMENTS.split("before <> label),", 1)[1].replace(">= 0.5", ">= 0.08") + " SELECT video_id, segment_id, start_index, end_index, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, label FROM segs")

# -- efficiency of inferred contacts --------------------------------------------------------------------

TE = (
    f", jerky AS (SELECT *, com_vx - lag(com_vx) {W} AS com_ax, com_vy - lag(com_vy) {W} AS com_ay FROM technique), jerked AS (SELECT *, sqrt((com_ax - lag(com_ax) {W})**2 + (com_ay - lag(com_ay) {W})**2) AS com_jerk FROM jerky)"
    + _steps("jerked", "steps")
    + ", pts AS (SELECT *, " + ", ".join(f"CASE WHEN {p}_contact_on = 1 THEN {p}_target_{c} END AS p{i}{c}" for i, p in enumerate(LIMBS) for c in "xy") + " FROM jerked)"
    + f", comp AS (SELECT pts.*, {_ON} AS n_points, {st._hull_sql()} AS far, greatest(0, com_perp_wall) AS wall_penalty, coalesce(com_jerk / (body_scale + 1e-6), 0) AS jerk_penalty, 0.05 * technique_bicycle + 0.05 * technique_back_flag + 0.03 * technique_drop_knee AS technique_bonus, "
    + "greatest(0, greatest(" + ", ".join(f"sqrt(({p}_x - hip_center_x)**2 + ({p}_y - hip_center_y)**2)" for p in LIMBS) + ") / body_scale - 1.1::DOUBLE * (1 + coalesce(0.05::DOUBLE + 0.05::DOUBLE * climber_flexibility, 0))) AS reach_penalty FROM pts)"
    + ", es AS (SELECT c.*, step_id, CASE WHEN n_points = 0 THEN 0 ELSE exp(-4 * far / (body_scale + 1e-6)) END AS stability, CASE WHEN n_points < 2 THEN 1 ELSE 0 END + 0.1::DOUBLE * CASE WHEN row_number() OVER k > 1 THEN "
    + " + ".join(f"CASE WHEN {p}_contact_hold IS DISTINCT FROM lag({p}_contact_hold) OVER k OR {p}_contact_type IS DISTINCT FROM lag({p}_contact_type) OVER k THEN 1 ELSE 0 END" for p in LIMBS)
    + " ELSE 0 END AS support_penalty, sqrt((com_x - lag(com_x) OVER k)**2 + (com_y - lag(com_y) OVER k)**2) AS hop FROM comp c JOIN steps USING (video_id) WHERE c.frame_index BETWEEN start_index AND end_index WINDOW k AS (PARTITION BY video_id, step_id ORDER BY frame_index))"
    + ", g AS (SELECT video_id, step_id, avg(stability) AS stability, avg(support_penalty) AS support_penalty, avg(wall_penalty) AS wall_penalty, avg(jerk_penalty) AS jerk_penalty, avg(reach_penalty) AS reach_penalty, avg(technique_bonus) AS technique_bonus, CASE WHEN count(*) >= 2 THEN sqrt((arg_max(com_x, frame_index) - arg_min(com_x, frame_index))**2 + (arg_max(com_y, frame_index) - arg_min(com_y, frame_index))**2) / (coalesce(sum(hop), 0) + 1e-6) ELSE 0 END AS path_efficiency FROM es GROUP BY ALL)"
    + ", s AS (SELECT *, 0.35 * stability + 0.25 * path_efficiency - (0.2 * support_penalty + 0.1 * wall_penalty + 0.07 * jerk_penalty + 0.03 * reach_penalty) + technique_bonus AS score FROM g)"
)
SQL["technique_efficiency"] = sql(b.NEARED, CONTACTED + TECHNIQUE + TE + " SELECT video_id, step_id, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("stability", "support_penalty", "wall_penalty", "jerk_penalty", "reach_penalty", "technique_bonus", "path_efficiency", "score")) + ", CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'moderate' WHEN score >= 0.2 THEN 'poor' ELSE 'very_poor' END AS band FROM s")

# -- the move planner -----------------------------------------------------------------------------------

_HELD = ", ".join(f"CASE WHEN {p}_contact_on = 1 THEN coalesce({p}_contact_hold, '') ELSE '' END" for p in LIMBS)
_OR = lambda p, c: f"CASE WHEN coalesce({p}_{c}, 0) = 0 THEN com_{c} ELSE {p}_{c} END"
_REACH = lambda p: f"sqrt((hx - {_OR(p, 'x')})**2 + (hy - {_OR(p, 'y')})**2)"


def _limb(part: str) -> str:
    return f"CASE WHEN left_{part}_contact_on = 0 THEN 'left_{part}' WHEN right_{part}_contact_on = 0 THEN 'right_{part}' WHEN {_REACH('left_' + part)} < {_REACH('right_' + part)} THEN 'left_{part}' ELSE 'right_{part}' END"


_T = "greatest(0, least(1, ((com_x - a.x) * (o.x - a.x) + (com_y - a.y) * (o.y - a.y)) / nullif((o.x - a.x)**2 + (o.y - a.y)**2, 0)))"
PLAN = f""", held AS MATERIALIZED (SELECT *, CASE WHEN coalesce(body_scale, 0) = 0 THEN 1 ELSE body_scale END AS scale, {_ON} AS supports FROM touch),
cand AS (SELECT t.*, hold_ord, hold_id, h.x AS hx, h.y AS hy, hold_type, CASE WHEN hold_type = 'jug' AND supports < 3 THEN 0.05 ELSE 0 END::DOUBLE AS jug, CASE WHEN hold_type IN ('crimp', 'sloper') AND h.y < com_y - 0.15 * scale THEN 0.03 ELSE 0 END::DOUBLE AS farther
  FROM held t JOIN holds h ON h.video_id = t.video_id WHERE hold_id NOT IN ({_HELD})),
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY 1 / (sqrt((com_x - hx)**2 + (com_y - hy)**2) / scale + 1e-6) + CASE WHEN hy < com_y THEN 0.3 * (com_y - hy) ELSE 0 END + greatest(jug, farther) DESC, hold_ord) - 1 AS ord FROM cand) WHERE ord < 10),
limbed AS (SELECT *, CASE WHEN hy < com_y - 0.1 * scale THEN {_limb("hand")} ELSE {_limb("foot")} END AS limb FROM ten),
poly AS (SELECT *, list_filter([{", ".join(f"CASE WHEN limb = '{p}' THEN {{'x': hx, 'y': hy}} WHEN {p}_contact_on = 1 THEN {{'x': {p}_target_x, 'y': {p}_target_y}} END" for p in LIMBS)}], lambda q: q IS NOT NULL) AS pts FROM limbed),
edge AS (SELECT video_id, frame_index, ord, com_x, com_y, pts[i] AS a, pts[CASE WHEN i = 1 THEN len(pts) ELSE i - 1 END] AS o, len(pts) AS n FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM poly)),
dist AS (SELECT video_id, frame_index, ord, min(CASE WHEN (o.x - a.x)**2 + (o.y - a.y)**2 < 1e-18 THEN sqrt((com_x - a.x)**2 + (com_y - a.y)**2) ELSE sqrt((com_x - (a.x + {_T} * (o.x - a.x)))**2 + (com_y - (a.y + {_T} * (o.y - a.y)))**2) END) AS away,
  any_value(n) >= 3 AND sum(CASE WHEN (a.y > com_y) <> (o.y > com_y) AND com_x < (o.x - a.x) * (com_y - a.y) / (o.y - a.y) + a.x THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM edge GROUP BY ALL),
judged AS (SELECT p.*, CASE WHEN inside THEN 0 ELSE away END AS far, sqrt((hip_center_x - hx)**2 + (hip_center_y - hy)**2) / scale AS reach,
  1.2 * CASE WHEN climber_height > 0 AND climber_wingspan IS NOT NULL THEN greatest(0.8, least(1.2, 0.9 + 0.2 * climber_wingspan / climber_height)) ELSE 1 END * coalesce(1 + 0.05 + 0.05 * climber_flexibility, 1) AS allowed FROM poly p JOIN dist USING (video_id, frame_index, ord)),
bad AS (SELECT *, list_filter([CASE WHEN len(pts) < 2 THEN 'low_support_count_' || len(pts)::VARCHAR END, CASE WHEN reach > allowed THEN printf('reach_exceeded_%.2f_vs_%.2f', reach, allowed) END, CASE WHEN far / scale > 0.15 THEN printf('com_outside_polygon_%.2f', far / scale) END], lambda v: v IS NOT NULL) AS faults FROM judged),
eff AS (SELECT *, greatest(0, 0.5 * exp(-4 * far / (scale + 1e-6)) + 1 - 0.1 * len(faults))::DOUBLE AS efficiency, (len(pts) < 2 OR reach > allowed)::INT AS critical FROM bad),
del AS (SELECT *, efficiency - 0.5 + (jug + farther) AS delta, min(critical) OVER (PARTITION BY video_id, frame_index) AS least_bad FROM eff),
best AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY efficiency DESC, ord) AS rank FROM del WHERE critical = 0 OR least_bad = 1)
SELECT video_id, frame_index, CAST(rank AS INTEGER) AS rank, limb, hold_id, hold_type, round(efficiency, 6) AS efficiency, round(delta, 6) AS delta, array_to_string(faults, ',') AS violations,
  concat_ws('; ', CASE WHEN delta > 0 THEN printf('Improves efficiency by %.2f', delta) END, CASE WHEN hy < com_y THEN 'Upward progression' END, 'Hold type: ' || hold_type, CASE WHEN len(faults) = 0 THEN 'No constraint violations' END) AS reasoning
FROM best WHERE rank <= 3"""
SQL["plan_moves"] = sql(b.NEARED, st.TOUCH + PLAN)

# -- frame selection ------------------------------------------------------------------------------------

SQL["diverse_frames"] = sql("pose_frames landmarks", """, seen AS MATERIALIZED (SELECT video_id, frame_index, pos, x, y FROM landmarks WHERE visibility >= 0.5),
sim AS MATERIALIZED (SELECT a.video_id, a.frame_index AS f, c.frame_index AS g, 1 / (1 + 2 * avg(sqrt((a.x - c.x)**2 + (a.y - c.y)**2))) AS v FROM seen a JOIN seen c ON a.video_id = c.video_id AND a.pos = c.pos AND c.frame_index < a.frame_index GROUP BY ALL),
every AS MATERIALIZED (SELECT DISTINCT video_id, frame_index FROM pose_frames),
walk AS (
  SELECT video_id, frame_index, frame_index AS last, true AS kept FROM every WHERE frame_index = 0
  UNION ALL
  SELECT e.video_id, e.frame_index, CASE WHEN coalesce(s.v, 0) < 0.8 AND e.frame_index - w.last >= 5 THEN e.frame_index ELSE w.last END, coalesce(s.v, 0) < 0.8 AND e.frame_index - w.last >= 5
  FROM walk w JOIN every e ON e.video_id = w.video_id AND e.frame_index = w.frame_index + 1 LEFT JOIN sim s ON s.video_id = e.video_id AND s.f = e.frame_index AND s.g = w.last
), counted AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, sum(kept::INT) OVER (PARTITION BY video_id) AS k FROM walk)
SELECT video_id, frame_index FROM counted WHERE CASE WHEN k < 3 THEN frame_index % greatest(1, n // 3) = 0 AND frame_index // greatest(1, n // 3) < 3 ELSE kept END""")

SQL["contact_moments"] = rt.SQL["limb_velocity"].split(" SELECT video_id, frame_index, round(")[0] + """, fast AS MATERIALIZED (SELECT video_id, frame_index, greatest(left_wrist, right_wrist, left_ankle, right_ankle) AS now FROM v),
run AS (
  SELECT video_id, frame_index, now, false AS holding, CAST(0 AS BIGINT) AS begun, CAST(NULL AS VARCHAR) AS moment FROM fast WHERE frame_index = 0
  UNION ALL
  SELECT f.video_id, f.frame_index, f.now,
    CASE WHEN r.now > 0.3 AND f.now < 0.25 THEN true WHEN r.holding AND r.now < 0.25 AND f.now > 0.3 THEN false ELSE r.holding END,
    CASE WHEN r.now > 0.3 AND f.now < 0.25 THEN f.frame_index ELSE r.begun END,
    CASE WHEN r.now > 0.3 AND f.now < 0.25 THEN 'contact' WHEN r.holding AND r.now < 0.25 AND f.now > 0.3 THEN CASE WHEN f.frame_index - r.begun >= 3 THEN 'release' END WHEN r.holding AND f.frame_index - r.begun = 1 THEN 'middle' END
  FROM run r JOIN fast f ON f.video_id = r.video_id AND f.frame_index = r.frame_index + 1
) SELECT video_id, frame_index, moment FROM run WHERE moment IS NOT NULL"""

# -- clusters -------------------------------------------------------------------------------------------


def _clusters(points: str, near: str, least: int) -> str:
    """Clusters of ``points`` (id, video_id); ``near``: the condition for a and c to be near."""
    return f""", near2 AS MATERIALIZED (SELECT a.id AS a, c.id AS c FROM {points} a JOIN {points} c ON a.video_id = c.video_id AND {near}),
core AS MATERIALIZED (SELECT a AS id FROM near2 GROUP BY a HAVING count(*) >= {least}),
link AS MATERIALIZED (SELECT a, c FROM near2 WHERE a IN (SELECT id FROM core) AND c IN (SELECT id FROM core)),
reach AS (SELECT id, id AS seed FROM core UNION SELECT l.c, r.seed FROM reach r JOIN link l ON l.a = r.id WHERE l.c > r.seed),
root AS MATERIALIZED (SELECT id, min(seed) AS cluster FROM (SELECT id, seed FROM reach) GROUP BY id),
member AS MATERIALIZED (SELECT n.a AS id, coalesce(any_value(o.cluster), min(r.cluster)) AS cluster FROM near2 n JOIN root r ON r.id = n.c LEFT JOIN root o ON o.id = n.a GROUP BY n.a)"""


SQL["density_clusters"] = sql("detections", """, dots AS MATERIALIZED (SELECT *, video_id * 100000000 + row_number() OVER (PARTITION BY video_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, x_center, width, height, confidence) AS id FROM detections)"""
  + _clusters("dots", "sqrt((a.x_center - c.x_center)**2 + (a.y_center - c.y_center)**2) <= 0.02", 3)
  + """, inside AS MATERIALIZED (SELECT d.*, cluster, CASE WHEN label = 'hold' THEN NULL ELSE label END AS hold_type FROM dots d JOIN member USING (id)),
centre AS (SELECT video_id, cluster, avg(x_center) AS x, avg(y_center) AS y, avg(confidence) AS confidence, count(*) AS size FROM inside GROUP BY ALL),
radius AS (SELECT i.video_id, i.cluster, avg(sqrt((x_center - x)**2 + (y_center - y)**2)) + 0.01 AS radius FROM inside i JOIN centre USING (video_id, cluster) GROUP BY ALL),
lab AS (SELECT video_id, cluster, arg_min(label, (-n, label)) AS label FROM (SELECT video_id, cluster, label, count(*) AS n FROM inside GROUP BY ALL) GROUP BY ALL),
kind AS (SELECT video_id, cluster, arg_min(hold_type, (-n, hold_type)) AS hold_type, arg_min(c, (-n, hold_type)) AS hold_type_confidence FROM (SELECT video_id, cluster, hold_type, count(*) AS n, avg(confidence) AS c FROM inside WHERE hold_type IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT video_id, cluster, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y, round(confidence + 1e-9, 6) AS confidence, size, round(radius + 1e-9, 6) AS radius, label, hold_type, round(hold_type_confidence + 1e-9, 6) AS hold_type_confidence FROM centre JOIN radius USING (video_id, cluster) JOIN lab USING (video_id, cluster) LEFT JOIN kind USING (video_id, cluster)""")

_NAMES = "[" + ", ".join(f"'{c}'" for c in ROUTE_COLOURS) + "]"
SQL["colour_routes"] = "WITH RECURSIVE dom AS (" + rt.SQL["dominant_colour"] + """), dots AS MATERIALIZED (SELECT hold_id AS id, hold_id % 10 AS video_id, h, s, v, sin(radians(2.0::DOUBLE * h)) AS hs, cos(radians(2.0::DOUBLE * h)) AS hc, s::DOUBLE / 255 AS sn, v::DOUBLE / 255 AS vn FROM dom)""" + _clusters(
    "dots", "sqrt((a.hs - c.hs)**2 + (a.hc - c.hc)**2 + (a.sn - c.sn)**2 + (a.vn - c.vn)**2) <= 0.2", 1
) + f""", g AS (SELECT video_id, cluster, CAST(floor(avg(h)) AS INTEGER) AS h, CAST(floor(avg(s)) AS INTEGER) AS s, CAST(floor(avg(v)) AS INTEGER) AS v, string_agg(id::VARCHAR, ',' ORDER BY id) AS hold_ids, count(*) AS hold_count FROM dots JOIN member USING (id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cluster) - 1 AS k FROM g)
SELECT video_id, 'route_' || k::VARCHAR AS route_id, CASE WHEN k < {len(ROUTE_COLOURS)} THEN {_NAMES}[CAST(k AS INTEGER) + 1] ELSE 'color_' || k::VARCHAR END AS colour, h, s, v, hold_ids, hold_count FROM k"""

SQL["box_overlap"] = """WITH t AS MATERIALIZED (SELECT p_partkey // 20 AS video_id, f AS frame_index, p_partkey AS object_id, CAST(p_size AS DOUBLE) / 50 + ((p_partkey * 7 + f * 13) % 11 - 5) * 0.001::DOUBLE AS x,
  (CAST(p_retailprice AS DOUBLE) - floor(CAST(p_retailprice AS DOUBLE) / 100) * 100) / 100 + ((p_partkey * 5 + f * 17) % 13 - 6) * 0.001::DOUBLE AS y FROM part, (SELECT range AS f FROM range(40)) WHERE (p_partkey + f) % 5 <> 0),
g AS MATERIALIZED (SELECT *, CAST(floor(x / 0.05) AS BIGINT) AS cx, CAST(floor(y / 0.05) AS BIGINT) AS cy FROM t),
n AS MATERIALIZED (SELECT video_id, frame_index, object_id, x, y, cx + dx AS cx, cy + dy AS cy FROM g, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
o AS (SELECT g.video_id, g.frame_index, g.object_id, n.object_id AS other_id, greatest(0, 0.05 - abs(g.x - n.x)) * greatest(0, 0.05 - abs(g.y - n.y)) AS i FROM g JOIN n USING (video_id, frame_index, cx, cy) WHERE g.object_id < n.object_id)
SELECT video_id, frame_index, object_id, other_id, round(i / (0.005 - i), 6) AS iou FROM o WHERE i / (0.005 - i) > 0.000001"""

_COVER = "greatest(0, least(a.{c}_center + a.{s} / 2, o.{c}_center + o.{s} / 2) - greatest(a.{c}_center - a.{s} / 2, o.{c}_center - o.{s} / 2))"
SQL["detection_overlap"] = sql("detections", """, d AS MATERIALIZED (SELECT * EXCLUDE (width, height), row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS k, power(width, 3) * 100 AS width, power(height, 3) * 100 AS height FROM detections),
o AS (SELECT a.video_id, a.frame_index, """ + _COVER.format(c="x", s="width") + " * " + _COVER.format(c="y", s="height") + """ AS i, a.width * a.height + o.width * o.height AS total FROM d a JOIN d o ON a.video_id = o.video_id AND a.frame_index = o.frame_index AND a.k < o.k)
SELECT video_id, frame_index, count(*) AS pairs, round(sum(i / (total - i)), 6) AS overlap FROM o WHERE i / (total - i) >= 0.1 GROUP BY ALL""")

SQL["route_grade_report"] = ("SELECT h.* , s.* EXCLUDE (video_id), r.* EXCLUDE (video_id), CAST(NULL AS DOUBLE) AS grade, 0::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS band FROM (" + rt.SQL["route_holds"] + ") h JOIN (" + rt.SQL["hold_spacing"] + ") s USING (video_id) JOIN (" + rt.SQL["route_steps"] + ") r USING (video_id)")

# -- training data --------------------------------------------------------------------------------------

_J = ("left_wrist", "right_wrist", "left_ankle", "right_ankle", "left_hip", "right_hip", "left_shoulder", "right_shoulder")
_PARTS = [f"{j}_{k}{c}" for j in _J for k in ("", "v", "a") for c in "xy"] + ["com_x", "com_y", "com_vx", "com_vy", *[f"{p}_contact_on" for p in LIMBS], _ON, "body_scale", "0", "0"]
SQL["frame_vectors"] = sql(b.NEARED, CONTACTED + ", f1 AS (SELECT slow.*, states.* EXCLUDE (video_id, frame_index), " + ", ".join(f"{j}_{c} - lag({j}_{c}) {W} AS {j}_v{c}" for j in _J for c in "xy") + " FROM slow JOIN states USING (video_id, frame_index)), f2 AS (SELECT *, "
  + ", ".join(f"{j}_v{c} - lag({j}_v{c}) {W} AS {j}_a{c}" for j in _J for c in "xy") + " FROM f1) SELECT video_id, frame_index, array_to_string([" + ", ".join(f"CAST(round(coalesce({x}, 0) * 10000) AS BIGINT)" for x in _PARTS) + "], ',') AS vector FROM f2")

SQL["stratified_split"] = """WITH o AS (SELECT o_orderkey, CASE WHEN CAST(o_totalprice AS DOUBLE) / 400000 >= 0.6 THEN 1 ELSE 0 END::DOUBLE AS label, ('0x' || substr(md5(o_orderkey::VARCHAR || ':42'), 1, 8))::BIGINT AS h FROM orders),
n AS (SELECT label, h, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) OVER (PARTITION BY label) AS n FROM o),
c AS (SELECT label, max(CASE WHEN k = CAST(ceil(0.8 * n) AS BIGINT) THEN h END) AS cut FROM n GROUP BY label)
SELECT o_orderkey, label, h > cut AS is_test FROM o JOIN c USING (label)"""
