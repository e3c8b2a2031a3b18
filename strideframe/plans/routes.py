"""Queries over detections, holds, walls, routes, frame selection, training data and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideframe.functions.tables import stored
from strideframe.operators import efficiency, features, frames, grading, holds, kinematics, labels, metrics, mlprep, segments, wall
from strideframe.params import HOLD_TYPES, LIMBS
from strideframe.plans import body as b
from strideframe.plans import fixtures as fx
from strideframe.plans import steps as st
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


# -- detections and holds ------------------------------------------------------------------------------


def numbered_detections(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    d = fx.detections(spark, sf_dir).select("*", "det_id.*").drop("det_id")
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(*key, "x_center", "width", "height", "confidence"))
    return d.withColumn("det_id", F.col("video_id") * 100_000_000 + n).drop(*key)


@query("normalised_boxes", sql("detections", "SELECT video_id, count(*) AS n, round(sum(((x_center*640 - width*320) + (x_center*640 + width*320)) / 2 / 640), 4) AS x, round(sum(greatest(width, 1e-6)), 4) AS w, round(sum(greatest(height, 1e-6)), 4) AS h FROM detections GROUP BY video_id"))
def normalised_boxes(spark, sf_dir):
    """H1: boxes in pixels of a 640 x 480 image and back."""
    d = fx.detections(spark, sf_dir)
    half = lambda c, s, n: F.col(f"{c}_center") * n + s * F.col("width" if c == "x" else "height") * n / 2
    px = d.select("video_id", half("x", -1, 640).alias("x1"), half("x", 1, 640).alias("x2"), half("y", -1, 480).alias("y1"), half("y", 1, 480).alias("y2"))
    out = holds.normalise_boxes(px, F.lit(640), F.lit(480))
    return out.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x_center"), 4).alias("x"), F.round(F.sum("width"), 4).alias("w"), F.round(F.sum("height"), 4).alias("h"))


@query("wanted_detections", sql("detections", "SELECT video_id, CASE WHEN label = 'hold' THEN NULL ELSE label END AS hold_type, count(*) AS n FROM detections GROUP BY ALL"))
def wanted_detections(spark, sf_dir):
    """H2."""
    return holds.wanted(fx.detections(spark, sf_dir)).groupBy("video_id", "hold_type").agg(F.count(F.lit(1)).alias("n"))


REGION = "SELECT l_suppkey % 10 AS video_id, CAST(l_quantity AS DOUBLE) * 150 AS area, CAST(l_discount AS DOUBLE) * 10 AS solidity, CAST(l_tax AS DOUBLE) * 100 AS aspect, CAST(l_quantity AS DOUBLE) AS gradient, CAST(l_linenumber AS DOUBLE) * 5 AS variance, CAST(l_discount AS DOUBLE) * 1000 AS mean_s, l_returnflag = 'A' AS is_white, CAST(l_quantity AS DOUBLE) * 10 AS y2, 500::DOUBLE AS image_height, l_linenumber + 2 AS vertices, 0.9::DOUBLE + CAST(l_tax AS DOUBLE) AS straightness FROM lineitem"


def regions(spark, sf_dir):
    q, dc, t = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    return fx.read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("video_id"), (q * 150).alias("area"), (dc * 10).alias("solidity"), (t * 100).alias("aspect"), q.alias("gradient"), (F.col("l_linenumber").cast("double") * 5).alias("variance"), (dc * 1000).alias("mean_s"),
        (F.col("l_returnflag") == "A").alias("is_white"), (q * 10).alias("y2"), F.lit(500.0).alias("image_height"), (F.col("l_linenumber") + 2).alias("vertices"), (0.9 + t).alias("straightness"),
    )


@query("screened_regions", f"WITH r AS ({REGION}) SELECT video_id, CASE WHEN is_white AND (area < 200 OR solidity < 0.3 OR aspect > 5 OR gradient < 5) THEN 'chalk' WHEN variance < 15 AND mean_s < 50 AND (y2 > 0.85 * image_height OR area > 3000) THEN 'safety' WHEN area >= 5000 AND vertices BETWEEN 4 AND 8 AND straightness > 0.95 AND aspect > 0.4 AND aspect < 2.5 THEN 'volume' ELSE 'valid' END AS verdict, count(*) AS n FROM r GROUP BY ALL")
def screened_regions(spark, sf_dir):
    """H3, H5."""
    return holds.verdict_counts(holds.screen_regions(regions(spark, sf_dir)))


PIXELS = "SELECT l_suppkey AS hold_id, CAST(l_quantity AS DOUBLE) * 3 AS h, CAST(l_discount AS DOUBLE) * 2000 AS s, CAST(l_tax AS DOUBLE) * 3000 AS v FROM lineitem"


def pixels(spark, sf_dir):
    c = lambda n, k: F.col(n).cast("double") * k
    return fx.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("hold_id"), c("l_quantity", 3).alias("h"), c("l_discount", 2000).alias("s"), c("l_tax", 3000).alias("v"))


@query("colour_statistics", f"WITH p AS ({PIXELS}), a AS (SELECT hold_id, count(*) AS pixels, avg(s) AS ms, avg(v) AS mv, stddev_pop(s) AS ss, stddev_pop(v) AS sv, stddev_pop(h) AS sh FROM p GROUP BY hold_id) SELECT hold_id, pixels, round(ms, 6) AS mean_s, round(mv, 6) AS mean_v, round(ss, 6) AS std_s, round(sv, 6) AS std_v, round(sqrt(((sh - (sh+ss+sv)/3)**2 + (ss - (sh+ss+sv)/3)**2 + (sv - (sh+ss+sv)/3)**2) / 3), 6) AS channel_spread, ms < 50 AND mv > 200 AS is_white, ms < 50 AND mv > 100 AND mv < 180 AS is_gray FROM a")
def colour_statistics(spark, sf_dir):
    """H4."""
    return b.rounded(holds.colour_statistics(pixels(spark, sf_dir), ["hold_id"]))


@query("dominant_colour", f"WITH p AS ({PIXELS}), n AS (SELECT hold_id, floor(h/32) AS bh, floor(s/32) AS bs, floor(v/32) AS bv, count(*) AS n, avg(h) AS h, avg(s) AS s, avg(v) AS v FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY hold_id ORDER BY n DESC, bh, bs, bv) AS k, sum(n) OVER (PARTITION BY hold_id) AS total FROM n) SELECT hold_id, CAST(floor(h) AS INTEGER) AS h, CAST(floor(s) AS INTEGER) AS s, CAST(floor(v) AS INTEGER) AS v, round(n / total, 6) AS colour_confidence FROM k WHERE k = 1")
def dominant_colour(spark, sf_dir):
    """H14."""
    return b.rounded(holds.dominant_colour(pixels(spark, sf_dir), ["hold_id"]))


@query("colour_routes")
def colour_routes(spark, sf_dir):
    """Holds of near colours in each video; components, tested by brute force."""
    c = holds.dominant_colour(pixels(spark, sf_dir), ["hold_id"]).withColumn("video_id", F.col("hold_id") % 10)
    return holds.routes(holds.colour_groups(c, 0.2)).withColumn("hold_ids", F.concat_ws(",", "hold_ids"))


@query("density_clusters")
def density_clusters(spark, sf_dir):
    """H6, H7: clusters of detections with their holds; tested by brute force."""
    d = holds.wanted(numbered_detections(spark, sf_dir))
    out = holds.cluster_holds(holds.density_clusters(d, 0.02, 3, "det_id"))
    return b.rounded(out.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else c for c, t in out.dtypes]))  # means of few decimals may tie: away from that


@query("box_overlap")
def box_overlap(spark, sf_dir):
    """H8: overlapping boxes of one frame."""
    pairs = holds.overlaps(fx.tracked_boxes(spark, sf_dir), ("video_id", "frame_index"), "object_id").where(F.col("iou") > 0.000001)
    return b.rounded(pairs.withColumnRenamed("other_object_id", "other_id"))


@query("detection_overlap")
def detection_overlap(spark, sf_dir):
    """H8 on boxes of many sizes: how many detections of one frame cover each other by a tenth and more."""
    sized = fx.detections(spark, sf_dir).withColumn("width", F.pow("width", 3) * 100).withColumn("height", F.pow("height", 3) * 100)
    return b.rounded(holds.overlap_totals(sized, ("video_id", "frame_index"), 0.1))


@query("hold_tracks")
def hold_tracks(spark, sf_dir):
    """H9 to H11; tested against plain Python."""
    return b.rounded(holds.track(fx.tracked_boxes(spark, sf_dir)))


@query("tracked_holds")
def tracked_holds(spark, sf_dir):
    """H12, H13."""
    return b.rounded(holds.holds_of(fx.tracked_boxes(spark, sf_dir)))


@query("screened_masks", "WITH m AS (SELECT l_suppkey % 10 AS video_id, CAST(l_quantity AS DOUBLE) * 8 AS w, CAST(l_linenumber AS DOUBLE) * 40 AS h, CAST(l_quantity AS DOUBLE) * 8 * CAST(l_linenumber AS DOUBLE) * 40 * (0.2 + CAST(l_discount AS DOUBLE) * 5) AS area, CAST(l_quantity AS DOUBLE) * 20 AS perimeter, CAST(l_tax AS DOUBLE) * 100 AS e FROM lineitem) SELECT video_id, count(*) AS n FROM m WHERE NOT (area > 0.15 * 640 * 480 OR greatest(w, h) / greatest(least(w, h), 1e-9) > 10 OR w > 0.6 * 640 OR h > 0.6 * 480 OR (area / (w * h) < 0.3 AND perimeter > 240) OR e < 0.9 * 3) GROUP BY video_id")
def screened_masks(spark, sf_dir):
    """H17."""
    q, d, t, n = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))
    m = fx.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("video_id"), (q * 8).alias("w"), (n * 40).alias("h"), (q * 8 * n * 40 * (0.2 + d * 5)).alias("area"), (q * 20).alias("perimeter"), (t * 100).alias("mean_edge"), F.lit(3.0).alias("image_mean_edge"), F.lit(640.0).alias("image_width"), F.lit(480.0).alias("image_height"))
    return holds.screen_masks(m).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


@query("class_mask", "SELECT l_orderkey AS image_id, arg_min(l_partkey, (l_linenumber, l_partkey)) AS mask_id FROM lineitem WHERE lower(l_returnflag) = 'a' GROUP BY l_orderkey")
def class_mask(spark, sf_dir):
    """H18."""
    m = fx.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("mask_id"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.col("l_returnflag").alias("class_name"))
    return holds.class_mask(m, "A", ["image_id"])


# -- wall ----------------------------------------------------------------------------------------------

LINES = "SELECT l_suppkey AS image_id, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) * 100 AS y1, CAST(l_linenumber AS DOUBLE) AS x2, CAST(l_tax AS DOUBLE) * 100 AS y2 FROM lineitem"
MOD = "(({x}) - 180 * floor(({x}) / 180))"
_LA = "degrees(atan2(y2 - y1, x2 - x1))"
WALL = (
    f"WITH l AS ({LINES}), a AS (SELECT image_id, count(*) AS lines, degrees(atan2(sum(sin(radians({MOD.format(x=_LA)}))), sum(cos(radians({MOD.format(x=_LA)}))))) AS s FROM l WHERE x1 <> x2 OR y1 <> y2 GROUP BY image_id), "
    + "p AS (SELECT image_id, degrees(0.5 * atan2(2 * covar_samp(x1, y1), var_samp(x1) - var_samp(y1))) AS q FROM l GROUP BY image_id HAVING count(*) >= 3), "
    + f"f AS (SELECT image_id, lines, {MOD.format(x='s')} AS line, {MOD.format(x='q')} AS axis FROM a LEFT JOIN p USING (image_id)) SELECT image_id, lines, round(line, 4) AS line_angle, round(axis, 4) AS axis_angle, round(CASE WHEN axis IS NOT NULL AND abs(line - axis) < 15 THEN (line + axis) / 2 ELSE line END, 4) AS angle, CASE WHEN axis IS NOT NULL AND abs(line - axis) < 15 THEN 0.9::DOUBLE WHEN axis IS NOT NULL THEN 0.6::DOUBLE WHEN lines >= 5 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN axis IS NOT NULL AND abs(line - axis) < 15 THEN 'hough+pca' ELSE 'hough' END AS method FROM f"
)


@query("wall_angle", WALL)
def wall_angle(spark, sf_dir):
    """W1 to W3."""
    c = lambda n, k=1: F.col(n).cast("double") * k
    lines = fx.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), c("l_quantity").alias("x1"), c("l_discount", 100).alias("y1"), c("l_linenumber").alias("x2"), c("l_tax", 100).alias("y2"))
    points = lines.select("image_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    both = wall.line_angle(lines, ["image_id"]).join(wall.principal_axis(points, ["image_id"]).drop("points").hint("merge"), "image_id", "left")
    angle, confidence, method = wall.fuse(F.col("line_angle"), F.col("axis_angle"), F.col("lines"))
    r = lambda x, n: F.round(x, 4).alias(n)
    return both.select("image_id", "lines", r(F.col("line_angle"), "line_angle"), r(F.col("axis_angle"), "axis_angle"), r(angle, "angle"), confidence.alias("confidence"), method.alias("method"))


_S = "(2 * (e[1] * e[3] - e[4] * e[2]))"


@query("device_angle", sql("pose_frames", f"SELECT vec_id, CASE WHEN video_id % 3 <> 0 THEN round(least(abs(CASE WHEN video_id % 3 = 0 THEN NULL WHEN abs({_S}) >= 1 THEN sign({_S}) * 90 ELSE degrees(asin({_S})) END), 180), 6) END AS angle, CASE WHEN video_id % 3 = 0 THEN 0::DOUBLE WHEN abs(degrees(atan2(2 * (e[1]*e[2] + e[3]*e[4]), 1 - 2 * (e[2]**2 + e[3]**2)))) > 45 THEN 0.7::DOUBLE ELSE 1::DOUBLE END AS confidence, CASE WHEN video_id % 3 = 0 THEN 'imu_missing' ELSE 'imu_sensor' END AS method FROM pose_frames"))
def device_angle(spark, sf_dir):
    """The first four numbers of a vector as a quaternion; every third video has none."""
    q = F.when(F.col("video_id") % 3 != 0, F.slice("e", 1, 4))
    angle, confidence, method = wall.device_angle(q, F.lit(None).cast("array<double>"))
    return fx.pose_frames(spark, sf_dir).select("vec_id", F.round(angle, 6).alias("angle"), confidence.alias("confidence"), method.alias("method"))


_T = "radians(60 + video_id)"
fx.CTE["angles"] = f"SELECT DISTINCT video_id, CASE video_id % 4 WHEN 0 THEN 95::DOUBLE WHEN 1 THEN degrees(asin(2 * cos({_T} / 2) * sin({_T} / 2))) WHEN 2 THEN least(abs(-20.0 - video_id), 180)::DOUBLE ELSE CASE WHEN video_id % 8 = 3 THEN 88::DOUBLE END END AS a FROM pose_frames"


@query("wall_angle_sources", sql("pose_frames landmarks wide sessions body angles", """
SELECT video_id, frame_index, round(a, 6) AS wall_angle, round(least(abs(hip_line_inclination - a) % 180, 180 - abs(hip_line_inclination - a) % 180), 6) AS hip_alignment_error,
  round(com_x * cos(radians(a)) + com_y * sin(radians(a)), 6) AS com_along_wall, round(-com_x * sin(radians(a)) + com_y * cos(radians(a)), 6) AS com_perp_wall FROM body JOIN angles USING (video_id)"""))
def wall_angle_sources(spark, sf_dir):
    """Of four videos one has a given angle, one a device's quaternion, one its angles, one what an image shows or nothing."""
    v, turn = F.col("video_id"), F.radians(60.0 + F.col("video_id")) / 2
    quaternion = F.when(v % 4 == 1, F.array(F.cos(turn), F.lit(0.0), F.sin(turn), F.lit(0.0)))
    angles = F.when(v % 4 == 2, F.array(-20.0 - v, F.lit(0.0), F.lit(0.0)))
    rows = b.frames(spark, sf_dir).withColumn("wall_angle", features.resolve_wall_angle(F.when(v % 4 == 0, 95.0), quaternion, angles, F.when(v % 8 == 3, 88.0)))
    out = features.body_features(rows, None, F.col("wall_angle"))
    return b.rounded(out.select("video_id", "frame_index", "wall_angle", "hip_alignment_error", "com_along_wall", "com_perp_wall"))


# -- routes --------------------------------------------------------------------------------------------


@query("route_holds", sql("holds", "SELECT video_id, count(*) AS hold_count, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y)) + 1e-6), 4) AS hold_density, " + ", ".join(f"round(avg(CASE WHEN hold_type = '{t}' THEN 1::DOUBLE ELSE 0 END), 6) AS {t}_ratio" for t in HOLD_TYPES) + " FROM holds GROUP BY video_id"))
def route_holds(spark, sf_dir):
    """D1, D6."""
    out = b.rounded(grading.hold_features(fx.holds(spark, sf_dir)))
    return out.withColumn("hold_density", F.round("hold_density", 4))


@query("hold_spacing", sql("holds", "SELECT video_id, round(coalesce(avg(d), 0), 6) AS spacing_mean, round(coalesce(median(d), 0), 6) AS spacing_median, round(coalesce(stddev_pop(d), 0), 6) AS spacing_std, round(coalesce(min(d), 0), 6) AS spacing_min, round(coalesce(max(d), 0), 6) AS spacing_max FROM (SELECT DISTINCT video_id FROM holds) LEFT JOIN (SELECT a.video_id, sqrt((a.x - c.x)**2 + (a.y - c.y)**2) AS d FROM holds a JOIN holds c ON a.video_id = c.video_id AND a.hold_ord < c.hold_ord AND c.y < a.y) USING (video_id) GROUP BY video_id"))
def hold_spacing(spark, sf_dir):
    """D2."""
    return b.rounded(grading.spacing(fx.holds(spark, sf_dir)))


def _route_parts(spark, sf_dir):
    t = st.touching(spark, sf_dir).select("*", F.lit(None).cast("double").alias("wall_angle"))
    tens = st.tens(t)
    times = t.select("video_id", F.col("frame_index").alias("start_index"), F.col("ts").alias("start_time"))
    ends = t.select("video_id", F.col("frame_index").alias("end_index"), F.col("ts").alias("end_time"))
    timed = tens.join(times.hint("merge"), ["video_id", "start_index"]).join(ends.hint("merge"), ["video_id", "end_index"])
    rows = segments.within(t, tens).join(timed.select("video_id", "segment_id", "start_time", "end_time").hint("merge"), ["video_id", "segment_id"])
    scores = efficiency.step_scores(t, tens, key="segment_id")
    return t, scores, grading.switch_rate(rows, "segment_id")


@query("route_steps", sql(b.NEARED, st.TOUCH + st.TENS + st.EFF + ", g AS (SELECT video_id, segment_id, avg(reach_penalty) AS reach_penalty, 0.35 * avg(stability) + 0.25 * CASE WHEN count(*) >= 2 THEN sqrt((arg_max(com_x, frame_index) - arg_min(com_x, frame_index))**2 + (arg_max(com_y, frame_index) - arg_min(com_y, frame_index))**2) / (sum(hop) + 1e-6) ELSE 0 END - (0.2 * avg(support_penalty) + 0.1 * avg(wall_penalty) + 0.07 * avg(jerk_penalty) + 0.03 * avg(reach_penalty)) AS score FROM es GROUP BY ALL), sw AS (SELECT c.video_id, segment_id, CASE WHEN row_number() OVER k > 1 THEN " + " + ".join(f"CASE WHEN {p}_contact_hold IS DISTINCT FROM lag({p}_contact_hold) OVER k THEN 1 ELSE 0 END" for p in LIMBS) + " ELSE 0 END AS s, (end_index - start_index)::DOUBLE / 25 AS d FROM touch c JOIN tens USING (video_id) WHERE c.frame_index BETWEEN start_index AND end_index WINDOW k AS " + st.K + "), r AS (SELECT video_id, sum(s) / (sum(d) + 1e-6) AS switch_rate FROM (SELECT video_id, segment_id, sum(s) AS s, max(d) AS d FROM sw GROUP BY ALL) GROUP BY video_id), x AS (SELECT video_id, max(com_y) - min(com_y) AS route_length, max(ts) - min(ts) AS route_duration FROM touch GROUP BY video_id) SELECT video_id, round(any_value(route_length), 6) AS route_length, round(any_value(route_duration), 6) AS route_duration, 90::DOUBLE AS wall_angle, count(*) AS step_count, round(avg(score), 4) AS efficiency_mean, round(min(score), 4) AS efficiency_min, round(max(score), 4) AS efficiency_max, round(stddev_pop(score), 4) AS efficiency_std, round(avg(reach_penalty), 4) AS reach_mean, round(max(reach_penalty), 4) AS reach_max, round(any_value(switch_rate), 4) AS switch_rate FROM g JOIN r USING (video_id) JOIN x USING (video_id) GROUP BY video_id"))
def route_steps(spark, sf_dir):
    """D3 to D5, D7."""
    t, scores, switching = _route_parts(spark, sf_dir)
    out = grading.route_extent(t)
    for part in (grading.route_wall_angle(t, F.lit(None).cast("double")), grading.step_features(scores), switching):
        out = out.join(part.hint("merge"), "video_id")
    return out.select(*[F.round(c, 6 if c in ("route_length", "route_duration", "wall_angle") else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("grade_model")
def grade_model(spark, sf_dir):
    """D8 to D11 on customers: sizes of their orders stand for route features."""
    o = fx.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("o_totalprice").cast("double")).alias("mean"), F.coalesce(F.stddev_pop(F.col("o_totalprice").cast("double")), F.lit(0.0)).alias("std"), F.max(F.col("o_totalprice").cast("double")).alias("high"))
    data = o.withColumn("grade", F.least(F.lit(10.0), F.col("mean") / 30000 + F.col("n") / 10))
    columns = ["n", "mean", "std", "high"]
    return b.rounded(grading.predict_grades(grading.fit_grades(data, columns), data.drop("grade"), columns).select("video_id", "grade", "confidence", "band"), 4)


@query("route_grade_report")
def route_grade_report(spark, sf_dir):
    """D11 without a model: the features D1 to D7 of each route, its grade unknown."""
    t, scores, switching = _route_parts(spark, sf_dir)
    out = grading.grade_report(grading.route_features(fx.holds(spark, sf_dir), t, scores, switching), [])
    long = ("route_length", "route_duration", "wall_angle")
    return out.select(*[F.round(c, 6 if c in long or c.startswith("spacing") or c.endswith("_ratio") else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("graded_routes")
def graded_routes(spark, sf_dir):
    """D8 to D11 with a model: routes' features, a grade learnt from half of them (a route's mean reach stands for its label) and given to all."""
    t, scores, switching = _route_parts(spark, sf_dir)
    features = stored(grading.route_features(fx.holds(spark, sf_dir), t, scores, switching), "route_features")
    columns = [c for c, kind in features.dtypes if c != "video_id"]
    known = features.where("video_id % 2 = 0").withColumn("grade", F.least(F.lit(10.0), 2 * F.col("reach_mean")))
    return b.rounded(grading.grade_report(features, columns, grading.fit_grades(known, columns, depth=3, rounds=5)).select("video_id", "grade", "confidence", "band"), 4)


@query("grade_bands", "SELECT o_orderkey AS id, CASE WHEN g >= 10 THEN 'Elite (V10+)' ELSE ['Beginner', 'Intermediate', 'Advanced', 'Expert', 'Elite'][CAST(floor(g / 2) AS INTEGER) + 1] || ' (V' || CAST(CAST(floor(g) AS INTEGER) AS VARCHAR) || ')' END AS band FROM (SELECT o_orderkey, least(10, CAST(o_totalprice AS DOUBLE) / 40000) AS g FROM orders)")
def grade_bands(spark, sf_dir):
    """D10."""
    g = F.least(F.lit(10.0), F.col("o_totalprice").cast("double") / 40000)
    return fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), grading.grade_band(g).alias("band"))


# -- frame selection -----------------------------------------------------------------------------------


def clip_frames(spark, sf_dir):
    """Events as frames with a motion score."""
    return fx.contact_rows(spark, sf_dir).select("video_id", "frame_index", "event_type", (F.col("com_x") * 10).alias("motion_score"))


@query("interval_sample", sql("contact_events contact_rows", f"SELECT video_id, frame_index, CAST(row_number() {W} - 1 AS BIGINT) AS saved_index, round(frame_index::DOUBLE / 25, 6) AS timestamp FROM contact_rows WHERE frame_index % 12 = 0"))
def interval_sample(spark, sf_dir):
    """F1."""
    return b.rounded(frames.sample_interval(clip_frames(spark, sf_dir), 25, 0.5).select("video_id", "frame_index", "saved_index", "timestamp"))


@query("low_motion", sql("contact_events contact_rows", "SELECT video_id, frame_index FROM (SELECT *, max(CASE WHEN com_x * 10 < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS any_in FROM contact_rows) WHERE com_x * 10 < 0.5 OR any_in = 0"))
def low_motion(spark, sf_dir):
    """F2."""
    return frames.low_motion(clip_frames(spark, sf_dir), 0.5).select("video_id", "frame_index")


@query("pose_similarity", sql("pose_frames landmarks", ", s AS (SELECT * FROM landmarks WHERE visibility >= 0.5) SELECT f.video_id, f.frame_index, round(coalesce(max(v), 0), 6) AS similarity FROM (SELECT DISTINCT video_id, frame_index FROM landmarks) f LEFT JOIN (SELECT a.video_id, a.frame_index, 1 / (1 + 2 * avg(sqrt((a.x - c.x)**2 + (a.y - c.y)**2))) AS v FROM s a JOIN s c ON a.video_id = c.video_id AND a.name = c.name AND a.frame_index = c.frame_index + 1 GROUP BY ALL) v USING (video_id, frame_index) GROUP BY ALL"))
def pose_similarity(spark, sf_dir):
    """F3."""
    return b.rounded(frames.consecutive_similarity(fx.landmarks(spark, sf_dir)))


def pose_rows(spark, sf_dir):
    return fx.landmarks(spark, sf_dir).groupBy("video_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "x", "y", "visibility"))).alias("landmarks"))


@query("diverse_frames")
def diverse_frames(spark, sf_dir):
    """greedy; tested against plain Python."""
    return frames.at_least_three(frames.diverse(pose_rows(spark, sf_dir))).where("kept").select("video_id", "frame_index")


@query("spaced_frames", sql("pose_frames", "SELECT video_id, frame_index FROM pose_frames WHERE frame_index % 5 = 0"))
def spaced_frames(spark, sf_dir):
    """F5; without gaps in the frames it keeps every fifth."""
    return frames.spaced(fx.pose_frames(spark, sf_dir).select("video_id", "frame_index")).where("kept").select("video_id", "frame_index")


_V = {n: f"max(CASE WHEN name = '{n}' AND visibility >= 0.5 THEN x END) AS {n}_x, max(CASE WHEN name = '{n}' AND visibility >= 0.5 THEN y END) AS {n}_y" for n in frames.FASTEST}


@query("limb_velocity", sql("pose_frames landmarks", ", w AS (SELECT video_id, frame_index, " + ", ".join(_V.values()) + " FROM landmarks GROUP BY ALL), v AS (SELECT video_id, frame_index, " + ", ".join(f"coalesce(sqrt(({n}_x - lag({n}_x) {W})**2 + ({n}_y - lag({n}_y) {W})**2), 0) AS {n}" for n in frames.FASTEST) + " FROM w) SELECT video_id, frame_index, " + ", ".join(f"round({n}, 6) AS {n}_velocity" for n in frames.FASTEST) + f", round(greatest({', '.join(frames.FASTEST)}), 6) AS velocity FROM v"))
def limb_velocity(spark, sf_dir):
    """F7."""
    return b.rounded(frames.limb_velocity(fx.landmarks(spark, sf_dir)))


@query("contact_moments")
def contact_moments(spark, sf_dir):
    """F8 with thresholds that the views reach; tested against plain Python."""
    return frames.contact_moments(frames.limb_velocity(fx.landmarks(spark, sf_dir)), 0.3, 0.25)


@query("capped_frames", sql("pose_frames", "SELECT video_id, frame_index FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM pose_frames) WHERE n <= 30 OR (frame_index % (n // 30) = 0 AND frame_index // (n // 30) < 30)"))
def capped_frames(spark, sf_dir):
    """F9."""
    return frames.cap(fx.pose_frames(spark, sf_dir).select("video_id", "frame_index")).select("video_id", "frame_index")


@query("detector_selection", sql("detections", ", d AS (SELECT *, CASE label WHEN 'crimp' THEN 'climber' ELSE label END AS l FROM detections), f AS (SELECT video_id, frame_index, max(confidence) FILTER (l = 'climber') AS r, max(confidence) FILTER (l IN ('jug', 'hold')) AS s FROM d GROUP BY ALL), k AS (SELECT *, coalesce(r >= 0.6, false) AND coalesce(s >= 0.6, false) AS ok FROM f), m AS (SELECT *, max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS any_in FROM k) SELECT video_id, frame_index, round(coalesce(s, 0), 6) AS score, CAST(row_number() " + W + " - 1 AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(s, 0) DESC, frame_index) AS rk FROM m WHERE ok OR any_in = 0) WHERE rk <= 10"))
def detector_selection(spark, sf_dir):
    """F10, F11."""
    return b.rounded(frames.detector_selection(fx.detections(spark, sf_dir), ("climber",), ("jug", "hold"), 0.6, 10, {"crimp": "climber"}))


@query("grey_difference", sql("pose_frames", f"SELECT vec_id, round(coalesce(list_sum(list_transform(range(1, 65), lambda i: abs(e[i] - prev[i]))) / 64 / 255, 0), 8) AS difference FROM (SELECT *, lag(e) {W} AS prev FROM pose_frames)"))
def grey_difference(spark, sf_dir):
    """F12."""
    out = frames.grey_difference(fx.pose_frames(spark, sf_dir).withColumnRenamed("e", "pixels"))
    return out.select("vec_id", F.round("difference", 8).alias("difference"))


@query("manifest_selection", sql("contact_events contact_rows", ", m AS (SELECT video_id, frame_index, 'f' || frame_index AS relative_path, com_x >= 0.99 AS sel FROM contact_rows), k AS (SELECT *, max(CASE WHEN sel THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS any_in FROM m) SELECT video_id, frame_index, relative_path FROM k WHERE sel OR any_in = 0"))
def manifest_selection(spark, sf_dir):
    """A manifest joined with its scores, filtered by the chosen frames, or whole where none is chosen."""
    rows = fx.contact_rows(spark, sf_dir).select("video_id", "frame_index", F.col("frame_index").alias("ordinal"), F.concat(F.lit("f"), F.col("frame_index").cast("string")).alias("relative_path"), "com_x")
    zipped = frames.zip_manifest(rows.drop("com_x"), rows.select("video_id", "ordinal", F.col("com_x").alias("probability")), rows.select("video_id", "ordinal", (F.col("com_x") > 0.5).alias("hold_changed")))
    return frames.filter_manifest(zipped, frames.key_frames(zipped, 0.99)).select("video_id", "frame_index", "relative_path")


@query("key_labels", sql("contact_events contact_rows", "SELECT video_id, sum(CASE WHEN event_type = 'click' THEN 1::DOUBLE ELSE 0 END) AS chosen, count(*) AS n FROM contact_rows GROUP BY video_id"))
def key_labels(spark, sf_dir):
    """F16."""
    rows = fx.contact_rows(spark, sf_dir).withColumn("file_name", F.col("event_id").cast("string"))
    return frames.key_labels(rows, rows.where("event_type = 'click'")).groupBy("video_id").agg(F.sum("label").alias("chosen"), F.count(F.lit(1)).alias("n"))


# -- training data -------------------------------------------------------------------------------------


@query("frame_vectors")
def frame_vectors(spark, sf_dir):
    """M1: the vectors in ten thousandths."""
    v = mlprep.frame_vector(kinematics.derivatives(b.contacted(spark, sf_dir), 1.0, mlprep.VECTOR_JOINTS))
    return v.select("video_id", "frame_index", F.array_join(F.transform("vector", lambda x: F.round(x * 10000).cast("bigint").cast("string")), ",").alias("vector"))


_H = ", ".join(f"lead({p}_contact_hold, {{k}}) {W} AS n{{k}}_{i}" for i, p in enumerate(LIMBS))


@query("next_action", sql("contact_events contact_rows", ", n AS (SELECT *, lead(frame_index, 5) " + W + " AS fin, " + ", ".join(_H.format(k=k) for k in range(1, 6)) + " FROM contact_rows) SELECT video_id, frame_index, CAST(CASE WHEN fin IS NULL THEN 0 " + " ".join(f"WHEN n{k}_{i} IS NOT NULL AND n{k}_{i} IS DISTINCT FROM {p}_contact_hold THEN {i + 1}" for k in range(1, 6) for i, p in enumerate(LIMBS)) + " ELSE 0 END AS INTEGER) AS action FROM n"))
def next_action(spark, sf_dir):
    """M2."""
    return mlprep.next_action(fx.contact_rows(spark, sf_dir)).select("video_id", "frame_index", "action")


@query("sliding_windows", sql("pose_frames", f"SELECT video_id, frame_index AS start_frame, frame_index + 31 AS end_frame, frame_index + 16 AS centre_frame, 32 AS size, round(s, 5) AS total FROM (SELECT *, sum(e[1]) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS s, lead(frame_index, 31) {W} AS fin FROM pose_frames) WHERE fin IS NOT NULL AND frame_index % 2 = 0"))
def sliding_windows(spark, sf_dir):
    """M3, M15."""
    w = mlprep.windows(fx.pose_frames(spark, sf_dir).withColumn("value", F.col("e")[0]), 32, 2, ("value",))
    return w.select("video_id", "start_frame", "end_frame", "centre_frame", F.size("value").alias("size"), F.round(F.aggregate("value", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("ordered_split", "SELECT o_orderkey, CASE WHEN k < CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN k < CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.2) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)")
def ordered_split(spark, sf_dir):
    """M4."""
    return mlprep.ordered_split(fx.read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "split")


@query("normalised_columns", sql("contact_events contact_rows", ", t AS (SELECT avg(com_x) AS mx, stddev_pop(com_x) AS sx, avg(com_y) AS my, stddev_pop(com_y) AS sy FROM contact_rows WHERE frame_index < 40) SELECT event_id, round((com_x - mx) / (sx + 1e-8), 5) AS com_x, round((com_y - my) / (sy + 1e-8), 5) AS com_y FROM contact_rows, t"))
def normalised_columns(spark, sf_dir):
    """M5."""
    from strideframe.operators.kinematics import normalise

    rows = fx.contact_rows(spark, sf_dir).select("event_id", "frame_index", "com_x", "com_y")
    return b.rounded(normalise(rows, ["com_x", "com_y"], rows.where("frame_index < 40"), add=True).drop("frame_index"), 5)


@query("encoded_columns", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def encoded_columns(spark, sf_dir):
    """M6."""
    c = fx.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_nationkey")
    return mlprep.encode(c, ["c_nationkey"], ["c_mktsegment"])


@query("stratified_split")
def stratified_split(spark, sf_dir):
    """M7, M8."""
    o = fx.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 400000).alias("efficiency"))
    return mlprep.stratified_split(mlprep.threshold_label(o, "efficiency"), "o_orderkey").select("o_orderkey", "label", "is_test")


@query("boosted_baseline")
def boosted_baseline(spark, sf_dir):
    """Importances of a boosted classifier."""
    o = fx.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_custkey") % 7).cast("double").alias("a"), (F.col("o_orderkey") % 5).cast("double").alias("c"))
    data = mlprep.stratified_split(mlprep.threshold_label(o, "price", 200000.0), "o_orderkey")
    _, importances = mlprep.fit_boosted(data, ["price", "a", "c"])
    return spark.createDataFrame([(n, float(v)) for n, v in importances], "feature string, importance double")


PRED = "SELECT doc_id, quality AS label, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS predicted, (doc_id % 97)::DOUBLE / 97 AS score FROM labels"


def predictions(spark, sf_dir):
    return fx.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("predicted"), ((F.col("doc_id") % 97) / 97.0).alias("score"))


@query("binary_report", f"WITH p AS ({PRED}), c AS (SELECT sum(CASE WHEN label=1 AND predicted=1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN label=0 AND predicted=1 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN label=1 AND predicted=0 THEN 1 ELSE 0 END)::DOUBLE AS fn, count(*)::DOUBLE AS n FROM p) SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def binary_report(spark, sf_dir):
    """M10."""
    return b.rounded(metrics.binary_report(predictions(spark, sf_dir)))


@query("regression_report", f"WITH p AS ({PRED}) SELECT round(avg((label - score)**2), 6) AS mse, round(avg(abs(label - score)), 6) AS mae, round(sqrt(avg((label - score)**2)), 6) AS rmse, round(corr(label, score), 6) AS pearson, round(1 - avg((label - score)**2) / var_pop(label), 6) AS r2 FROM p")
def regression_report(spark, sf_dir):
    """M10, M11."""
    return b.rounded(metrics.regression_report(predictions(spark, sf_dir), predicted="score"))


CLASSES = "SELECT CAST(doc_id % 5 AS INTEGER) AS label, CAST((doc_id + quality + toxic * 2) % 5 AS INTEGER) AS predicted FROM labels"


@query("confusion_matrix", f"WITH p AS ({CLASSES}), g AS (SELECT CAST(a.range AS INTEGER) AS label, CAST(c.range AS INTEGER) AS predicted FROM range(5) a, range(5) c) SELECT g.label, g.predicted, count(p.label) AS n FROM g LEFT JOIN p USING (label, predicted) GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    """M12."""
    return metrics.confusion(fx.read(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("label"), ((F.col("doc_id") + F.col("quality") + F.col("toxic") * 2) % 5).alias("predicted")))


@query("class_accuracy", f"WITH p AS ({CLASSES}) SELECT label, round(avg(CASE WHEN label = predicted THEN 1::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM p GROUP BY label")
def class_accuracy(spark, sf_dir):
    """M12."""
    return b.rounded(metrics.class_accuracy(confusion_matrix(spark, sf_dir)))


@query("roc_auc", f"WITH p AS ({PRED}), c AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM p GROUP BY score), r AS (SELECT pos * (coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS w, pos, neg FROM c) SELECT round(sum(w) / (sum(pos) * sum(neg)), 6) AS auc FROM r")
def roc_auc(spark, sf_dir):
    """M13."""
    return b.rounded(metrics.roc_auc(predictions(spark, sf_dir)))


_E = "[exp(e[1]), exp(e[2]), exp(e[3]), exp(e[4]), exp(e[5])]"


@query("decoded_actions", sql("pose_frames", f"SELECT vec_id, round({_E}[1] / list_sum({_E}), 6) AS none_share, ['none', 'left_hand', 'right_hand', 'left_foot', 'right_foot'][list_position({_E}, list_max({_E}))] AS action FROM pose_frames"))
def decoded_actions(spark, sf_dir):
    """M16."""
    soft, name = mlprep.decode(F.slice("e", 1, 5))
    return fx.pose_frames(spark, sf_dir).select("vec_id", F.round(soft[0], 6).alias("none_share"), name.alias("action"))


@query("loss_report", sql("pose_frames", f", p AS (SELECT abs(e[6] * 20 - e[7] * 20) AS d, ({_E}[CAST(vec_id % 5 AS INTEGER) + 1]) / list_sum({_E}) AS q FROM pose_frames), m AS (SELECT avg(CASE WHEN d <= 1 THEN 0.5 * d * d ELSE d - 0.5 END) AS h, avg(d * d) AS s, avg(-ln(q)) AS c FROM p) SELECT round(h, 6) AS huber, round(s, 6) AS mse, round(c, 6) AS cross_entropy, round(h + 0.5 * c, 6) AS huber_total, round(s + 0.5 * c, 6) AS mse_total FROM m"))
def loss_report(spark, sf_dir):
    """M17."""
    soft, _ = mlprep.decode(F.slice("e", 1, 5))
    p = fx.pose_frames(spark, sf_dir).select((F.col("e")[5] * 20).alias("y"), (F.col("e")[6] * 20).alias("p"), (F.col("vec_id") % 5).cast("int").alias("a"), soft.alias("q"))
    return b.rounded(metrics.loss_report(p, "y", "p", "a", "q"))


# -- labels --------------------------------------------------------------------------------------------


@query("annotation_counts", "WITH g AS (SELECT unnest(['train', 'val', 'test']) AS split, k AS hold_type FROM (SELECT unnest(['jug', 'crimp', 'sloper']) AS k)), a AS (SELECT CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, CASE WHEN o_orderpriority LIKE '1%' THEN 'jug' WHEN o_orderpriority LIKE '2%' THEN 'crimp' ELSE 'other' END AS hold_type FROM orders) SELECT g.split, g.hold_type, count(a.split) AS n FROM g LEFT JOIN a USING (split, hold_type) GROUP BY ALL")
def annotation_counts(spark, sf_dir):
    """L1."""
    o = fx.read(spark, sf_dir, "orders")
    k, p = F.col("o_orderkey") % 10, F.col("o_orderpriority")
    a = o.select(F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split"), F.when(p.startswith("1"), "jug").when(p.startswith("2"), "crimp").otherwise("other").alias("hold_type"))
    return labels.annotation_counts(a, ("train", "val", "test"), ("jug", "crimp", "sloper"))


@query("label_summary", "WITH l AS (SELECT o_custkey AS session_id, o_orderkey AS pos, o_orderstatus <> 'F' AS is_hold, CASE WHEN o_orderkey % 3 > 0 THEN 'jug' END AS hold_type, o_orderpriority AS colour FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, p) AS k FROM (SELECT session_id, colour, count(*) AS n, min(pos) AS p FROM l WHERE is_hold AND hold_type IS NOT NULL GROUP BY session_id, colour)) SELECT l.session_id, sum(CASE WHEN is_hold AND hold_type IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS positive, sum(CASE WHEN is_hold AND hold_type IS NOT NULL THEN 0 ELSE 1 END)::BIGINT AS negative, any_value(c.colour) AS hold_colour FROM l LEFT JOIN (SELECT session_id, colour FROM c WHERE k = 1) c USING (session_id) GROUP BY l.session_id")
def label_summary(spark, sf_dir):
    """L2."""
    o = fx.read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") != "F").alias("is_hold"), F.when(F.col("o_orderkey") % 3 > 0, "jug").alias("hold_type"), F.col("o_orderpriority").alias("colour"), F.lit(None).cast("string").alias("given_colour"))
    return labels.label_summary(rows)


@query("label_pool", "SELECT o_custkey AS session_id, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS latest FROM orders GROUP BY o_custkey")
def label_pool(spark, sf_dir):
    """L3, L4."""
    return labels.pool(fx.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey"), "session_id", "o_orderkey")


POOL = """WITH chosen AS (SELECT o_custkey AS video_id, count(*) AS selected_frames, min('frame_' || o_orderkey) AS first_frame FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT c_custkey AS video_id, c_custkey * 7 % 1000 AS created_at, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS hold_colour, CASE WHEN c_custkey % 3 <> 0 THEN 'V' || c_nationkey END AS route_difficulty, coalesce(selected_frames, 0) AS selected_frames, first_frame FROM customer LEFT JOIN chosen ON c_custkey = video_id"""


def _key_frame_pool(spark, sf_dir):
    frames_ = fx.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.concat(F.lit("frame_"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderstatus") == "F").alias("chosen"))
    told = F.col("c_custkey") % 3 != 0
    metadata = fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") * 7 % 1000).alias("created_at"), F.when(told, F.col("c_mktsegment")).alias("hold_colour"), F.when(told, F.concat(F.lit("V"), F.col("c_nationkey").cast("string"))).alias("route_difficulty"))
    return labels.key_frame_pool(frames_, metadata)


@query("key_frame_pool", POOL)
def key_frame_pool(spark, sf_dir):
    """L4: customers as videos of the pool; every third has no metadata."""
    return _key_frame_pool(spark, sf_dir)


@query("key_frame_totals", f"SELECT count(*) AS video_count, CAST(sum(selected_frames) AS BIGINT) AS frame_count FROM ({POOL})")
def key_frame_totals(spark, sf_dir):
    """L4."""
    return labels.pool_totals(_key_frame_pool(spark, sf_dir))


@query("session_progress", "SELECT o_custkey AS session_id, count(*) AS frames, sum(CASE WHEN o_orderkey % 4 > 0 THEN 1 ELSE 0 END)::BIGINT AS labelled, sum(o_orderkey % 4)::BIGINT AS segments, CAST(floor(sum(CASE WHEN o_orderkey % 4 > 0 THEN 1 ELSE 0 END) * 100 / count(*)) AS INTEGER) AS percent FROM orders GROUP BY o_custkey")
def session_progress(spark, sf_dir):
    """L5."""
    return labels.progress(fx.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 4).alias("segments")))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    """L6."""
    return labels.status_counts(fx.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("latest_labels", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(CAST(value AS DOUBLE), (ts, event_id)), 6) AS value FROM events GROUP BY ALL")
def latest_labels(spark, sf_dir):
    """L7."""
    e = fx.read(spark, sf_dir, "events").withColumn("value", F.col("value").cast("double"))
    return b.rounded(labels.latest(e, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]))


@query("export_lines", sql("detections", ", r AS (SELECT *, CASE label WHEN 'jug' THEN 0 WHEN 'crimp' THEN 1 END AS c FROM detections), f AS (SELECT video_id, frame_index, count(*) AS n_lines FROM r WHERE c IS NOT NULL GROUP BY ALL) SELECT video_id, frame_index, n_lines, CASE WHEN k < CAST(floor(n * 0.7) AS INTEGER) THEN 'train' WHEN k < CAST(floor(n * 0.7) AS INTEGER) + CAST(floor(n * 0.15) AS INTEGER) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() " + W + " - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM f)"))
def export_lines(spark, sf_dir):
    """L8."""
    out = labels.export_lines(fx.detections(spark, sf_dir), ("jug", "crimp"))
    return out.select("video_id", "frame_index", F.size(F.split("lines", "\n")).cast("bigint").alias("n_lines"), "split")


PROFILED = ["left_elbow_angle", "com_x", "com_y", "body_scale", "left_hand_x"]


@query("column_profile", sql(b.BASE, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{'angle' if 'angle' in c else 'com' if c.startswith('com') else 'other'}' AS family, count({c}) AS n, round(min({c}), 6) AS low, round(max({c}), 6) AS high, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std FROM body" for c in PROFILED)))
def column_profile(spark, sf_dir):
    """L9."""
    return b.rounded(labels.profile(b.bodies(spark, sf_dir), PROFILED))


@query("run_summary", sql(b.BASE, "SELECT video_id, count(*) AS frames, 100::DOUBLE AS coverage, round(min(detection_score), 6) AS low, round(max(detection_score), 6) AS high, CAST(least(count(*), 10) AS INTEGER) AS first_frames FROM body GROUP BY video_id"))
def run_summary(spark, sf_dir):
    """L10."""
    return b.rounded(labels.run_summary(b.frames(spark, sf_dir)).withColumn("first_frames", F.size("first_frames")))
