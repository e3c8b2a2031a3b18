"""Keys that are split into blocks give the rows of plain Python over whole keys."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strideframe.functions import blocks
from strideframe.functions.fold import Carried, Smoothing, Total, fold
from strideframe.operators import contacts, features, frames, grading, kinematics, mlprep, segments
from strideframe.operators.holds import density_clusters
from strideframe.params import ContactParams

FLIP = StructType([StructField("flip", LongType())])
MOMENT = StructType([StructField("moment", StringType())])


def series(seed, make, lengths=(300, 7, 1), gap=0.1):
    """Rows (video, frame, ...) with gaps between frames; one video has most of them."""
    draw, out = random.Random(seed), []
    for video, n in enumerate(lengths):
        frame = draw.randrange(40)
        for _ in range(n):
            out.append((video, frame, *make(draw, frame)))
            frame += 1 if draw.random() > gap else draw.randrange(2, 60)
    return out


def plain(rows, machine):
    state, at, out = None, None, {}
    for video, frame, *values in rows:
        if video != at:
            state, at = None, video
        state, made = machine(state, tuple(values))
        out[video, frame] = made
    return out


def contact(draw, frame):
    return "left_foot" if draw.random() < 0.5 else "left_hand", draw.choice([0.1, 0.25, 0.26, 0.4, None]), draw.choice([0.0, 0.0, 0.5, None]), draw.choice([1.0, 1.1]), draw.choice([0.0, 0.01, 0.2, None]), draw.choice(["a", "b", None])


MACHINES = {
    "contact": (contacts.ContactStep(), contacts.STATE, "limb string, distance double, speed double, scale double, z double, target string", contact),
    "contact_one": (contacts.ContactStep(ContactParams(min_on=1)), contacts.STATE, "limb string, distance double, speed double, scale double, z double, target string", contact),
    "sustain": (segments.Sustain(3), FLIP, "frame long, label string", lambda d, f: (f, d.choice(["movement", "movement", "rest"]))),
    "cuts": (segments.StepCut(5, 1.0), segments.CUT, "frame long, ts double, candidate boolean", lambda d, f: (f, f / 25, d.random() < 0.4)),
    "rare_cuts": (segments.StepCut(5, 4.0), segments.CUT, "frame long, ts double, candidate boolean", lambda d, f: (f, f / 25, d.random() < 0.03)),
    "apart": (frames.Apart(7), frames.KEEP, "frame long", lambda d, f: (f,)),
    "moments": (frames.Moments(0.05, 0.01, 3), MOMENT, "frame long, velocity double", lambda d, f: (f, d.choice([0.1, 0.001, 0.001, 0.03]))),
}


@pytest.mark.parametrize("name", MACHINES)
def test_machines_over_blocks(spark, name):
    machine, outputs, kind, make = MACHINES[name]
    for seed, length in ((1, 10), (2, 1), (3, 64)):
        rows = series(seed, make)
        df = spark.createDataFrame(rows, f"video_id long, frame_index long, {kind}").repartition(3, F.rand(1))
        inputs = [c.split()[0] for c in kind.split(", ")]
        got = fold(df, ["video_id"], ["frame_index"], inputs, outputs, machine, length).collect()
        want = plain(rows, machine)
        assert len(got) == len(want)
        for r in got:
            assert tuple(r[c] for c in outputs.names) == want[r.video_id, r.frame_index], (seed, r)


def test_a_long_key_runs_in_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_index"), F.lit(1).cast("bigint").alias("one"))
    out = fold(df, ["video_id"], ["frame_index"], ["one"], StructType([StructField("total", LongType())]), Total(), 500).withColumn("task", F.spark_partition_id())
    assert out.where("total <> frame_index + 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 12_000


def test_states_compare_by_place():
    assert Carried(1) == Carried(1) and Carried(1) != Carried(2) and Carried(1) != "a" and len({Carried(3), Carried(3)}) == 1


@pytest.mark.parametrize("length", [1, 5, 100, 1 << 16])
def test_smoothing_over_blocks(spark, length):
    draw = random.Random(4)
    rows = series(5, lambda d, f: (f // 37, d.random(), d.random()), (400, 3))
    df = spark.createDataFrame(rows, "video_id long, frame_index long, run long, x double, y double").repartition(3, F.rand(1))
    out = StructType([features.SMOOTHED["s_x"], features.SMOOTHED["s_y"]])
    for alpha in (0.6, 0.05, 1.0):
        got = {(r.video_id, r.frame_index): (r.s_x, r.s_y) for r in fold(df, ["video_id"], ["frame_index"], ["run", "x", "y"], out, Smoothing(alpha), length).collect()}
        last = None
        for video, frame, run, x, y in rows:
            if last and last[:2] == (video, run) and 0 < alpha < 1:
                x, y = alpha * x + (1 - alpha) * last[2], alpha * y + (1 - alpha) * last[3]
            last = (video, run, x, y)
            assert got[video, frame] == pytest.approx((x, y), abs=1e-9)
    assert draw.random() >= 0


def test_smoothing_of_landmarks_starts_anew(spark):
    rows = [(1, f, k, float(f + k), 0.0, 0.0, 1.0) for f in (0, 1, 2, 5, 6) for k in range(2 if f != 1 else 1)]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, pos int, x double, y double, z double, visibility double")
    got = {(r.frame_index, r.pos): r.s_x for r in features.smooth(df, 0.5).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (2, 0): 2, (2, 1): 3, (5, 0): 5, (5, 1): 6, (6, 0): 5.5, (6, 1): 6.5}


@pytest.mark.parametrize("length", [1, 4, 9, 1000])
def test_windows_over_blocks(spark, length, monkeypatch):
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (0, length))
    rows = series(6, lambda d, f: (d.random(), d.random() if d.random() > 0.1 else None, [d.random()], d.choice(["a", "b", None])), (120, 2, 1))
    df = spark.createDataFrame(rows, "video_id long, frame_index long, com_x double, com_y double, vector array<double>, h string")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for r in kinematics.derivatives(df, 25.0, ("com",)).collect():
        mine = by[r.video_id]
        k = next(i for i, x in enumerate(mine) if x[1] == r.frame_index)
        x = [m[2] for m in mine[max(0, k - 3) : k + 1]]
        want = None if k < 3 else (x[3] - 3 * x[2] + 3 * x[1] - x[0]) * 25.0**3
        assert (r.com_jx is None) == (want is None) and (want is None or math.isclose(r.com_jx, want, abs_tol=1e-6))
    for r in contacts.com_trail(df, 5).collect():
        known = [m for m in by[r.video_id] if m[3] is not None and m[1] <= r.frame_index][-5:]
        assert [tuple(p) for p in r.com_trail] == [(m[2], m[3]) for m in known]
    for stride in (1, 3):
        got = sorted((r.video_id, r.start_frame, r.end_frame, tuple(map(tuple, r.vector))) for r in mlprep.windows(df, 6, stride).collect())
        assert got == sorted((v, m[k][1], m[k + 5][1], tuple(tuple(x[4]) for x in m[k : k + 6])) for v, m in by.items() for k in range(0, len(m) - 5, stride))


def test_blocks_share_one_shuffle_of_the_frames(spark):
    df = spark.range(100).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_index"), F.rand(1).alias("com_x"), F.rand(2).alias("com_y"))
    plan = kinematics.derivatives(df, 25.0, ("com",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(video_id") <= 3  # by block, for both branches, of which one is reused at run time, and of the edges by video


def plain_clusters(points, eps, least):
    near = {i: [j for j, w, *q in points if w == v and math.dist(p, q) <= eps] for i, v, *p in points}
    core = {i for i in near if len(near[i]) >= least}
    label = {i: i for i in core}
    while True:
        new = {i: min(label[j] for j in near[i] if j in core) for i in core}
        if new == label:
            break
        label = new
    return {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in near}


@pytest.mark.parametrize("kind", ["loose", "dense", "far_blobs", "equal", "four_axes"])
def test_clusters_by_cells(spark, kind):
    draw = random.Random(8)
    if kind == "loose":
        points = [(i, i % 3, draw.random() * 0.4, draw.random() * 0.4) for i in range(300)]
    elif kind == "dense":  # a third of a video in two cells, and a thin bridge
        points = [(i, 0, 0.5 + draw.random() * 0.02, 0.5 + draw.random() * 0.02) for i in range(300)] + [(300 + i, 0, 0.5 + 0.012 * i, 0.53) for i in range(20)]
    elif kind == "far_blobs":  # large cells at a distance near eps, which outermost points do not settle
        points = [(i, 0, 0.3 + draw.random() * 0.004, draw.random() * 0.02) for i in range(200)] + [(200 + i, 0, 0.3 + 0.0335 + draw.random() * 0.004, draw.random() * 0.02) for i in range(200)]
    elif kind == "equal":
        points = [(i, 0, 0.25, 0.25) for i in range(150)] + [(150 + i, 0, 0.25 + 0.03, 0.25) for i in range(150)] + [(300, 0, 0.9, 0.9)]
    else:
        points = [(i, i % 2, *[round(draw.random() * 0.3, 2) for _ in range(4)]) for i in range(200)]
    axes = tuple(f"x{k}" for k in range(len(points[0]) - 2))
    df = spark.createDataFrame(points, "det_id long, video_id long, " + ", ".join(f"{a} double" for a in axes)).withColumn("cell", F.lit("clash"))
    for eps, least in ((0.03, 3), (0.1, 12) if kind == "loose" else (0.03, 1)):
        got = {r.det_id: r.cluster for r in density_clusters(df, eps, least, "det_id", axes=axes).collect()}
        assert got == plain_clusters(points, eps, least), (eps, least)


def test_clusters_without_coordinates(spark):
    df = spark.createDataFrame([(1, 1, None, 0.1), (2, 1, 0.1, 0.1), (3, 1, 0.1, 0.1)], "det_id long, video_id long, x_center double, y_center double")
    assert {r.det_id: r.cluster for r in density_clusters(df, 0.03, 2, "det_id").collect()} == {1: None, 2: 2, 3: 2}
    assert density_clusters(df.limit(0), 0.03, 2, "det_id").count() == 0


def test_split_of_a_large_table_is_exact(spark):
    """Two million rows: ranges are cut once, whatever columns are read."""
    df = spark.range(2_000_000).select("id", F.xxhash64("id").alias("h"))
    got = {r["split"]: (r["count"], r["low"], r["high"]) for r in mlprep.ordered_split(df, ["id"]).groupBy("split").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("low"), F.max("id").alias("high")).collect()}
    assert got == {"train": (1_400_000, 0, 1_399_999), "validation": (400_000, 1_400_000, 1_799_999), "test": (200_000, 1_800_000, 1_999_999)}


def test_stratified_split_of_a_large_table_is_exact(spark):
    """Over a million rows of a label the cut is the very row of its place; a missing target is label 0, a row without an id has no side."""
    df = spark.range(2_000_000).select("id", (F.col("id") % 4 / 3).alias("efficiency"))
    odd = spark.createDataFrame([(-1, None), (None, 0.0)], "id long, efficiency double")
    marked = mlprep.stratified_split(mlprep.threshold_label(df.union(odd), "efficiency"), "id")
    got = {(r.label, r.is_test): r["count"] for r in marked.groupBy("label", "is_test").count().collect()}
    for label, n in ((1.0, 1_000_000), (0.0, 1_000_002)):
        hashes = marked.where(F.col("label") == label).select("is_test", F.conv(F.substring(F.md5(F.concat("id", F.lit(":42")).cast("binary")), 1, 8), 16, 10).cast("long").alias("h")).toPandas()
        h = hashes["h"].dropna().sort_values().to_numpy()
        assert len(hashes) == n and got[label, True] == (h > h[-(-n * 4 // 5) - 1]).sum() == (hashes["is_test"] == True).sum()  # noqa: E712
    assert sum(got.values()) == 2_000_002 and got[0.0, None] == 1


def test_hash_quantile_of_crowded_values(spark):
    from decimal import Decimal

    from strideframe.functions.ranks import hash_quantile

    draw = random.Random(4)
    rows = [(k, draw.choice([0, 5, 65535, 65536, 65537, 2**32 - 1, None])) for k in (1, 2) for _ in range(40 * k)] + [(3, None), (3, 7)]
    df = spark.createDataFrame(rows, "key long, h long")
    for share in ("0.8", "0.5", "0.01", "1"):
        at = lambda values: sorted(values, key=lambda v: (v is None, v))[max(math.ceil(Decimal(share) * len(values)), 1) - 1]  # noqa: E731, B023
        got = {r.key: r.cut for r in hash_quantile(df, ["key"], "h", Decimal(share)).collect()}
        assert got == {k: at([h for q, h in rows if q == k]) for k in (1, 2, 3)}
        assert [r.cut for r in hash_quantile(df, [], "h", Decimal(share)).collect()] == [at([h for _, h in rows])]


@pytest.mark.parametrize("block", [3, 512])
def test_spacing_of_blocks(spark, block):
    draw = random.Random(7)
    rows = [(v, k, round(draw.random(), 2 if v else 9), draw.choice([0.1, 0.2, draw.random()])) for v, n in ((0, 60), (1, 41), (2, 2), (3, 1)) for k in range(n)] + [(4, 0, None, 0.5), (4, 1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "video_id long, hold_ord long, x double, y double").repartition(3, F.rand(1))
    got = {r.video_id: r for r in grading.spacing(df, block).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    for v, r in got.items():
        mine = [q for q in rows if q[0] == v and q[2] is not None]
        d = sorted(math.hypot(a[2] - b[2], a[3] - b[3]) for a in mine for b in mine if b[1] > a[1] and b[3] < a[3]) or [0.0]
        mean = sum(d) / len(d)
        want = (mean, (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2, math.sqrt(sum((x - mean) ** 2 for x in d) / len(d)), d[0], d[-1])
        assert (r.spacing_mean, r.spacing_median, r.spacing_std, r.spacing_min, r.spacing_max) == pytest.approx(want, abs=1e-9)


def test_spacing_measures_copies_once(spark, monkeypatch):
    """Places with many holds each, in any order of the list, and so many in one place that it makes several entries."""
    monkeypatch.setattr(grading, "SHARE", 4, raising=False)
    draw = random.Random(9)
    places = [(0.1 * i, 0.2 * j) for i in range(4) for j in range(3)]
    rows = [(1, k, *draw.choice(places)) for k in range(200)]
    df = spark.createDataFrame(rows, "video_id long, hold_ord long, x double, y double")
    entries = sum(len(r.a) for r in grading._block_pairs(df, 512).collect())
    assert entries < 100  # not 200 holds
    r = grading.spacing(df, 5).first()
    d = sorted(math.hypot(a[2] - b[2], a[3] - b[3]) for a in rows for b in rows if b[1] > a[1] and b[3] < a[3])
    mean = sum(d) / len(d)
    want = (mean, (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2, math.sqrt(sum((x - mean) ** 2 for x in d) / len(d)), d[0], d[-1])
    assert (r.spacing_mean, r.spacing_median, r.spacing_std, r.spacing_min, r.spacing_max) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_of_boxes_of_all_sizes(spark, seed):
    from strideframe.operators.holds import overlaps

    draw = random.Random(seed)
    side = lambda: draw.choice([0.01, 0.03, 0.125, 0.25, 0.9, draw.random() * 0.3])
    rows = [(i % 2, i, draw.choice([0.25, draw.random() * 2 - 0.5]), draw.random(), side(), side()) for i in range(120)] + [(0, 500, 0.5, 0.5, 0.0, 0.1), (0, 501, None, 0.5, 0.1, 0.1), (1, 502, 0.25, 0.25, 0.25, 0.25), (1, 503, 0.25, 0.25, 0.25, 0.25)]
    df = spark.createDataFrame(rows, "frame long, box long, x_center double, y_center double, width double, height double")
    got = {(r.box, r.other_box): r.iou for r in overlaps(df, ("frame",), "box").collect()}
    cover = lambda a, b, c, s: max(0.0, min(a[c] + a[s] / 2, b[c] + b[s] / 2) - max(a[c] - a[s] / 2, b[c] - b[s] / 2))
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and None not in a + b:
                inner = cover(a, b, 2, 4) * cover(a, b, 3, 5)
                if inner > 0:
                    want[a[1], b[1]] = inner / (a[4] * a[5] + b[4] * b[5] - inner)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items()) and len(got) == overlaps(df, ("frame",), "box").count()
    assert overlaps(df.limit(0), ("frame",), "box").count() == 0


def test_overlap_totals_meet_copies_once(spark, monkeypatch):
    from strideframe.operators import holds

    draw = random.Random(3)
    some = [(draw.random(), draw.random(), draw.choice([0.1, 0.4]), draw.choice([0.1, 0.3])) for _ in range(15)]
    rows = [(i % 2, *draw.choice(some)) for i in range(150)] + [(0, 0.5, 0.5, 0.0, 0.1), (0, None, 0.5, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "frame long, x_center double, y_center double, width double, height double")
    met, overlaps = [], holds.overlaps
    monkeypatch.setattr(holds, "overlaps", lambda boxes, *a: met.append(boxes.count()) or overlaps(boxes, *a))
    got = {r.frame: (r.pairs, r.overlap) for r in holds.overlap_totals(df, ("frame",), 0.1).collect()}
    cover = lambda a, b, c, s: max(0.0, min(a[c] + a[s] / 2, b[c] + b[s] / 2) - max(a[c] - a[s] / 2, b[c] - b[s] / 2))
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] == b[0] and None not in a + b and a[3] * a[4] * b[3] * b[4] > 0:
                inner = cover(a, b, 1, 3) * cover(a, b, 2, 4)
                iou = inner / (a[3] * a[4] + b[3] * b[4] - inner)
                if iou >= 0.1:
                    n, total = want.get(a[0], (0, 0.0))
                    want[a[0]] = (n + 1, total + iou)
    assert met == [len({r for r in rows if r[3] and None not in r})] and met[0] < 32
    assert set(got) == set(want) and all(got[f][0] == want[f][0] and got[f][1] == pytest.approx(want[f][1]) for f in want)


def test_tracks_of_many_videos_advance_together(spark, monkeypatch):
    """The frames of many videos are few steps; a video by itself takes one a frame; the tracks are the same."""
    from strideframe.operators import holds

    rows = [(v, f, 0.1 + 0.2 * k + 0.001 * ((v * 7 + f * 3 + k) % 5), 0.5 + 0.002 * ((v + f) % 3), 0.05, 0.05, 0.5 + 0.01 * k, "hold", None) for v in range(60) for f in range(v % 3 * 4 + 4) for k in range(4) if (v + f + k) % 5]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, x_center double, y_center double, width double, height double, confidence double, label string, hold_type string").coalesce(1)
    pdf = df.toPandas().sort_values(["video_id", "frame_index", "x_center", "y_center"], kind="stable")
    steps, advance = [], holds.Tracker.advance
    monkeypatch.setattr(holds.Tracker, "advance", lambda self, *a: steps.append(1) or advance(self, *a))
    together = sorted(holds.tracks_of(pdf, holds.TrackerParams()), key=lambda t: t[:2])
    assert len(steps) == 12
    apart = []
    for v, part in pdf.groupby("video_id"):
        tracker = holds.Tracker()
        holds.advance_frames(tracker, part)
        apart += [(v, *t[1:]) for t in tracker.confirmed()]
    assert together == sorted(apart, key=lambda t: t[:2]) and len(together) >= 120
    monkeypatch.undo()
    want = sorted(map(tuple, holds.track(df).collect()), key=lambda t: t[:2])
    assert want == together


def test_overlaps_of_small_frames_need_no_cells(spark, monkeypatch):
    """Boxes of frames that have few are compared side by side: the same pairs as by cells, also where one frame is crowded."""
    from strideframe.operators import holds

    draw = random.Random(5)
    rows = [(i % 9 if i < 240 else 9, i, draw.random(), draw.random(), draw.choice([0.02, 0.1, 0.4]), draw.random() * 0.2) for i in range(330)] + [(None, 999, 0.5, 0.5, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "frame long, box long, x_center double, y_center double, width double, height double")
    found = lambda d: sorted((r.frame, r.box, r.other_box, round(r.iou, 12)) for r in holds.overlaps(d, ("frame",), "box").collect())
    mixed, plain, written, stored = found(df), found(df.where("frame < 9")), [], holds.stored
    monkeypatch.setattr(holds, "stored", lambda d, name: written.append(name) or stored(d, name))
    assert found(df.where("frame < 9")) == plain and written == ["box_lists"]
    monkeypatch.setattr(holds, "FEW", 0)
    assert found(df) == mixed and {r[0] for r in mixed} == set(range(10)) and found(df.where("frame < 9")) == plain


def test_boxes_of_crowded_frames_meet_in_blocks(spark, monkeypatch):
    """Boxes of all sizes in blocks of 16, by the axis along which a frame's boxes overlap less; pairs below ``least`` are not made."""
    from strideframe.operators import holds

    monkeypatch.setattr(holds, "RUN", 16)
    draw = random.Random(11)
    side = lambda flat: draw.choice([0.001, 0.01, 0.05]) if flat else draw.choice([0.001, 0.1, 0.7])
    rows = [(i % 2, i, draw.choice([0.5, draw.random()]), draw.random(), side(i % 2), side(not i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "frame long, box long, x_center double, y_center double, width double, height double")
    cover = lambda a, b, c, s: max(0.0, min(a[c] + a[s] / 2, b[c] + b[s] / 2) - max(a[c] - a[s] / 2, b[c] - b[s] / 2))
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and (inner := cover(a, b, 2, 4) * cover(a, b, 3, 5)) > 0:
                want[a[1], b[1]] = inner / (a[4] * a[5] + b[4] * b[5] - inner)
    written, stored = {}, holds.stored
    monkeypatch.setattr(holds, "stored", lambda d, name: written.setdefault(name, stored(d, name)))
    got = holds.overlaps(df, ("frame",), "box").collect()
    assert len(got) == len(want) and all(want[r.box, r.other_box] == pytest.approx(r.iou) for r in got)
    assert written["box_blocks"].agg(F.max(F.size("_boxes"))).first()[0] == 16 and {r["_tall"] for r in written["box_blocks"].collect()} == {True, False}
    assert written["box_meetings"].count() < 2 * 13 * 14 / 2 / 2  # not half of all
    few = {(r.box, r.other_box) for r in holds.overlaps(df, ("frame",), "box", 0.3).collect()}
    assert {k for k, v in want.items() if v >= 0.3} <= few and len(few) < len(want) / 4
