"""State machines, clustering, planning, streams and readers against plain Python."""

import datetime
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.functions.fold import Smoothing
from strideframe.functions.geometry import hull_distance, point_in_polygon
from strideframe.operators import contacts, features, frames, grading, holds, mlprep, recommend, segments
from strideframe.params import LIMBS, ContactParams, PlannerParams
from strideframe.plans import body, fixtures, steps
from strideframe.sources import readers, sinks
from strideframe.streaming import live


def test_smoothing_golden():
    columns = [pa.array(c) for c in ([0, 0, 1], [0.2, 0.4, 0.4], [0.2, 0.4, 0.4], [0.0, 0.0, 0.0], [0.8, 0.95, 0.95])]
    _, out = Smoothing(0.5).run(None, columns)
    assert out[0][1] == pytest.approx(0.3) and out[3][1] == pytest.approx(0.875)
    assert out[0][2] == 0.4  # another run starts anew


def test_contact_golden():
    step = contacts.ContactStep(ContactParams(r_on=0.2, r_off=0.3, min_on=2, v_hold=0.1))
    rows = [(0.1, 0.0), (0.1, 0.0), (0.25, 0.0), (0.35, 0.0), (0.35, 0.0)]
    state, seen = None, []
    for d, v in rows:
        state, out = step(state, ("left_hand", d, v, 1.0, 0.0, "H1"))
        seen.append(out)
    assert [s[0] for s in seen] == [0, 1, 1, 0, 0] and seen[2][2] == "H1"
    smear = contacts.ContactStep(ContactParams(min_on=1))
    assert smear(None, ("right_foot", 0.5, 0.0, 1.0, 0.01, "H2"))[1] == (1, "smear", None)
    assert smear(None, ("right_hand", 0.5, 0.0, 1.0, 0.01, "H2"))[1] == (0, "none", None)


def test_contacts_do_not_depend_on_partitions(spark, sf):
    rows = contacts.limb_rows(steps.touching(spark, sf).select("*", *[F.lit(0.0).alias(f"{p}_speed") for p in LIMBS if f"{p}_speed" not in ()]))
    one = sorted(map(tuple, contacts.fold(rows.coalesce(1), ["video_id", "limb"], ["frame_index"], ["limb", "distance", "speed", "body_scale", "z", "target"], contacts.STATE, contacts.ContactStep()).select("video_id", "limb", "frame_index", "contact_on").collect()))
    two = sorted(map(tuple, contacts.fold(rows.repartition(7, F.rand(3)), ["video_id", "limb"], ["frame_index"], ["limb", "distance", "speed", "body_scale", "z", "target"], contacts.STATE, contacts.ContactStep()).select("video_id", "limb", "frame_index", "contact_on").collect()))
    assert one == two


def plain_steps(rows, fps=25.0, low=0.2, high=4.0):
    out, start = [], 0
    for i in range(1, len(rows)):
        changed = sum(rows[i][f"{p}_contact_hold"] != rows[i - 1][f"{p}_contact_hold"] or rows[i][f"{p}_contact_type"] != rows[i - 1][f"{p}_contact_type"] for p in LIMBS)
        if changed == 1 and sum(rows[i][f"{p}_contact_on"] for p in LIMBS) >= 2 and (i - start >= max(1, int(low * fps)) or not out) and rows[i]["ts"] - rows[start]["ts"] <= high:
            out.append((start, i))
            start = i
    if not out or out[-1][1] != len(rows) - 1:
        out.append((start, len(rows) - 1))
    return out


def test_contact_steps(spark, sf):
    rows = fixtures.contact_rows(spark, sf)
    got = {}
    for r in segments.contact_steps(rows).orderBy("video_id", "step_id").collect():
        got.setdefault(r.video_id, []).append((r.start_index, r.end_index))
    by = {}
    for r in rows.orderBy("video_id", "frame_index").collect():
        by.setdefault(r.video_id, []).append(r)
    assert got == {v: plain_steps(rs) for v, rs in by.items()}


def plain_activity(scores, times, threshold, sustain, least):
    label = lambda s: "movement" if s >= threshold else "rest"
    out, current, start, up, down = [], None, 0, 0, 0
    for i, s in enumerate(scores):
        if current is None:
            current = label(s)
            continue
        up, down = (up + 1, 0) if label(s) == "movement" else (0, down + 1)
        if label(s) != current and max(up, down) >= sustain:
            cut = i - sustain + 1
            if times[cut] - times[start] >= least:
                out.append((current, start, cut))
            current, start = label(s), cut
    if times[-1] - times[start] >= least or not out:
        out.append((current, start, len(scores) - 1))
    return out


@pytest.mark.parametrize("sustain", [1, 2, 3])
def test_activity(spark, sustain):
    draw = random.Random(sustain)
    series = {v: [draw.random() for _ in range(60)] for v in range(4)}
    series[9] = [0.05] * 5 + [0.25] * 6 + [0.1] * 4
    df = spark.createDataFrame([(v, i, i * 0.5, s) for v, xs in series.items() for i, s in enumerate(xs)], "video_id long, frame_index long, ts double, activity double")
    got = {}
    for r in segments.activity_segments(df, segments.thresholds(df, given=0.18), 1.0, sustain).orderBy("video_id", "start_index").collect():
        got.setdefault(r.video_id, []).append((r.label, r.start_index, r.end_index))
    assert got == {v: plain_activity(xs, [i * 0.5 for i in range(len(xs))], 0.18, sustain, 1.0) for v, xs in series.items()}
    if sustain == 1:
        assert [x[0] for x in got[9]] == ["rest", "movement", "rest"]


def test_hull_distance(spark):
    draw = random.Random(5)
    rows = [(i, *[draw.random() for _ in range(2)], *[None if draw.random() < 0.2 and k % 2 == 0 else draw.random() for k in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, cx double, cy double, " + ", ".join(f"p{k}{c} double" for k in range(4) for c in "xy"))
    got = df.select("*", hull_distance((F.col("cx"), F.col("cy")), [(F.col(f"p{k}x"), F.col(f"p{k}y")) for k in range(4)]).alias("d")).collect()
    for r in got:
        pts = [(r[f"p{k}x"], r[f"p{k}y"]) for k in range(4) if r[f"p{k}x"] is not None]
        if not pts:
            assert r.d is None
            continue
        grid = [np.array(pts[0])]
        w = np.random.default_rng(r.i).dirichlet(np.ones(len(pts)) * 0.5, 4000)
        near = np.min(np.hypot(*(w @ np.array(pts) - [r.cx, r.cy]).T)) if len(grid) else 0
        assert r.d <= near + 1e-9 and near - r.d < 0.08


def test_point_in_polygon(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5)], "x double, y double")
    square = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    assert [r[0] for r in df.select(point_in_polygon((F.col("x"), F.col("y")), square)).collect()] == [True, False]


def test_density_clusters(spark):
    draw = random.Random(2)
    pts = [(i, i % 2, draw.random() * 0.3, draw.random() * 0.3) for i in range(160)]
    df = spark.createDataFrame(pts, "det_id long, video_id long, x_center double, y_center double")
    got = {r.det_id: r.cluster for r in holds.density_clusters(df, 0.03, 3, "det_id").collect()}
    near = {i: [j for j, w, a, b in pts if w == v and math.hypot(a - x, b - y) <= 0.03] for i, v, x, y in pts}
    core = {i for i in near if len(near[i]) >= 3}
    label = {i: i for i in core}
    for _ in range(200):
        label = {i: min(label[j] for j in near[i] if j in core) for i in core}
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in near}
    assert got == want and None in got.values()


def test_tracks(spark, sf):
    got = holds.track(fixtures.tracked_boxes(spark, sf)).groupBy("video_id").count().collect()
    assert len(got) == fixtures.tracked_boxes(spark, sf).select("video_id").distinct().count()
    again = sorted(map(tuple, holds.track(fixtures.tracked_boxes(spark, sf).repartition(9, F.rand(1))).collect()), key=str)
    assert again == sorted(map(tuple, holds.track(fixtures.tracked_boxes(spark, sf)).collect()), key=str)


def test_colour_groups(spark):
    df = spark.createDataFrame([(1, 0, 120, 200, 150), (2, 0, 125, 195, 155), (3, 0, 60, 200, 150)], "hold_id long, video_id long, h int, s int, v int")
    got = {r.hold_id: r.cluster for r in holds.colour_groups(df, 0.3).collect()}
    assert got[1] == got[2] != got[3]


def test_diverse_frames(spark, sf):
    rows = {}
    from strideframe.plans.routes import pose_rows

    df = pose_rows(spark, sf)
    for r in df.orderBy("frame_index").collect():
        rows.setdefault(r.video_id, []).append(r)
    want = set()
    for v, rs in rows.items():
        last = None
        for r in rs:
            seen = {p.name: p for p in r.landmarks if p.visibility >= 0.5}
            if last:
                shared = seen.keys() & last[1].keys()
                s = 1 / (1 + 2 * np.mean([math.hypot(seen[n].x - last[1][n].x, seen[n].y - last[1][n].y) for n in shared])) if shared else 0.0
                if not (s < 0.8 and r.frame_index - last[0] >= 5):
                    continue
            last = (r.frame_index, seen)
            want.add((v, r.frame_index))
    assert {(r.video_id, r.frame_index) for r in frames.diverse(df).where("kept").collect()} == want


def test_contact_moments():
    step, state, out = frames.Moments(0.05, 0.01, 3), None, []
    for i, v in enumerate([0.1, 0.001, 0.001, 0.001, 0.001, 0.2, 0.2]):
        state, (m,) = step(state, (i, v))
        out.append(m)
    assert out == [None, "contact", "middle", None, None, "release", None]


def plain_plan(f, hs, p):
    scale = f.body_scale or 1.0
    dist = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    com = (f.com_x, f.com_y)
    on = {l: bool(f[f"{l}_contact_on"]) for l in LIMBS}
    used = {f[f"{l}_contact_hold"] for l in LIMBS if on[l]}
    bonus = lambda h: (p.jug_bonus if h.hold_type == "jug" and sum(on.values()) < 3 else 0.0, p.reach_bonus if h.hold_type in ("crimp", "sloper") and h.y < f.com_y - 0.15 * scale else 0.0)
    c = [(1 / (dist(com, (h.x, h.y)) / scale + 1e-6) + (p.upward_bias * (f.com_y - h.y) if h.y < f.com_y else 0) + max(bonus(h)), h) for h in hs if h.hold_id not in used]
    out = []
    for _, h in sorted(c, key=lambda x: (-x[0], x[1].hold_ord))[: p.candidates]:
        part = "hand" if h.y < f.com_y - 0.1 * scale else "foot"
        free = [l for l in (f"left_{part}", f"right_{part}") if not on[l]]
        at = lambda l: (f[f"{l}_x"] or f.com_x, f[f"{l}_y"] or f.com_y)
        limb = free[0] if free else f"left_{part}" if dist((h.x, h.y), at(f"left_{part}")) < dist((h.x, h.y), at(f"right_{part}")) else f"right_{part}"
        poly = [(h.x, h.y) if l == limb else (f[f"{l}_target_x"], f[f"{l}_target_y"]) for l in LIMBS if l == limb or on[l]]
        inside, n = False, len(poly)
        for i in range(n if n >= 3 else 0):
            (x1, y1), (x2, y2) = poly[i], poly[i - 1]
            if (y1 > com[1]) != (y2 > com[1]) and com[0] < (x2 - x1) * (com[1] - y1) / (y2 - y1) + x1:
                inside = not inside

        def seg(a, b):
            dx, dy = b[0] - a[0], b[1] - a[1]
            q = dx * dx + dy * dy
            t = 0 if q < 1e-18 else max(0, min(1, ((com[0] - a[0]) * dx + (com[1] - a[1]) * dy) / q))
            return dist(com, (a[0] + t * dx, a[1] + t * dy))

        far = 0.0 if inside else min(seg(poly[i], poly[i - 1]) for i in range(n))
        limit = p.max_reach * min(1.2, max(0.8, 0.9 + 0.2 * f.climber_wingspan / f.climber_height)) * (1 if f.climber_flexibility is None else 1.05 + 0.05 * f.climber_flexibility)
        bad = [n < p.min_support, dist((f.hip_center_x, f.hip_center_y), (h.x, h.y)) / scale > limit, far / scale > p.polygon_tolerance]
        eff = max(0.0, 0.5 * math.exp(-p.stability_alpha * far / (scale + 1e-6)) + 1 - 0.1 * sum(bad))
        out.append((eff, h.hold_id, limb, bad[0] or bad[1]))
    good = [x for x in out if not x[3]] or out
    return [(x[1], x[2]) for x in sorted(good, key=lambda x: -x[0])[: p.top_k]]


def test_plan_moves(spark, sf):
    fr, hs = steps.touching(spark, sf).where("frame_index < 6").persist(), fixtures.holds(spark, sf)
    got = {}
    for r in recommend.plan_moves(fr, hs).orderBy("rank").collect():
        got.setdefault((r.video_id, r.frame_index), []).append((r.hold_id, r.limb))
    lists = {}
    for h in hs.collect():
        lists.setdefault(h.video_id, []).append(h)
    want = {(f.video_id, f.frame_index): plain_plan(f, lists[f.video_id], PlannerParams()) for f in fr.collect() if f.video_id in lists}
    assert got == {k: v for k, v in want.items() if v}


def test_grade_bands(spark):
    df = spark.createDataFrame([(0.0,), (1.99,), (4.5,), (9.9,), (10.0,)], "g double")
    assert [r[0] for r in df.select(grading.grade_band(F.col("g"))).collect()] == ["Beginner (V0)", "Beginner (V1)", "Advanced (V4)", "Elite (V9)", "Elite (V10+)"]


def test_ordered_split_is_exact(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    got = {r.split: r["count"] for r in mlprep.ordered_split(df, ["k"], parts=7).groupBy("split").count().collect()}
    assert got == {"train": 72, "validation": 20, "test": 11}


# -- streams -------------------------------------------------------------------------------------------


def parts_of(df, path, n, order):
    rows = df.toPandas().sort_values(order).reset_index(drop=True)
    for i in range(n):
        df.sparkSession.createDataFrame(rows.iloc[len(rows) * i // n : len(rows) * (i + 1) // n], df.schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, name, mode="append", **options):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_live_kinematics_equals_batch(spark, sf, tmp_path):
    pts = body.bodies(spark, sf).select("video_id", "frame_index", F.col("com_x").alias("x"), F.col("com_y").alias("y"))
    parts_of(pts, str(tmp_path / "in"), 4, ["frame_index", "video_id"])
    got = drain(live.live_kinematics(spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), alpha=1.0), "kin").collect()
    want = {(r.video_id, r.frame_index): r for r in body.kinematics.derivatives(body.bodies(spark, sf), points=("com",)).collect()}
    assert len(got) == len(want) > 0
    for r in got:
        w = want[r.video_id, r.frame_index]
        for a, b in ((r.vx, w.com_vx), (r.ay, w.com_ay), (r.jx, w.com_jx)):
            assert (a is None or math.isnan(a)) if b is None else a == pytest.approx(b, abs=1e-6)


def test_live_contacts_equal_batch(spark, sf, tmp_path):
    rows = contacts.limb_rows(body.kinematics.derivatives(features.nearest_holds(body.bodies(spark, sf), fixtures.holds(spark, sf)), 1.0)).persist()
    parts_of(rows, str(tmp_path / "in"), 3, ["frame_index", "video_id", "limb"])
    got = drain(live.live_contacts(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), body.TOUCHY), "con")
    want = contacts.fold(rows, ["video_id", "limb"], ["frame_index"], ["limb", "distance", "speed", "body_scale", "z", "target"], contacts.STATE, contacts.ContactStep(body.TOUCHY))
    cols = ["video_id", "limb", "frame_index", "contact_on", "contact_type", "contact_hold"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_live_contacts_count_late_rows(spark, tmp_path):
    kind = "video_id long, limb string, frame_index int, distance double, speed double, body_scale double, z double, target string"
    rows = lambda frames: [(1, "left_hand", f, 0.01, 0.0, 1.0, 0.0, "a") for f in frames]
    for frames in ([0, 1, 2, 3], [2, 3], [4, 5]):
        spark.createDataFrame(rows(frames), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.frame_index: r.late for r in drain(live.live_contacts(stream()), "late").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 2, 5: 2}


def test_live_state_of_ended_videos_is_forgotten(spark, tmp_path):
    kind = "video_id long, frame_index int, x double, y double, ts timestamp"
    at = lambda minute: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minute)
    for video, frame, minute in ((1, 5, 0), (2, 0, 300), (2, 1, 301), (2, 2, 302), (1, 3, 303), (1, 2, 304)):
        spark.createDataFrame([(video, frame, 0.5, 0.5, at(minute))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for idle, name in (("1 hour", "idle"), (None, "ever")):  # forgotten, video 1 begins anew at frame 3; else both come late
        q = live.live_kinematics(stream, idle=idle).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        got = spark.table(name).collect()
        assert sorted((r.video_id, r.frame_index) for r in got) == sorted([(1, 5), (2, 0), (2, 1), (2, 2)] + ([(1, 3)] if idle else []))
        assert all(r.late == 0 for r in got)
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
        removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress)
        assert removed == (1 if idle else 0)


def test_live_tracks_of_ended_videos_are_forgotten_and_state_outlives_a_restart(spark, tmp_path):
    """Two runs over one checkpoint equal one run; a track that is missed too often leaves the list state."""
    kind = "video_id long, frame_index long, x_center double, y_center double, width double, height double, label string, hold_type string, confidence double, ts timestamp"
    at = lambda frame: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=frame)
    box = lambda v, f, x: (v, f, x, 0.5, 0.1, 0.1, "jug", None, 0.5, at(f))
    batches = [[box(1, f, 0.2 + 0.001 * f) for f in range(4)] + [box(2, f, 0.7) for f in range(4)], [box(1, f, 0.204) for f in range(4, 8)] + [box(1, f, 0.8) for f in range(8, 11)], [box(1, f, 0.8) for f in range(11, 18)]]

    def run(name, groups, idle=None):
        found = []
        for group in groups:
            for rows in group:
                spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
            out = live.live_tracks(stream, idle=idle).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / name / "cp"))
            q = out.foreachBatch(lambda df, n: found.append(sorted(map(str, df.collect())))).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
        return [f for f in found if f], q

    whole, q = run("whole", [batches])
    parted, _ = run("parted", [batches[:1], batches[1:2], batches[2:]])
    assert whole == parted and len(whole) == 3
    assert [sum("video_id=1," in r for r in f) for f in whole] == [1, 2, 1]  # the first track is missed from frame 8 on
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    late = [box(3, 500, 0.3)], [box(3, 900, 0.3)], [box(2, 910, 0.7)]  # video 2 was forgotten long before
    forgotten, q = run("idle", [batches[:1] + list(late)], "1 hour")
    assert not any("video_id=2," in r for f in forgotten[1:] for r in f)


def test_live_windows_and_bouts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("motion"))
    parts_of(e, str(tmp_path / "in"), 3, ["ts"])
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = {(r.video_id, r.start): (r.frames, round(r.max_motion, 6)) for r in live.motion_windows(e, "1 day").collect()}
    got = {(r.video_id, r.start): (r.frames, round(r.max_motion, 6)) for r in drain(live.motion_windows(stream(), "1 day"), "win").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    bouts = {(r.video_id, r.start): r.frames for r in live.movement_bouts(e, "1 day").collect()}
    some = {(r.video_id, r.start): r.frames for r in drain(live.movement_bouts(stream(), "1 day"), "bouts").collect()}
    assert some and all(bouts[k] == v for k, v in some.items())


def test_live_tracks_and_next_holds(spark, sf, tmp_path):
    boxes = fixtures.tracked_boxes(spark, sf)
    parts_of(boxes.repartition(1), str(tmp_path / "in"), 1, ["frame_index", "video_id", "x_center"])
    got = drain(live.live_tracks(spark.readStream.schema(boxes.schema).parquet(str(tmp_path / "in"))), "tracks", "update")
    assert {(r.video_id, r.track_id) for r in got.collect()} == {(r.video_id, r.track_id) for r in holds.track(boxes).collect()}
    fr = steps.touching(spark, sf).select("video_id", "frame_index", "com_x", "com_y", *[f"{p}_contact_hold" for p in LIMBS]).persist()
    parts_of(fr, str(tmp_path / "fr"), 2, ["frame_index", "video_id"])
    top = drain(live.live_next_holds(spark.readStream.schema(fr.schema).parquet(str(tmp_path / "fr")), fixtures.holds(spark, sf)), "next")
    assert sorted(map(str, top.collect())) == sorted(map(str, recommend.next_holds(fr, fixtures.holds(spark, sf)).collect()))


# -- readers -------------------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    d = tmp_path / "clip"
    d.mkdir()
    (d / "pose_results.json").write_text(json.dumps({"video": "v1", "frame_count": 2, "frames": [{"image_path": "a.jpg", "timestamp_seconds": 0.0, "landmarks": [{"name": "left_hip", "x": 0.1, "y": 0.2, "z": 0.0}]}]}))
    rows = readers.read_poses(spark, str(d / "pose_results.json")).collect()
    assert len(rows) == 1 and rows[0].visibility == 0.0 and rows[0].detection_score == 0.0
    (d / "manifest.json").write_text(json.dumps({"video": "v1", "frames": [{"frame_index": 0, "timestamp_seconds": 0.0, "relative_path": "a"}, {"frame_index": 25, "timestamp_seconds": 1.0, "relative_path": "b"}]}))
    assert {r.interval_seconds for r in readers.read_manifests(spark, str(tmp_path)).collect()} == {1.0}
    (d / "holds.json").write_text(json.dumps({"h1": {"coords": [0.1, 0.2]}, "h2": {"x": 0.3, "y": 0.4, "hold_type": "jug"}}))
    hs = readers.read_holds(spark, str(d / "holds.json")).orderBy("hold_ord").collect()
    assert [(h.hold_id, h.x, h.hold_type) for h in hs] == [("h1", 0.1, "auto"), ("h2", 0.3, "jug")]
    for i, text in enumerate(('[{"a": 1}]', '{"features": [{"a": 2}]}', '{"rows": [{"a": 3}]}')):
        (tmp_path / f"f{i}.json").write_text(text)
    assert sorted(r.a for i in range(3) for r in readers.read_features(spark, str(tmp_path / f"f{i}.json"), "a int").collect()) == [1, 2, 3]
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.1 0.1\n\n9 0.1 0.1 0.1 0.1\nbroken\n")
    lab = readers.read_label_text(spark, str(tmp_path / "l.txt"), {0: "jug"})
    assert [r.hold_type for r in lab.orderBy("class_id").collect()] == ["jug", "unknown"]
    assert sinks.label_lines(lab).orderBy("value").first()[0] == "0 0.500000 0.500000 0.100000 0.100000"
    for route, grade in (("r1", "4.5"), ("r2", "V?"), ("r3", "11")):
        (tmp_path / "routes" / route).mkdir(parents=True)
        (tmp_path / "routes" / route / "grade.txt").write_text(grade)
        (tmp_path / "routes" / route / "pose_features.json").write_text('[{"com_x": 0.5, "wall_angle": 95.0}]')
    routes = readers.read_routes(spark, str(tmp_path / "routes"), "com_x double, wall_angle double").collect()
    assert [(r.route, r.grade, r.wall_angle) for r in routes] == [("r1", 4.5, 95.0)]
    (tmp_path / "x.MP4").write_bytes(b"1")
    (tmp_path / "x.txt").write_bytes(b"1")
    vids = readers.list_videos(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in vids.collect()] == ["x.MP4"]
    assert readers.expired(vids, 1).count() == 0 and readers.expired(vids, 1, F.current_timestamp() + F.expr("interval 3 days")).count() == 1
    with pytest.raises(ValueError):
        readers.expired(vids, 0)


def test_session_checks(spark):
    df = spark.createDataFrame([(180.0, 180.0, 0.5, [1.0] * 4, None), (300.0, None, 2.0, [1.0], None)], "climber_height double, climber_wingspan double, climber_flexibility double, imu_quaternion array<double>, imu_euler array<double>")
    good, bad = readers.check_sessions(df)
    assert good.count() == 1 and bad.first().faults == ["height", "flexibility", "imu_quaternion"]


def test_sink(spark, tmp_path):
    sinks.write_by_video(spark.createDataFrame([(1, 2.0), (2, 3.0)], "video_id long, x double"), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("video_id", "x").collect())) == [(1, 2.0), (2, 3.0)]
