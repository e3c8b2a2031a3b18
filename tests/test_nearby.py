"""The nearest holds of points: by grid, blocks and boxes, against looking at every hold."""

import math
import random

import pytest

from strideframe.operators import nearby, recommend
from strideframe.params import LIMBS

HOLDS = "video_id long, hold_ord long, hold_id string, x double, y double, hold_type string"
POINTS = "video_id long, _row long, x double, y double"


def closest(spark, holds, points, k, farthest=None):
    out = {}
    for r in nearby.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(holds, HOLDS), ["_row"], k, farthest).collect():
        out.setdefault(r["_row"], []).append((r["rank"], r["hold_ord"]))
    return {row: [o for _, o in sorted(v)] for row, v in out.items()}


def looked_up(holds, points, k, farthest=None):
    cap = lambda d: d if farthest is None else min(d, farthest)
    out = {}
    for video, row, x, y in points:
        if x is not None and y is not None:
            near = sorted((cap(math.hypot(h[3] - x, h[4] - y)), h[1]) for h in holds if h[0] == video and None not in h[3:5])
            if near:
                out[row] = [o for _, o in near[:k]]
    return out


def lattice(copies, size=1.0):
    """Positions on a lattice, each ``copies`` times, in two videos; one video has two holds, one only unknown places."""
    places = [(v, i / 10 * size, j / 20 * size) for v in (1, 2) for i in range(10) for j in range(20)]
    rows = [(v, c * len(places) + n, x, y) for c in range(copies) for n, (v, x, y) in enumerate(places)]
    rows += [(3, 10**6, 0.1, 0.2), (3, 10**6 + 1, 0.9, 0.2), (4, 10**6 + 2, None, 0.5)]
    return [(v, o, f"H{o}", x, y, "jug") for v, o, x, y in rows]


def scattered(rng, size=1.0, n=60):
    spots = [(rng.choice((1, 1, 2, 3, 4, 5)), rng.uniform(-0.5, 1.5) * size, rng.uniform(-0.2, 1.2) * size) for _ in range(n)]
    return [(v, i, None if i == 7 else x, y) for i, (v, x, y) in enumerate(spots)]


@pytest.mark.parametrize("pairs", [0, 1 << 24])
@pytest.mark.parametrize(("k", "farthest", "size"), [(1, None, 1.0), (3, 1.0, 1.0), (3, 0.05, 1.0), (3, 1.0, 500.0)])  # in pixels most holds tie beyond the farthest
def test_nearest_equals_looking_at_all(spark, monkeypatch, pairs, k, farthest, size):
    monkeypatch.setattr(nearby, "PAIRS", pairs, raising=False)
    rng = random.Random(2)
    holds, points = lattice(4, size), scattered(rng, size)
    assert closest(spark, holds, points, k, farthest) == looked_up(holds, points, k, farthest)


def test_copies_of_holds_leave_no_points_to_look_at_all(spark, monkeypatch):
    """Sixty copies in each place: cells as wide as six holds would hold no place but a point's own."""
    looked = []
    blocks = nearby.hold_blocks
    monkeypatch.setattr(nearby, "hold_blocks", lambda holds, *a: looked.append(holds.count()) or blocks(holds, *a))
    rng = random.Random(4)
    holds = lattice(60)
    points = [(rng.choice((1, 2)), i, rng.uniform(0.05, 0.85), rng.uniform(0.05, 0.9)) for i in range(40)]
    assert closest(spark, holds, points, 1) == looked_up(holds, points, 1)
    assert sum(looked) <= 402  # one of each place, where anything is left


def test_rows_of_a_stream_hold_few_copies_of_a_place(spark):
    """Some of the copies are held. What stands beside a frame does not grow with them."""
    rng = random.Random(6)
    holds = [(1, c * 30 + n, f"H{c * 30 + n}", n % 5 / 5, n % 6 / 6, "jug") for c in range(40) for n in range(30)]
    frames = [(1, i, rng.random(), rng.random(), *(f"H{rng.randrange(90)}" for _ in LIMBS)) for i in range(20)]
    df = spark.createDataFrame(frames, "video_id long, frame_index long, com_x double, com_y double, " + ", ".join(f"{p}_contact_hold string" for p in LIMBS))
    out = recommend.next_holds_in_row(df, spark.createDataFrame(holds, HOLDS))
    got = {(r.frame_index, r.rank): r.hold_id for r in out.collect()}
    for _, i, x, y, *held in frames:
        best = sorted((-(0.7 * (1 - min(math.hypot(x - h[3], y - h[4]), 1)) + 0.3 * (h[2] not in held)), h[1]) for h in holds)
        assert [got[i, r] for r in (1, 2, 3)] == [f"H{o}" for _, o in best[:3]]
    assert "_same" in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("query", ["activity_segments_report", "frame_report"])
def test_queries_look_at_a_place_once(spark, sf, tmp_path, monkeypatch, query):
    """However often the table of holds is repeated, a search keeps the first few holds of each place, and the result is the same."""
    import __spark_entry__
    from pyspark.sql import functions as F

    (tmp_path / "embeddings.parquet").symlink_to(f"{sf}/embeddings.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet")
    times = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t")
    part.select("*", times).withColumn("p_partkey", F.col("p_partkey") + 20_000 * F.col("t")).drop("t").write.parquet(str(tmp_path / "part.parquet"))
    kept, stored = [], nearby.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "holds":
            kept.append(out.groupBy("video_id", "x", "y").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(nearby, "stored", counted)
    run = __spark_entry__.queries()[query]
    many = sorted(map(str, run(spark, str(tmp_path)).collect()))
    assert kept and max(kept) < 12
    if query != "frame_report":  # which lists copies beside each other
        assert many == sorted(map(str, run(spark, sf).collect()))


@pytest.mark.parametrize("size", [1.0, 500.0])  # in pixels most holds tie beyond the farthest
def test_frames_of_a_stream_look_at_few_holds_in_a_row(spark, tmp_path, monkeypatch, size):
    """Rows have a leaf's holds and the first few of the video, not all 2,400, and the result is that of looking at all."""
    rng = random.Random(8)
    holds = lattice(4, size) + [(5, 20_000 + i, f"H{20_000 + i}", rng.random() * size, rng.random() * size, "jug") for i in range(2_400)]
    holds += [(6, 30_000 + i, "H30000", None if i % 2 else math.nan, 0.5, "jug") for i in range(9)] + [(5, 1, "H1", None, None, "jug"), (5, 40_000, "H20001", 0.5, 0.5, "jug")]
    some = {v: [h[2] for h in holds if h[0] == v] for v in range(1, 8)}
    frames = [(v, i, x, y, *(rng.choice([None, *some[v][:9]]) for _ in LIMBS)) for i, (v, x, y) in enumerate((rng.randrange(1, 8), rng.uniform(-0.3, 1.3) * size, rng.uniform(-0.3, 1.3) * size) for _ in range(150))]
    frames += [(5, 0, 0.5, 0.5, *[None] * 4), (5, 0, 0.1, 0.9, *[None] * 4), (1, 999, None, 0.5, *[None] * 4)]  # one number twice
    df = spark.createDataFrame(frames, "video_id long, frame_index long, com_x double, com_y double, " + ", ".join(f"{p}_contact_hold string" for p in LIMBS))
    table, want = spark.createDataFrame(holds, HOLDS), []
    away = lambda x, y, h: math.inf if None in h[3:5] or math.isnan(h[3]) else math.hypot(x - h[3], y - h[4])
    for v, i, x, y, *held in frames:
        if x is not None:
            best = sorted((-(0.7 * (1 - min(away(x, y, h), 1)) + 0.3 * (h[2] not in held)), h[1], h[2]) for h in holds if h[0] == v)
            want += [(v, i, n + 1, h, round(-s, 9)) for n, (s, _, h) in enumerate(best[:3])]
    plain = lambda out: sorted((r.video_id, r.frame_index, r["rank"], r.hold_id, round(r.score, 9)) for r in out.collect())
    widest, sized = [], recommend.reached_by_stream

    def watched(*a):
        out = sized(*a)
        if not out.isStreaming:
            from pyspark.sql import functions as F

            widest.append(out.select(F.max(F.size("_holds") + F.size("_first"))).first()[0])
        return out

    monkeypatch.setattr(recommend, "reached_by_stream", watched)
    monkeypatch.setattr(recommend, "MERGED", 50)
    from strideframe.streaming import live

    assert plain(live.live_next_holds(df, table)) == sorted(want) and 0 < widest[0] <= 200
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = live.live_next_holds(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), table)
    q = stream.writeStream.format("memory").queryName("next_by_boxes").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and plain(spark.table("next_by_boxes")) == sorted(want)
