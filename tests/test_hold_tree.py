"""The tree of holds: the search against looking at every hold, and the planner on deep trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators import hold_tree as ht
from strideframe.operators import recommend
from strideframe.params import PlannerParams
from strideframe.plans import fixtures, steps

HOLDS = "video_id long, hold_ord long, hold_id string, x double, y double, hold_type string"
FRAMES = "_row long, video_id long, px double, py double"


def layout(kind, rng, n=300):
    if kind == "even":
        points = [(rng.random(), rng.random()) for _ in range(n)]
    elif kind == "outlier":  # a dense cluster and one hold very far from it
        points = [(rng.random() * 1e-4, rng.random() * 1e-4) for _ in range(n - 1)] + [(1e6, 1e6)]
    elif kind == "ties":
        points = [(rng.randrange(4) / 4, rng.randrange(4) / 4) for _ in range(n)]
    else:  # one place
        points = [(0.5, 0.5)] * n
    return [(1, i, f"H{i}", x, y, "jug") for i, (x, y) in enumerate(points)] + [(2, n, "H", 0.1, 0.2, None), (1, n + 1, "X", None, 0.1, "jug"), (3, n + 2, "Y", 0.1, None, "jug")]


def closest(spark, holds, frames, k, leaf, fan):
    """Ids of the ``k`` nearest by the tree, and how many holds each frame met."""
    tree = ht.hold_tree(holds, k, leaf=leaf, fan=fan)

    def bounds(b):
        near, far = ht.near_and_far(b, F.col("px"), F.col("py"))
        return -far, -near

    met, seen = {}, {}
    for r in ht.reached(frames, tree, ["_row"], bounds, k).collect():
        met.setdefault(r._row, []).extend((math.hypot(h.x - r.px, h.y - r.py), h.hold_ord) for h in r._holds)
        seen[r._row] = seen.get(r._row, 0) + len(r._holds)
    return {row: [o for _, o in sorted(v)[:k]] for row, v in met.items()}, seen, tree


@pytest.mark.parametrize("most", [0, 2000])
@pytest.mark.parametrize("kind", ["even", "outlier", "ties", "one place"])
def test_search_equals_looking_at_all(spark, monkeypatch, kind, most):
    monkeypatch.setattr(ht, "BROADCAST", most)
    monkeypatch.setattr(ht, "PART", 50)
    rng = random.Random(3)
    rows = layout(kind, rng)
    frames = [(i, rng.choice((1, 1, 2, 3)), rng.uniform(-1, 2) if i % 2 else rng.random() * 1e-4, rng.random()) for i in range(40)]
    got, _, tree = closest(spark, spark.createDataFrame(rows, HOLDS), spark.createDataFrame(frames, FRAMES), 5, 4, 3)
    want = {}
    for row, video, x, y in frames:
        near = sorted((math.hypot(h[3] - x, h[4] - y), h[1]) for h in rows if h[0] == video and None not in h[3:5])
        if near:
            want[row] = [o for _, o in near[:5]]
    assert got == want
    assert max(len(r._holds) for r in tree.leaves.collect()) <= 4
    assert all(len(r._nodes) <= 3 for level in tree.levels for r in level.collect())


def test_frames_open_few_boxes_however_many_holds(spark):
    rng = random.Random(5)
    frames = spark.createDataFrame([(i, 1, rng.random(), rng.random()) for i in range(20)], FRAMES)
    most = []
    for n in (500, 4000):
        _, seen, _ = closest(spark, spark.createDataFrame(layout("even", rng, n), HOLDS), frames, 5, 16, 8)
        most.append(sum(seen.values()) / len(seen))
    assert most[1] < 1.5 * most[0] < 400


def test_nothing(spark):
    frames = spark.createDataFrame([(1, 1, 0.1, 0.1)], FRAMES)
    assert closest(spark, spark.createDataFrame([], HOLDS), frames, 3, 4, 3)[0] == {}
    assert closest(spark, spark.createDataFrame(layout("even", random.Random(1)), HOLDS), frames.limit(0), 3, 4, 3)[0] == {}


@pytest.mark.parametrize("size", [1.0, 1000.0])  # in pixels the height over the centre outweighs nearness
def test_planner_on_a_deep_tree(spark, sf, size):
    fr = steps.touching(spark, sf).where("frame_index < 2")
    lengths = [c for c in fr.columns if c.endswith(("_x", "_y")) or c == "body_scale"]
    fr = fr.withColumns({c: F.col(c) * size for c in lengths}).persist()
    hs = fixtures.holds(spark, sf).withColumns({"x": F.col("x") * size, "y": F.col("y") * size})
    twice = hs.union(hs.where("hold_ord % 3 = 0").withColumn("hold_ord", F.col("hold_ord") + 100_000))  # ids on two rows
    plans = [sorted(map(str, recommend.plan_moves(fr, twice, PlannerParams(), leaf, fan).collect())) for leaf, fan in ((4, 3), (100_000, 2))]
    assert plans[0] and plans[0] == plans[1]
