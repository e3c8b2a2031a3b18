"""Components of link tables against a plain search."""

import random

import pytest

from strideframe.functions.tables import components


def plain(links):
    near, label = {}, {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        if start not in label:
            open_ = [start]
            while open_:
                at = open_.pop()
                if at not in label:
                    label[at] = start
                    open_ += near[at]
    return label


def shuffled(rng, n):
    out = list(range(n))
    rng.shuffle(out)
    return out


def path(rng):
    ids = shuffled(rng, 600)
    return list(zip(ids, ids[1:], strict=False))


def grid(rng, wide=40):
    ids = shuffled(rng, wide * wide)
    return [(ids[x * wide + y], ids[u * wide + v]) for x in range(wide) for y in range(wide) for u, v in ((x + 1, y), (x, y + 1)) if u < wide and v < wide]


SHAPES = {
    "path": path,
    "rising path": lambda rng: [(i, i + 1) for i in range(300)],
    "grid": grid,
    "star": lambda rng: [(7, i) for i in range(100)],
    "loops and repeats": lambda rng: [(1, 1), (2, 3), (3, 2), (2, 3), (9, 8), (8, 4)],
    "few": lambda rng: [(rng.randrange(400), rng.randrange(400)) for _ in range(150)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_in_few_rounds(spark, shape):
    """However far apart the nodes of a component lie."""
    links = SHAPES[shape](random.Random(3))
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), most_rounds=7).collect()}
    assert got == plain(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_that_are_together_are_not_compared_again(spark, monkeypatch):
    """Dense points: outermost points bring all cells together, and no points of cells meet."""
    from strideframe.operators import clusters

    def never(*_):
        raise AssertionError("cells of one cluster were compared")

    monkeypatch.setattr(clusters, "linked_cells", never)
    rng = random.Random(5)
    df = spark.createDataFrame([(i, i % 2, rng.random() * 0.15, rng.random() * 0.15) for i in range(4000)], "det_id long, video_id long, x_center double, y_center double")
    assert {(r.video_id, r.cluster) for r in clusters.density_clusters(df, 0.03, 3, "det_id").collect()} == {(0, 0), (1, 1)}
