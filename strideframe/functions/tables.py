"""Scratch tables in the folder that driver and executors share, and components of a link table."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it names none, a private folder in local mode. On a cluster it must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="strideframe-")
    return _own[app]


def share_package(spark: SparkSession) -> None:
    """Let local Python workers import this package however the driver found it. On a cluster, ship it with the job."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (the least node reachable) for links (a, b), by contraction.

    Every node points to its least neighbour or itself, pointers are doubled until they stop at roots, and what links two roots
    is linked anew. A root stands for two nodes at least, so rounds and doublings grow with the logarithm of a component,
    however far apart its nodes lie, and each round has fewer links."""
    left = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = None
    for _ in range(most_rounds):
        roots = stored(left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "roots")
        moving = True
        while moving:
            up = roots.select(F.col("node").alias("label"), F.col("label").alias("up"))
            doubled = stored(roots.join(up.hint("merge"), "label").select("node", F.col("label").alias("old"), F.col("up").alias("label")), "roots")
            moving = doubled.where(F.col("old") != F.col("label")).limit(1).count()
            roots = doubled.select("node", "label")
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("label"), F.col("label").alias("up"))
            labels = stored(labels.join(up.hint("merge"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        root = lambda c: roots.select(F.col("node").alias(c), F.col("label").alias(f"root_{c}")).hint("merge")  # noqa: E731, B023
        once = left.where("a < b").join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        once = stored(once, "contracted")
        if not once.limit(1).count():
            return labels
        left = once.union(once.select(F.col("b"), F.col("a"))).distinct()
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")
