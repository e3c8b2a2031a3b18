"""Route difficulty: features of holds, steps and the path, and a boosted grade model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.ranks import hinted
from strideframe.functions.tables import stored
from strideframe.params import HOLD_TYPES, LIMBS


def hold_features(holds: DataFrame) -> DataFrame:
    """Count, density and share of each type of a video's holds."""
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    typed = F.col("hold_type").isin(*HOLD_TYPES)
    shares = [F.coalesce(F.sum((F.col("hold_type") == t).cast("int")) / F.sum(typed.cast("int")), F.lit(0.0)).alias(f"{t}_ratio") for t in HOLD_TYPES]
    return holds.groupBy("video_id").agg(F.count(F.lit(1)).alias("hold_count"), (F.count(F.lit(1)) / (F.when(box > 0, box).otherwise(1.0) + 1e-6)).alias("hold_density"), *shares)


BINS = 1024  # of a pass that looks for a median


SHARE = 256  # holds of one place that make an entry of a block, about
DEALT = 16  # parts of a video's pairs of blocks


def _block_pairs(holds: DataFrame, block: int) -> DataFrame:
    """video_id, a and b: two blocks of a video's places with the numbers of their holds, of which ``b`` has some hold later in the list than one of ``a``.

    Holds in one place are one entry, or several where they are very many: their distances to others are the same."""
    known = holds.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("video_id", "x", "y", F.col("hold_ord").cast("double").alias("k"))
    place = ["video_id", "x", "y"]
    crowded = stored(known.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("_shares")).where("_shares > 1"), "crowded")
    share = F.pmod(F.xxhash64("k"), F.coalesce("_shares", F.lit(1)))
    entries = known.join(hinted(crowded), place, "left").groupBy(*place, share.alias("_share")).agg(F.sort_array(F.collect_list("k")).alias("ks"))
    entries = stored(entries, "entries")
    sizes = hinted(entries.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks")))
    placed = entries.join(sizes, "video_id").withColumn("_b", F.pmod(F.xxhash64("x", "y", "_share"), F.col("_blocks")))
    ends = [F.min(F.get("ks", F.lit(0))).alias("first"), F.max(F.element_at("ks", -1)).alias("last")]
    lists = placed.groupBy("video_id", "_b").agg(F.collect_list(F.struct("x", "y", "ks")).alias("h"), *ends)
    lists = stored(lists, "blocks")
    part = ["video_id", "_part"]  # a video's pairs are dealt over tasks, however few bytes its blocks have
    parts = max(DEALT, int(holds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = lists.select("video_id", F.pmod(F.col("_b"), F.lit(DEALT)).alias("_part"), F.col("h").alias("a"), "first").repartition(parts, *part)
    right = lists.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALT - 1).cast("bigint"))).alias("_part"), F.col("h").alias("b"), "last").repartition(parts, *part)
    met = left.join(right.hint("merge"), part).drop("_part")
    return met.where(F.col("first") < F.col("last")).drop("first", "last")


def _later(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Of each entry of ``a`` and of ``b`` the number of pairs of a hold and a later one."""
    if len(a) == sum(map(len, a)) and len(b) == sum(map(len, b)):
        return (np.concatenate(a)[:, None] < np.concatenate(b)[None, :]).astype(np.int64)
    flat, owner = np.concatenate(a), np.repeat(np.arange(len(a)), [len(ks) for ks in a])
    order = np.argsort(flat, kind="stable")
    owner, before = owner[order], np.searchsorted(flat[order], np.concatenate(b))  # holds of ``a`` before each of ``b``
    starts, made = np.cumsum([0, *map(len, b[:-1])]), []
    for i in range(0, len(a), 32):  # entries whose counts are in memory at once
        mine = np.arange(i, min(i + 32, len(a)))
        upto = np.zeros((len(flat) + 1, len(mine)), np.int32)
        np.cumsum(owner[:, None] == mine, axis=0, out=upto[1:])
        made.append(np.add.reduceat(upto[before], starts, axis=0, dtype=np.int64).T)
    return np.concatenate(made)


def _sweep(pairs: DataFrame, extra: list[str], out: str, work: Callable[[np.ndarray, np.ndarray, tuple], list[tuple]]) -> DataFrame:
    """``work(distances, how often each, values of extra)`` of every pair of blocks, as rows after video_id. Distances are from each hold to the later ones that lie higher, and never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                (a, ka), (b, kb) = ((np.array([[h["x"], h["y"]] for h in r[side]], float), [np.array(h["ks"], float) for h in r[side]]) for side in "ab")
                often = np.where(b[None, :, 1] < a[:, None, 1], _later(ka, kb), 0)
                i, j = np.nonzero(often)
                d = np.hypot(a[i, 0] - b[j, 0], a[i, 1] - b[j, 1])
                if len(d):
                    rows += [(r["video_id"], *made) for made in work(d, often[i, j], tuple(r[c] for c in extra))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["video_id", *[c.split()[0] for c in out.split(", ")]])

    return pairs.select("video_id", *extra, "a", "b").mapInArrow(run, f"video_id long, {out}")


def _binned(d: np.ndarray, often: np.ndarray, target: tuple) -> list[tuple]:
    rank, low, high = target
    inside = (d >= low) & (d <= high)
    d, often = d[inside], often[inside]
    if not len(d):
        return []
    at = np.minimum(((d - low) * (BINS / (high - low))).astype(np.int64), BINS - 1)
    order = np.argsort(at, kind="stable")
    at, d = at[order], d[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    ends, n = np.append(starts[1:], len(at)), np.add.reduceat(often[order], starts)
    return [(rank, int(at[s]), int(c), float(d[s:e].min()), float(d[s:e].max())) for s, e, c in zip(starts, ends, n, strict=True)]


def _medians(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """video_id, spacing_median: of each video the two middle distances are looked for by counting, in ever narrower ranges."""
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    target = stored(sums.select("video_id", middle, F.col("low").alias("low"), F.col("high").alias("high")).select("*", F.col("rank").alias("left")), "targets")
    found = []
    for _ in range(60):  # a range of doubles is narrowed a thousandfold each time
        found.append(target.where("low = high").select("video_id", "rank", F.col("low").alias("d")))
        target = target.where("low < high")
        if not target.limit(1).count():
            break
        swept = _sweep(pairs.join(hinted(target.select("video_id", "rank", "low", "high")), "video_id"), ["rank", "low", "high"], "rank long, bin long, n long, low double, high double", _binned)
        bins = stored(swept.groupBy("video_id", "rank", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "bins")
        upto = F.sum("n").over(Window.partitionBy("video_id", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows at most
        placed = bins.withColumn("_upto", upto).join(target.select("video_id", "rank", "left").hint("merge"), ["video_id", "rank"])
        hit = placed.where((F.col("left") < F.col("_upto")) & (F.col("left") >= F.col("_upto") - F.col("n")))
        target = stored(hit.select("video_id", "rank", "low", "high", (F.col("left") - F.col("_upto") + F.col("n")).alias("left")), "targets")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("video_id").agg((F.min("d") + (F.max("d") - F.min("d")) * 0.5).alias("spacing_median"))


def spacing(holds: DataFrame, block: int = 512) -> DataFrame:
    """Distances from each hold to the later ones in the list that lie higher. All pairs are the feature, but none is written:
    bounded blocks of a video's places meet, and a block pair leaves its task as sums, or as counts by range. Holds in one
    place are measured once and counted as often as they occur."""
    pairs = _block_pairs(holds, block)
    totals = _sweep(pairs, [], "n long, s double, low double, high double", lambda d, n, _: [(int(n.sum()), float((d * n).sum()), float(d.min()), float(d.max()))])
    sums = stored(totals.groupBy("video_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")), "sums")
    means = hinted(sums.select("video_id", (F.col("s") / F.col("n")).alias("mean")))
    off = _sweep(pairs.join(means, "video_id"), ["mean"], "q double", lambda d, n, mean: [(float((n * (d - mean[0]) ** 2).sum()),)]).groupBy("video_id").agg(F.sum("q").alias("q"))
    stats = sums.join(stored(off, "deviations").hint("merge"), "video_id").join(stored(_medians(pairs, sums), "middles").hint("merge"), "video_id")
    stats = stats.select("video_id", (F.col("s") / F.col("n")).alias("spacing_mean"), "spacing_median", F.sqrt(F.col("q") / F.col("n")).alias("spacing_std"), F.col("low").alias("spacing_min"), F.col("high").alias("spacing_max"))
    names = ("mean", "median", "std", "min", "max")
    return holds.select("video_id").distinct().join(stored(stats, "spacing").hint("merge"), "video_id", "left").select("video_id", *[F.coalesce(f"spacing_{n}", F.lit(0.0)).alias(f"spacing_{n}") for n in names])


def step_features(scores: DataFrame) -> DataFrame:
    """scores: video_id, score, reach_penalty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scores.groupBy("video_id").agg(F.count(F.lit(1)).alias("step_count"), zero(F.avg("score")).alias("efficiency_mean"), zero(F.min("score")).alias("efficiency_min"), zero(F.max("score")).alias("efficiency_max"), zero(F.stddev_pop("score")).alias("efficiency_std"), zero(F.avg("reach_penalty")).alias("reach_mean"), zero(F.max("reach_penalty")).alias("reach_max"))


def switch_rate(rows: DataFrame, key: str = "step_id") -> DataFrame:
    """Hold changes within steps of more than one frame for each second of all steps. rows: frames with their step's times."""
    by = Window.partitionBy("video_id", key).orderBy("frame_index")
    changed = [(~F.col(f"{p}_contact_hold").eqNullSafe(F.lag(f"{p}_contact_hold").over(by))).cast("int") for p in LIMBS]
    counted = rows.withColumn("_s", F.when(F.row_number().over(by) > 1, sum(changed[1:], changed[0])).otherwise(0))
    steps = counted.groupBy("video_id", key).agg(F.sum("_s").alias("_s"), F.max(F.col("end_time") - F.col("start_time")).alias("_d"))
    return steps.groupBy("video_id").agg((F.sum("_s") / (F.sum("_d") + 1e-6)).alias("switch_rate"))


def route_extent(frames: DataFrame) -> DataFrame:
    two = F.count(F.lit(1)) >= 2
    return frames.groupBy("video_id").agg(F.when(two, F.max("com_y") - F.min("com_y")).otherwise(0.0).alias("route_length"), F.when(two, F.max("ts") - F.min("ts")).otherwise(0.0).alias("route_duration"))


def route_wall_angle(frames: DataFrame, given: Column, angle: str = "wall_angle") -> DataFrame:
    """The given angle, else the mean of the known ones, else 90."""
    return frames.groupBy("video_id").agg(F.coalesce(F.max(given), F.avg(angle), F.lit(90.0)).alias("wall_angle"))


def route_features(holds: DataFrame, frames: DataFrame, scores: DataFrame, switching: DataFrame, given_angle: Column | None = None) -> DataFrame:
    """All features of each video's route, one row: its holds, their spacing, steps, extent and wall. ``switching``: frames with their step's times."""
    parts = [
        hold_features(holds), spacing(holds), step_features(scores), switching, route_wall_angle(frames, F.lit(None).cast("double") if given_angle is None else given_angle),
    ]
    out = stored(route_extent(frames), "routes")
    for part in parts:
        out = out.join(stored(part, "part").hint("merge"), "video_id", "left")
    return out


def grade_report(features: DataFrame, columns: list[str], model: GBTRegressionModel | None = None) -> DataFrame:
    """The features with grade, confidence and band of each route; without a model the grade is unknown and the confidence 0."""
    if model is None:
        return features.select("*", F.lit(None).cast("double").alias("grade"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("band"))
    return predict_grades(model, features, columns)


def fit_grades(features: DataFrame, columns: list[str], label: str = "grade", depth: int = 6, rounds: int = 100, step: float = 0.1) -> GBTRegressionModel:
    data = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(features.na.fill(0.0, columns))
    return GBTRegressor(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=step, seed=42).fit(data)


def predict_grades(model: GBTRegressionModel, features: DataFrame, columns: list[str]) -> DataFrame:
    """Adds grade (0 to 10), confidence and band."""
    data = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(features.na.fill(0.0, columns))
    out = model.transform(data).withColumn("grade", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("prediction")))).drop("features", "prediction")
    return out.withColumn("confidence", confidence(columns)).withColumn("band", grade_band(F.col("grade")))


def confidence(columns: list[str]) -> Column:
    filled = sum(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0).cast("int") for c in columns), F.lit(0))
    return F.least(F.lit(1.0), filled / F.greatest(F.lit(1.0), F.lit(0.5 * len(columns))))


#: Fixed names of the two-grade bands.
BANDS = ("Beginner", "Intermediate", "Advanced", "Expert", "Elite")


def grade_band(grade: Column) -> Column:
    name = F.get(F.array(*[F.lit(b) for b in BANDS]), F.floor(grade / 2).cast("int"))
    number = F.concat(F.lit("V"), grade.cast("int").cast("string"))
    return F.when(grade >= 10, "Elite (V10+)").when(grade < 0, number).otherwise(F.concat(name, F.lit(" ("), number, F.lit(")")))
