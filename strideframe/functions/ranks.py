"""Running sums and exact quantiles of ordered tables, without one task that sees the whole order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.tables import stored


def running(df: DataFrame, keys: list[str], order: list[str], amounts: list[str], parts: int = 64) -> DataFrame:
    """Adds ``before_{c}`` for each of ``amounts``: its sum over the rows of the key that come earlier. ``order`` must not tie.

    Ranges of the order are summed apart and shifted by the ranges before them (``parts`` rows a key at most), so a key
    with most of the rows is spread over many tasks."""
    placed = stored(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = stored(placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in amounts]), "range_sums")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in amounts]), "range_shifts")
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{c}") for c in amounts])
    joined = rows.join(shifts.hint("merge"), [*keys, "_part"])
    return joined.select(*df.columns, *[(F.col(f"_w_{c}") + F.col(f"_s_{c}")).alias(f"before_{c}") for c in amounts])


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median (the mean of the middle two of an even number). Equal values are counted first."""
    return counted_medians(stored(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "values"), keys, value)


def counted_medians(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same of distinct values with their number ``n``."""
    sizes = stored(counted.groupBy(*keys).agg(F.sum("n").alias("_all")), "sizes")
    placed = running(counted, keys, [value], ["n"]).join(sizes.hint("merge"), keys)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    at = lambda rank: F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col(value)))
    found = placed.where((F.col("before_n") <= high) & (low < F.col("before_n") + F.col("n"))).groupBy(*keys).agg(at(low).alias("_low"), at(high).alias("_high"))
    return found.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5).alias("median"))


def hash_quantile(df: DataFrame, keys: list[str], value: str, share: Decimal) -> DataFrame:
    """keys and cut: the value at place ceil(share * n) of the key's n rows, exact. ``value`` is below 2^32; null comes last.

    The upper halves of the values are counted, then the lower halves of those in the half that holds the place, so a key
    has 65,536 rows each time and one more at most."""
    half = F.lit(1 << 16)
    split = df.select(*keys, F.coalesce(F.shiftright(value, 16), half).alias("_high"), F.coalesce(F.col(value).bitwiseAND(half - 1), F.lit(0)).alias("_low"))
    upto = lambda c: F.sum("_n").over(Window.partitionBy(*keys).orderBy(c))
    highs = stored(split.groupBy(*keys, "_high").agg(F.count(F.lit(1)).alias("_n")), "halves")
    place = F.greatest(F.ceil(F.lit(share) * F.sum("_n").over(Window.partitionBy(*keys)).cast("decimal(20,0)")).cast("bigint"), F.lit(1))
    placed = highs.select("*", upto("_high").alias("_upto"), place.alias("_place"))
    found = placed.where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place")))
    found = found.select(*keys, "_high", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place"))  # one row a key
    lows = split.join(hinted(found), [*keys, "_high"]).groupBy(*keys, "_high", "_place", "_low").agg(F.count(F.lit(1)).alias("_n"))
    lows = lows.withColumn("_upto", upto("_low")).where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place")))
    return lows.select(*keys, F.when(F.col("_high") < half, F.col("_high") * half + F.col("_low")).alias("cut"))


def hinted(small: DataFrame, most: int = 10_000) -> DataFrame:
    """A written table with a join hint: broadcast up to ``most`` rows, else sorted and merged."""
    kept = stored(small, "small")
    return kept.hint("broadcast" if kept.count() <= most else "merge")


