"""Evaluation over prediction tables; each is one pass of partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.ranks import running


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def binary_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    n = lambda y, p: F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("bigint"))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    accuracy = _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.select(accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"))


def regression_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    c = df.agg(F.avg(F.pow(y - p, 2)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.corr(y, p).alias("pearson"), F.var_pop(y).alias("_v"))
    clean = F.when(F.isnan("pearson"), None).otherwise(F.col("pearson"))
    return c.select("mse", "mae", F.sqrt("mse").alias("rmse"), F.coalesce(clean, F.lit(0.0)).alias("pearson"), F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).otherwise(0.0).alias("r2"))


def confusion(df: DataFrame, classes: int = 5, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """label, predicted, n for every pair of classes."""
    grid = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("predicted"))
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts.hint("merge"), ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_accuracy(matrix: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy("label").agg(_ratio(hit, F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """auc by rank sums with average ranks, 0 with one class only. Rows are first counted by score, so the ranking sees distinct scores."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    ranked = running(counts, [], ["s"], ["neg"]).withColumn("won", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q")).select(_ratio(F.col("w"), F.col("p") * F.col("q")).alias("auc"))


def loss_report(df: DataFrame, label: str, predicted: str, action: str, probabilities: str, delta: float = 1.0, weight: float = 0.5) -> DataFrame:
    """Mean Huber and squared loss, cross entropy, and the sums with the weighted cross entropy."""
    d = F.abs(F.col(label) - F.col(predicted))
    huber = F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))
    entropy = -F.log(F.greatest(F.get(F.col(probabilities), F.col(action)), F.lit(1e-12)))
    out = df.agg(F.avg(huber).alias("huber"), F.avg(d * d).alias("mse"), F.avg(entropy).alias("cross_entropy"))
    return out.select("*", (F.col("huber") + weight * F.col("cross_entropy")).alias("huber_total"), (F.col("mse") + weight * F.col("cross_entropy")).alias("mse_total"))
