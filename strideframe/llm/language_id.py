"""Language identification (operator 13): averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Words and byte n-grams of a text, in lower case and without digits and signs, are hashed into buckets; each bucket has a
learned vector; a text is the mean of its vectors; a linear layer and a softmax give the languages. The executors count the
buckets of a bounded sample of labelled texts (``per_lang`` rows of each language, chosen by a hash) and write them to the
shared folder. The driver trains by stochastic gradient descent in numpy and reads one part of that table at a time, so
that no text's buckets are left out and its memory stays bounded. Whole texts are then scored on the executors.

Every fifth row of the sample is not trained on. With it the softmax gets a temperature, and the least score is chosen at
which the share of wrong answers among accepted texts, by an exact binomial bound, is at most ``risk``: texts below are
marked ``rejected``. Where no score is proven, all texts are rejected.

Cases: null texts and those without a letter are ``und`` with score 0 and rejected. Very long texts are learnt and scored
whole. Rows with null language are not learnt from; null ids count as an empty one. Equal rows are learnt once, and scored
each. Without labelled rows every text is ``und``; with one language every text with a letter is that one. Ties go to the
first language by name. An empty table gives no rows; extra columns are ignored. Language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strideframe.functions.ranks import hinted
from strideframe.llm.common import crc_of_id, fields, groups, materialize, table, whole
from strideframe.llm.quality_classifier import Bag, SubwordParams, bag_of, buckets_of, pack_counts, parts_of
from strideframe.llm.quality_rules import upper_bound

UNKNOWN = "und"
#: Letters and bytes beyond ASCII stay; all else is a space.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageParams:
    bits: int = 15
    grams: tuple[int, ...] = (2, 3, 4)
    dim: int = 16
    per_lang: int = 1000  # about so many labelled rows of a language are learnt from
    part_bytes: int = 8 << 20  # of the sample's bucket counts that the driver holds at once
    epochs: int = 8
    rate: float = 0.5
    risk: float = 0.05  # wrong answers among accepted texts
    alpha: float = 0.05
    seed: int = 13

    @property
    def subwords(self) -> SubwordParams:
        return SubwordParams(bits=self.bits, grams=self.grams)


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS)


def sums(blobs: list[bytes], vectors: np.ndarray, params: LanguageParams) -> np.ndarray:
    """Mean over all n-grams of each text of its buckets' vectors; 0 where there are none."""
    out, count = np.zeros((len(blobs), vectors.shape[1])), np.zeros(len(blobs), np.int64)
    columns = [np.ascontiguousarray(vectors[:, i]) for i in range(vectors.shape[1])]
    for a, b in groups(blobs):
        for buckets, offsets in buckets_of(blobs[a:b], params.subwords):
            for i, c in enumerate(columns):
                running = np.concatenate([[0.0], np.cumsum(c[buckets], dtype=np.float64)])
                out[a:b, i] += running[offsets[1:]] - running[offsets[:-1]]
            count[a:b] += np.diff(offsets)
    return out / np.maximum(count, 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sgd(parts: Callable[[], Iterator[list[Bag]]], classes: int, prior: np.ndarray, params: LanguageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias. ``parts()`` gives the sample again, a part (buckets, shares, class) at a time."""
    draw = np.random.default_rng(params.seed)
    vectors = draw.normal(0, 0.1, (1 << params.bits, params.dim)).astype(np.float32)
    layer, bias = draw.normal(0, 0.1, (params.dim, classes)).astype(np.float32), np.log(prior).astype(np.float32)
    seen_v, seen_l = np.full(1 << params.bits, 1e-6, np.float32), np.full_like(layer, 1e-6)
    for epoch in range(params.epochs):
        rate = np.float32(params.rate * (1 - epoch / params.epochs))
        for part in parts():
            for i in draw.permutation(len(part)):
                index, weight, label = part[i]
                mine = vectors[index]
                mean = weight @ mine
                g = softmax(mean @ layer + bias)
                g[label] -= 1
                back = layer @ g
                step = np.outer(mean, g)
                seen_l += step * step
                layer -= rate * step / np.sqrt(seen_l)
                seen_v[index] += weight * weight * (back @ back)
                vectors[index] = mine - (rate * weight / np.sqrt(seen_v[index]))[:, None] * back
    return vectors, layer, bias


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(truth)), truth], 1e-300)).mean()
    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def cutoff(scores: np.ndarray, right: np.ndarray, params: LanguageParams) -> float:
    """The least score whose accepted texts are wrong at most ``risk`` often with confidence 1 - alpha; 2 where none is proven.

    One fixed sequence: the surest texts, as many as a proof without errors needs, then ever more of them, up to the first
    step that is not proven. Steps depend on the scores alone, so the level needs no correction."""
    order, best = np.argsort(-scores, kind="stable"), 2.0
    least = int(np.ceil(np.log(params.alpha) / np.log1p(-params.risk)))
    for n in np.unique(np.linspace(least, len(scores), 101).astype(int)) if len(scores) >= least else ():
        taken = scores >= scores[order[n - 1]]
        if upper_bound(int((taken & ~right).sum()), int(taken.sum()), params.alpha) > params.risk:
            break
        best = float(scores[order[n - 1]])
    return best


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    vectors: np.ndarray  # folded with the layer where there are fewer languages than dimensions
    layer: np.ndarray | None
    bias: np.ndarray
    heat: float
    least: float

    def logits(self, blobs: list[bytes], params: LanguageParams) -> np.ndarray:
        mean = sums(blobs, self.vectors, params)
        return (mean if self.layer is None else mean @ self.layer) + self.bias


def labelled_sample(rows: DataFrame, params: LanguageParams) -> DataFrame:
    """(lang, text, _h) of about ``per_lang`` rows of each language, by a hash; equal rows count once."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    hashed = rows.withColumn("_h", F.xxhash64("_id", "text"))
    share = F.least(F.lit(1.0), F.lit(float(params.per_lang)) / F.col("_n"))
    some = hashed.join(hinted(counts), "lang").where((F.col("_h") / 2.0**64 + 0.5) < share)
    return some.groupBy("lang", "_h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, params: LanguageParams) -> LanguageModel | None:
    """Learns from the rows given; None without a labelled text that has a letter."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    @pandas_udf("binary")
    def bag(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            packed = [pack_counts([b for b, _ in buckets_of([normal(t)], params.subwords)]) for t in batch]
            yield pd.Series(packed, index=batch.index, dtype=object)

    sample = materialize(labelled_sample(rows, params).select(F.col("lang").alias("_label"), "_h", bag("text").alias("bag")), "sample")
    shares = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}  # one row a language
    names = tuple(sorted(shares))
    if not names:
        return None
    code = {name: i for i, name in enumerate(names)}.__getitem__
    held = sample.where(F.pmod("_h", F.lit(5)) == 0)
    parts = parts_of(materialize(sample.where(F.pmod("_h", F.lit(5)) != 0), "trained"), code, params.part_bytes)
    prior = np.array([shares[name] for name in names], float) / sum(shares.values())
    vectors, layer, bias = sgd(parts, len(names), prior, params)
    if len(names) <= params.dim:
        vectors, layer = vectors @ layer, None

    def rescored() -> Iterator[tuple[np.ndarray, int]]:
        for r in held.toLocalIterator():
            index, weight, label = bag_of(r, code)
            mean = weight @ vectors[index]
            yield (mean if layer is None else mean @ layer) + bias, label

    checked = list(rescored())  # one row of scores for each held row
    if not checked:
        return LanguageModel(names, vectors, layer, bias, 1.0, 2.0)
    logits, truth = np.array([c[0] for c in checked], float), np.array([c[1] for c in checked])
    heat = temperature(logits, truth)
    p = softmax(logits / heat)
    return LanguageModel(names, vectors, layer, bias, heat, cutoff(p.max(1), p.argmax(1) == truth, params))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: LanguageParams = LanguageParams(), learn: F.Column | None = None) -> DataFrame:
    """id, held_out, lang_pred, score and rejected of every row. Rows where ``learn`` is false are held out; by default a third by a checksum of the id."""
    held = (crc_of_id(id_col) % 3 == 1) if learn is None else ~learn
    model = fit(docs.where(~held), id_col, text_col, lang_col, params)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows of ``dim`` floats at most

    @pandas_udf(fields("lang_pred string,score double,rejected boolean"))
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in texts:
            p = softmax(model.logits([normal(t) for t in batch], params) / model.heat)
            top = p.max(1)
            yield pd.DataFrame({"lang_pred": np.array(model.names, object)[p.argmax(1)], "score": top, "rejected": top < model.least}, index=batch.index)

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    readable = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    found = none if model is None else F.when(readable, best.asNondeterministic()(whole(text_col))).otherwise(none)
    return docs.select(F.col(id_col), held.alias("held_out"), found.alias("_found")).select(id_col, "held_out", "_found.*")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
