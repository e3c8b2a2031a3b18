"""Quality classifier with supervised subword embeddings (operator 5).

Words, word pairs and byte n-grams are hashed into buckets; each bucket has a learned vector; a document is
the mean of its vectors; a softmax layer gives the two classes. The executors hash the texts of a bounded
sample of labelled documents (``sample``, the fold of the contract, in the order of a hash of the id) into
bucket counts and write them to the shared folder; the driver trains vectors and layer by stochastic gradient descent in
numpy, a part of that table (``part_bytes``) at a time, so that every bucket of a text counts and its memory stays bounded.
As the mean is linear, a trained bucket enters the softmax by one number, which the executors average over whole texts.

Cases: null and empty texts have no n-grams and get the score of the bias. Very long texts are trained on and scored
whole. Labels other than 0 and 1 are unused; contradicting labels of one id
count as 1. Null ids are not held out and have no label. Without labels, or with one class alone, the score is the
(smoothed) share of label 1. Repeated ids are scored row by row, and trained on by the text with the least hash.
Labels, language, source and id are never inputs. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DoubleType

from strideframe.llm.common import crc_of_id, first_by_hash, groups, hash_words, materialize, table, whole


@dataclass(frozen=True)
class SubwordParams:
    bits: int = 16  # 2**bits buckets, 16 at most
    grams: tuple[int, ...] = (3, 4)  # bytes in a character n-gram
    dim: int = 8
    sample: int = 3000  # labelled documents that are trained on
    part_bytes: int = 16 << 20  # of the sample's bucket counts that the driver holds at once; one document's are 6 * 2**bits at most
    epochs: int = 12
    rate: float = 0.5
    seed: int = 7


def buckets_of(blobs: list[bytes], params: SubwordParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: bucket of each occurrence, and where each text's begin (length n + 1)."""
    shift = np.uint64(64 - params.bits)
    mix = np.uint64(0x9E3779B97F4A7C15)
    words, offsets = hash_words(blobs)
    out = [((words * mix >> shift).astype(np.int64), offsets)]
    # Pairs: the last word of a text has no partner, so each non-empty text has one pair fewer.
    inner = np.ones(len(words), bool)
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    inner[ends] = False
    first, second = words[:-1][inner[:-1]], words[1:][inner[:-1]]
    pairs = np.where(first == second, np.uint64(1), first * np.uint64(31) + second)  # a word said twice is one feature, whichever word
    counts = np.maximum(np.diff(offsets) - 1, 0)
    out.append(((pairs * mix >> shift).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])))
    data = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    for n in params.grams:
        h = np.zeros(max(0, len(data) - n + 1), np.uint32)
        for k in range(n):
            h = h * np.uint32(257) + data[k : k + len(h)]
        h = (h + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - params.bits)
        # Those that reach into the next text are left out.
        fits = np.ones(len(h), bool)
        for b in begins[1:-1]:
            fits[max(0, b - n + 1) : b] = False
        out.append((h[fits].astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(sizes - n + 1, 0))])))
    return out


def margins(blobs: list[bytes], weights: np.ndarray, params: SubwordParams) -> np.ndarray:
    """Mean over all n-grams of each text of its buckets' numbers; 0 where there are none."""
    total, count = np.zeros(len(blobs)), np.zeros(len(blobs), np.int64)
    for a, b in groups(blobs):
        for buckets, offsets in buckets_of(blobs[a:b], params):
            running = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
            total[a:b] += running[offsets[1:]] - running[offsets[:-1]]
            count[a:b] += np.diff(offsets)
    return total / np.maximum(count, 1)


def pack_counts(buckets: list[np.ndarray]) -> bytes:
    """Sparse bucket shares: the buckets as 2-byte numbers, then their shares as 4-byte floats."""
    every = np.concatenate(buckets)
    index, n = np.unique(every, return_counts=True)
    return index.astype("<u2").tobytes() + (n / max(1, len(every))).astype("<f4").tobytes()


#: A text's buckets and their shares, and its label.
Bag = tuple[np.ndarray, np.ndarray, int]


def bag_of(row, code: Callable[[object], int]) -> Bag:
    raw, n = bytes(row["bag"]), len(row["bag"]) // 6
    return np.frombuffer(raw, "<u2", n), np.frombuffer(raw, "<f4", n, 2 * n), code(row["_label"])


def parts_of(sample: DataFrame, code: Callable[[object], int], part_bytes: int) -> Callable[[], Iterator[list[Bag]]]:
    """A function that reads the written sample (_h, _label, bag) anew, a part of about ``part_bytes`` at a time. Parts and their order come from the hash _h, not from Spark's partitions."""
    total = sample.agg(F.sum(F.length("bag"))).first()[0] or 0
    n = 1 + int(total) // part_bytes
    tables = [materialize(sample.where(F.pmod(F.xxhash64("_h"), F.lit(n)) == k), "bags") for k in range(n)] if n > 1 else [sample]
    held: list[list[Bag]] = []

    def read() -> Iterator[list[Bag]]:
        if held:
            yield held[0]
            return
        for table_ in tables:
            part = [bag_of(r, code) for r in sorted(table_.collect(), key=lambda r: (r["_h"], r["_label"], bytes(r["bag"])))]
            if n == 1:
                held.append(part)
            yield part
            del part

    return read


def train(parts: Callable[[], Iterator[list[Bag]]], good: int, total: int, params: SubwordParams) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent with adaptive rates; returns each bucket's number in the softmax and the bias. ``good`` of ``total`` labels are 1."""
    share = float((good + 1) / (total + 2))
    prior = float(np.log(share / (1 - share)))
    if not 0 < good < total:
        return np.zeros(1 << params.bits, np.float32), prior
    draw = np.random.default_rng(params.seed)
    vectors = draw.normal(0, 0.1, (1 << params.bits, params.dim)).astype(np.float32)
    layer, bias = draw.normal(0, 0.1, (params.dim, 2)).astype(np.float32), np.array([0.0, prior], np.float32)
    seen_v, seen_l, seen_b = np.full(1 << params.bits, 1e-6, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-2)
    target = np.eye(2, dtype=np.float32)
    for epoch in range(params.epochs):
        rate = np.float32(params.rate * (1 - epoch / params.epochs))
        for part, i in ((part, i) for part in parts() for i in draw.permutation(len(part))):
            index, weight, label = part[i]
            mine = vectors[index]
            mean = weight @ mine
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            g = p / p.sum() - target[label]
            back = layer @ g
            step = np.outer(mean, g)
            seen_l += step * step
            layer -= rate * step / np.sqrt(seen_l)
            seen_b += g * g
            bias -= np.float32(0.1) * rate * g / np.sqrt(seen_b)
            seen_v[index] += weight * weight * (back @ back)
            vectors[index] = mine - (rate * weight / np.sqrt(seen_v[index]))[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, params: SubwordParams) -> tuple[np.ndarray, float]:
    """``labels``: rows (_id, _label) to learn from. Only a bounded sample's bucket counts reach the driver, in parts."""
    labels = materialize(labels, "labels")
    some = materialize(first_by_hash(labels, "_id", params.sample, labels.count()), "labelled")  # params.sample rows at most: safe to broadcast

    @pandas_udf(BinaryType())
    def bag(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = [pack_counts([b for b, _ in buckets_of([t.encode("utf-8", "surrogatepass")], params)]) for t in batch]
            yield pd.Series(rows, index=batch.index, dtype=object)

    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).join(F.broadcast(some), "_id")
    bags = rows.select("_id", "_label", F.xxhash64("_text").alias("_order"), bag("_text").alias("bag"))
    once = bags.groupBy("_id").agg(F.first("_label").alias("_label"), F.min_by("bag", "_order").alias("bag"))  # of a repeated id one text
    sample = materialize(once.select(F.xxhash64("_id").alias("_h"), "_label", "bag"), "sample")  # params.sample rows at most
    good, total = sample.agg(F.coalesce(F.sum("_label"), F.lit(0)), F.count(F.lit(1))).first()
    return train(parts_of(sample, int, params.part_bytes), int(good), int(total), params)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: SubwordParams = SubwordParams()) -> DataFrame:
    """id, held_out, score and predicted of every document; ``held_out`` ones are never learnt from."""
    truth = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    weights, bias = fit(docs, truth.where(crc_of_id("_id") % 3 != 1), id_col, text_col, params)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            z = margins([t.encode("utf-8", "surrogatepass") for t in batch], shared.value, params) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))), index=batch.index)

    out = docs.select(F.col(id_col), (crc_of_id(id_col) % 3 == 1).alias("held_out"), score.asNondeterministic()(whole(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
