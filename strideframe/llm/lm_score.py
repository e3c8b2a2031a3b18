"""Language-model scores (operator 7): a log-bilinear model trained with noise-contrastive estimation.

Token counts cover every training document. The output units are the ``words`` commonest tokens and
``classes`` classes of all others (by their last two bytes); a token outside the common ones has its class's
probability times its smoothed share of the class. A unit's score after two context units is bilinear,
``C1 r(w1) + C2 r(w2)`` against its vector plus a bias. Models are trained on all tokens of their share of the
documents by stochastic gradient steps in numpy, with noise from the unigram distribution shared by a batch;
Spark averages the parameters by tokens, and the next round starts from the average. The shares are groups of some
``group_tokens`` tokens by a hash of the document, so that neither tasks nor partitions change a score. For scoring, batched
matrix products give the logarithm of the normaliser of every context pair, so probabilities are exact and
sum to one.

The ``head`` commonest tokens' counts go to every task (bounded); all other tokens are joined by token, summed
to document sums before anything else, so a token is nowhere limited and none is hot.

Texts are split once: counts come from a first pass, and a second one writes each document's units, two bytes a
token, from which models are trained and documents scored.

Cases: null and empty texts are the end token alone. Very long texts are read whole. Null ids count as the empty id.
Repeated rows count as often as they occur. Of equally common tokens those with the least hash are in the head, and
those first in byte order are units. Without training documents every count is zero and the units are uniform. Empty
tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from strideframe.llm.common import crc_of_id, fields, materialize, table, whole

END = b"\n"  # cannot occur in a word


@dataclass(frozen=True)
class BilinearParams:
    words: int = 767
    classes: int = 256
    head: int = 200_000  # commonest tokens whose counts every task holds
    dim: int = 16
    rounds: int = 1
    group_tokens: int = 1 << 21  # that one model is trained on before models are averaged
    batch: int = 4096
    noise: int = 96  # noise units, shared by the batch
    rate: float = 0.08
    smoothing: float = 0.1  # of counts, as in the base score
    seed: int = 5

    @property
    def units(self) -> int:
        return self.words + self.classes


def class_of(token: bytes, params: BilinearParams) -> int:
    return zlib.crc32(token[-2:]) % params.classes


def tokens_of(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def count_tokens(docs: DataFrame, params: BilinearParams) -> DataFrame:
    """token (binary), c and class of every token in ``docs`` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts):
            tokens = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([class_of(t, params) for t in tokens], pa.int32())], names=["token", "c", "class"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_of(text))
            if len(counts) > 200_000:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    rows = docs.select("text").mapInArrow(run, fields("token binary, c long, class int"))
    return materialize(rows.groupBy("token").agg(F.sum("c").alias("c"), F.first("class").alias("class")), "tokens")


@dataclass
class Vocabulary:
    total: int  # N
    distinct: int  # V
    head: dict[bytes, tuple[int, float]]  # token: unit, log10(c + smoothing)
    unit_count: np.ndarray
    class_norm: np.ndarray  # log10 of the smoothed tokens of each class

    def unit(self, token: bytes, params: BilinearParams) -> int:
        found = self.head.get(token)
        return found[0] if found else params.words + class_of(token, params)


def read_vocabulary(counts: DataFrame, params: BilinearParams) -> Vocabulary:
    """The bounded parts of the counts: the head, and sums by class."""
    # The least count of the head, from a histogram of the counts' logarithms (a few thousand rows): no task sorts the tokens.
    step = F.floor(F.log2("c") * 64).cast("int")
    histogram = {r["k"]: r["n"] for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    room, chosen = params.head, step >= 0
    for k in sorted(histogram, reverse=True):
        if histogram[k] > room:
            share = max(0.0, room - 4 * room**0.5) / histogram[k]  # of this step's tokens as many as there is room for
            chosen = (step > k) | ((step == k) & (F.xxhash64("token") < F.lit(int(-(1 << 63) + (1 << 64) * share))))
            break
        room -= histogram[k]
    top = counts.where(chosen).collect()  # params.head rows, but for chance
    top.sort(key=lambda r: (-r["c"], bytes(r["token"])))
    head, unit_count = {}, np.zeros(params.units, np.int64)
    for i, r in enumerate(top):
        token = bytes(r["token"])
        unit = i if i < params.words else params.words + r["class"]
        head[token] = (unit, float(np.log10(r["c"] + params.smoothing)))
        if i < params.words:
            unit_count[i] = r["c"]
    sums = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    c, n = np.zeros(params.classes), np.zeros(params.classes)
    for r in sums:
        c[r["class"]], n[r["class"]] = r["c"], r["n"]
    for token, (unit, _) in head.items():
        if unit < params.words:
            k = class_of(token, params)
            c[k] -= unit_count[unit]
            n[k] -= 1
    unit_count[params.words :] = c
    return Vocabulary(int(sum(r["c"] for r in sums)), int(sum(r["n"] for r in sums)), head, unit_count, np.log10(c + params.smoothing * (n + 1)))


@dataclass
class Model:
    context: np.ndarray  # (units + 1) x dim; the last is before a text's begin
    mix1: np.ndarray  # dim x dim
    mix2: np.ndarray
    output: np.ndarray  # units x dim
    bias: np.ndarray

    def copy(self) -> Model:
        return Model(*(x.copy() for x in (self.context, self.mix1, self.mix2, self.output, self.bias)))

    def rows(self) -> np.ndarray:
        """All parameters as rows of dim + 1 numbers."""
        d = self.context.shape[1]
        full = np.vstack([self.context, self.mix1, self.mix2, self.output])
        last = np.concatenate([np.zeros(len(self.context) + 2 * d), self.bias])
        return np.column_stack([full, last]).astype(np.float64)

    @classmethod
    def of(cls, rows: np.ndarray, units: int) -> Model:
        d = rows.shape[1] - 1
        a, b, c = units + 1, units + 1 + d, units + 1 + 2 * d
        f = rows.astype(np.float32)
        return cls(f[:a, :d].copy(), f[a:b, :d].copy(), f[b:c, :d].copy(), f[c:, :d].copy(), f[c:, d].copy())


def start_model(v: Vocabulary, params: BilinearParams) -> Model:
    draw = np.random.default_rng(params.seed)
    make = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
    eye = np.eye(params.dim, dtype=np.float32)
    return Model(make(params.units + 1, params.dim), eye.copy(), 0.5 * eye, make(params.units, params.dim), np.log(noise_share(v)).astype(np.float32))


def noise_share(v: Vocabulary) -> np.ndarray:
    smooth = v.unit_count + 1.0
    return smooth / smooth.sum()


def summed(at: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the sum of those rows of ``what`` whose index is it."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # a radix sort
    sorted_ = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    out = np.zeros((n, what.shape[1]), np.float32)
    out[sorted_[first]] = np.add.reduceat(what[order], first, axis=0)
    return out


class Steps:
    """Noise-contrastive steps with adaptive rates, updating a model in place."""

    def __init__(self, model: Model, share: np.ndarray, seed: int, params: BilinearParams):
        self.m, self.params, self.draw = model, params, np.random.default_rng(seed)
        self.cumulative, self.log_noise = np.cumsum(share), (np.log(share) + np.log(params.noise)).astype(np.float32)
        self.seen = [np.full_like(x, 1e-5) for x in self._arrays()]

    def _arrays(self) -> list[np.ndarray]:
        m = self.m
        return [m.context, m.mix1, m.mix2, m.output, m.bias]

    def learn(self, units: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        order = self.draw.permutation(len(units))
        units, w1, w2 = units[order], w1[order], w2[order]
        for a in range(0, len(units), self.params.batch):
            self.step(*(x[a : a + self.params.batch] for x in (units, w1, w2)))

    def step(self, t: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        m, n = self.m, len(t)
        r1, r2 = m.context[c1], m.context[c2]
        q = r1 @ m.mix1 + r2 @ m.mix2
        noise = np.minimum(np.searchsorted(self.cumulative, self.draw.random(self.params.noise)), len(m.bias) - 1)
        out_t, out_n = m.output[t], m.output[noise]
        # A token against its noise units, which the batch shares; the model's own normaliser is taken as one.
        g_t = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, out_t) + (m.bias - self.log_noise)[t], -30, 30)))
        g_n = -1 / (1 + np.exp(-np.clip(q @ out_n.T + (m.bias - self.log_noise)[noise], -30, 30)))
        dq = g_t[:, None] * out_t + g_n @ out_n
        output = summed(t, g_t[:, None] * q, len(m.bias))
        np.add.at(output, noise, g_n.T @ q)
        bias = np.bincount(t, g_t, len(m.bias)).astype(np.float32)
        np.add.at(bias, noise, g_n.sum(axis=0))
        context = summed(c1, dq @ m.mix1.T, len(m.context)) + summed(c2, dq @ m.mix2.T, len(m.context))
        rate = np.float32(self.params.rate)
        for x, seen, g in zip(self._arrays(), self.seen, (context, r1.T @ dq, r2.T @ dq, output, bias), strict=True):
            g = g / np.float32(n)
            seen += g * g
            x += rate * g / np.sqrt(seen)


def contexts(units: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets with their last and last but one unit, over several texts."""
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for u in units:
        padded = np.concatenate([[begin, begin], u])
        one.append(padded[1:-1])
        two.append(padded[:-2])
    return np.concatenate([np.zeros(0, np.int64), *units]).astype(np.int64), np.concatenate(one), np.concatenate(two)


def train(encoded: DataFrame, v: Vocabulary, params: BilinearParams) -> Model:
    """``encoded``: the training documents' units. Each round ends in one average row for each row of parameters."""
    model = start_model(v, params)
    sc = encoded.sparkSession.sparkContext
    share = noise_share(v)
    groups = -(-v.total // params.group_tokens) or 1
    key = F.xxhash64("_id", "units")
    placed = encoded.select(F.pmod(key, F.lit(groups)).cast("int").alias("group"), key.alias("key"), "units")
    placed = placed.repartition(min(groups, 100_000), "group").sortWithinPartitions("group", "key", "units").select("group", "units")
    for round_ in range(params.rounds):
        now = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now, round_=round_) -> Iterator[pa.RecordBatch]:
            group, steps, seen, held, tokens = None, None, 0, [], 0

            def learn():
                nonlocal held, tokens, seen
                if held:
                    steps.learn(*contexts(held, params.units))
                    seen, held, tokens = seen + tokens, [], 0

            def made():
                learn()
                rows = steps.m.rows() * seen
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int64()), pa.array(np.full(len(rows), seen), pa.int64()), *(pa.array(c) for c in rows.T)], names=["row", "seen", *(f"p{i}" for i in range(rows.shape[1]))])

            for batch in batches:
                for g, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if g != group:
                        if group is not None:
                            yield made()
                        group, steps, seen = g, Steps(now.value.copy(), share, params.seed + round_, params), 0
                    held.append(np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64))
                    tokens += len(held[-1])
                    if tokens >= 1 << 18:  # texts are learnt from so many tokens at a time, however they arrive
                        learn()
            if group is not None:
                yield made()

        columns = [f"p{i}" for i in range(params.dim + 1)]
        parts = placed.mapInArrow(run, fields("row long, seen long, " + ", ".join(f"{c} double" for c in columns)))
        mean = parts.groupBy("row").agg(F.sum("seen").alias("seen"), *[F.sum(c).alias(c) for c in columns]).where("seen > 0").collect()
        if not mean:
            return model
        rows = np.zeros((len(mean), params.dim + 1))
        for r in mean:
            rows[r["row"]] = [r[c] / r["seen"] for c in columns]
        model = Model.of(rows, params.units)
    return model


def tables(m: Model, params: BilinearParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of a unit by the last context unit (bias included) and by the one before it, and log10 of the normaliser of each pair of contexts, by batched matrix products."""
    s1 = (m.context @ m.mix1) @ m.output.T + m.bias
    s2 = (m.context @ m.mix2) @ m.output.T
    high1, high2 = s1.max(axis=1), s2.max(axis=1)
    e1, e2 = np.exp(s1 - high1[:, None]).astype(np.float64), np.exp(s2 - high2[:, None]).astype(np.float64)
    # The sum over units of exp(s1 + s2) is a product of matrices: contexts x units by units x contexts.
    z = np.empty((len(s1), len(s2)), np.float32)
    for a in range(0, len(s1), 256):
        z[a : a + 256] = np.log(np.maximum(e1[a : a + 256] @ e2.T, 1e-300)) + high1[a : a + 256, None] + high2
    ten = np.float32(np.log(10))
    return (s1 / ten).astype(np.float32), (s2 / ten).astype(np.float32), z / ten


def encode_documents(rows: DataFrame, v: Vocabulary, params: BilinearParams) -> DataFrame:
    """_id, held_out, n_tokens, n_head (tokens of the head), head_sum (of their logarithms), class_sum (of those that are no units of their own), units and tail (the other tokens)."""
    head = rows.sparkSession.sparkContext.broadcast(v.head)
    norm = v.class_norm
    tail = ArrayType(fields("token binary, tf long"))
    schema = StructType([StructField("_id", rows.schema["_id"].dataType), StructField("held_out", rows.schema["held_out"].dataType), *fields("n_tokens long, n_head long, head_sum double, class_sum double, units binary", tail=tail).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        struct = pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int64())]))
        for batch in batches:
            out = [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                tokens = tokens_of(text)
                found = [known.get(t) for t in tokens]
                rare = Counter(t for t, f in zip(tokens, found, strict=True) if f is None)
                units = np.fromiter((f[0] if f else params.words + class_of(t, params) for t, f in zip(tokens, found, strict=True)), np.uint16, len(tokens))
                logs = np.fromiter((f[1] if f else 0.0 for f in found), np.float64, len(tokens))
                others = units >= params.words
                mine = (len(tokens), len(tokens) - rare.total(), float(logs.sum()), float(logs[others].sum() - norm[units[others] - params.words].sum()), units.tobytes(), [{"token": t, "tf": n} for t, n in rare.items()])
                for column, value in zip(out, mine, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: BilinearParams = BilinearParams()) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = docs.select(F.col(id_col).alias("_id"), (crc_of_id(id_col) % 10 == 0).alias("held_out"), whole(text_col).alias("text"))
    counts = count_tokens(rows.where(~F.col("held_out")), params)
    v = read_vocabulary(counts, params)
    encoded = materialize(encode_documents(rows, v, params), "encoded")
    model = train(encoded.where(~F.col("held_out")), v, params)
    shared = docs.sparkSession.sparkContext.broadcast(tables(model, params))

    @pandas_udf(DoubleType())
    def model_sum(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s1, s2, z = shared.value
        for batch in texts:
            units = [np.frombuffer(u, np.uint16) for u in batch]
            t, c1, c2 = contexts(units, params.units)
            logs = s1[c1, t].astype(np.float64) + s2[c2, t] - z[c1, c2]
            sizes = np.array([len(u) for u in units], np.int64)  # one at least: the end
            yield pd.Series(np.add.reduceat(logs, np.cumsum(sizes) - sizes) if len(units) else np.zeros(0), index=batch.index)

    rare = encoded.where(F.size("tail") > 0).select("_row", F.explode("tail").alias("t")).select("_row", F.col("t.token").alias("token"), F.col("t.tf").alias("tf"))
    smooth = F.log10(F.coalesce("c", F.lit(0)) + F.lit(params.smoothing))
    tail = rare.join(counts.select("token", "c").hint("merge"), "token", "left").groupBy("_row").agg(F.sum(F.col("tf") * smooth).alias("tail_sum"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    scored = encoded.select("_id", "held_out", "n_tokens", "n_head", "head_sum", "_row", (F.col("class_sum") + model_sum.asNondeterministic()("units")).alias("model_sum"))
    out = scored.join(materialize(tail, "tails").hint("merge"), "_row", "left")
    rest, norm = F.coalesce("tail_sum", F.lit(0.0)), float(np.log10(v.total + params.smoothing * (v.distinct + 1)))
    return out.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + rest - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model_sum") + rest).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
