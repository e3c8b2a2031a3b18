"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 11).

The centred rows X are bidiagonalised, X V = U B: a distributed product X v gives the next left vector, a distributed
product of X transposed with it the next right vector. Both are orthogonalised anew against all earlier ones. A left
vector has an entry for each row; it is never stored or collected, as it is X g for a short vector g that the driver keeps,
so that a task makes the entries of its rows when it needs them. The small SVD of B gives components and deviations.

Work stops before the full dimension only where that is proven safe: the wanted components have settled, and what is
left of the squared entries of X outside the right vectors is less than the last wanted component's share, so that no
component, not even a repeated one, can be missing.

Cases: vectors that are null, empty or hold null or non-finite entries are dropped, and so are those whose length is not
the commonest (of ties the longer). Entries beyond 2**51 count as 2**51. Components without variance are left out, so that
one row alone, equal rows or an empty table give no rows. Null and repeated ids are rows like others. A squared deviation
beyond a long is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strideframe.llm.common import fields, materialize, table

EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class WhitenParams:
    components: int = 8
    scale: int = 1024  # an entry c becomes floor(scale * c) + shift
    shift: int = 100_000
    lanes: int = 4096  # most tasks of a product: the driver receives one vector from each
    seed: int = 11


@dataclass(frozen=True)
class Whitening:
    """What the fit learns. ``floor`` and ``rest``: the mean of a dimension is floor + rest / n exactly."""

    n: int
    floor: np.ndarray
    rest: np.ndarray
    components: np.ndarray  # dimension x component
    variances: np.ndarray
    total: float  # trace of the covariance
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(float) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)**2, exact; None beyond a long."""
        away = x - self.floor
        if len(away) and (self.n * (float(np.abs(away).max()) + 1)) ** 2 * away.shape[1] < 2.0**62:
            return ((self.n * away - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in away]
        return [e if e < 1 << 63 else None for e in exact]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, params: WhitenParams) -> tuple[DataFrame, int]:
    """Table (_id, x) of the vectors that count, as whole numbers, and their dimension."""
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    large = float(1 << 51)
    number = lambda c: F.floor(params.scale * F.greatest(F.least(c.cast("double"), F.lit(large)), F.lit(-large))) + params.shift
    kept = materialize(vectors.where(finite).select(F.col(id_col).alias("_id"), F.transform(v, number).alias("x")), "vectors")
    common = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0]["d"] if common else 0
    return kept.where(F.size("x") == d), d


def block(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of an Arrow batch as one array, row by row."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def total(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], params: WhitenParams, kind: str = "double") -> np.ndarray:
    """Sum of ``work`` (a short vector for a block of rows) over all rows: one partial vector a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            if batch.num_rows:
                mine = work(block(batch))
                part = mine if part is None else part + mine
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part.tolist()])], names=["part"])

    parts = rows.select("x").coalesce(params.lanes).mapInArrow(run, f"part array<{kind}>").collect()
    return np.array([r["part"] for r in parts], object if kind == "bigint" else float).sum(0)  # whole numbers without a bound


def centre(rows: DataFrame, d: int, params: WhitenParams) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and floor and remainder of each dimension's mean, by exact sums of high and low halves."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    sums = total(rows, halves, params, "bigint")
    n = int(sums[0])
    exact = [(int(h) << 32) + int(low) for h, low in zip(sums[1 : d + 1], sums[d + 1 :], strict=True)]
    return n, np.array([s // n for s in exact], np.int64), np.array([s % n for s in exact], np.int64)


def bidiagonalise(rows: DataFrame, d: int, centred: Callable[[np.ndarray], np.ndarray], energy: float, params: WhitenParams) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and singular values of the centred rows, the largest first."""
    draw = np.random.default_rng(params.seed)
    right, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; g of each left vector; X'u
    b = np.zeros((d, d))
    tiny = EPS * np.sqrt(energy)

    def fresh() -> np.ndarray:
        v = draw.normal(size=d)
        for _ in range(2):
            v = v - right @ (right.T @ v)
            v = v / np.linalg.norm(v)
        return v

    def forward(g: np.ndarray) -> np.ndarray:
        """Products of w = X g with all earlier left vectors."""
        return total(rows, lambda x: (lambda c: (c @ short).T @ (c @ g))(centred(x)), params)

    def backward(g: np.ndarray) -> np.ndarray:
        """X'w of w = X g, its products with all earlier left vectors, and its square."""

        def work(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            w = c @ g
            return np.concatenate([c.T @ w, (c @ short).T @ w, [w @ w]])

        return total(rows, work, params)

    v, beta = fresh(), 0.0
    for k in range(d):
        g = v - beta * short[:, -1] if k else v
        if k:
            g = g - short @ forward(g)  # the product X v, made orthogonal
        got = backward(g)
        z, again, square = got[:d], got[d : d + k], got[-1] - got[d : d + k] @ got[d : d + k]
        g, z = g - short @ again, z - back @ again  # the second time is enough
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= tiny:  # nothing of X in this direction
            alpha, g, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            g, z = g / alpha, z / alpha
        right, short, back = np.column_stack([right, v]), np.column_stack([short, g]), np.column_stack([back, z])
        b[k, k] = alpha
        r = z - alpha * v
        for _ in range(2):
            r = r - right @ (right.T @ r)
        beta = float(np.linalg.norm(r))
        if beta <= tiny:
            beta = 0.0
        left, sigma, _ = np.linalg.svd(b[: k + 1, : k + 1])
        wanted = min(params.components, d)
        if k + 1 >= wanted:
            settled = beta * np.abs(left[-1, :wanted]).max() <= 4 * EPS * sigma[0]
            outside = energy - (b[: k + 1, : k + 1] ** 2).sum()
            if settled and outside < 0.999 * sigma[wanted - 1] ** 2:
                break
        if k + 1 < d:
            v = r / beta if beta else fresh()
            b[k, k + 1] = beta
    k = right.shape[1]
    _, sigma, turned = np.linalg.svd(b[:k, :k])
    return right @ turned.T, sigma


def fit(rows: DataFrame, d: int, params: WhitenParams = WhitenParams()) -> Whitening | None:
    """``rows``: (_id, x) of dimension ``d``. None where there is nothing to learn from."""
    if not d or not rows.limit(1).count():
        return None
    n, floor, rest = centre(rows, d, params)
    plain = Whitening(n, floor, rest, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    energy = float(total(rows, lambda x: np.array([(plain.centred(x) ** 2).sum()]), params)[0])
    if energy <= 0:
        return None
    vectors, sigma = bidiagonalise(rows, d, plain.centred, energy, params)
    k = int((sigma[: params.components] > d * EPS * sigma[0]).sum())
    vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])  # one sign, whatever the start
    model = Whitening(n, floor, rest, vectors, sigma[:k] ** 2 / n, energy / n, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    sums = total(rows, moments, params) / n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return Whitening(n, floor, rest, vectors, model.variances, model.total, float(np.abs(covariance - np.eye(k)).max()))


def transform(rows: DataFrame, model: Whitening | None, id_col: str) -> DataFrame:
    """One row a vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    kept = StructType([StructField(id_col, rows.schema["_id"].dataType), *fields("component int,n long,deviation long,whitened double,explained double,identity_error double").fields])
    if model is None:
        return rows.sparkSession.createDataFrame([], kept)
    k = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = block(batch)
            each = np.repeat(np.arange(rows), k)
            columns = [
                batch.column("_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.variances / model.total, rows)), pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=kept.names)

    return rows.mapInArrow(run, kept)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: WhitenParams = WhitenParams()) -> DataFrame:
    """Fits on all vectors that count and whitens them."""
    rows, d = whole_vectors(vectors, id_col, vector_col, params)
    return transform(rows, fit(rows, d, params), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
