"""Benchmark decontamination by latent semantic retrieval (operator 8).

Benchmark items are cut into passages and weighed by TF-IDF, with document frequencies counted over the whole
corpus. A distributed randomised SVD of the passages gives a latent space of fewer dimensions than passages, so that
passages that share words share directions, and words that go together stand for each other: as many dimensions as
keep ``energy`` of all passages and ``least_energy`` of each, so that a copy is always near its own passage. Every
document is read in half overlapping windows; a window whose projection has enough cosine with a passage's is a
candidate; what lies outside the space counts against it. Candidates are checked by the longest common subsequence of words between the item and the words around the window, and by
the answer (the item's answer column, else its last third): an item leaks if most of it is there in order, or
a good part of it together with the answer. So copies and paraphrases that change or drop words are caught.

Words are lower-cased runs of letters, digits and non-ASCII characters; in scripts without spaces each character is a
word. A word that the benchmark lacks lies outside the latent space and weighs nothing: it neither adds to a window's
cosine nor lowers it, so the search finds the same leaks in a large corpus as in a small one. A latent space spans a
block of ``block`` items and at most ``passages`` passages (or one longer item). The documents are read twice for every
``blocks`` blocks, and what is found is written before the next, which is what bounds the broadcasts and the memory of
driver and tasks however large the benchmark is. Items of fewer than ``least_words`` words say too little for a latent search and are found as exact
runs of words in the same pass.

Cases: null and empty texts and items, and items without words, leak nothing. Very long texts are read whole. Repeated
rows are judged row by row; repeated items each report. Of several places of one item in a text the first is
reported, and of passages that lead to it the first. A null doc_id stays null. Empty tables give empty results; extra
columns are ignored, and filtering keeps them, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType

from strideframe.llm.common import PUNCTUATION, fields, hash_words, materialize, packed, table, unpacked, whole


@dataclass(frozen=True)
class LatentParams:
    window: int = 24  # words of a passage, and of a window; windows begin every half of it
    passages: int = 512  # of a block
    energy: float = 0.8  # share of all passages' squared length that the latent space keeps
    least_energy: float = 0.5  # of each passage's
    oversample: int = 16
    rounds: int = 4  # power iterations
    cosine: float = 0.3
    leak: float = 0.8  # share of the item's words in order that is a leak
    paraphrase: float = 0.6  # share that is one together with the answer
    answer: float = 0.8  # share of the answer's words in order
    least_words: int = 8  # of items that are searched in the latent space; shorter ones as exact runs
    block: int = 250  # items of one latent space
    blocks: int = 8  # latent spaces in one pass over the documents: some 8 MB of broadcast each
    seed: int = 11


#: Scripts that put no spaces between words: Thai to Myanmar, Khmer, kana, Han and their extensions.
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _bytes(text: str) -> bytes:
    text = text.lower()
    try:
        text.encode("latin-1")  # quick, and true of most texts: none of those scripts
    except UnicodeEncodeError:
        text = UNSPACED.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass")


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([_bytes(t) for t in texts], PUNCTUATION)


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bits for the item's positions (Hyyrö's recurrence)."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def position_masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Index:
    """What the executors need of one block of items."""

    vocabulary: np.ndarray  # sorted word hashes
    weight: np.ndarray  # by word; last, for words outside, zero
    latent: np.ndarray  # word x dimensions: the word's weighted latent vector; last row zero
    passages: np.ndarray  # dimensions x passages: the passages' unit latent vectors
    item: np.ndarray  # of each passage
    names: list  # of the items
    words: list[list[int]]
    answers: list[list[int]]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))


def windows_of(codes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Passages of an item: full windows, and the last words as one more."""
    n = len(codes)
    if n <= window:
        return [(0, n)]
    return [(a, a + window) for a in range(0, n - window + 1, window)] + ([(n - window, n)] if n % window else [])


def document_frequency(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents with each word of ``vocabulary``, and documents; partial counts are summed by word before the driver sees them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = shared.value, 0
        total = np.zeros(len(v) + 1, np.int64)
        for batch in batches:
            hashes, offsets = words_of(batch.column(0).to_pylist())
            n += batch.num_rows
            at = np.minimum(np.searchsorted(v, hashes), len(v) - 1)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            known = v[at] == hashes
            pairs = np.unique(doc[known] * np.int64(len(v)) + at[known])
            total[:-1] += np.bincount(pairs % len(v), minlength=len(v))
        total[-1] = n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["word", "n"])

    rows = docs.select(whole(text_col).alias("text")).mapInArrow(run, fields("word long, n long")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:  # one row a word of the block, at most
        out[r["word"]] = r["n"]
    return out[:-1], int(out[-1])


def randomised_svd(rows: DataFrame, n_columns: int, rank: int, params: LatentParams) -> np.ndarray:
    """Right singular vectors (columns x rank) of the sparse matrix with rows (index array<long>, value array<double>).

    Each round multiplies by A'A where the rows are: tasks send, for each column they have, one vector of the
    sketch's width, which Spark sums by column; the driver holds columns x width numbers and orthonormalises them.
    """
    width = min(rank + params.oversample, n_columns)
    q = np.linalg.qr(np.random.default_rng(params.seed).normal(size=(n_columns, width)))[0]
    rows = materialize(rows, "passages")
    z = q
    for _ in range(max(1, params.rounds)):
        q = np.linalg.qr(z)[0]
        shared = rows.sparkSession.sparkContext.broadcast(q)

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, sums = shared.value, {}
            for batch in batches:
                for index, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    y = np.asarray(value) @ q[index]
                    for j, v in zip(index, value, strict=True):
                        sums[j] = sums[j] + v * y if j in sums else v * y
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["j", "z"])

        products = rows.mapInArrow(multiply, "j long, z array<double>")
        summed = products.groupBy("j").agg(Summarizer.sum(array_to_vector("z")).alias("z"))
        z = np.zeros((n_columns, width))
        for r in summed.collect():
            z[r["j"]] = r["z"].toArray()
    values, turn = np.linalg.eigh(q.T @ z)
    keep = [i for i in np.argsort(-values) if values[i] > 1e-9][:rank]
    return q @ turn[:, keep]


def build_indexes(docs: DataFrame, text_col: str, blocks: list[list[tuple]], params: LatentParams) -> list[Index]:
    """The indexes of several blocks of items (name, text, answer), their words' document frequencies counted in one scan."""
    split = []
    for block in blocks:
        hashes, offsets = words_of([t for _, t, _ in block])
        split.append([hashes[a:b] for a, b in zip(offsets, offsets[1:])])
    every = np.unique(np.concatenate([w for words in split for w in words] or [np.zeros(0, np.uint64)]))
    if not len(every):
        return []
    df, n = document_frequency(docs, text_col, every)
    return [build_index(docs.sparkSession, block, words, (every, df, n), params) for block, words in zip(blocks, split, strict=True) if any(map(len, words))]


def dimensions(projected: np.ndarray, params: LatentParams) -> int:
    """The fewest leading dimensions that keep enough of all passages (columns, of length 1 before they were projected) and of each."""
    kept = np.cumsum(projected**2, axis=0)
    enough = (kept.mean(axis=1) >= params.energy * kept[-1].mean()) & (kept.min(axis=1) >= min(params.least_energy, kept[-1].min()) - 1e-12)
    return int(np.argmax(enough)) + 1


def build_index(spark: SparkSession, block: list[tuple], words: list[np.ndarray], counted: tuple, params: LatentParams) -> Index:
    every, df, n = counted
    vocabulary = np.unique(np.concatenate(words))
    idf = np.append(np.log((1 + n) / (1 + df[np.searchsorted(every, vocabulary)])) + 1e-3, 0)  # a word of every document says next to nothing
    rows, item = [], []
    for i, w in enumerate(words):
        if len(w) < params.least_words:
            continue
        c = np.searchsorted(vocabulary, w)
        for a, b in windows_of(c, params.window):
            index, tf = np.unique(c[a:b], return_counts=True)
            value = tf * idf[index]
            rows.append((index.tolist(), (value / np.linalg.norm(value)).tolist()))
            item.append(i)
    latent, projected = np.zeros((len(vocabulary) + 1, 0), np.float32), np.zeros((0, 0))
    if rows:
        matrix = spark.createDataFrame(rows, "index array<long>, value array<double>")
        v = randomised_svd(matrix, len(vocabulary), len(rows), params)
        projected = np.stack([np.asarray(value) @ v[index] for index, value in rows], axis=1)
        r = dimensions(projected, params)
        projected = projected[:r] / np.maximum(np.linalg.norm(projected[:r], axis=0), 1e-9)
        latent = np.append(v[:, :r] * idf[:-1, None], np.zeros((1, r)), axis=0)
    answers = []
    for w, (_, _, answer) in zip(words, block, strict=True):
        own = words_of([answer])[0].tolist() if answer else []
        answers.append(own or w[len(w) - (len(w) + 2) // 3 :].tolist())
    return Index(vocabulary, idf.astype(np.float32), latent.astype(np.float32), projected.astype(np.float32), np.array(item, np.int64), [name for name, _, _ in block], [w.tolist() for w in words], answers)


class Screen:
    """Finds the leaks of one index in texts."""

    def __init__(self, index: Index, params: LatentParams):
        self.index, self.params = index, params
        self.masks = [position_masks(w) for w in index.words]
        self.answer_masks = [position_masks(w) for w in index.answers]
        self.short: dict[int, list[int]] = {}  # items too short for the latent space, by their first word
        for i, w in enumerate(index.words):
            if 0 < len(w) < params.least_words:
                self.short.setdefault(w[0], []).append(i)
        self.short_first = np.array(sorted(self.short), np.uint64)

    def candidates(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word of the window in the text, passage, cosine).

        The cosine is of the window's words in the benchmark, in the latent space; windows without such words are passed
        over, the others are projected a bounded number at a time."""
        x, w = self.index, self.params.window
        step = w // 2
        codes = x.codes(hashes).astype(np.int32)
        n_blocks = -(-np.diff(offsets) // step)
        text = np.repeat(np.arange(len(n_blocks)), n_blocks)
        within = (np.arange(len(text)) - (np.cumsum(n_blocks) - n_blocks)[text]) * step
        first = offsets[text] + within
        known = np.add.reduceat((codes < len(x.vocabulary)).astype(np.int64), first)
        same = text[:-1] == text[1:]
        known[:-1][same] += known[1:][same]
        some = np.flatnonzero(known)
        codes = np.append(codes, np.int32(len(x.vocabulary)))
        for part in np.array_split(some, max(1, -(-len(some) // 1000))):
            at = first[part, None] + np.arange(w)
            mine = codes[np.where(at < offsets[text[part] + 1, None], at, len(codes) - 1)]  # past the text's end: a word outside
            again = (mine[:, :, None] == mine[:, None, :]).sum(axis=2)  # a word's squared weight counts once for each time it is said
            norms = np.sqrt(np.maximum((x.weight[mine].astype(np.float64) ** 2 * again).sum(axis=1), 1e-12)).astype(np.float32)
            place = np.zeros((len(part), x.latent.shape[1]), np.float32)
            for k in range(w):
                place += x.latent[mine[:, k]]
            cosine = place @ x.passages / norms[:, None]
            for i, q in zip(*np.nonzero(cosine >= self.params.cosine), strict=True):
                yield int(text[part[i]]), int(within[part[i]]), int(q), float(cosine[i, q])

    def runs(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, word, item) wherever all words of a short item stand one after another."""
        if not len(self.short_first):
            return
        at = np.flatnonzero(np.isin(hashes, self.short_first))
        for p, text in zip(at.tolist(), (np.searchsorted(offsets, at, side="right") - 1).tolist(), strict=True):
            for i in self.short[int(hashes[p])]:
                w = self.index.words[i]
                if p + len(w) <= offsets[text + 1] and hashes[p : p + len(w)].tolist() == w:
                    yield text, p - int(offsets[text]), i

    def leaks(self, hashes: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        x, p = self.index, self.params
        out: list[list[dict]] = [[] for _ in offsets[1:]]
        if not len(hashes):
            return out
        done: set[tuple[int, int]] = set()
        for text, start, i in self.runs(hashes, offsets):
            if (text, i) not in done:
                done.add((text, i))
                out[text].append({"item": x.names[i], "cosine": 1.0, "share": 1.0, "answer": 1.0, "word": start})
        tried: dict[tuple[int, int], int] = {}
        for text, start, passage, cosine in self.candidates(hashes, offsets) if len(x.item) else ():
            i = int(x.item[passage])
            if (text, i) in done or tried.get((text, i)) == start:  # found, or led to by another passage of the item
                continue
            n = len(x.words[i])
            tried[text, i] = start
            begin = max(0, start - n)
            here = hashes[offsets[text] + begin : min(offsets[text] + start + p.window + n, offsets[text + 1])].tolist()
            share = common_subsequence(self.masks[i], n, here) / n
            answer = x.answers[i]
            if share < min(p.paraphrase, p.leak):
                continue
            said = common_subsequence(self.answer_masks[i], len(answer), here) / max(1, len(answer))
            if share >= p.leak or (share >= p.paraphrase and said >= p.answer):
                done.add((text, i))
                out[text].append({"item": x.names[i], "cosine": cosine, "share": share, "answer": said, "word": start})
        return out


FOUND = ArrayType(fields("item string, cosine double, share double, answer double, word int"))


def leaks_in(text: Column, indexes_of, params: LatentParams) -> Column:
    @pandas_udf(FOUND)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        screens = [Screen(x, params) for x in indexes_of.value]
        for batch in texts:
            hashes, offsets = words_of(batch.tolist())
            found = [s.leaks(hashes, offsets) for s in screens]
            yield pd.Series([[x for each in parts for x in each] for parts in zip(*found, strict=True)], index=batch.index, dtype=object)

    return run.asNondeterministic()(text)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, params: LatentParams) -> Iterator[list[tuple]]:
    """The items (name, text, answer), at most ``block`` and, unless one alone has more, ``passages`` passages at a time on the driver."""
    answer = F.col(answer_col) if answer_col else F.lit("")
    block: list[tuple] = []
    passages = 0
    items = benchmark.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), whole(text_col).alias("text"), F.coalesce(answer, F.lit("")).alias("answer"))
    for r in items.orderBy("id", "text").toLocalIterator():
        words = words_of([r["text"]])[0]
        n = len(windows_of(words, params.window)) if len(words) >= params.least_words else 0
        if block and (len(block) == params.block or passages + n > params.passages):
            yield block
            block, passages = [], 0
        block.append((r["name"], r["text"], r["answer"]))
        passages += n
    if block:
        yield block


def passes(docs: DataFrame, text_col: str, blocks: Iterator[list[tuple]], params: LatentParams) -> Iterator:
    """Broadcast indexes, of ``params.blocks`` blocks at a time, and whether they are the last; the broadcast before is given up then."""
    some, held = list(islice(blocks, params.blocks)), None
    while some:
        more = list(islice(blocks, params.blocks))
        if held is not None:
            held.unpersist()
        indexes = build_indexes(docs, text_col, some, params)
        if indexes:
            held = docs.sparkSession.sparkContext.broadcast(indexes)
            yield held, not more
        some = more


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, params: LatentParams = LatentParams()) -> DataFrame:
    """id, item id, cosine, share (of the item's words in order), answer and word: one row for each leak."""
    kind = dict(benchmark.dtypes)[item_col]
    out = docs.select(F.col(id_col), F.lit(None).cast(kind).alias(item_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cosine", "double"), ("share", "double"), ("answer", "double"), ("word", "int"))]).limit(0)
    for indexes, last in passes(docs, text_col, item_blocks(benchmark, item_col, item_text_col, answer_col, params), params):
        found = docs.select(F.col(id_col).alias("_id"), F.explode(leaks_in(whole(text_col), indexes, params)).alias("f"))
        found = found.select("_id", F.col("f.item").cast(kind).alias("item"), "f.cosine", "f.share", "f.answer", "f.word")
        out = out.union(found if last else materialize(found, "leaks"))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, params: LatentParams = LatentParams()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns. One pass filters as it reads and shuffles nothing; where the
    benchmark needs several, rows get numbers in a written table and each pass writes the numbers of those it rejects."""
    rows, rejected = None, None
    for indexes, last in passes(docs, text_col, item_blocks(benchmark, item_col, item_text_col, answer_col, params), params):
        if rows is None and last:
            return docs.where(F.size(leaks_in(whole(text_col), indexes, params)) == 0)
        if rows is None:
            rows = materialize(docs.select(packed(docs), F.monotonically_increasing_id().alias("_n"), whole(text_col).alias("_text")), "numbered")
        leaking = materialize(rows.where(F.size(leaks_in(F.col("_text"), indexes, params)) > 0).select("_n"), "rejected")
        rejected = leaking if rejected is None else rejected.union(leaking)
    if rows is None:
        return docs
    return rows.join(rejected.hint("merge"), "_n", "left_anti").select(*unpacked(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
