"""Divergence of the sources of each language by their terms, in exact arithmetic (operator 12).

A term's rows lie together in a task, which is the term-major index: term, then its sources. Each source in turn scatters
its terms through that index into a dense accumulator with one cell a peer, so that no pair of postings becomes a row: a
task returns at most one number for two sources and block of the index (``block`` postings). A cell holds what a shared
term adds to the value that two sources would have if only one of them had it; the rest depends on a source's term counts
alone: terms that both lack give one constant (the zero baseline), terms that one lacks come from the histogram of its
counts, of which there are few. All sums are whole numbers.

Cases: null text, language and source are read as ''. Texts of any length are read whole. A group without terms has all
values of zero counts; a language without kept terms has values 0 and no ``term`` rows; a source alone in its language has
no ``pair`` rows. Repeated rows count each. Ties are ranked by item, as UTF-8. An empty table gives no rows; extra columns
are ignored. A row of pairs for each two sources of a language is what is asked for, so a language's sources are few
enough for one row's array; its terms and documents are not bounded.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.ranks import hinted
from strideframe.llm.common import LOWER, UPPER, fields, materialize, table, whole

#: What a byte of UTF-8 becomes: letters in lower case, bytes of other characters themselves, the rest of ASCII a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNIT = 1_000_000_000


@dataclass(frozen=True)
class DivergenceParams:
    documents: int = 10  # least documents of a language that hold a kept term
    smooth: int = 2
    top: int = 10  # ranks of terms; pairs have all ranks
    block: int = 1 << 18  # postings of an index block
    held: int = 200_000  # counts that a task keeps before it passes them on
    piece: int = 1 << 20  # bytes of a text that are split at once


def terms_of(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    text, begin = text.translate(FOLD), 0
    while begin < len(text):
        end = text.find(b" ", begin + piece)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def counted(docs: DataFrame, lang: str, source: str, text: str, params: DivergenceParams) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed in each task first. Each group has an empty term, with no occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, inside = defaultdict(Counter), defaultdict(Counter)

        def passed_on() -> pa.RecordBatch:
            rows = [(*group, term, n, inside[group][term]) for group, terms in found.items() for term, n in terms.items()]
            found.clear()
            inside.clear()
            lang, source, term, n, docs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=out.names)

        for batch in batches:
            held = sum(map(len, found.values()))
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                group, seen = (lang, source), set()
                before = len(found[group])
                found[group][b""] += 0
                for words in terms_of(text, params.piece):
                    found[group].update(words)
                    seen.update(words)
                inside[group].update(seen)
                held += len(found[group]) - before
                if held > params.held:
                    yield passed_on()
                    held = 0
        if found:
            yield passed_on()

    out = fields("lang string,source string,term binary,n long,docs long")
    rows = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).cast("binary").alias("text")).mapInArrow(run, out)
    return materialize(rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def share(n: str, total: str, smooth: int) -> F.Column:
    """1 + floor(10**9 (n + smooth) / total), exact beyond the range of a long; 1 without a total."""
    exact = F.expr(f"({UNIT}BD * (cast({n} as decimal(20,0)) + {smooth})) div cast({total} as decimal(20,0))")
    return F.when(F.col(total) > 0, 1 + exact).otherwise(F.lit(1)).cast("bigint")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def index_of(counts: DataFrame, params: DivergenceParams) -> tuple[DataFrame, DataFrame]:
    """Kept postings (lang, source, term, p, zero, q) and groups (lang, source, terms, zero): ``zero`` is the p of an absent term, ``q`` the language's p."""
    of_term = Window.partitionBy("lang", "term")
    first = F.row_number().over(of_term.orderBy("source")) == 1
    rows = counts.where("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("_docs"), F.sum("n").over(of_term).alias("lang_n"), first.alias("_first"))
    kept = materialize(rows.where(F.col("_docs") >= params.documents).drop("_docs"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("_first").cast("bigint")).alias("terms"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(own.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left")
    wide = params.smooth * F.coalesce("terms", F.lit(0))
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("total", F.lit(0)) + wide).alias("_over"), (F.coalesce("lang_total", F.lit(0)) + wide).alias("_lang_over"), F.lit(0).alias("_none"))
    groups = materialize(groups.withColumn("zero", share("_none", "_over", params.smooth)), "groups")
    rows = kept.join(hinted(groups), ["lang", "source"])
    rows = rows.select("lang", "source", "term", share("n", "_over", params.smooth).alias("p"), "zero", share("lang_n", "_lang_over", params.smooth).alias("q"))
    return materialize(rows, "postings"), groups.select("lang", "source", "terms", "zero")


def scatter(term: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray, sources: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each source of an index block the dense accumulator: what shared terms add, by peer. Postings come by ``term``."""
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(np.append(starts, len(term)))
    row = np.repeat(np.arange(len(starts)), sizes)  # the index row of a posting
    by_source = np.argsort(source, kind="stable")
    cuts = np.searchsorted(source[by_source], np.arange(sources + 1))
    for g in range(sources):
        mine = by_source[cuts[g] : cuts[g + 1]]
        n = sizes[row[mine]]
        at = np.repeat(starts[row[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())  # all postings of my terms
        pg, zg, ph, zh = np.repeat(p[mine], n), np.repeat(zero[mine], n), p[at], zero[at]
        cells = np.zeros(sources, np.int64)
        np.add.at(cells, source[at], gap(pg, ph) - gap(pg, zh) - gap(zg, ph) + gap(zg, zh))
        cells[g] = 0
        yield g, cells


AMOUNTS = fields("lang string,source string,item string,value long")


def shared_terms(postings: DataFrame, params: DivergenceParams) -> DataFrame:
    """lang, source, item, value: what the terms that both have add, in parts."""

    def scattered(held: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = held.column("lang").to_numpy()
        cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1), len(langs)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = held.slice(a, b - a)
            coded = part.column("source").combine_chunks().dictionary_encode()
            words = part.column("term").to_numpy()
            term = np.cumsum(np.append(False, words[1:] != words[:-1]))
            names = coded.dictionary
            for g, cells in scatter(term, coded.indices.to_numpy().astype(np.int64), part.column("p").to_numpy(), part.column("zero").to_numpy(), len(names)):
                some = np.flatnonzero(cells)
                if len(some):
                    one = [pa.array([x] * len(some), pa.string()) for x in (langs[a], names[g].as_py())]
                    yield pa.RecordBatch.from_arrays([*one, names.take(pa.array(some)).cast(pa.string()), pa.array(cells[some])], names=AMOUNTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < params.block:
                continue
            whole_ = pa.Table.from_batches(held)
            lang, term = whole_.column("lang"), whole_.column("term")
            cut = rows - 1  # the last term may go on in the next batch
            while cut and lang[cut - 1].as_py() == lang[rows - 1].as_py() and term[cut - 1].as_py() == term[rows - 1].as_py():
                cut -= 1
            if cut:
                yield from scattered(whole_.slice(0, cut))
                held, rows = whole_.slice(cut).to_batches(), rows - cut
        if rows:
            yield from scattered(pa.Table.from_batches(held))

    index = postings.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return index.mapInArrow(run, AMOUNTS)


def lone_terms(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the zero baseline of two sources, and what the terms of each add if the other lacks them."""
    counts = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("counts"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("peers"))
    rows = groups.join(counts.hint("merge"), ["lang", "source"], "left").join(materialize(peers, "peers").hint("merge"), "lang")
    rows = rows.select("lang", "source", "terms", "zero", F.col("counts.p").alias("p"), F.col("counts.n").alias("n"), F.col("peers.source").alias("items"), F.col("peers.zero").alias("zeros"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lang, source, terms, zero, p, n, items, zeros = (c[r].as_py() for c in batch.columns)
                zh = np.array(zeros, np.int64)
                both = gap(np.int64(zero), zh)
                mine = np.zeros(len(zh), np.int64)
                for pk, nk in zip(p or (), n or (), strict=True):
                    mine += nk * (gap(np.int64(pk), zh) - both)
                for a, b, value in ([source] * len(zh), items, mine + terms * both), (items, [source] * len(zh), mine):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(zh), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value)], names=AMOUNTS.names)

    return rows.mapInArrow(run, AMOUNTS)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence, and the terms that set a source apart."""
    postings, groups = index_of(counted(docs, lang, source, text, params), params)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    amounts = shared_terms(postings, params).union(lone_terms(postings, groups)).where("source <> item")
    pairs = amounts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    apart = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    terms = apart.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= params.top)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs.withColumn("rank", F.row_number().over(by)), "pair").union(named(terms, "term"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * s.v)::HUGEINT AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (s.lang_total + 2 * s.v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
apart AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM apart QUALIFY rank <= 10
"""
