"""Whitening, source divergence and language identification against brute force, held-out accuracy and odd inputs."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import divergence, language_id, whitening
from strideframe.llm.common import prepare


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


# -- 11 whitening --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(vectors):
    x = np.floor(np.asarray(vectors, np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    away = n * x - s
    c = away / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, (away**2).sum(1), c @ v / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def check_whitening(rows, vectors, ids, k):
    n, deviation, white, explained = plain_whitening(vectors)
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert set(got) == set(ids) and all(sorted(g) == list(range(1, k + 1)) for g in got.values())
    signs = [1 if got[ids[0]][j + 1].whitened * white[0, j] > 0 else -1 for j in range(k)]
    for i, v in enumerate(ids):
        for j in range(k):
            r = got[v][j + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert r.explained == pytest.approx(explained[j], rel=1e-9) and r.whitened == pytest.approx(signs[j] * white[i, j], abs=1e-6)
            assert r.identity_error < 1e-9


def test_whitening_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL").collect()
    check_whitening(whitening.query(spark, sf).collect(), [r.embedding for r in rows], [r.vec_id for r in rows], 8)


@pytest.mark.parametrize("d, k", [(12, 8), (3, 3), (1, 1)])
def test_whitening_drops_odd_vectors(spark, d, k):
    draw = np.random.default_rng(d)
    good = (draw.normal(size=(60, d)) * np.arange(1, d + 1)).astype(np.float32)
    good[10] = good[11]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [None] * d, [nan] * d, [inf, *[0.0] * (d - 1)], [0.0] * (d + 1)]
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5, F.rand(1)).select("*", *[F.lit("clash").alias(c) for c in ("_id", "x", "component", "n", "part")])
    check_whitening(whitening.whiten(df).collect(), good, list(range(60)), k)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    rows = [(i, [float(i % 7), 2.0, float(i % 7)]) for i in range(30)]  # one direction of three varies
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.component for r in got} == {1} and len(got) == 30 and got[0].explained == pytest.approx(1)


def test_whitening_of_repeated_eigenvalues(spark):
    """All directions vary alike: one start vector alone would find one of them."""
    rows = [(2 * j + s, [0.25 * (1 - 2 * s) if i == j else 0.0 for i in range(10)]) for j in range(10) for s in range(2)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 20 * 8 and all(r.explained == pytest.approx(0.1) and r.identity_error < 1e-9 for r in got)


def test_whitening_of_very_large_entries(spark):
    rows = [(i, [1e30 * (i % 2), float(i)]) for i in range(8)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)


def test_bidiagonalisation_stops_early_where_that_is_safe(spark, monkeypatch):
    """Few directions carry nearly all: the products are far fewer than dimensions, and the result is the same."""
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(200, 9)) * 30) @ draw.normal(size=(9, 40)) + draw.normal(size=(200, 40)) * 0.01
    seen, real = [], whitening.total
    monkeypatch.setattr(whitening, "total", lambda *a, **k: (seen.append(1), real(*a, **k))[1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert len(seen) < 50
    x = np.floor(vectors * 1024)
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert sorted({r.explained for r in rows}, reverse=True) == pytest.approx((e[:8] / e.sum()).tolist(), rel=1e-9)


# -- 12 divergence -------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(docs, least=10, top=10):
    counts, inside = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        inside[lang].update(set(terms))
    out = []
    by_bytes = lambda x: (-x[1], x[0].encode())
    for lang, source in groups:
        kept = [t for t, n in inside[lang].items() if n >= least]
        def p_of(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        own, whole = p_of(counts[lang, source]), p_of(sum((counts[g] for g in groups if g[0] == lang), collections.Counter()))
        pairs = []
        for other in sorted(s for g, s in groups if g == lang and s != source):
            theirs = p_of(counts[lang, other])
            pairs.append((other, sum(f(own[t], theirs[t]) for t in kept)))
        out += [(lang, source, "pair", item, value, k + 1) for k, (item, value) in enumerate(sorted(pairs, key=by_bytes))]
        terms = [(t, f(own[t], whole[t])) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        out += [(lang, source, "term", item, value, k + 1) for k, (item, value) in enumerate(sorted(terms, key=by_bytes)[:top])]
    return out


DOCS = "lang string, source string, text string"


@pytest.mark.parametrize("params", [divergence.DivergenceParams(), divergence.DivergenceParams(block=7, held=5, piece=3)])
def test_divergence(spark, params):
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma-delta", "éa", "日本", "x1y", "Ω", "the", "THE", "q"]
    docs = [(draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "é", None]), " ".join(draw.choice(words[: draw.randint(1, 10)]) for _ in range(draw.randint(0, 30)))) for _ in range(150)]
    docs += [("xx", "alone", "one"), ("yy", "a", None), ("yy", "b", "few terms"), ("en", "empty", ""), ("en", "digits", "1 2 3")] + [("zz", s, "same words here") for s in "ab" for _ in range(12)]
    df = spark.createDataFrame(docs, DOCS).repartition(4, F.rand(2)).select("*", *[F.lit("clash").alias(c) for c in ("term", "n", "docs", "p", "zero", "item")])
    got = [tuple(r) for r in divergence.audit(df, params=params).collect()]
    assert sorted(got) == sorted(plain_audit(docs))


def test_divergence_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, divergence.query(spark, sf).collect())) == sorted(map(tuple, con.execute(divergence.SQL).fetchall()))


def test_divergence_of_very_long_texts_and_large_counts(spark):
    docs = [("en", "long", "many words " * 200_000 + "w" * 2_000_000)] + [("en", s, "many other words") for s in ("long", "b") for _ in range(10)]
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(docs, DOCS)).collect()]
    assert sorted(got) == sorted(plain_audit(docs))
    df = spark.createDataFrame([(10**15, 3 * 10**15), (0, 10**18), (5, 0)], "n long, total long")
    assert [r[0] for r in df.select(divergence.share("n", "total", 2)).collect()] == [1 + 10**9 * (10**15 + 2) // (3 * 10**15), 1, 1]


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    assert divergence.audit(spark.createDataFrame([("en", "a", None)], DOCS)).count() == 0
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame([("en", "a", None), ("en", "b", None), ("en", None, "x")], DOCS)).collect()]
    assert sorted(got) == sorted(plain_audit([("en", "a", None), ("en", "b", None), ("en", None, "x")]))


# -- 13 language ---------------------------------------------------------------------------------------

SPOKEN = {"en": "the of and to in is that it was for on are with as his they be at one have this", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als", "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur", "es": "de la que el en y a los se del las un por con no una su para es al"}


def said(draw, lang, n):
    return " ".join(draw.choice(SPOKEN[lang].split()) for _ in range(n))


def test_languages(spark):
    draw = random.Random(9)
    rows = [(i, said(draw, lang, draw.randint(8, 40)), lang, "s") for i, lang in enumerate(list(SPOKEN) * 150)]
    odd = [(10_000, None, "en", "s"), (10_001, "", "de", "s"), (10_002, "123 !? 456", "fr", None), (10_003, said(draw, "de", 30), None, "s"), (10_004, said(draw, "fr", 60_000), "fr", "s"), (None, said(draw, "en", 20), "en", "s"), (3, rows[3][1], "es", "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").repartition(5, F.rand(4))
    params = language_id.LanguageParams(per_lang=200, part_bytes=200_000)
    got = language_id.identify(df.select("*", *[F.lit("x").alias(c) for c in ("_id", "_label", "bag", "score", "_h", "_n")]), params=params).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for i in (10_000, 10_001, 10_002):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[10_003].lang_pred == "de" and by[10_004].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    accepted = [r for r in held if not r.rejected]
    assert len(accepted) > 0.9 * len(held) and np.mean([r.lang_pred == truth[r.doc_id] for r in accepted]) >= 1 - params.risk
    again = language_id.identify(df.repartition(2), params=params).collect()
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in again) == sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in got)
    flipped = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "en").otherwise(F.col("lang")))
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in language_id.identify(flipped, params=params).collect()) == sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in got)


def test_languages_of_the_table(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in language_id.query(spark, sf).collect() if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_languages_without_labels(spark):
    kind = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(1, "some text", None), (2, None, None)], kind)
    assert [(r.lang_pred, r.score) for r in language_id.identify(none).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(none.limit(0)).count() == 0
    one = spark.createDataFrame([(i, f"word number {i}", "en") for i in range(20)], kind)
    assert {(r.lang_pred, r.score) for r in language_id.identify(one).collect()} == {("en", 1.0)}


def test_cutoff_keeps_the_risk():
    """Of a thousand samples the cutoff's true share of errors exceeds the risk in few: at most alpha, but for chance."""
    p, draw, over, found = language_id.LanguageParams(), np.random.default_rng(1), 0, 0
    for _ in range(1000):
        scores = draw.random(400)
        right = draw.random(400) > 0.3 * (1 - scores) ** 2
        c = language_id.cutoff(scores, right, p)
        if c <= 1:
            found += 1
            over += 0.1 * (1 - c) ** 2 > p.risk  # mean of 0.3 (1 - s)**2 over s in (c, 1)
    assert found > 300 and over <= 0.07 * 1000
    assert language_id.cutoff(np.ones(10), np.ones(10, bool), p) == 2.0 and language_id.cutoff(np.ones(100), np.ones(100, bool), p) == 1.0
    assert 1 <= language_id.temperature(np.array([[9.0, 0.0], [9.0, 0.0], [0.0, 9.0]]), np.array([0, 1, 1])) <= 20.1


def test_averages_against_a_loop():
    p = language_id.LanguageParams(bits=8)
    v = np.random.default_rng(0).normal(size=(256, 3))
    texts = [language_id.normal(t) for t in ("", "A", "Der Hund, der Hund", "été 12", "x" * 400)]
    want = []
    for t in texts:
        b = np.concatenate([x for x, _ in language_id.buckets_of([t], p.subwords)])
        want.append(v[b].mean(0) if len(b) else np.zeros(3))
    assert np.allclose(language_id.sums(texts, v, p), want)
