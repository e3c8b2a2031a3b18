"""Quality rules with risk-controlled thresholds (operator 10).

Each rule rejects a document whose ratio exceeds a cutoff. Labelled documents are the holdout. In each stratum a third of
them, chosen by a hash of the id, draws a path of combined settings: no cutoffs at first, then at each step the cutoff of
one rule a notch stricter, the notch that catches most of the bad for what it costs of the good; notches that catch none
are not taken. The other two thirds test the settings of this path, one after another, each by an exact
(Clopper-Pearson) upper bound on the share of good documents that all its rules together would reject. Testing stops at
the first setting that fails, so the sequence needs no further correction and the allowed share is not divided among the
rules; the level is divided by the number of strata (Bonferroni), so that with probability ``1 - delta`` no stratum loses
more than ``alpha`` of its good documents. Among certified settings the one with the best balance of bad and good
rejections is taken.

A setting is certified with ``ln(strata / delta) / alpha`` good labelled documents that it does not reject, about 86 of the
test part for four strata. ``calibrate`` returns a row for every stratum with labels: its certified setting, or none, in
which case the base rule alone decides there.

Cases: a null text has no words (base_failed). Very long texts are measured whole. Null strata form a stratum of their
own, beside the empty string's. Repeated ids are judged row by row; a label with a null or other value than 0 and 1 is
unused; contradicting labels of one id count as good (the cautious reading). Of equally good settings the mildest is
taken. Empty tables give empty results. Extra columns are ignored, and filtering keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strideframe.llm.common import BLANKS, fields, materialize, packed, unpacked, whole

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shouts long, n_upper long, n_ascii long"
#: Rule name, and the ratio (numerator over denominator) it limits.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "shouts": ("n_shouts", "n_words"),
    "capitals": ("n_upper", "n_ascii"),
}


@dataclass(frozen=True)
class RiskParams:
    alpha: float = 0.05  # largest share of a stratum's good documents that may be rejected
    delta: float = 0.05  # probability that the guarantee fails anywhere
    grid: tuple[float, ...] = tuple(round(1.25**-k, 6) for k in range(-6, 25))  # cutoffs, mildest first
    good_cost: float = 20.0  # a good document lost weighs as much as so many bad ones caught
    seed: int = 10  # of the hash that draws the paths' labels


def measure_text(text: str) -> tuple[int, ...]:
    """The counts of ``MEASURES`` for one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        index = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, len(windows))
        twice = np.bincount(index)[index] > 1
        change = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(change, at, 1)
        np.add.at(change, at + 5, -1)
        repeated = int((np.cumsum(change)[:n] > 0).sum())
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    letters = raw.translate(None, bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122)))
    upper = len(letters) - len(letters.translate(None, bytes(range(65, 91))))
    return (
        n, len(text) - (len(raw) - len(raw.translate(None, BLANKS))), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines), raw.count(b"!"), upper, len(letters),
    )


@pandas_udf(fields(MEASURES))
def _measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in MEASURES.split(",")]
    for batch in texts:
        yield pd.DataFrame([measure_text(t) for t in batch], columns=names, dtype="int64")


measure = _measure.asNondeterministic()  # evaluated once, never pushed below or repeated


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def ratio(rule: str, m: str = "m") -> Column:
    above, below = RULES[rule]
    return F.col(f"{m}.{above}") / F.greatest(F.col(f"{m}.{below}"), F.lit(1))


def tail(bad: int, n: int, p: float) -> float:
    """Probability of at most ``bad`` of ``n`` at share ``p``: the incomplete beta function by its continued fraction.

    Takes some sqrt(n) steps at most, so that millions of labels cost no time."""
    if bad >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - bad, bad + 1, 1 - p
    flip = x > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14 or m > 1_000_000:
            break
    return min(1.0, max(0.0, 1 - front * out if flip else front * out))


def upper_bound(bad: int, n: int, level: float) -> float:
    """Exact binomial (Clopper-Pearson) upper bound for a share of which ``bad`` of ``n`` were seen."""
    if n == 0 or bad >= n:
        return 1.0
    low = bad / n
    high = min(1.0, low + math.sqrt(-math.log(level) / (2 * n)))  # Hoeffding's bound, which is never the lower one
    for _ in range(50):
        p = (low + high) / 2
        low, high = (p, high) if tail(bad, n, p) > level else (low, p)
    return high


#: A stratum's setting: the cutoff of each rule that has one, and what it rejects of the labelled documents it was tested on.
SETTING = "stratum string, cutoffs map<string,double>, good long, good_rejected long, bad long, bad_rejected long"
PATH = "stratum string, rule string, notch int, step int"


def draw_path(rows: pd.DataFrame, params: RiskParams) -> pd.DataFrame:
    """The path of one stratum, from rows of stratum, rule, first (the mildest notch that rejects), good and bad: which notch of which rule comes at which step.

    A ladder of cutoffs a rule; the next step is the top of the ladder, or the run of notches from it, with the most bad
    documents for each good one, counted twice for caution; good documents may be lost up to twice the allowed share."""
    last, out = len(params.grid), []
    counts, total = {}, 0
    for rule, mine in rows.groupby("rule"):
        n = np.zeros((2, last + 1), np.int64)
        np.add.at(n[0], mine["first"], mine["good"])
        np.add.at(n[1], mine["first"], mine["bad"])
        counts[rule], total = n, int(n[0].sum())
    at, lost = dict.fromkeys(counts, 0), 0
    while True:
        best = None
        for rule in sorted(counts):
            good, bad = np.cumsum(counts[rule][:, at[rule] : last], axis=1)
            for k in np.flatnonzero(bad > 0):
                worth = bad[k] / (2 * good[k] + 1)
                if best is None or worth > best[0] + 1e-12:
                    best = (worth, rule, int(at[rule] + k), int(good[k]))
        if best is None or lost + best[3] > 2 * params.alpha * total:
            return pd.DataFrame(out, columns=[x.split()[0] for x in PATH.split(", ")])
        _, rule, notch, good = best
        out.append((rows["stratum"].iloc[0], rule, notch, len(out)))
        at[rule], lost = notch + 1, lost + good


def select_setting(rows: pd.DataFrame, strata: int, params: RiskParams) -> pd.DataFrame:
    """The certified setting of one stratum, from rows of stratum, step (the first that rejects; null if none does), good, bad and path."""
    path = sorted((p["step"], p["rule"], p["notch"]) for p in rows["path"].iloc[0]) if rows["path"].iloc[0] is not None else []
    n = np.zeros((2, len(path) + 1), np.int64)
    step = rows["step"].fillna(len(path)).astype(int)
    np.add.at(n[0], step, rows["good"])
    np.add.at(n[1], step, rows["bad"])
    good, bad = (int(x.sum()) for x in n)
    best = None
    for k, (good_cut, bad_cut) in enumerate(np.cumsum(n, axis=1).T[: len(path)].tolist()):
        if not good or tail(good_cut, good, params.alpha) > params.delta / max(1, strata):  # its upper bound is above the allowed share
            break
        gain = bad_cut / max(1, bad) - params.good_cost * good_cut / good
        if gain > 0 and (best is None or gain > best[0] + 1e-12):
            best = (gain, k, good_cut, bad_cut)
    cutoffs = {} if best is None else {rule: params.grid[notch] for _, rule, notch in path[: best[1] + 1]}  # of a rule's notches the last
    return pd.DataFrame([(rows["stratum"].iloc[0], cutoffs, good, 0 if best is None else best[2], bad, 0 if best is None else best[3])], columns=[x.split()[0] for x in SETTING.replace("<string,double>", "").split(", ")])


def stratum_of(column: Column) -> Column:
    """A null stratum is one of its own, beside the empty one."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str, params: RiskParams) -> DataFrame:
    """stratum, its certified setting (no cutoffs if there is none), and what that rejects of the tested labels. ``measured``: _id, _stratum, m.

    Counts cover all labelled documents; a stratum's rows (rules x notches, then steps of the path) are one group, and no stratum reaches the driver."""
    truth = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_good"))
    grid = F.array(*[F.lit(x) for x in params.grid])
    counts = [F.sum("_good").cast("long").alias("good"), F.sum(1 - F.col("_good")).cast("long").alias("bad")]
    rows = measured.where(~base_failed()).select("_id", F.col("_stratum").alias("stratum"), "m").join(truth.hint("merge"), "_id")
    # The number of grid cutoffs that the value does not exceed: it is rejected by every notch from there on.
    mildest = lambda value: F.size(F.filter(grid, lambda c: c >= value)).alias("first")
    notch = F.array(*[F.struct(F.lit(r).alias("rule"), mildest(ratio(r))) for r in sorted(RULES)])
    marked = materialize(rows.select("stratum", "_good", (F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(params.seed)), F.lit(3)) == 0).alias("_draws"), notch.alias("_notches")), "labelled")
    drawn = marked.where("_draws").select("stratum", "_good", F.explode("_notches").alias("r")).groupBy("stratum", "r.rule", "r.first").agg(*counts)
    path = materialize(drawn.groupBy("stratum").applyInPandas(lambda mine: draw_path(mine, params), PATH), "path")
    by = path.groupBy("stratum").agg(F.collect_list(F.struct("step", "rule", "notch")).alias("path"))  # as many entries as rules x notches at most
    by = materialize(by, "paths")
    tested = marked.where("NOT _draws").join(by.hint("broadcast" if by.count() <= 1000 else "merge"), "stratum", "left")
    first = F.array_min(F.transform(F.filter("path", lambda p: F.exists("_notches", lambda r: (r["rule"] == p["rule"]) & (r["first"] <= p["notch"]))), lambda p: p["step"]))
    steps = materialize(tested.select("stratum", "_good", first.alias("step")).groupBy("stratum", "step").agg(*counts), "steps").join(by.hint("merge"), "stratum", "left")
    strata = marked.select("stratum").distinct().count()
    return materialize(steps.groupBy("stratum").applyInPandas(lambda mine: select_setting(mine, strata, params), SETTING), "settings")


def with_rejections(measured: DataFrame, settings: DataFrame) -> DataFrame:
    """Adds rejected_by, the names of the rules that reject the row."""
    by = materialize(settings.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cuts")), "strata")
    small = by.count() <= 1000
    joined = measured.join(by.hint("broadcast" if small else "merge"), "_stratum", "left")
    rejects = F.array(*[F.when(ratio(r) > F.col("_cuts")[r], F.lit(r)) for r in sorted(RULES)])
    return joined.withColumn("rejected_by", F.array_compact(rejects)).drop("_cuts")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", params: RiskParams = RiskParams()) -> DataFrame:
    """id, measures, base_failed, kept and the rejecting rules of every document."""
    measured = materialize(docs.select(F.col(id_col).alias("_id"), stratum_of(F.col(stratum_col)).alias("_stratum"), measure(whole(text_col)).alias("m")), "quality")
    judged = with_rejections(measured, calibrate(measured, labels, id_col, params)).withColumn("base_failed", base_failed())
    return judged.select(F.col("_id").alias(id_col), "m.*", "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", params: RiskParams = RiskParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are measured once, beside their rows in a scratch table, and never shuffled."""
    measured = materialize(docs.select(packed(docs), F.col(id_col).alias("_id"), stratum_of(F.col(stratum_col)).alias("_stratum"), measure(whole(text_col)).alias("m")), "quality")
    judged = with_rejections(measured, calibrate(measured, labels, id_col, params))
    return judged.where(~base_failed() & (F.size("rejected_by") == 0)).select(*unpacked(docs))


def query(spark, sf_dir: str) -> DataFrame:
    from strideframe.llm.common import table

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
