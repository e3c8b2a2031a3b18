"""URL filters (operator 1): rules first, then gradient-boosted trees on lexical features.

A rule names a host with its subdomains and a path prefix; the longest that fits decides. Urls that a rule
decides are the labelled ones: a bounded sample of them, in the order of a hash of the url, trains the trees,
which judge every url that no rule fits. Features are lengths, depth, digit ratio, entropy, parameter counts
and the smoothed share of blocked urls by suffix (the host's last label, last two labels, and first path
segment) among all labelled urls, each counted once.

Cases: a null url, or one without ``://``, has an empty host and path and is judged by the trees. Without
labelled urls everything is allowed; if all labels agree, that label is the verdict. Equal urls are trained
on once; repeated pages are judged row by row. Very long urls are read whole. Of rules that fit, equally long ones can
only be the same. Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import ascii_lower, first_by_hash, materialize, table

#: The contract's rules: verdict by host and path prefix.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "query_len", "fragment", "https", "rate_top", "rate_domain", "rate_segment")


@dataclass(frozen=True)
class UrlParams:
    sample: int = 20_000  # labelled urls that the trees are fitted on; suffixes are counted over all
    trees: int = 12
    depth: int = 4
    folds: int = 5  # a training url's suffix statistics come from the other folds
    smoothing: float = 10.0  # prior weight of a suffix's blocked share


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path, F.substr(rest, F.length(host) + F.length(path) + 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest last, so that it wins
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def suffix_keys() -> list[Column]:
    host, path = F.col("host"), F.col("path")
    return [F.substring_index(host, ".", -1).alias("k_top"), F.substring_index(host, ".", -2).alias("k_domain"), F.regexp_extract(path, "^/([^/]*)", 1).alias("k_segment")]


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that need no table, and the suffix keys; expects url, host, path, tail."""
    url, host, path, tail = F.coalesce("url", F.lit("")), F.col("host"), F.col("path"), F.col("tail")
    chars = F.split(url, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    n = F.length(url)
    return pages.select(
        "*", n.cast("double").alias("url_len"), F.length(host).cast("double").alias("host_len"), F.length(path).cast("double").alias("path_len"),
        _count(path, "/").cast("double").alias("depth"), _count(host, ".").cast("double").alias("labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1))).alias("digit_ratio"), _count(host, "-").cast("double").alias("hyphens"),
        F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.regexp_count(tail, F.lit("[?&][^=&#]*=")).cast("double").alias("params"), F.length(tail).cast("double").alias("query_len"),
        tail.contains("#").cast("double").alias("fragment"), url.startswith("https").cast("double").alias("https"),
        *suffix_keys(),
    )


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, params: UrlParams = UrlParams()) -> DataFrame:
    """id, host, path, rule, verdict and the trees' share for block (null where a rule decides)."""
    host, path, tail = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), tail.alias("tail"))
    verdict_of = F.create_map(*[F.lit(x) for kv in sorted(rules.items()) for x in kv]) if rules else None
    ruled = parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("ruled", F.element_at(verdict_of, F.col("rule")) if rules else F.lit(None).cast("string"))
    labelled = ruled.where(F.col("rule").isNotNull() & F.col("url").isNotNull())
    once = labelled.groupBy("url").agg(*[F.first(c).alias(c) for c in ("host", "path", "tail", "ruled")])  # equal urls have equal parts
    once = materialize(once.withColumn("label", (F.col("ruled") == "block").cast("double")).withColumn("_fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(params.folds))), "labelled")
    seen = once.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    if not seen["n"] or seen["share"] in (0.0, 1.0):
        return ruled.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.lit("block" if seen["n"] and seen["share"] == 1.0 else "allow")).alias("verdict"), F.lit(None).cast("double").alias("block_share"))
    sample = materialize(lexical(first_by_hash(once, "url", params.sample, seen["n"])), "urls")
    prior, keys = F.lit(seen["share"]), ("top", "domain", "segment")
    suffixes = once.select("label", "_fold", *suffix_keys())
    own = {k: materialize(suffixes.groupBy(f"k_{k}", "_fold").agg(F.sum("label").alias(f"_fs_{k}"), F.count(F.lit(1)).alias(f"_fn_{k}")), f"suffix_fold_{k}") for k in keys}
    sums = {k: materialize(own[k].groupBy(f"k_{k}").agg(F.sum(f"_fs_{k}").alias(f"_s_{k}"), F.sum(f"_fn_{k}").alias(f"_n_{k}")), f"suffix_{k}") for k in keys}

    def featured(df: DataFrame, training: bool = False) -> DataFrame:
        """The blocked share by suffix; of training urls from the other folds alone, so that a rare suffix does not give its label away."""
        for k in keys:  # as many rows as the labelled urls have suffixes
            df = df.join(sums[k].hint("merge"), f"k_{k}", "left")
            s, n = F.coalesce(f"_s_{k}", F.lit(0.0)), F.coalesce(f"_n_{k}", F.lit(0))
            if training:
                df = df.join(own[k].hint("merge"), [f"k_{k}", "_fold"], "left")
                s, n = s - F.coalesce(f"_fs_{k}", F.lit(0.0)), n - F.coalesce(f"_fn_{k}", F.lit(0))
            df = df.withColumn(f"rate_{k}", (s + params.smoothing * prior) / (n + params.smoothing))
        return df

    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform
    training = materialize(featured(sample, True).orderBy("url").select("url", *FEATURES, "label"), "training").coalesce(4)
    training = assembled(training).select("features", "label")
    model = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, stepSize=0.3, seed=42).fit(training)
    scored = model.transform(assembled(featured(lexical(ruled.where(F.col("rule").isNull())))))
    share = vector_to_array("probability")[1]
    judged = scored.select(id_col, "host", "path", "rule", F.when(share >= 0.5, "block").otherwise("allow").alias("verdict"), share.alias("block_share"))
    return judged.unionByName(ruled.where(F.col("rule").isNotNull()).select(id_col, "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("block_share")))


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
