"""The queries of this subpackage and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import chat_format, decontaminate, divergence, html_extract, language_id, lm_score, packing, quality_classifier, quality_rules, secret_scan, simhash_dedup, url_filter, whitening
from strideframe.llm.common import prepare


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_html_extract": html_extract.query,
    "op3_secret_scan": secret_scan.query,
    "op4_chat_format": chat_format.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_simhash_dedup": simhash_dedup.query,
    "op7_lm_score": lm_score.query,
    "op8_decontaminate": decontaminate.query,
    "op9_best_fit_packing": packing.query,
    "op10_quality_rules": quality_rules.query,
    "op11_embedding_whitening": whitening.query,
    "op12_source_divergence": divergence.query,
    "op13_language_id": language_id.query,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat_format.SQL, "op12_source_divergence": divergence.SQL}
