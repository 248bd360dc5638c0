"""The registered queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_toxicity, op2_decontamination, op3_gru, op4_lines, op5_language, op6_urls, op7_jaccard, op8_mixing, op9_licenses, op10_quality
from .common import table
from .sql import ORACLES

URL_RULES = [
    op6_urls.Rule("net", "/", "block"),
    op6_urls.Rule("example.net", "/en/", "allow"),
    op6_urls.Rule("example.com", "/de/", "block"),
    op6_urls.Rule("org", "/fr/", "allow"),
]


def op1_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op1_toxicity.score(docs, op1_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op2_decontamination.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_copies", "n_held", "containment")


def op3_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_gru.score(spark, table(spark, sf_dir, "documents"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lines.rules(spark, table(spark, sf_dir, "documents"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op5_language.identify(docs, op5_language.fit(docs))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_jaccard.component_table(spark, table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing.mix(spark, table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_licenses.licenses(table(spark, sf_dir, "documents")).drop("expressions")


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op10_quality.score(docs, op10_quality.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity_gbt, op2_decontaminate, op3_gru_score, op4_line_rules, op5_language_mixture, op6_url_rules, op7_jaccard_components, op8_mix, op9_license_scan, op10_quality_cnn)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
