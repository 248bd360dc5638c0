"""A corpus pipeline: each stage takes the documents that the one before it kept, and returns what is left of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import op2_decontamination, op4_lines, op5_language, op7_jaccard, op8_mixing
from quadrille.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those of which no language holds a third or so, go."""
    return op5_language.accepted(docs, op5_language.fit(docs))


def line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or consist of lines that are frequent in their source go; such lines go from the others."""
    return op4_lines.cleaned(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 in five-word shingles, that with the smallest doc_id stays."""
    return op7_jaccard.one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's five-word shingles go."""
    return op2_decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, their source's target and the words taken."""
    return op8_mixing.mix(spark, docs, docs.columns).where(F.col("taken") > 0)


STAGES = [("language", language), ("line rules", line_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture)]

#: The language and similarity stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
