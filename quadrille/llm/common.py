"""What the operators share: reading tables and plain SQL expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, broadcast_if

__all__ = ["Scratch", "broadcast_if", "is_remainder", "lowered", "n_words", "remainder", "small_batches", "table", "words"]

#: Separators of words: space and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers 1,024 rows at a time, unless the session says otherwise: both sides hold whole batches, outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "1024")


def lowered(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; null for null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def is_remainder(key: Column, n: int, r: int) -> Column:
    return F.coalesce(remainder(key, n) == r, F.lit(False))
