"""Plain versions of what the operators compute."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that an operator might use itself.
CLASHES = ["score", "held_out", "key", "row", "n", "cls", "host", "size", "taken", "h", "left", "text_key", "component_id"]


def docs(spark, rows, clashes: bool = False):
    """A documents table of (doc_id, text, lang, source); with clashes, many more columns."""
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("other") for c in CLASHES})
    return df


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
    return [
        (1, "one two three four five six seven eight nine ten", "en", "a"),
        (1, "one two three four five six seven eight nine ten", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (None, "one two three four five six seven eight nine ten", None, "b"),
        (None, None, None, None),
        (4, long, "en", None),
        (5, " \t\n ", "fr", "b"),
        (6, "x" * 50_000, "fr", "b"),
        (7, "ÀÉÎ ça 日本 \u0000 \U0001f600", "fr", "c"),
    ]


def remainder(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def words(text):
    return WORD.findall(text or "")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
