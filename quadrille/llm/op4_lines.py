"""Quality rules by cross-document line frequency, in DataFrame expressions only.

One pass over the texts measures each document and hashes its lines, normalised: lower-cased, blanks trimmed and joined. Lines
are counted by the distinct documents of their host (the source) that hold them. Documents of the same text count as one (a
document's identity is a hash of its whole text), so that a text that was copied often doesn't make its own lines frequent; near
copies are distinct documents. A line in more documents than both limits is removed, and so is a long line in more documents
than an absolute limit, however large the host; a document that loses more than a limit of its text so is depleted and rejected.

Null and empty texts: all measures 0, base_failed, not kept. Null hosts are one host. Null doc_id: judged like others. Repeated
rows: alike, one result each, counted as one document. Blank lines are neither counted nor removed. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: A line is frequent in more documents of its host than both; a document is depleted if it keeps less than this part.
MIN_DOCS, DOC_SHARE, KEPT = 20, 0.02, 0.2
#: A line of so many characters is frequent in more documents of its host than this, whatever their share.
LONG, MOST_DOCS = 100, 1000
#: Frequent lines, of all hosts, that are told to all tasks; beyond, hosts' lists are dealt under salts.
MAX_TOLD, SALTS = 500_000, 32


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _covered(sorted_windows: Column) -> Column:
    """Words in windows of which there are two or more; sorted_windows: (hash, place) in order of hash."""
    h = lambda i: F.get(sorted_windows, i)["h"]
    return F.filter(sorted_windows, lambda x, i: (h(i - 1) == x["h"]) | (h(i + 1) == x["h"]))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, identity, lines (hash and characters of each line with a word)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), words(F.col("text")).alias("w"), F.filter(lines_of(F.col("text")), lambda x: x.rlike(WORD)).alias("l"))
    n = F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    rows = rows.select(
        "doc_id", "host", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("windows"), F.xxhash64("text").alias("identity"),
        F.transform("l", lambda x: F.struct(line_hash(x).alias("h"), F.length(x).alias("n"))).alias("lines"),
    )
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(some, pairs)).drop("windows")
    rows = rows.withColumn("places", F.sort_array(F.transform(_covered(F.col("sorted")), lambda x: x["i"]))).drop("sorted")
    spans = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("places")


def frequent_lines(rows: DataFrame) -> DataFrame:
    """host, line: hashes of lines above the limits. For each host, they are at most 1 / DOC_SHARE times the mean lines of a document, and long lines at most the host's lines / MOST_DOCS."""
    hosts = rows.groupBy("host").agg(F.countDistinct("identity").alias("docs")).withColumnRenamed("host", "of_host")
    each = rows.select("host", "identity", F.explode(F.array_distinct("lines")).alias("line")).select("host", "identity", F.col("line.h").alias("line"), F.col("line.n").alias("n"))
    found = each.groupBy("host", "line").agg(F.countDistinct("identity").alias("held_by"), F.max("n").alias("n")).where(F.col("held_by") > MIN_DOCS)
    often = (F.col("n") >= LONG) & (F.col("held_by") > MOST_DOCS)
    return found.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where((F.col("held_by") > DOC_SHARE * F.col("docs")) | often).select("host", "line")


def with_frequent(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """rows (with a column host) and the array of frequent lines of the host."""
    lists = frequent.groupBy(F.col("host").alias("of_host")).agg(F.collect_list("line").alias("frequent"))
    if frequent.limit(MAX_TOLD + 1).count() <= MAX_TOLD:
        return rows.join(F.broadcast(lists), F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    lists = lists.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return salted.join(lists, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt") == F.col("of_salt")), "left").drop("of_host", "of_salt", "salt")


def judged(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Measures and verdicts, one row for each row of docs (with removed_lines and kept_part), and the frequent lines."""
    scratch = scratch or Scratch(spark, "lines")
    rows = scratch.keep(measured(docs))
    frequent = scratch.keep(frequent_lines(rows))
    found = with_frequent(rows, frequent).withColumn("removed", F.array_intersect("lines.h", F.coalesce("frequent", F.array().cast("array<long>"))))
    long = F.lit(0).cast("long")
    total = F.aggregate("lines", long, lambda a, x: a + x["n"])
    lost = F.when(F.size("removed") > 0, F.aggregate(F.filter("lines", lambda x: F.array_contains("removed", x["h"])), long, lambda a, x: a + x["n"])).otherwise(long)
    found = found.withColumn("kept_part", F.when(total > 0, 1 - lost / total).otherwise(1.0))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("kept_part") >= KEPT))
    return found.withColumn("removed_lines", F.size("removed").cast("long")).drop("removed", "frequent", "lines", "identity"), frequent


def rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_lines, kept_part."""
    return judged(spark, docs)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "kept_part")


def cleaned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The kept rows of docs, all columns, without their frequent lines; n_chars, if there is one, counts what is left.

    The verdict depends on host and text alone, so rejected texts are told by host and two hashes and removed by an anti-join.
    """
    scratch = Scratch(spark, "cleaned")
    names = [f"_{i}" for i in range(len(docs.columns))]  # any names of docs' columns are allowed
    plain = docs.toDF(*names)
    of = {c: F.col(n) for c, n in zip(docs.columns, names)}
    keyed = plain.select(*names, of["source"].alias("host"), F.xxhash64(of["text"]).alias("k1"), F.length(of["text"]).alias("k2"))
    keyed = keyed.withColumn("k3", F.crc32(of["text"].cast("binary")))
    rows = docs.select(F.struct(F.xxhash64("text").alias("k1"), F.length("text").alias("k2"), F.crc32(F.col("text").cast("binary")).alias("k3")).alias("doc_id"), "text", "source")
    found, frequent = judged(spark, rows, scratch)
    bad = scratch.keep(found.where(~F.col("kept")).select(F.col("host").alias("bad_host"), "doc_id.*").distinct().withColumnsRenamed({"k1": "b1", "k2": "b2", "k3": "b3"}))
    small = bad.limit(MAX_TOLD + 1).count() <= MAX_TOLD
    same = F.col("host").eqNullSafe(F.col("bad_host")) & F.col("k1").eqNullSafe(F.col("b1")) & F.col("k2").eqNullSafe(F.col("b2")) & F.col("k3").eqNullSafe(F.col("b3"))
    good = keyed.join(F.broadcast(bad) if small else bad, same, "left_anti")
    shown = with_frequent(good, frequent)
    text = of["text"]
    split = F.transform(lines_of(text), lambda x: F.struct(x.alias("x"), F.when(x.rlike(WORD), line_hash(x)).alias("h")))
    shown = shown.withColumn("split", F.when(F.size("frequent") > 0, split))
    shown = shown.withColumn("gone", F.array_intersect("split.h", "frequent"))
    left = F.array_join(F.transform(F.filter("split", lambda x: x["h"].isNull() | ~F.array_contains("gone", x["h"])), lambda x: x["x"]), "\n")
    shown = shown.withColumn("left", F.when(F.size("gone") > 0, left).otherwise(text))
    new = of | {"text": F.col("left")} | ({"n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return shown.select(*[new[c].alias(c) for c in docs.columns])
