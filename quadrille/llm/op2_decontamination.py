"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are sets of hashed five-word shingles (words are lower-cased letters and digits). Items are partitioned by size. In a
partition of sets of up to u shingles an item may lack m = u - ceil(0.8 u) of them; its signature is its m + r smallest shingle
hashes, r = 1 + u // 10 (all of them, if it has no more). A document's sketch for the partition is its own shingle hashes up to the
largest that any signature of the partition holds. An item of which a document holds 0.8 lacks m at most, so r of its signature (or
all but m of a shorter one) are in the sketch, no matter how long the document is, and no pair is missed. Pairs found so are
verified by counting the item's shingles in the document.

Items with the same set are one class, named by its smallest item_id, with the number of items. An item of fewer than five words is
one shingle, their whole sequence, which is looked for in all texts: documents are also cut in windows of each such length that
occurs. Null and empty texts hold nothing and match nothing. Null ids: a document's matches are reported with a null id; a class
without any id is item -1. Repeated document rows: one result each. A very long text is searched whole. An empty table on either
side gives no rows. Extra columns, of any name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if
from .textvec import ALNUM, Words, pieces, shingles

SHINGLE, PERCENT = 5, 80
#: Upper bounds of the sizes of partitions grow by this factor.
GROWTH = 1.25
#: Item shingles that each task may hold; beyond, documents' shingles are dealt by hash and meet the items there.
MAX_HELD = 4_000_000


def allowed(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles of a set of n that a document may lack."""
    return n - (PERCENT * n + 99) // 100


def signature(n: int) -> tuple[int, int]:
    """Length of the signature of a set of n shingles, and how many of it any match has in its sketch."""
    u = partition_bound(n)
    length = min(n, allowed(u) + 1 + u // 10)
    return length, length - allowed(n)


def partition_bound(n: int) -> int:
    """The largest size of the partition that holds sets of n shingles."""
    u = 1
    while u < n:
        u = max(u + 1, int(u * GROWTH))
    return u


def windows(h: np.ndarray, short: tuple[int, ...]) -> np.ndarray:
    """Shingles of a document, given its words' hashes, and its windows of the lengths of short items."""
    own = [shingles(h, SHINGLE)] if len(h) >= SHINGLE else []
    return np.concatenate([*own, *(shingles(h, k) for k in short if k <= len(h)), h[:0]])


def item_shingles(items: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ITEM: each shingle of each class of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                w = Words(texts, ALNUM)
                h = w.hashes()
                sets = [(i, min(b - a, SHINGLE), np.unique(shingles(h[a:b], SHINGLE))) for i, a, b in zip(part.column("item_id").to_pylist(), w.at[:-1], w.at[1:]) if b > a]
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([i for i, _, _ in sets], pa.int64()), "words": pa.array([k for _, k, _ in sets], pa.int32()), "n": pa.array([len(s) for *_, s in sets], pa.int32()), "held": pa.array([s.astype("<u8").tobytes() for *_, s in sets], pa.binary())})

    sets = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id long, words int, n int, held binary")
    classes = scratch.keep(sets.groupBy("held", "n", "words").agg(F.coalesce(F.min("item_id"), F.lit(-1)).alias("item_id"), F.count("*").alias("copies")).withColumn("cls", F.xxhash64("held", "n", "words")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, i, words, n, copies, held in zip(*(batch.column(c).to_pylist() for c in ("cls", "item_id", "words", "n", "copies", "held"))):
                length, least = signature(n)
                same = {"cls": pa.int64(), "item_id": pa.int64(), "words": pa.int32(), "n": pa.int32(), "copies": pa.int64(), "least": pa.int32(), "bound": pa.int32()}
                values = dict(zip(same, (cls, i, words, n, copies, least, partition_bound(n))))
                yield pa.RecordBatch.from_pydict({**{c: pa.array([values[c]] * n, t) for c, t in same.items()}, "shingle": np.frombuffer(held, "<i8"), "signed": np.arange(n) < length})

    return classes.mapInArrow(spread, ITEM)


#: least: of the signature, how many a match has; bound: the partition.
ITEM = "cls long, item_id long, words int, n int, copies long, least int, bound int, shingle long, signed boolean"


class Items:
    """Items that a task holds: class by number, shingles in order, and the partitions' signatures."""

    def __init__(self, rows):
        rows = rows.assign(shingle=rows["shingle"].to_numpy(np.int64).view(np.uint64)).sort_values(["item_id", "cls", "shingle"])
        key = rows.groupby(["item_id", "cls"], sort=False).ngroup().to_numpy()
        shingle, signed = rows["shingle"].to_numpy(np.uint64), rows["signed"].to_numpy(bool)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.ids, self.copies = rows["item_id"].iloc[first].tolist(), rows["copies"].iloc[first].tolist()
        self.least = rows["least"].to_numpy(np.int64)[first]
        self.sets = np.split(shingle, first[1:]) if len(first) else []
        self.short = tuple(sorted(set(rows["words"].iloc[first].tolist()) - {SHINGLE}))
        #: For each partition the signatures' shingles in order, their items, and the largest one.
        self.partitions = []
        for bound in np.unique(rows["bound"].to_numpy()):
            at = np.flatnonzero(signed & (rows["bound"].to_numpy() == bound))
            at = at[np.argsort(shingle[at], kind="stable")]
            self.partitions.append((shingle[at], key[at], shingle[at[-1]]))
        self.some = np.zeros(1 << 20, bool)
        self.some[shingle[signed] >> np.uint64(44)] = True

    def candidates(self, likely: np.ndarray) -> np.ndarray:
        """Classes of whose signatures a sketch holds enough. likely: distinct shingles in order, less those that are in no signature."""
        met = []
        for shingle, of, top in self.partitions:
            sketch = likely[: np.searchsorted(likely, top, "right")]
            lo, hi = np.searchsorted(shingle, sketch, "left"), np.searchsorted(shingle, sketch, "right")
            found = [of[i:j] for i, j in zip(lo, hi) if j > i]
            if found:
                cls, hits = np.unique(np.concatenate(found), return_counts=True)
                met.append(cls[hits >= self.least[cls]])
        return np.sort(np.concatenate(met)) if met else np.zeros(0, np.int64)

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """(class, shingles held) of each text."""
        w = Words(texts, ALNUM)
        h = w.hashes()
        out = []
        for a, b in zip(w.at[:-1], w.at[1:]):
            s = windows(h[a:b], self.short)
            likely = np.unique(s[self.some[s >> np.uint64(44)]])
            met = self.candidates(likely) if len(likely) else []
            found = []
            if len(met):
                held = np.unique(s)
                for c in met:
                    at = np.searchsorted(held, self.sets[c])
                    n = int((held[np.minimum(at, len(held) - 1)] == self.sets[c]).sum())
                    if 100 * n >= PERCENT * len(self.sets[c]):
                        found.append((int(c), n))
            out.append(found)
        return out


PAIRS = "item_id long, n_item long, n_copies long, n_held long, containment double"


def search(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), item_id, n_item, n_copies, n_held, containment: a row for each document and class of items of which it holds 0.8 or more."""
    scratch = Scratch(spark, "decontaminate")
    held = scratch.keep(item_shingles(items, scratch))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    if held.limit(MAX_HELD + 1).count() > MAX_HELD:
        return search_dealt(texts, held, kind, scratch)
    known = spark.sparkContext.broadcast(held.toPandas())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(known.value)
        for batch in batches:
            for part, some in pieces(batch):
                pairs = [(i, c, n) for i, found in enumerate(items.matches(some)) for c, n in found]
                at = pa.array([i for i, _, _ in pairs], pa.int32())
                size = np.array([len(items.sets[c]) for _, c, _ in pairs], np.int64)
                n = np.array([n for _, _, n in pairs], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("text_key").take(at), pa.array([items.ids[c] for _, c, _ in pairs], pa.int64(), from_pandas=True), pa.array(size), pa.array([items.copies[c] for _, c, _ in pairs], pa.int64()), pa.array(n), pa.array(n / np.maximum(size, 1))], ["doc_id", "text_key", *(c.split()[0] for c in PAIRS.split(", "))])

    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, {PAIRS}")


def search_dealt(texts: DataFrame, held: DataFrame, kind: str, scratch: Scratch, salts: int = 16) -> DataFrame:
    """As search(), for any number of items: sketches of distinct texts, under a salt of the text, meet the signatures; the texts of pairs found so are read again, with all shingles of their items beside them.

    Texts of one key are one, so that a text that was copied often is searched once.
    """
    short = tuple(sorted(r["words"] for r in held.select("words").distinct().collect() if r["words"] < SHINGLE))  # lengths under five
    top = held.where("signed").agg(F.max(F.shiftrightunsigned("shingle", 1)).alias("top")).first()["top"] or 0

    def run(batches: Iterator[pa.RecordBatch], only: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in pieces(batch):
                w = Words(some, ALNUM)
                h = w.hashes()
                sets = [np.unique(windows(h[a:b], short)) for a, b in zip(w.at[:-1], w.at[1:])]
                sets = [s[: np.searchsorted(s >> np.uint64(1), np.uint64(top), "right")] for s in sets] if only else sets
                which = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("text_key").take(which), pa.array(np.concatenate([*sets, h[:0]]).view(np.int64))], ["text_key", "shingle"])

    salt = F.pmod(F.xxhash64("text_key", F.lit("salt")), F.lit(salts))
    own = texts.select("text_key", "text").mapInArrow(lambda b: run(b, True), "text_key long, shingle long").distinct().withColumn("salt", salt)
    signed = held.where("signed").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    hits = own.join(signed, ["salt", "shingle"]).groupBy("text_key", "cls", "item_id", "n", "copies", "least").agg(F.count("*").alias("hits"))
    pairs = scratch.keep(hits.where("hits >= least").select("text_key", "cls", "item_id", "n", "copies"))
    found = pairs.select("text_key").distinct()
    whole = texts.join(broadcast_if(found, 500_000), "text_key", "left_semi").select("text_key", "text")
    whole = whole.mapInArrow(lambda b: run(b, False), "text_key long, shingle long").distinct()
    counted = pairs.join(held.select("cls", "item_id", "shingle"), ["cls", "item_id"]).join(whole, ["text_key", "shingle"])
    good = counted.groupBy("text_key", "item_id", "cls", "n", "copies").agg(F.count("*").alias("n_held")).where(F.col("n_held") * 100 >= F.col("n") * PERCENT)
    out = texts.select("doc_id", "text_key").join(broadcast_if(good, 500_000), "text_key")  # once for each repeated row
    return out.select("doc_id", "text_key", "item_id", F.col("n").cast("long").alias("n_item"), F.col("copies").alias("n_copies"), "n_held", (F.col("n_held") / F.col("n")).alias("containment"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns (of any names), that hold no item. An empty table of items leaves all."""
    scratch = Scratch(spark, "contaminated")
    bad = scratch.keep(search(spark, docs, items).select(F.col("text_key").alias("bad_text_key")).distinct())
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    return plain.join(broadcast_if(bad, 500_000), F.xxhash64(plain[names[docs.columns.index("text")]]) == bad["bad_text_key"], "left_anti").toDF(*docs.columns)
