"""N-gram Jaccard join by a count-vector R-tree.

1. Documents with the same set of word shingles are one class.
2. Blocks. In an order that all sets share, two sets of similarity t have l of the first n - ceil(t n) + l shingles of each in
   common; l is a tenth of the smallest size that can be linked with n. The order puts the shingles that a first pass saw often
   last, then those of rarer words first, by counts of every eighth word, then goes by hash (this only saves work, any order finds
   all links; by hash alone, chance meetings of common words grow with the square of the documents). Classes that share fewer than l of their first
   shingles with any others have no link and go. Of the rest, those that share one and are of sizes that can be linked are brought
   together in clusters, through links to one class of each block; blocks of frequent shingles are dealt under salts first.
   Clusters of more than a piece are divided by the same rule with another order and shingles of the same cluster only: chance
   meetings that chained their parts together are fewer among fewer classes. This is done again while it helps.
3. In a cluster, shingles are hashed into groups; a class is the point of its group counts. An R-tree over the points bounds the
   overlap of a set with all sets of a box by the sum over groups of the smaller of its count and the box's upper count; what the
   bound and the sizes leave is verified by exact intersection. Pairs that are connected already are skipped. Large clusters are
   cut in pieces: each piece meets itself and the first one; what isn't connected then meets all pieces of sizes that can be linked.
4. Connected components of the links, by smallest doc_id.

Null and empty texts: no shingles, linked with nothing. Null doc_id: a component_id of null, linked with nothing. Rows that repeat
a doc_id with the same text: alike, and their set is sent once by a task; with other texts: one result each. A very long text is
one set, which one task holds. Empty tables: no rows. Only doc_id and text are read; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, small_batches
from .components import components
from .textvec import PLAIN, Words, mixed, pieces, shingles

#: Groups of a count vector at least (larger sets have more, so that a group holds few shingles); points of a leaf and boxes of a node.
GROUPS, LEAF = 128, 8
#: Classes and shingles of a piece of a cluster, about.
PIECE, PIECE_SHINGLES = 512, 1 << 19
#: A task tells the shingles that it sees in so many sets of one pass over this many shingles; those seen so often in all are frequent; those kept at most; salts of a frequent shingle's block.
TOLD_FROM, SEEN, OFTEN, MAX_FREQUENT, SALTS = 3, 4_000_000, 12, 500_000, 32
#: Every so manieth word is counted; a task tells words that it saw so often in one pass; words kept at most; the rarity, in bits, of others.
WORD_STEP, WORD_TOLD, MAX_WORDS, RARE = 8, 16, 65_536, 16
#: First shingles in common: this part of the smallest size that can be linked.
COMMON = 10
#: Times that large clusters are divided at most, and the part of their classes that may be left for it to have helped.
DIVISIONS, HELPED = 4, 0.8
#: Documents of clusters, and documents that go, that are told to all tasks; more are joined by shuffle.
MAX_TOLD, MAX_GONE = 1_000_000, 2_000_000


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must have in common with any set linked to it."""
    return (percent * n + 99) // 100


def sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    w = Words(texts, PLAIN)
    h = w.hashes()
    return [np.unique(shingles(h[a:b], k)) for a, b in zip(w.at[:-1], w.at[1:])]


def word_rarities(counts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common words, sorted, and the rarity of each, from columns cls (hash) and often."""
    counts = counts.assign(hash=counts["cls"].to_numpy(np.int64).view(np.uint64)).sort_values("hash")
    often = counts["often"].to_numpy(float)
    return counts["hash"].to_numpy(), np.clip(np.round(np.log2(often.sum() / often)) if len(often) else often, 1, RARE - 1).astype(np.uint8)


def ranked_sets_of(texts: list[bytes], k: int, words: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """sets_of(), each with the rarity (0 to 127) of its shingles: the sum of their words' ones."""
    w = Words(texts, PLAIN)
    h = w.hashes()
    rare = np.full(len(h), RARE, np.int64)
    if len(words[0]):
        at = np.minimum(np.searchsorted(words[0], h), len(words[0]) - 1)
        rare = np.where(words[0][at] == h, words[1][at], rare)
    sums, out = np.concatenate([[0], np.cumsum(rare)]), []
    for a, b in zip(w.at[:-1], w.at[1:]):
        s, first = np.unique(shingles(h[a:b], k), return_index=True)
        first += a
        out.append((s, np.minimum(sums[np.minimum(first + k, b)] - sums[first], 127).astype(np.uint8)))
    return out


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def in_common(n: int, percent: int) -> int:
    """First shingles that a set of n must have in common with any set linked to it."""
    return max(1, needed(n, percent) // COMMON)


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int, turn: int = 0, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order of this turn, and which of them are frequent. rarity: of each shingle, for turn 0."""
    if turn:
        s = s[np.argsort(mixed(s ^ np.uint64(turn * 0x9E3779B1)), kind="stable")]
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
    late = often.astype(np.uint8) << 7
    if rarity is not None:
        late |= 127 - rarity
    order = np.argsort(late, kind="stable")[: len(s) - needed(len(s), percent) + max(1, len(s) // COMMON)]
    return s[order], often[order]


# R-tree


class Tree:
    """Boxes over points in a fixed order: a node holds LEAF consecutive points or nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._arranged(points, sizes)
        hi, lo_n, hi_n = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = []
        while True:
            first = np.arange(0, len(hi), LEAF)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, first), np.minimum.reduceat(lo_n, first), np.maximum.reduceat(hi_n, first)
            self.levels.append((hi, lo_n, hi_n))
            if len(hi) == 1:
                break

    @staticmethod
    def _arranged(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Halves at the median of the widest group, after sizes, down to leaves."""
        out, todo = [], [np.argsort(sizes, kind="stable")]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                out.append(at)
                continue
            some = points[at]
            spread = some.max(0) - some.min(0)
            axis = spread.argmax()
            by = sizes[at] if np.ptp(sizes[at]) > 4 * spread[axis] else some[:, axis]
            at = at[np.argsort(by, kind="stable")]
            half = -(-len(at) // (2 * LEAF)) * LEAF
            todo += [at[half:], at[:half]]
        return np.concatenate(out)

    def near(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Points that can have the needed overlap with a set of n shingles."""
        low, high = needed(n, percent), 100 * n // percent
        at = np.array([0])
        for hi, lo_n, hi_n in reversed(self.levels):
            at = at[at < len(hi)]
            fits = (hi_n[at] >= low) & (lo_n[at] <= high)
            at = at[fits]
            least = np.maximum(lo_n[at], low)
            at = at[(100 + percent) * np.minimum(hi[at], point).sum(1) >= percent * (n + least)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        return self.order[at[at < len(self.order)]]


def counts(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount(mixed(s ^ np.uint64(0x5DEECE66D)) >> np.uint64(65 - groups.bit_length()), minlength=groups).astype(np.int32)


def groups_for(sizes: np.ndarray) -> int:
    """A power of two: about four shingles of the larger sets for a group, so that the bound tells sets of chance overlap from similar ones."""
    return int(np.clip(1 << int(np.quantile(sizes, 0.9) / 4).bit_length(), GROUPS, 8192))


def connected(sets: list[np.ndarray], group: np.ndarray, percent: int, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what similarity connects. group: what is connected already (equal numbers); ask: only pairs with one of these places."""
    sizes = np.array([len(s) for s in sets])
    points = np.stack([counts(s, groups_for(sizes)) for s in sets])
    tree = Tree(points, sizes)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, first in enumerate(np.unique(group, return_index=True)[1][np.unique(group, return_inverse=True)[1]]):
        root[find(i)] = find(int(first))
    links = []
    for i in tree.order.tolist() if ask is None else ask.tolist():
        near = tree.near(points[i], len(sets[i]), percent)
        near = near[(100 + percent) * np.minimum(points[near], points[i]).sum(1) >= percent * (sizes[near] + sizes[i])]
        for j in near.tolist():
            if find(i) != find(j):
                a, b = sets[i], sets[j]
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
                    links.append((i, j))
    return links


# Over Spark


def class_table(docs: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """doc_id, n, cls (hash of the set; null if empty) for each row, shingles that a pass saw often, and word_rarities()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        some: list[np.ndarray] = []
        held = counted = 0

        def told(value: np.ndarray, n: np.ndarray, word: bool) -> pa.RecordBatch:
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "cls": value.view(np.int64), "often": n, "word": np.full(len(n), word)})

        def common() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(some or [np.zeros(0, np.uint64)]), return_counts=True)
            some.clear()
            return told(value[n >= WORD_TOLD], n[n >= WORD_TOLD], True)

        def often() -> pa.RecordBatch:
            value = np.concatenate(list(seen.values()) or [np.zeros(0, np.uint64)])
            seen.clear()
            value.sort()
            last = max(0, len(value) - TOLD_FROM + 1)
            begins = np.append(True, value[1:] != value[:-1])[:last]
            value, at = value[:last][begins & (value[:last] == value[TOLD_FROM - 1 :])], value
            n = np.searchsorted(at, value, "right") - np.searchsorted(at, value)
            return told(value, n, False)

        for batch in batches:
            for part, texts in pieces(batch):
                w = Words(texts, PLAIN)
                h = w.hashes()
                sets = [np.unique(shingles(h[a:b], k)) for a, b in zip(w.at[:-1], w.at[1:])]
                some.append(h[::WORD_STEP].copy())
                counted += len(some[-1])
                if counted >= SEEN // WORD_STEP:
                    yield common()
                    counted = 0
                cls = [digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.bool_())], ["doc_id", "n", "cls", "often", "word"])
                for c, s in zip(cls, sets):
                    if c is not None and c not in seen:
                        seen[c] = s
                        held += len(s)
                if held >= SEEN:
                    yield often()
                    held = 0
        yield often()
        yield common()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    table = scratch.keep(texts.mapInArrow(run, "doc_id long, n long, cls long, often long, word boolean"))
    top = table.where("not word").groupBy("cls").agg(F.sum("often").alias("often")).where(F.col("often") >= OFTEN).orderBy(F.desc("often"), "cls").limit(MAX_FREQUENT).select("cls").toPandas()
    words = table.where("word").groupBy("cls").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "cls").limit(MAX_WORDS).toPandas()
    return table.where("often is null").drop("often", "word"), np.sort(top["cls"].to_numpy(np.int64).view(np.uint64)), word_rarities(words)


ROW = "shingle long, salt int, cls long, lo long, hi long"


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of shingle, salt, lo and cls, one for each class of blocks with two or more, and all of salted blocks."""
    held = None  # the last row, and whether its block has one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "salt", "cls", "lo", "hi")])
        if held is not None:
            rows = np.concatenate([held[0], rows], 1)
        rows = rows[:, np.concatenate([[True], (np.diff(rows[:3]) != 0).any(0)])]
        same = (np.diff(rows[:2]) == 0).all(0)
        before = np.concatenate([[held is not None and held[1]], same])
        keep = before | np.append(same, False) | (rows[1] > 0)
        held = rows[:, -1:], before[-1] or rows[1, -1] > 0
        yield _rows(rows[:, :-1][:, keep[:-1]])
    if held is not None and held[1]:
        yield _rows(held[0])


def _rows(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), *(pa.array(x) for x in rows[2:])], ["shingle", "salt", "cls", "lo", "hi"])


def stars(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks, in order of shingle, salt and lo, are cut where no size can be linked with one beyond; a, b: links of each part to its first class. Of salted parts, also a row of that class with the part's sizes."""
    far = np.int64(1) << 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.zeros((5, 0), np.int64)

        def out(ends: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
            none = lambda n: pa.nulls(n, pa.int64())
            heads = heads[:, heads[1] > 0]
            link, head = ends.shape[1], heads.shape[1]
            columns = [pa.concat_arrays([pa.array(x), none(head)]) for x in ends] + [pa.concat_arrays([none(link), pa.array(heads[i])]) for i in (0, 2, 3, 4)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "shingle", "cls", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "salt", "cls", "lo", "hi")])
            rows = np.concatenate([open_, rows], 1)
            change = np.concatenate([[True], (np.diff(rows[:2]) != 0).any(0)])
            block = np.cumsum(change)
            most = np.maximum.accumulate(rows[4] + block * far) - block * far
            change[1:] |= 100 * most[:-1] < percent * rows[3, 1:]
            first = np.flatnonzero(change)
            to = rows[2, first[np.cumsum(change) - 1]]
            ends = np.unique(np.stack([to, rows[2]])[:, to != rows[2]], axis=1)
            heads = rows[:, first]
            heads[4] = most[np.append(first[1:], len(to)) - 1]
            open_ = heads[:, -1:]
            yield out(ends, heads[:, :-1])
        yield out(np.zeros((2, 0), np.int64), open_)

    return run


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "lo", "cls")


def first_rows(sets: dict[int, np.ndarray], frequent: np.ndarray, percent: int, turn: int = 0, within: list[int] | None = None, rarity: dict[int, np.ndarray] | None = None) -> pa.RecordBatch | None:
    """Rows of the first shingles of classes; within: the cluster of each, which alone its shingles meet in; rarity: of each one's shingles."""
    firsts = [prefix(s, frequent, percent, turn, None if rarity is None else rarity[c]) for c, s in sets.items()]
    if not firsts:
        return None
    length = [len(f) for f, _ in firsts]
    cls, n = np.repeat(np.array(list(sets), np.int64), length), np.repeat([len(s) for s in sets.values()], length)
    often, value = np.concatenate([o for _, o in firsts]), np.concatenate([f for f, _ in firsts])
    if within is not None:
        value = mixed(value ^ np.repeat(np.array(within, np.int64).view(np.uint64), length) * np.uint64(0x9E3779B97F4A7C15))
    return _rows(np.stack([value.view(np.int64), np.where(often, 1 + cls % SALTS, 0), cls, n, n]))


def hooked(firsts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: by these links, classes that may be linked are connected. firsts: first_rows()."""
    rows = scratch.keep(dealt(firsts).mapInArrow(shared, ROW))
    scratch.settle()
    least = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * percent + 99) / 100) / COMMON))
    for turn in range(2):
        enough = rows.groupBy("cls").agg(F.count("*").alias("shared"), F.max("lo").alias("n")).where(F.col("shared") >= least).select("cls")
        rest = rows.join(enough, "cls", "left_semi").select("shingle", "salt", "cls", "lo", "hi")
        rest = scratch.keep(dealt(rest).mapInArrow(shared, ROW))
        scratch.drop(rows)
        scratch.settle()
        rows = rest
    schema = "a long, b long, shingle long, cls long, lo long, hi long"
    first = scratch.keep(dealt(rows).mapInArrow(stars(percent), schema))
    heads = first.where("shingle is not null").select("shingle", F.lit(0).alias("salt"), "cls", "lo", "hi")
    links = scratch.keep(first.where("a is not null").select("a", "b").union(dealt(heads).mapInArrow(stars(percent), schema).where("a is not null").select("a", "b")).distinct())
    scratch.drop(rows, first)
    return links


def clusters(spark: SparkSession, docs: DataFrame, k: int, percent: int, frequent: np.ndarray, words: tuple[np.ndarray, np.ndarray], scratch: Scratch) -> DataFrame:
    """node, root: the cluster of each class that may be linked with another."""
    known = spark.sparkContext.broadcast((frequent, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that this task has told, the last so many
        for batch in batches:
            for _, texts in pieces(batch):
                often, common = known.value
                own = {c: (s, r) for c, s, r in ((digest(s), s, r) for s, r in ranked_sets_of(texts, k, common) if len(s)) if c not in seen}
                seen = seen | own.keys() if len(seen) < 500_000 else set(own)
                if (rows := first_rows({c: s for c, (s, _) in own.items()}, often, percent, rarity={c: r for c, (_, r) in own.items()})) is not None:
                    yield rows

    links = hooked(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, ROW), percent, scratch)
    found = components(links, scratch)
    scratch.drop(links)
    return found


MEMBER = "cls long, cluster long, held binary"


def divided(spark: SparkSession, members: DataFrame, percent: int, frequent: np.ndarray, scratch: Scratch) -> DataFrame:
    """members (cls, cluster, held) with large clusters divided into those that first shingles in other orders connect; classes that then have no cluster go."""
    known = spark.sparkContext.broadcast(frequent)
    done: DataFrame | None = None
    for turn in range(1, DIVISIONS + 1):
        sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("held") / 8).alias("shingles"))
        large = scratch.keep(sizes.where((F.col("n") > PIECE) | (F.col("shingles") > PIECE_SHINGLES)))
        before = large.agg(F.sum("n")).first()[0]
        if not before:
            break

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 256):
                    part = batch.slice(begin, 256)
                    own = {c: np.frombuffer(s, "<u8") for c, s in zip(part.column("cls").to_pylist(), part.column("held").to_pylist())}
                    of = dict(zip(part.column("cls").to_pylist(), part.column("cluster").to_pylist()))
                    if (rows := first_rows(own, known.value, percent, turn, [of[c] for c in own])) is not None:
                        yield rows

        some = members.join(broadcast_if(large.select("cluster"), MAX_TOLD), "cluster").select("cls", "cluster", "held")
        links = hooked(some.mapInArrow(run, ROW), percent, scratch)
        found = scratch.keep(components(links, scratch).select(F.col("node").alias("cls"), F.col("root").alias("new")))
        parts = some.join(broadcast_if(found, MAX_TOLD), "cls").select("cls", F.col("new").alias("cluster"), "held")
        small = members.join(broadcast_if(large.select("cluster"), MAX_TOLD), "cluster", "left_anti").select("cls", "cluster", "held")
        done = small if done is None else done.union(small)
        members = scratch.keep(parts)
        left = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("held") / 8).alias("shingles")).where((F.col("n") > PIECE) | (F.col("shingles") > PIECE_SHINGLES)).agg(F.sum("n")).first()[0]
        if (left or 0) > HELPED * before:
            break
    return members if done is None else done.union(members)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Few bytes, much work: partitions by keys that aren't put together again for their small size."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def told_or_hashed(ids: DataFrame, limit: int) -> DataFrame:
    """To be joined with texts: told to all tasks, or dealt and held as a hash table, so that texts are shuffled but never sorted (and spilled)."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids.hint("shuffle_hash")


def band(n: Column, percent: int) -> Column:
    """Sets that can be linked are of the same band of sizes or of adjacent ones; a little wider than needed, for rounding."""
    return F.floor(F.log(n) / (1.0001 * max(math.log(100 / percent), 0.05))).cast("long")


def blockwise(percent: int, ask: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls").sort_values("cls").reset_index(drop=True)
        sets = [np.frombuffer(s, "<u8") for s in pdf["held"]]
        links = connected(sets, pdf["root"].to_numpy(), percent, np.flatnonzero(pdf["asked"]) if ask else None) if len(sets) > 1 else []
        at = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pdf["cls"].to_numpy()[at[:, 0]], "b": pdf["cls"].to_numpy()[at[:, 1]]})

    return run


def component_table(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    table, frequent, words = class_table(docs, k, scratch)
    near = clusters(spark, docs, k, percent, frequent, words, scratch)  # node: cls, root: its cluster
    reps = scratch.keep(table.where("cls is not null and doc_id is not null").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    told = scratch.keep(near.join(reps, near["node"] == reps["cls"]).select("rep", "cls", F.col("root").alias("cluster")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a repeated row's set is sent once
        for batch in batches:
            for part, texts in pieces(batch):
                sets, cls = sets_of(texts, k), part.column("cls").to_pylist()
                own = {c: i for i, (s, c) in enumerate(zip(sets, cls)) if c not in seen and len(s) and digest(s) == c}
                seen |= own.keys()
                at = pa.array(own.values(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("cls").take(at), part.column("cluster").take(at), pa.array([sets[i].tobytes() for i in own.values()], pa.binary())], ["cls", "cluster", "held"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    some = texts.join(told_or_hashed(told, MAX_TOLD), texts["doc_id"] == told["rep"]).select("text", "cls", "cluster")
    fetched = scratch.keep(some.mapInArrow(fetch, MEMBER))
    scratch.settle()
    members = divided(spark, fetched, percent, frequent, scratch)
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("held") / 8).alias("shingles"))
    of = scratch.keep(size.where("n > 1").select("cluster", F.ceil(F.greatest(F.col("n") / PIECE, F.col("shingles") / PIECE_SHINGLES)).cast("long").alias("of")))
    members = members.join(broadcast_if(of, MAX_TOLD), "cluster").withColumn("piece", F.pmod(F.xxhash64("cls"), "of")).select("cls", "cluster", "of", "piece", "held")
    # Each piece with itself and with the first piece.
    tasks = F.when(F.col("piece") == 0, F.sequence(F.lit(0), F.col("of") - 1)).otherwise(F.array("piece"))
    first = members.select("cluster", F.explode(tasks).alias("task"), "cls", F.col("cls").alias("root"), "held")
    links = scratch.keep(spread(first, "cluster", "task").groupBy("cluster", "task").applyInPandas(blockwise(percent, False), "a long, b long"))
    # In clusters of several pieces, what isn't in the largest group meets every piece.
    wide = members.where("of > 1")
    if of.where("of > 1").limit(1).count():
        so_far = components(links, scratch)
        with_roots = scratch.keep(wide.join(so_far, wide["cls"] == so_far["node"], "left").select(*wide.columns, F.coalesce("root", "cls").alias("root")))
        most = with_roots.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("m")).select("cluster", F.col("m.root").alias("main"))
        rooted = with_roots.withColumn("band", band(F.length("held") / 8, percent))
        rest = rooted.join(most, "cluster").where("root <> main and piece > 0").drop("main")
        near_bands = rest.select("*", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("other"))
        # The rest of three bands is dealt to parts, and what is in a band with rows that were asked to its own pieces.
        count = F.ceil(F.greatest(F.count("*") / PIECE, F.sum(F.length("held") / 8) / PIECE_SHINGLES)).cast("long")
        parts = near_bands.groupBy("cluster", F.col("other").alias("band")).agg(count.alias("parts"))
        others = rooted.where("piece > 0").join(parts, ["cluster", "band"])
        whole = others.groupBy("cluster", "band").agg(count.alias("pieces"))
        dealing = scratch.keep(parts.join(whole, ["cluster", "band"]))
        others = rooted.where("piece > 0").join(dealing, ["cluster", "band"]).withColumn("piece", F.pmod(F.xxhash64("cls", F.lit("piece")), "pieces"))
        others = others.select("cluster", "band", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "cls", "root", "held", F.lit(False).alias("asked"))
        asked = near_bands.drop("band").withColumnRenamed("other", "band").join(dealing, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("cls", F.lit("part")), "parts"))
        asked = asked.select("cluster", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "part", "cls", "root", "held", F.lit(True).alias("asked"))
        both = asked.unionByName(others)
        more = spread(both, "cluster", "band", "piece", "part").groupBy("cluster", "band", "piece", "part").applyInPandas(blockwise_asked(percent), "a long, b long")
        more = scratch.keep(more)
        scratch.drop(with_roots, dealing)
        links = links.union(more)
    known = reps.select("cls", "rep")
    ends = links.join(known.withColumnsRenamed({"cls": "a", "rep": "ra"}), "a").join(known.withColumnsRenamed({"cls": "b", "rep": "rb"}), "b")
    found = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), scratch)
    # A class of one document that is linked with no other needs no entry.
    entry = reps.join(found, reps["rep"] == found["node"], "left").where("root is not null or rows > 1").select("cls", "n", F.coalesce("root", "rep").alias("component"))
    entry = scratch.keep(entry)
    scratch.drop(told, fetched, of, reps)
    scratch.settle()
    return table.join(entry, ["cls", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def blockwise_asked(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    run = blockwise(percent, True)
    return lambda pdf: run(pdf.sort_values("asked", ascending=False))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns (of any names), less those of a component other than of its smallest doc_id, and less repeated rows of that id. Rows without an id stay; an empty table gives none."""
    scratch = Scratch(spark, "one-of-each")
    found = scratch.keep(component_table(spark, docs, k, percent).where("doc_id is not null"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain, id_ = docs.toDF(*names), names[docs.columns.index("doc_id")]
    copies = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rest = plain.join(told_or_hashed(copies, MAX_GONE), plain[id_] == F.col("gone"), "left_anti")
    again = scratch.keep(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again")))
    if not again.limit(1).count():
        return rest.toDF(*docs.columns)
    again = told_or_hashed(again, MAX_GONE)
    once = rest.join(again, rest[id_] == F.col("again"), "left_anti")
    return once.union(rest.join(again, rest[id_] == F.col("again"), "left_semi").dropDuplicates([id_])).toDF(*docs.columns)
