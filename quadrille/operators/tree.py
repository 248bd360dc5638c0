"""Trees of boxes: packing along the Hilbert curve, choice of a subtree, splits and reinsertion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import as_box, box, hilbert_key, mbr, mbr_of, rect_area, rect_intersection_area, rect_margin
from ..plans.rank import ranked
from ..plans.scratch import Scratch

# Least fill of a node, part of a full node's entries that is inserted anew, bytes of a block, of its head and of an entry.
MIN_FILL, REINSERT = 0.4, 0.3
BLOCK, HEAD, LEAF_ENTRY, INNER_ENTRY = 32 * 1024, 12, 20, 36


def leaf_capacity(block_bytes: int = BLOCK) -> int:
    return (block_bytes - HEAD) // LEAF_ENTRY


def inner_capacity(block_bytes: int = BLOCK) -> int:
    return (block_bytes - HEAD) // INNER_ENTRY


def tree_height(n: int, leaf: int, inner: int) -> int:
    """Levels above the leaves of n packed points."""
    nodes, levels = math.ceil(n / leaf), 0
    while nodes > 1:
        nodes, levels = math.ceil(nodes / inner), levels + 1
    return levels


def hilbert_order(points: DataFrame) -> DataFrame:
    """points with hilbert_key, for the square from the least coordinates to the greatest extent."""
    ends = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if ends["x0"] is None:
        return points.withColumn("hilbert_key", F.lit(0).cast("long"))
    side = max(ends["x1"] - ends["x0"], ends["y1"] - ends["y0"])
    return points.withColumn("hilbert_key", hilbert_key(F.col("x") - F.lit(ends["x0"]), F.col("y") - F.lit(ends["y0"]), F.lit(side)))


def packed(rank: Column, n: int, capacity: int) -> Column:
    """Node of the entry of this rank among n: full nodes, but the last one has the least fill, at the expense of the one before."""
    least, nodes = int(capacity * MIN_FILL), math.ceil(n / capacity)
    full = F.floor(rank / capacity).cast("long")
    if n > capacity and 0 < n % capacity < least:
        return F.when(rank >= n - least, F.lit(nodes - 1)).otherwise(F.least(full, F.lit(nodes - 2))).cast("long")
    return full


def bulk_load_leaves(points: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """points with hilbert_key and leaf_id (in curve order, ties by id)."""
    held = scratch.keep(ranked(hilbert_order(points), ["hilbert_key", "id"], scratch))
    return held.withColumn("leaf_id", packed(F.col("rank"), held.count(), capacity)).drop("rank")


def tree_nodes(leaves: DataFrame, inner: int, scratch: Scratch) -> DataFrame:
    """All nodes: level (0 is the root), node_id (place in its level), parent_id, entries, box. From rows with leaf_id, x, y.

    The leaves' boxes come from one aggregation; each level above is an aggregation of a table that is smaller by the capacity.
    """
    level = scratch.keep(leaves.groupBy(F.col("leaf_id").alias("node_id")).agg(F.count("*").alias("entries"), *mbr(F.col("x"), F.col("y"))))
    levels = []
    while True:
        n = level.count()
        if n <= 1:
            levels.append(level.withColumn("parent_id", F.lit(None).cast("long")))
            break
        level = level.withColumn("parent_id", packed(F.col("node_id"), n, inner))
        levels.append(level)
        level = scratch.keep(level.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("entries"), *mbr_of(as_box())))
    out = None
    for depth, rows in enumerate(reversed(levels)):
        rows = rows.select(F.lit(depth).alias("level"), "node_id", "parent_id", "entries", "xmin", "ymin", "xmax", "ymax")
        out = rows if out is None else out.union(rows)
    return out


def tree_dump(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """A line for each node and each leaf's record, with its place in the dump: level, node, parent, entry."""
    deepest = nodes.agg(F.max("level").alias("deepest"))
    of_nodes = nodes.select("level", "node_id", F.lit(None).cast("long").alias("record_id"), F.format_string("level %d node %d parent %s entries %d box [%.2f, %.2f, %.2f, %.2f]", "level", "node_id", F.coalesce(F.col("parent_id").cast("string"), F.lit("-")), "entries", "xmin", "ymin", "xmax", "ymax").alias("line"))
    of_records = leaves.join(F.broadcast(deepest)).select(F.col("deepest").alias("level"), F.col("leaf_id").alias("node_id"), F.col("id").alias("record_id"), F.format_string("  record %d at %.2f, %.2f", "id", "x", "y").alias("line"))
    return of_nodes.union(of_records)


def write_dump(dump: DataFrame, path: str) -> None:
    """The lines of tree_dump() as text, level by level, nodes in order, a leaf's records after it: files by name and lines in them are in that order."""
    dump.orderBy("level", "node_id", F.col("record_id").asc_nulls_first()).select("line").write.text(path)


def rect_order(boxes: DataFrame, scratch: Scratch, key: str = "id") -> DataFrame:
    """boxes (key, bounds) with their places by the lower and the upper bound of each axis, ties by key."""
    out = boxes
    for axis in "xy":
        for bound, end in (("lower", "min"), ("upper", "max")):
            out = ranked(out, [f"{axis}{end}", key], scratch, f"{axis}_{bound}")
    return out


# Choice of a subtree

#: Boxes that go to all tasks; beyond, points and boxes are dealt by parent, under salts.
MAX_BOXES, SALTS = 200_000, 16
#: Nodes of so many entries are compared with all of a node's entries at once, many nodes together; entries of a larger node are in blocks of so many.
SMALL = 32
#: Numbers of a table in memory, about.
CELLS = 1 << 19

Bounds = list[np.ndarray]


def _grown(b: Bounds, x: np.ndarray, y: np.ndarray) -> Bounds:
    return [np.minimum(b[0], x), np.minimum(b[1], y), np.maximum(b[2], x), np.maximum(b[3], y)]


def _area(b: Bounds) -> np.ndarray:
    return (b[2] - b[0]) * (b[3] - b[1])


def _meet(a: Bounds, b: Bounds) -> np.ndarray:
    return np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)


def _inside(b: Bounds, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])


class Blocks:
    """Entries of one large node, in order of node_id, in blocks of near ones, whose boxes tell which can matter."""

    def __init__(self, bounds: np.ndarray):
        self.b, self.area = bounds, _area(bounds)
        n = bounds.shape[1]
        self.size = max(SMALL, math.isqrt(n) // 2)
        order = self._arranged(bounds[:2] + bounds[2:])
        self.at = np.concatenate([order, np.full(-n % self.size, order[-1])]).reshape(-1, self.size)  # the last one again
        self.real = (np.arange(self.at.size) < n).reshape(self.at.shape)
        own = bounds[:, self.at]
        self.outer = [own[0].min(1), own[1].min(1), own[2].max(1), own[3].max(1)]
        self.width, self.height = (own[2] - own[0]).min(1), (own[3] - own[1]).min(1)
        self.whole = bounds[0].min(), bounds[1].min(), bounds[2].max(), bounds[3].max()

    def _arranged(self, middle: np.ndarray) -> np.ndarray:
        """Halves at the median of the wider axis, down to blocks."""
        out, todo = [], [np.arange(middle.shape[1])]
        while todo:
            at = todo.pop()
            if len(at) <= self.size:
                out.append(at)
                continue
            at = at[np.argsort(middle[np.ptp(middle[:, at], axis=1).argmax(), at], kind="stable")]
            half = -(-len(at) // (2 * self.size)) * self.size
            todo += [at[half:], at[:half]]
        return np.concatenate(out)

    def best(self, x: np.ndarray, y: np.ndarray, leaf_parents: bool) -> tuple[np.ndarray, np.ndarray]:
        """Place of the entry and growth for each point."""
        step = max(1, CELLS // max(self.at.shape))
        found = [self._best(x[i : i + step], y[i : i + step], leaf_parents) for i in range(0, len(x), step)]
        return np.concatenate([f for f, _ in found]), np.concatenate([g for _, g in found])

    def _growth(self, block: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = self.at[block]
        return np.round(_area(_grown([v[at] for v in self.b], x[:, None], y[:, None])) - self.area[at], 9)

    def _best(self, x: np.ndarray, y: np.ndarray, leaf_parents: bool) -> tuple[np.ndarray, np.ndarray]:
        x0, y0, x1, y1 = self.outer
        dx = np.maximum(np.maximum(x0 - x[:, None], x[:, None] - x1), 0)
        dy = np.maximum(np.maximum(y0 - y[:, None], y[:, None] - y1), 0)
        # No box of a block grows by less; what rounding may change is allowed for.
        bound = self.width * dy + self.height * dx + dx * dy
        slack = 2e-9 + 1e-14 * _area(_grown(self.whole, x, y))
        rows, nearest = np.arange(len(x)), bound.argmin(1)
        may = bound <= (self._growth(nearest, x, y).min(1) * (1 + 1e-12) + slack)[:, None]
        may[rows, nearest] = True
        of, block = np.nonzero(may)
        least, small, first = [], [], []
        for i in range(0, len(of), CELLS // self.size):
            o, k = of[i : i + CELLS // self.size], block[i : i + CELLS // self.size]
            growth, at = self._growth(k, x[o], y[o]), self.at[k]
            least.append(growth.min(1))
            area = np.where(growth == least[-1][:, None], self.area[at], np.inf)
            small.append(area.min(1))
            first.append(np.where(area == small[-1][:, None], at, len(self.area)).min(1))
        begin = np.searchsorted(of, rows)
        least, small, first = np.concatenate(least), np.concatenate(small), np.concatenate(first)
        growth = np.minimum.reduceat(least, begin)
        small = np.where(least == growth[of], small, np.inf)
        first = np.where(small == np.minimum.reduceat(small, begin)[of], first, len(self.area))
        at = np.minimum(np.minimum.reduceat(first, begin), len(self.area) - 1)
        if leaf_parents:
            # A box that holds the point, or overlaps the others no more than before, is the best of all. Points without such a first box are looked at one by one.
            rest = np.flatnonzero(~_inside([v[at] for v in self.b], x, y))
            for i in rest[self._overlap(at[rest], x[rest], y[rest]) > 0]:
                at[i], growth[i] = self._least_overlap(x[i], y[i])
        return at, growth

    def _overlap(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Growth of the overlap with all other entries, if the entry at a place takes the point."""
        own = [v[at] for v in self.b]
        grown = _grown(own, x, y)
        x0, y0, x1, y1 = self.outer
        of, block = np.nonzero((x0 <= grown[2][:, None]) & (x1 >= grown[0][:, None]) & (y0 <= grown[3][:, None]) & (y1 >= grown[1][:, None]))
        more = np.zeros(len(at))
        for i in range(0, len(of), CELLS // self.size):
            o, k = of[i : i + CELLS // self.size], self.at[block[i : i + CELLS // self.size]]
            others = [v[k] for v in self.b]
            each = _meet([v[o, None] for v in grown], others) - _meet([v[o, None] for v in own], others)
            each[(k == at[o, None]) | ~self.real[block[i : i + CELLS // self.size]]] = 0
            more += np.bincount(o, each.sum(1), len(at))
        return np.round(more, 9)

    def _least_overlap(self, x: float, y: float) -> tuple[int, float]:
        """The entry of least growth of overlap, then of area, then least area. In that order of the rest, the first without overlap is the best of all."""
        grown = _grown(self.b, x, y)
        growth = np.round(_area(grown) - self.area, 9)
        order = np.lexsort([self.area, growth])
        best, least = -1, np.inf
        for begin in range(0, len(order), 64):
            e = order[begin : begin + 64]
            g, own = [v[e] for v in grown], self.b[:, e]
            # Others that none of these grown boxes meets add nothing.
            o = np.flatnonzero((self.b[0] <= g[2].max()) & (self.b[2] >= g[0].min()) & (self.b[1] <= g[3].max()) & (self.b[3] >= g[1].min()))
            others = self.b[:, o]
            more = _meet([v[:, None] for v in g], others) - _meet([v[:, None] for v in own], others)
            more[e[:, None] == o] = 0
            more = np.round(more.sum(1), 9)
            k = int(more.argmin())
            if more[k] < least:
                best, least = int(e[k]), more[k]
            if least <= 0:
                break
        return best, growth[best]


class Entries:
    """Boxes of many nodes, by parent and in order of node_id."""

    def __init__(self, rows: pd.DataFrame):
        ids, parent = rows["node_id"].to_numpy(np.int64), rows["parent_id"].to_numpy(np.int64)
        order = np.lexsort([ids, parent])
        self.ids, self.b = ids[order], rows[["xmin", "ymin", "xmax", "ymax"]].to_numpy(float).T[:, order]
        self.area = _area(self.b)
        self.parents, self.begin, self.n = np.unique(parent[order], return_index=True, return_counts=True)
        self.large: dict[int, Blocks] = {}

    def best(self, parent: np.ndarray, x: np.ndarray, y: np.ndarray, leaf_parents: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the points whose node has entries, and the entry's node_id and the growth for each of them."""
        if not len(self.parents):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        node = np.minimum(np.searchsorted(self.parents, parent), len(self.parents) - 1)
        known = np.flatnonzero(self.parents[node] == parent)
        node, x, y = node[known], x[known], y[known]
        at, growth = np.zeros(len(known), np.int64), np.zeros(len(known))
        width = 1
        while width <= SMALL:  # nodes of like sizes together
            some = np.flatnonzero((self.n[node] <= width) & (self.n[node] > width // 2))
            step = max(1, CELLS // (width * width))
            for i in range(0, len(some), step):
                s = some[i : i + step]
                at[s], growth[s] = self._best(node[s], x[s], y[s], width, leaf_parents)
            width *= 2
        wide = np.flatnonzero(self.n[node] > SMALL)
        wide = wide[np.argsort(node[wide], kind="stable")]
        for s in np.split(wide, np.flatnonzero(np.diff(node[wide])) + 1) if len(wide) else ():
            k, begin = int(node[s[0]]), int(self.begin[node[s[0]]])
            if k not in self.large:
                self.large[k] = Blocks(self.b[:, begin : begin + self.n[k]])
            found, growth[s] = self.large[k].best(x[s], y[s], leaf_parents)
            at[s] = begin + found
        return known, self.ids[at], growth

    def _best(self, node: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, leaf_parents: bool) -> tuple[np.ndarray, np.ndarray]:
        """For points of nodes of width entries at most: place of the entry and growth."""
        each, n = np.arange(width), self.n[node]
        at = self.begin[node][:, None] + np.minimum(each, n[:, None] - 1)
        none = each >= n[:, None]
        own, area = [v[at] for v in self.b], self.area[at]
        grown = _grown(own, x[:, None], y[:, None])
        growth = np.round(_area(grown) - area, 9)
        growth[none] = area[none] = np.inf
        rows = np.arange(len(x))
        best = np.where(growth == growth.min(1, keepdims=True), area, np.inf).argmin(1)
        if leaf_parents:
            # A box that holds the point overlaps the others no more than before: nothing is better.
            rest = np.flatnonzero(~_inside([v[rows, best] for v in own], x, y))
            others = [v[rest][:, None, :] for v in own]
            more = _meet([v[rest][:, :, None] for v in grown], others) - _meet([v[rest][:, :, None] for v in own], others)
            more[:, each, each] = 0
            more[np.broadcast_to(none[rest][:, None, :], more.shape)] = 0
            more = np.round(more.sum(2), 9)
            more[none[rest]] = np.inf
            least = np.where(more == more.min(1, keepdims=True), growth[rest], np.inf)
            best[rest] = np.where(least == least.min(1, keepdims=True), area[rest], np.inf).argmin(1)
        return at[rows, best], growth[rows, best]


def _dealt(points: DataFrame) -> DataFrame:
    """Few bytes, much work: a file of few row groups goes to all cores too."""
    spark = points.sparkSession
    return points.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")


def choose_subtree(spark: SparkSession, points: DataFrame, boxes: DataFrame, leaf_parents: bool = True) -> DataFrame:
    """id, x, y, node_id, growth: for each point (id, x, y) the entry (node_id of boxes) that it would go to, of any number.

    If points and boxes have a parent_id, of the entries of that node; points whose node has no entry go. Among parents of leaves:
    least growth of the overlap with the node's other boxes, then of the area, then least area, then node_id; else without the first.
    """
    nodes = "parent_id" in boxes.columns
    held = boxes.select((F.col("parent_id") if nodes else F.lit(0)).cast("long").alias("parent_id"), F.col("node_id").cast("long"), "xmin", "ymin", "xmax", "ymax").where("parent_id is not null")
    asked = points.select("id", "x", "y", (F.col("parent_id") if nodes else F.lit(0)).cast("long").alias("parent_id"))
    kind = points.schema["id"].dataType.simpleString()
    schema = f"id {kind}, x double, y double, node_id long, growth double"

    def chosen(entries: Entries, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["parent_id"].notna()]
        known, ids, growth = entries.best(pdf["parent_id"].to_numpy(np.int64), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), leaf_parents)
        return pdf[["id", "x", "y"]].iloc[known].assign(node_id=ids, growth=growth)

    if held.limit(MAX_BOXES + 1).count() <= MAX_BOXES:
        known = spark.sparkContext.broadcast(held.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            entries = Entries(known.value)
            for pdf in batches:
                yield chosen(entries, pdf)

        return _dealt(asked).mapInPandas(run, schema)

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return chosen(Entries(right), left)

    salted = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    each = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.groupBy("parent_id", "salt").cogroup(each.groupBy("parent_id", "salt")).applyInPandas(both, schema)


def descend(spark: SparkSession, points: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """id, x, y, leaf_id: for each point the leaf that it would go to, from the root down; in one pass if all tasks can hold the nodes, else a level at a time. nodes: tree_nodes()."""
    deepest = nodes.agg(F.max("level").alias("d")).first()["d"] or 0
    at = points.select("id", "x", "y", F.lit(0).cast("long").alias("parent_id"))
    if nodes.limit(MAX_BOXES + 1).count() <= MAX_BOXES:
        known = spark.sparkContext.broadcast(nodes.where("level > 0").select("level", "parent_id", "node_id", "xmin", "ymin", "xmax", "ymax").toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            levels = [Entries(known.value[known.value["level"] == level]) for level in range(1, deepest + 1)]
            for pdf in batches:
                for level, entries in enumerate(levels, 1):
                    found, ids, _ = entries.best(pdf["parent_id"].to_numpy(np.int64), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), level == deepest)
                    pdf = pdf.iloc[found].assign(parent_id=ids)
                yield pdf.rename(columns={"parent_id": "leaf_id"})

        return _dealt(at).mapInPandas(run, f"id {points.schema['id'].dataType.simpleString()}, x double, y double, leaf_id long")
    for level in range(1, deepest + 1):
        entries = nodes.where(F.col("level") == level).select("parent_id", "node_id", "xmin", "ymin", "xmax", "ymax")
        new = scratch.keep(choose_subtree(spark, at, entries, level == deepest))
        at = new.select("id", "x", "y", F.col("node_id").alias("parent_id"))
    return at.withColumnRenamed("parent_id", "leaf_id")


# Splits


def _cuts(entries: DataFrame, sorts: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Every legal cut: node_id, axis, sort, cut (entries of the first part), margin, overlap, area, and the parts' boxes. entries: node_id, id, r."""
    out = None
    for name, (axis, order) in sorts.items():
        own = Window.partitionBy("node_id").orderBy(*order)
        head, tail = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1, Window.unboundedFollowing)
        bounds = lambda w: box(F.min("r.xmin").over(w), F.min("r.ymin").over(w), F.max("r.xmax").over(w), F.max("r.ymax").over(w))
        rows = entries.select("node_id", F.lit(axis).alias("axis"), F.lit(name).alias("sort"), F.row_number().over(own).cast("long").alias("cut"), F.count("*").over(Window.partitionBy("node_id")).alias("n"), bounds(head).alias("a"), bounds(tail).alias("b"))
        out = rows if out is None else out.union(rows)
    least = F.floor((F.col("n") - 1) * MIN_FILL)
    legal = out.where((F.col("cut") >= least) & (F.col("cut") <= F.col("n") - least) & (F.col("cut") < F.col("n")))
    a, b = F.col("a"), F.col("b")
    return legal.select("node_id", "axis", "sort", "cut", (rect_margin(a) + rect_margin(b)).alias("margin"), rect_intersection_area(a, b).alias("overlap"), (rect_area(a) + rect_area(b)).alias("area"), "a", "b")


POINT_SORTS = {"x": ("x", ["r.xmin", "r.ymin", "id"]), "y": ("y", ["r.ymin", "r.xmin", "id"])}
BOX_SORTS = {
    "x lower": ("x", ["r.xmin", "r.xmax", "id"]),
    "x upper": ("x", ["r.xmax", "r.xmin", "id"]),
    "y lower": ("y", ["r.ymin", "r.ymax", "id"]),
    "y upper": ("y", ["r.ymax", "r.ymin", "id"]),
}


def split_axis(entries: DataFrame, sorts: dict = POINT_SORTS) -> DataFrame:
    """node_id, axis, margin: the axis with the least sum of margins over all legal cuts."""
    sums = _cuts(entries, sorts).groupBy("node_id", "axis").agg(F.round(F.sum("margin"), 4).alias("margin"))
    return sums.groupBy("node_id").agg(F.min(F.struct("margin", "axis")).alias("m")).select("node_id", F.col("m.axis").alias("axis"), F.col("m.margin").alias("margin"))


def split(entries: DataFrame, sorts: dict = POINT_SORTS) -> DataFrame:
    """node_id, axis, sort, cut, overlap, area: on the split axis the cut of least overlap, then least area, then the first. All overfull nodes split at once."""
    cuts = _cuts(entries, sorts)
    axis = split_axis(entries, sorts).select(F.col("node_id").alias("of"), F.col("axis").alias("on"))
    rank = F.struct(F.round("overlap", 6).alias("overlap"), F.round("area", 6).alias("area"), "sort", "cut", "axis")
    best = cuts.join(axis, (F.col("node_id") == F.col("of")) & (F.col("axis") == F.col("on"))).groupBy("node_id").agg(F.min(rank).alias("m"))
    return best.select("node_id", *(F.col(f"m.{c}").alias(c) for c in ("axis", "sort", "cut", "overlap", "area")))


def reinsert_candidates(leaves: DataFrame) -> DataFrame:
    """leaf_id, id, dist: of each leaf the part of its points that is farthest from its box's centre, ties by id."""
    node = Window.partitionBy("leaf_id")
    cx, cy = (F.min("x").over(node) + F.max("x").over(node)) / 2, (F.min("y").over(node) + F.max("y").over(node)) / 2
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    far = leaves.withColumns({"cx": cx, "cy": cy, "n": F.count("*").over(node)}).withColumn("dist", F.sqrt(dx * dx + dy * dy))
    place = F.row_number().over(node.orderBy(F.desc("dist"), "id"))
    return far.withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * REINSERT)).select("leaf_id", "id", "dist")
