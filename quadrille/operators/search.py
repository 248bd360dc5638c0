"""Range, nearest-neighbour and skyline queries. Each has an exhaustive twin that uses no clustering or pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box, distance, dominates, rect_contains, vector_distance, vector_in_box
from ..plans.scratch import Scratch


def checked_box(lo: list[float], hi: list[float]) -> None:
    if any(not math.isfinite(v) for v in [*lo, *hi]):
        raise ValueError("a box needs finite bounds")
    if any(a > b for a, b in zip(lo, hi)):
        raise ValueError("a box's lower bound is above its upper bound")


def range_query(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in the closed box. The bounds reach the scan, which skips row groups by their statistics."""
    checked_box([x0, y0], [x1, y1])
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def range_query_linear(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The same points by a test of every row, which the scan can't use."""
    checked_box([x0, y0], [x1, y1])
    q = box(*(F.lit(float(v)) for v in (x0, y0, x1, y1)))
    return points.where(rect_contains(q, F.col("x") + F.lit(0.0), F.col("y") + F.lit(0.0)))


def range_query_vectors(vectors: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """Vectors in the closed box of as many dimensions as lo has; further dimensions are free."""
    checked_box(lo, hi)
    as_array = lambda v: F.array(*(F.lit(float(a)) for a in v))
    return vectors.where((F.size("coords") >= len(lo)) & vector_in_box(F.slice("coords", 1, len(lo)), as_array(lo), as_array(hi)))


def range_count(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return range_query(points, x0, y0, x1, y1).agg(F.count("*").alias("n"))


def point_lookup(points: DataFrame, x: float, y: float) -> DataFrame:
    """Points at exactly this place."""
    return points.where((F.col("x") == F.lit(float(x))) & (F.col("y") == F.lit(float(y))))


def _checked_k(k: int) -> int:
    if k < 1:
        raise ValueError("k is 1 at least")
    return k


def checked_place(*coordinates: float) -> None:
    if any(not math.isfinite(v) for v in coordinates):
        raise ValueError("a point needs finite coordinates")


def knn_query(points: DataFrame, k: int, qx: float, qy: float, key: list[str], include_coincident: bool = False) -> DataFrame:
    """The k nearest points by (dist, key); points at distance 0 don't count unless asked for. Tasks keep k rows each."""
    checked_place(qx, qy)
    found = points.withColumn("dist", distance(F.col("x"), F.col("y"), F.lit(float(qx)), F.lit(float(qy))))
    if not include_coincident:
        found = found.where("dist > 0")
    return found.orderBy("dist", *key).limit(_checked_k(k))


def knn_query_linear(points: DataFrame, k: int, qx: float, qy: float, key: list[str]) -> DataFrame:
    """The same rows from a rank of all distances of each row hash, merged: no top-k operator takes part until the last few rows."""
    checked_place(qx, qy)
    found = points.withColumn("dist", distance(F.col("x"), F.col("y"), F.lit(float(qx)), F.lit(float(qy)))).where("dist > 0")
    lot = found.withColumn("lot", F.pmod(F.xxhash64(*key, "x", "y"), F.lit(64)))
    some = lot.withColumn("r", F.row_number().over(Window.partitionBy("lot").orderBy("dist", *key))).where(F.col("r") <= _checked_k(k))
    return some.withColumn("r", F.row_number().over(Window.orderBy("dist", *key))).where(F.col("r") <= k).drop("r", "lot")


def knn_vectors(vectors: DataFrame, k: int, query: list[float], include_coincident: bool = False) -> DataFrame:
    checked_place(*query)
    found = vectors.withColumn("dist", vector_distance(F.col("coords"), F.array(*(F.lit(float(v)) for v in query))))
    if not include_coincident:
        found = found.where("dist > 0")
    return found.orderBy("dist", "id").limit(_checked_k(k))


# Skylines: least values in all dimensions


def skyline_query(points: DataFrame) -> DataFrame:
    """Points that no other dominates; all of those at one place.

    Points are first reduced within each task. What is left is dealt by ranges of x; a table of the least y of each range, a row for
    a partition, tells each range what came before it.
    """
    scratch = Scratch(points.sparkSession, "skyline")
    near = scratch.keep(local_skyline(points, ["x", "y"]))
    least = near.groupBy("x").agg(F.min("y").alias("y"))
    held = scratch.keep(least.repartitionByRange("x").withColumn("range", F.spark_partition_id()))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.groupBy("range").agg(F.min("y").alias("y")).select("range", F.min("y").over(until(Window.orderBy("range"))).alias("ahead"))
    own = F.min("y").over(until(Window.partitionBy("range").orderBy("x")))
    rows = held.join(F.broadcast(ahead), "range").withColumn("before", F.least("ahead", own))  # a row for each range; least() skips nulls
    best = rows.where("before is null or y < before").select(F.col("x").alias("bx"), F.col("y").alias("by"))
    return near.join(best, (F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")), "left_semi")


def skyline_ordered(points: DataFrame, key: str = "id") -> DataFrame:
    """The skyline by falling x, then by key."""
    return skyline_query(points).orderBy(F.desc("x"), key)


def skyline_distinct(points: DataFrame, key: str = "id") -> DataFrame:
    """The point of the smallest key at each place of the skyline."""
    return skyline_query(points).groupBy("x", "y").agg(F.min(key).alias(key)).select(key, "x", "y")


def skyline_antijoin(points: DataFrame) -> DataFrame:
    """The same by comparing pairs: a check for small inputs."""
    other = points.select(F.col("x").alias("ox"), F.col("y").alias("oy"))
    return points.join(other, dominates(F.col("ox"), F.col("oy"), F.col("x"), F.col("y")), "left_anti")


def _undominated(v: np.ndarray, step: int = 256) -> np.ndarray:
    """Places of rows that no row dominates, of distinct or equal rows."""
    if v.shape[1] == 2:
        order = np.lexsort([v[:, 1], v[:, 0]])
        x, y = v[order].T
        first = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)  # of each x, the least y
        size = np.diff(np.append(first, len(x)))
        before = np.append(np.inf, np.minimum.accumulate(y[first])[:-1])
        return order[(y == np.repeat(y[first], size)) & (y < np.repeat(before, size))]
    # Only a row with a smaller sum can dominate; rounding can make sums equal, so the order goes on by the values.
    order = np.lexsort([*v.T[::-1], v.sum(1)])
    kept = v[:0]
    out: list[np.ndarray] = []
    for begin in range(0, len(order), step):
        at = order[begin : begin + step]
        at = at[~dominated(v[at], kept)]
        at = at[~dominated(v[at], v[at])]
        kept = np.concatenate([kept, v[at]])
        out.append(at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def dominated(v: np.ndarray, by: np.ndarray, step: int = 512) -> np.ndarray:
    """Whether each row of v is dominated by one of by."""
    out = np.zeros(len(v), bool)
    for begin in range(0, len(by), step):
        open_ = np.flatnonzero(~out)
        if not len(open_):
            break
        some, own = by[begin : begin + step], v[open_]
        below, less = np.ones((len(own), len(some)), bool), np.zeros((len(own), len(some)), bool)
        for d in range(v.shape[1]):  # an axis at a time keeps the table small
            below &= some[:, d] <= own[:, d, None]
            less |= some[:, d] < own[:, d, None]
        out[open_] = (below & less).any(1)
    return out


def local_skyline(df: DataFrame, columns: list[str], step: int = 50_000) -> DataFrame:
    """Rows that no row of the same task dominates, in these columns (doubles or one array of doubles); a task holds its skyline and a batch."""

    def values(t: pa.Table) -> np.ndarray:
        if len(columns) == 1:
            return np.array(t.column(columns[0]).to_pylist(), float).reshape(t.num_rows, -1)
        return np.stack([t.column(c).to_numpy() for c in columns], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                some = pa.Table.from_batches([batch.slice(begin, step)])
                both = some if held is None else pa.concat_tables([held, some])
                v = values(both)
                # Dominance among few rows first discards most others at once.
                few = v[np.argsort(v.sum(1), kind="stable")[:32]]
                open_ = np.ones(len(v), bool)
                for f in few:
                    open_ &= ~((f <= v).all(1) & (f < v).any(1))
                at = np.flatnonzero(open_)
                held = both.take(pa.array(at[_undominated(v[at])])).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return df.mapInArrow(run, df.schema)


#: Candidates that all tasks hold at a time.
MAX_CANDIDATES = 50_000


def skyline_vectors(vectors: DataFrame) -> DataFrame:
    """The skyline in any number of dimensions, the same for all vectors: within tasks, then what they leave is held against all of what they leave, a bounded part at a time."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "skyline")
    found = scratch.keep(local_skyline(vectors, ["coords"]))
    parts = -(-found.count() // MAX_CANDIDATES)
    dealt = scratch.keep(found.withColumn("part", F.pmod(F.xxhash64("coords"), F.lit(max(1, parts))))) if parts > 1 else found
    for part in range(parts):
        some = (dealt.where(F.col("part") == part) if parts > 1 else dealt).select("coords").distinct()
        known = spark.sparkContext.broadcast(np.array([r["coords"] for r in some.collect()], float))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            by = known.value[np.argsort(known.value.sum(1), kind="stable")]
            for batch in batches:
                if batch.num_rows:
                    v = np.array(batch.column("coords").to_pylist(), float)
                    yield batch.filter(pa.array(~dominated(v, by)))

        found = found.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, found.schema) if part == 0 else found.mapInArrow(run, found.schema)
    return found
