"""A clustered layout: Parquet files that each hold a stretch of the Hilbert curve, with a small table of their boxes.

The files of a layout never change. An insert adds files, a delete adds the id to a list that every reader takes off, and
compact() writes a new layout. The table of boxes names the files of a layout: an insert writes its points first, where no reader
looks, and then one file of boxes, which appears at once. What a failed insert leaves is never read, and the insert can be run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import as_box, box, mbr, point_rect_mindist, rect_intersects
from ..operators.search import checked_box, checked_place, knn_query, range_query, skyline_query
from ..operators.tree import hilbert_order
from ..sources.points import DIMENSIONS, checked_dimensions, finite
from .scratch import broadcast_if

#: Deleted ids that are told to all tasks; more are joined by shuffle. File names that a query fetches.
MAX_TOLD, MAX_FILES = 1_000_000, 10_000


def _describe(spark: SparkSession, files: str, part: str) -> DataFrame:
    """A row for each file: its box, rows, the point with the least sum of coordinates, and the folder that it is in."""
    rows = spark.read.parquet(files).select("x", "y", F.col("_metadata.file_path").alias("file"))
    best = F.min(F.struct((F.col("x") + F.col("y")).alias("s"), "x", "y"))
    found = rows.groupBy("file").agg(F.count("*").alias("rows"), *mbr(F.col("x"), F.col("y")), best.alias("best"))
    return found.select("file", "rows", "xmin", "ymin", "xmax", "ymax", F.col("best.x").alias("best_x"), F.col("best.y").alias("best_y"), F.lit(part).alias("part")).coalesce(1)


class Layout:
    """A layout at a path: points (id, x, y, more), boxes, deletes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, points: DataFrame, path: str, files: int, dimensions: int = DIMENSIONS) -> Layout:
        """dimensions: of the places; the curve has two, fewer are no place."""
        if checked_dimensions(dimensions) != DIMENSIONS:
            raise ValueError("a layout has two dimensions; tables of vectors have any number")
        spark = points.sparkSession
        dealt = hilbert_order(points).repartitionByRange(files, "hilbert_key", "id").sortWithinPartitions("hilbert_key", "id")
        dealt.write.parquet(f"{path}/points/base")
        _describe(spark, f"{path}/points/base", "base").write.parquet(f"{path}/boxes/base")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def boxes(self) -> DataFrame:
        return self._table("boxes")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def deletes(self) -> DataFrame | None:
        return self._table("deletes") if self._exists("deletes") else None

    def _visible(self, rows: DataFrame) -> DataFrame:
        gone = self.deletes()
        return rows if gone is None else rows.join(broadcast_if(gone, MAX_TOLD), "id", "left_anti")

    def points(self) -> DataFrame:
        """All visible points; folders are a row for each insert since the last compaction."""
        folders = sorted(r["part"] for r in self.boxes().select("part").distinct().collect())
        schema = self._schema()
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/points/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return self._visible(found)

    def _schema(self) -> StructType:
        return self.spark.read.parquet(f"{self.path}/points/base").schema

    def _of(self, boxes: DataFrame) -> DataFrame:
        """Points of these files. Up to a number of names are fetched, and the files are read; beyond, the whole layout is: callers test each point themselves."""
        files = [r["file"] for r in boxes.select("file").limit(MAX_FILES + 1).collect()]
        if not files:
            return self.points().limit(0)
        if len(files) > MAX_FILES:
            return self.points()
        return self._visible(self.spark.read.schema(self._schema()).parquet(*files))

    # Queries

    def range(self, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        checked_box([x0, y0], [x1, y1])
        q = box(*(F.lit(float(v)) for v in (x0, y0, x1, y1)))
        return range_query(self._of(self.boxes().where(rect_intersects(as_box(), q))), x0, y0, x1, y1)

    def knn(self, k: int, qx: float, qy: float, key: list[str]) -> DataFrame:
        """Two steps: the nearest files that hold k points bound the distance; a box of that size, widened against rounding, holds the result."""
        checked_place(qx, qy)
        near = self.boxes().withColumn("near", point_rect_mindist(F.lit(float(qx)), F.lit(float(qy)), as_box())).orderBy("near", "file")
        n, files = near.count(), 1
        while True:
            some = knn_query(self._of(near.limit(files)), k, qx, qy, key).agg(F.count("*").alias("n"), F.max("dist").alias("r")).first()
            if some["n"] >= k:
                break
            if files >= n:
                return knn_query(self.points(), k, qx, qy, key)
            files = min(n, files * 2)
        pad = [some["r"] * (1 + 1e-9) + 1e-12 * max(1.0, abs(q)) for q in (qx, qy)]
        return knn_query(self.range(qx - pad[0], qy - pad[1], qx + pad[0], qy + pad[1]), k, qx, qy, key)

    def skyline(self) -> DataFrame:
        """Files whose box lies beyond some file's best point hold nothing of the skyline and aren't read (only if nothing is deleted, as the point may be gone)."""
        boxes = self.boxes()
        if self.deletes() is None:
            best = skyline_query(boxes.select(F.col("best_x").alias("x"), F.col("best_y").alias("y"))).distinct()
            beyond = (F.col("x") <= F.col("xmin")) & (F.col("y") <= F.col("ymin")) & ((F.col("x") < F.col("xmin")) | (F.col("y") < F.col("ymin")))
            boxes = boxes.join(best, beyond, "left_anti")
        return skyline_query(self._of(boxes))

    # Updates

    def insert(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds points (id, x, y and the other columns of the layout); rows without a finite place are left out. A batch of a name is added once, however often it is run."""
        part = f"added-{uuid.uuid4().hex}" if batch is None else f"batch-{batch}"
        if batch is not None and self._exists(f"boxes/{part}/_SUCCESS"):
            return
        have = self._schema()
        filled = rows.withColumns({c: F.lit(None).cast(have[c].dataType) for c in have.names if c not in rows.columns})
        placed = filled.where(finite(F.col("x")) & finite(F.col("y")))
        placed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in have)).write.mode("overwrite").parquet(f"{self.path}/points/{part}")
        _describe(self.spark, f"{self.path}/points/{part}", part).write.mode("overwrite").parquet(f"{self.path}/boxes/{part}")

    def delete_point(self, x: float, y: float) -> bool:
        """Deletes the point of the smallest id at exactly this place; whether there was one."""
        found = self.range(x, y, x, y).agg(F.min("id").alias("id")).first()["id"]
        if found is None:
            return False
        self.spark.createDataFrame([(found,)], "id long").write.mode("append").parquet(f"{self.path}/deletes")
        return True

    def compact(self, path: str, files: int) -> Layout:
        """A new layout of what is visible."""
        return Layout.write(self.points().drop("hilbert_key"), path, files)
