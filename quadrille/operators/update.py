"""Inserts and deletes on plain DataFrames; layouts have their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import checked_place


def insert_record(points: DataFrame, key: int, x: float, y: float, node_id: int | None = None, name: str | None = None) -> DataFrame:
    """points and one more, with a node id above 0 and a name if there are any; a key or place may be there already."""
    checked_place(x, y)
    if node_id is not None and node_id <= 0:
        raise ValueError("a node id is above 0")
    more = {"node_id": (node_id, "long"), "name": (name, "string")}
    more = {c: v for c, v in more.items() if v[0] is not None}
    row = points.sparkSession.createDataFrame([(key, float(x), float(y), *(v for v, _ in more.values()))], ", ".join(["id long, x double, y double", *(f"{c} {t}" for c, (_, t) in more.items())]))
    return points.unionByName(row, allowMissingColumns=True)


def delete_point(points: DataFrame, x: float, y: float) -> DataFrame:
    """points without the one of the smallest id at exactly this place, if there is one."""
    gone = points.where((F.col("x") == F.lit(float(x))) & (F.col("y") == F.lit(float(y)))).agg(F.min("id").alias("id"))
    return points.join(F.broadcast(gone), "id", "left_anti")  # one row
