"""Point views: x, y as doubles and the key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 2


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def points(df: DataFrame, x: str, y: str, key: str | list[str], *more: str) -> DataFrame:
    """The key columns (one alone is named id), x, y and more columns. Rows with a null, NaN or infinite coordinate are left out: no query can place them."""
    keys = [F.col(key).alias("id")] if isinstance(key, str) else [F.col(k) for k in key]
    out = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *more)
    return out.where(finite(F.col("x")) & finite(F.col("y")))


def vectors(df: DataFrame, values: str, key: str, dimensions: int | None = None) -> DataFrame:
    """id and coords (array of doubles), for any number of dimensions from 2 on; if it is told, vectors of another length are left out."""
    size = F.size("coords") >= DIMENSIONS if dimensions is None else F.size("coords") == checked_dimensions(dimensions)
    out = df.select(F.col(key).alias("id"), F.col(values).cast("array<double>").alias("coords"))
    return out.where(size & F.forall("coords", finite))


def checked_dimensions(d: int) -> int:
    if d < 2:
        raise ValueError("points need two dimensions at least")
    return d


def record(df: DataFrame, key: int) -> DataFrame:
    """The point of a key."""
    return df.where(F.col("id") == F.lit(key))
