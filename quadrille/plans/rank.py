"""Global ranks without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch


def ranked(df: DataFrame, order: list[str], scratch: Scratch, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with the place of each row, from 0, in the order of columns that are unique together.

    Rows are dealt by ranges of the order and written with the number of their range; a count for each range gives where it
    starts, and rows are numbered within their range. The counts are one row for each range.
    """
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    held = scratch.keep(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_range").orderBy(*order)
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.row_number().over(own) - 1).drop("_range", "_start")
