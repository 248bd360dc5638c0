"""OpenStreetMap XML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .points import finite

SCHEMA = "_id LONG, _lat DOUBLE, _lon DOUBLE, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"


def osm_scan(spark: SparkSession, path: str) -> DataFrame:
    """Nodes as node_id, x (latitude), y (longitude), name (of the first `name:en` tag, null if there is none or it's empty). Ways and relations aren't read."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema(SCHEMA).load(path)
    name = F.get(F.filter("tag", lambda t: t["_k"] == "name:en"), F.lit(0))["_v"]
    found = nodes.select(F.col("_id").alias("node_id"), F.col("_lat").alias("x"), F.col("_lon").alias("y"), F.when(name != "", name).alias("name"))
    return found.where(finite(F.col("x")) & finite(F.col("y")))


def write_osm(df: DataFrame, path: str) -> None:
    """Rows (node_id, x, y, name or null) as XML, a document for each partition."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": ["<osm>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</osm>"]})

    def quoted(c: str) -> str:
        return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"

    tag = F.when(F.col("name").isNotNull(), F.concat(F.lit('<tag k="name:en" v="'), F.expr(quoted("name")), F.lit('"/>'))).otherwise("")
    df.select(F.concat(F.lit('<node id="'), "node_id", F.lit('" lat="'), "x", F.lit('" lon="'), "y", F.lit('">'), tag, F.lit("</node>")).alias("value")).mapInArrow(document, "value string").write.text(path)
