"""The registered queries of the library's own operators, over point views of the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import oracle
from .functions import geometry as g
from .operators import search, tree, update
from .plans.layout import Layout
from .plans.rank import ranked
from .plans.scratch import Scratch
from .sources import blocks, osm
from .sources.points import points, record, vectors

LINE_KEY = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
VECTOR = 64
BOX, QUERY, K = (10.0, 20000.0, 20.0, 40000.0), (25.0, 30000.0), 10
#: Small nodes, so that small tables make trees of several levels.
LEAF, INNER = 24, 5
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    FOUND[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark, d):
    return points(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", LINE_KEY)


def parts(spark, d):
    return points(read(spark, d, "part"), "p_size", "p_retailprice", "p_partkey")


def events(spark, d, *more):
    return points(read(spark, d, "events"), "user_id", "value", "event_id", *more)


def customers(spark, d):
    return points(read(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_custkey")


def embeddings(spark, d):
    return vectors(read(spark, d, "embeddings"), "embedding", "vec_id", VECTOR)


def type_boxes(spark, d):
    """The box of each event type."""
    return events(spark, d, "event_type").groupBy("event_type").agg(F.count("*").alias("n"), *g.mbr(F.col("x"), F.col("y")))


def neighbours(spark, d):
    """Each event type's box a with that of the next type b, in order of names."""
    own = Window.orderBy("event_type")  # a row for each type
    rows = type_boxes(spark, d).select("event_type", g.as_box().alias("a"))
    return rows.withColumn("b", F.lead("a").over(own)).where("b is not null")


def layout(spark, d, name="layout", files=8):
    return Layout.write(events(spark, d), Scratch(spark, name).path(), files)


# Scans


@query
def scan_points(spark, d):
    return parts(spark, d)


@query
def record_lookup(spark, d):
    return record(parts(spark, d), 17)


@query
def record_location(spark, d):
    block, slot = blocks.unnamed_location(F.col("id"))
    return parts(spark, d).select("id", block.alias("block"), slot.alias("slot"))


@query
def osm_scan(spark, d):
    """Suppliers, written as XML nodes and read back."""
    path = Scratch(spark, "osm").path()
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").cast("double").alias("y"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"))
    osm.write_osm(rows, path)
    return osm.osm_scan(spark, path)


@query
def reuse_layout(spark, d):
    """A layout that is opened again by its path."""
    return Layout(spark, layout(spark, d).path).points().select("id", "x", "y")


# Ranges


@query
def range_query(spark, d):
    return search.range_query(lines(spark, d), *BOX)


@query
def range_query_linear(spark, d):
    return search.range_query_linear(lines(spark, d), *BOX)


@query
def range_count(spark, d):
    return search.range_count(lines(spark, d), *BOX)


@query
def range_query_negative(spark, d):
    return search.range_query(customers(spark, d), 2.0, -900.0, 12.0, 1500.0)


@query
def range_query_vectors(spark, d):
    return search.range_query_vectors(embeddings(spark, d), [-0.3] * VECTOR, [0.3] * VECTOR).select("id")


@query
def range_clustered(spark, d):
    return layout(spark, d).range(20.0, 5.0, 60.0, 50.0).select("id", "x", "y")


@query
def point_lookup(spark, d):
    return search.point_lookup(parts(spark, d), 11.0, 900.0)


# Nearest neighbours


@query
def knn_query(spark, d):
    return search.knn_query(lines(spark, d), K, *QUERY, LINE_KEY)


@query
def knn_query_linear(spark, d):
    return search.knn_query_linear(lines(spark, d), K, *QUERY, LINE_KEY)


@query
def knn_pruned(spark, d):
    return layout(spark, d).knn(K, 75.0, 60.0, ["id"]).select("id", "x", "y", "dist")


@query
def knn_vector(spark, d):
    v = embeddings(spark, d)
    first = record(v, 0).select("coords").first()["coords"]
    return search.knn_vectors(v, K, first).select("id", F.round("dist", 6).alias("dist"))


# Skylines


@query
def skyline_query(spark, d):
    return search.skyline_query(parts(spark, d))


@query
def skyline_events(spark, d):
    return search.skyline_query(events(spark, d))


@query
def skyline_distinct(spark, d):
    return search.skyline_distinct(parts(spark, d))


@query
def skyline_ordered(spark, d):
    """With the place in the order."""
    return ranked(search.skyline_query(parts(spark, d)).withColumn("down", -F.col("x")), ["down", "id"], Scratch(spark, "skyline-order")).drop("down")


@query
def skyline_pruned(spark, d):
    return layout(spark, d).skyline().select("id", "x", "y")


@query
def skyline_vectors(spark, d):
    return search.skyline_vectors(embeddings(spark, d)).select("id")


@query
def skyline_space(spark, d):
    """In three dimensions: size and price of parts, and a number made of their key."""
    rows = read(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice", (F.col("p_partkey") * 7919 % 1009).cast("double")).alias("place"))
    return search.skyline_vectors(vectors(rows, "place", "p_partkey", 3)).select("id")


# Kernels


@query
def mbr_points(spark, d):
    return type_boxes(spark, d)


@query
def mbr_rects(spark, d):
    return type_boxes(spark, d).agg(*g.mbr_of(g.as_box()))


@query
def rect_area(spark, d):
    return type_boxes(spark, d).select("event_type", g.rect_area(g.as_box()).alias("area"))


@query
def rect_margin(spark, d):
    return type_boxes(spark, d).select("event_type", g.rect_margin(g.as_box()).alias("margin"))


def _pair_kernel(name: str, kernel) -> None:
    def run(spark, d):
        return neighbours(spark, d).select("event_type", kernel(F.col("a"), F.col("b")).alias("v"))

    FOUND[name] = run


for _name in ("rect_intersects", "rect_intersection_area", "rect_union_area", "rect_enlargement"):
    _pair_kernel(_name, getattr(g, _name))


@query
def mbr_enlarge(spark, d):
    return neighbours(spark, d).select("event_type", g.mbr_enlarge(F.col("a"), F.col("b")).alias("r")).select("event_type", "r.*")


@query
def point_rect_mindist(spark, d):
    return type_boxes(spark, d).select("event_type", g.point_rect_mindist(F.lit(200.0), F.lit(-10.0), g.as_box()).alias("mindist"))


# Order and trees


@query
def sort_points(spark, d):
    """Points with their place by x, then y, then key."""
    return ranked(parts(spark, d), ["x", "y", "id"], Scratch(spark, "sort"))


@query
def sort_rects(spark, d):
    """Boxes of users with their places by both bounds of both axes."""
    rows = events(spark, d).groupBy(F.col("x").cast("long").alias("id")).agg(*g.mbr(F.col("x"), F.col("y")))
    return tree.rect_order(rows, Scratch(spark, "rects"), "id").select("id", "x_lower", "x_upper", "y_lower", "y_upper")


@query
def hilbert_sort(spark, d):
    return ranked(tree.hilbert_order(parts(spark, d)), ["hilbert_key", "id"], Scratch(spark, "hilbert")).select("id", "hilbert_key", "rank")


def _leaves(spark, d):
    scratch = Scratch(spark, "tree")
    return tree.bulk_load_leaves(parts(spark, d), LEAF, scratch), scratch


@query
def bulk_load_leaves(spark, d):
    rows, _ = _leaves(spark, d)
    return rows.groupBy("leaf_id").agg(F.count("*").alias("entries"), *g.mbr(F.col("x"), F.col("y")))


@query
def tree_leaf_records(spark, d):
    rows, _ = _leaves(spark, d)
    return rows.select("leaf_id", "id", "x", "y")


@query
def tree_nodes(spark, d):
    rows, scratch = _leaves(spark, d)
    return tree.tree_nodes(rows, INNER, scratch)


@query
def bulk_load_levels(spark, d):
    """Nodes and entries of each level."""
    rows, scratch = _leaves(spark, d)
    return tree.tree_nodes(rows, INNER, scratch).groupBy("level").agg(F.count("*").alias("nodes"), F.sum("entries").alias("entries"))


@query
def tree_dump(spark, d):
    rows, scratch = _leaves(spark, d)
    rows = scratch.keep(rows)
    return tree.tree_dump(tree.tree_nodes(rows, INNER, scratch), rows)


@query
def tree_height(spark, d):
    """Levels above the leaves, by the sizes of a block."""
    n = read(spark, d, "events").count()
    found = [(b, tree.leaf_capacity(b), tree.inner_capacity(b), tree.tree_height(n, tree.leaf_capacity(b), tree.inner_capacity(b))) for b in (512, 4096, tree.BLOCK)]
    return spark.createDataFrame(found, "block_bytes long, leaf long, inner_ long, height long")


def _user_boxes(spark, d):
    """Boxes of groups of ten users."""
    return events(spark, d).groupBy(F.floor(F.col("x") / 10).alias("node_id")).agg(*g.mbr(F.col("x"), F.col("y")))


def _shifted(spark, d):
    """Points between the boxes and beyond them."""
    return events(spark, d).select("id", (F.col("x") + 4.75).alias("x"), (F.col("y") * 1.25 - 30.0).alias("y"))


@query
def choose_subtree(spark, d):
    return tree.choose_subtree(spark, _shifted(spark, d), _user_boxes(spark, d)).select("id", "node_id", F.round("growth", 7).alias("growth"))


@query
def choose_subtree_inner(spark, d):
    return tree.choose_subtree(spark, _shifted(spark, d), _user_boxes(spark, d), False).select("id", "node_id", F.round("growth", 7).alias("growth"))


@query
def choose_leaf(spark, d):
    """The leaf for each point, from the root down."""
    rows, scratch = _leaves(spark, d)
    nodes = scratch.keep(tree.tree_nodes(scratch.keep(rows), INNER, scratch))
    moved = parts(spark, d).select("id", (F.col("x") * 1.125 - 2.0).alias("x"), (F.col("y") * 1.0625 - 60.0).alias("y"))
    return tree.descend(spark, moved, nodes, scratch).select("id", "leaf_id")


def _overfull(spark, d):
    """Points as entries of nodes: groups of ten users."""
    return events(spark, d).select(F.floor(F.col("x") / 10).alias("node_id"), "id", g.point_box(F.col("x"), F.col("y")).alias("r"))


def _overfull_inner(spark, d):
    """Boxes of users as entries of nodes: groups of thirty users."""
    return events(spark, d).groupBy(F.col("x").cast("long").alias("id")).agg(*g.mbr(F.col("x"), F.col("y"))).select(F.floor(F.col("id") / 30).alias("node_id"), "id", g.as_box().alias("r"))


@query
def split_axis(spark, d):
    return tree.split_axis(_overfull(spark, d)).withColumn("margin", F.round("margin", 2))


@query
def split_leaf(spark, d):
    return tree.split(_overfull(spark, d))


@query
def split_inner(spark, d):
    return tree.split(_overfull_inner(spark, d), tree.BOX_SORTS)


@query
def reinsert_candidates(spark, d):
    rows, _ = _leaves(spark, d)
    return tree.reinsert_candidates(rows).withColumn("dist", F.round("dist", 6))


# Updates


@query
def insert_record(spark, d):
    return update.insert_record(parts(spark, d), 10_000_000, 3.5, 950.25)


@query
def insert_named_record(spark, d):
    """A supplier with a node id and a name."""
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").cast("double").alias("y"), (F.col("s_suppkey") + 1).alias("node_id"), F.col("s_name").alias("name"))
    return update.insert_record(rows, 10_000_000, 3.5, 950.25, 77, "new")


@query
def block_slots(spark, d):
    """Named records written to a file of blocks and read back with their addresses, by the file's folder in the shared one."""
    rows = read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("node_id"), F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").cast("double").alias("y"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"))
    path = Scratch(spark, "blocks").path()
    blocks.write_blocks(rows, path, ["node_id"], 512)
    return blocks.read_blocks(spark, path).select("record_id", "node_id", "name", "block", "slot")


@query
def delete_point(spark, d):
    return update.delete_point(parts(spark, d), 11.0, 900.0)


@query
def compact_layout(spark, d):
    """Two inserts at one place, one delete there, and a new layout of what is left."""
    held = layout(spark, d, "changed")
    held.insert(spark.createDataFrame([(-1, 5.0, 5.0), (-2, 5.0, 5.0)], "id long, x double, y double"))
    held.delete_point(5.0, 5.0)
    return held.compact(Scratch(spark, "compact").path(), 4).points().select("id", "x", "y")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return oracle.sql(LEAF, INNER)
