"""Connected components of a table of links, without a task or driver that holds all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node that links reach from it) for each node of links (a long, b long).

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends (each step doubles the way), and
    replaces the ends of links by what they lead to; links within one group go. The smallest node of a component never moves,
    so it is what remains. Minima are taken before the shuffle, and each step's tables are written, so that a lost executor
    costs one step.
    """
    # Hooks name smaller nodes only, so following them ends.
    ends = scratch.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    while ends.limit(1).count():
        hook = ends.select(F.col("b").alias("node"), F.col("a").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        hook = scratch.keep(hook)
        while True:
            on = hook.select(F.col("node").alias("at"), F.col("to").alias("further"))
            new = scratch.keep(hook.join(on, F.col("to") == F.col("at"), "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            scratch.drop(hook)
            hook = new.select("node", "to")
            hook._scratch_path = new._scratch_path
            if not new.where("moved").limit(1).count():
                break
        new_ends = _moved(_moved(ends, hook, "a"), hook, "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        kept = scratch.keep(new_ends)
        if roots is None:
            first = hook.select("node", F.col("to").alias("root"))
            lone = hook.select(F.col("to").alias("node")).union(ends.select("a")).distinct().join(hook, "node", "left_anti")
            new_roots = scratch.keep(first.union(lone.select("node", F.col("node").alias("root"))))
        else:
            new_roots = scratch.keep(_moved(roots, hook, "root"))
            scratch.drop(roots)
        scratch.drop(ends, hook)
        roots, ends = new_roots, kept
    scratch.drop(ends)
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)


def _moved(rows: DataFrame, hook: DataFrame, column: str) -> DataFrame:
    """rows with the column's nodes replaced by what they hook to."""
    to = hook.select(F.col("node").alias("_from"), F.col("to").alias("_to"))
    return rows.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
