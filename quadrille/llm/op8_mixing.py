"""Mixing sources to target weights.

Each document gets a key from a hash of its id, which puts every source in a random order. The keys' space is cut into ranges; a
table of (source, range) sums is brought into order, and prefix sums over it show in which range a source's budget ends. That
range alone is cut again, and at the last level its documents are sorted and cut at the exact word: no task holds more than the
ranges of a source or the documents of one small range, whatever share of the rows a source has. The whole order is run
through once for each full epoch that a target needs; the cut then ends the last one.

Null texts have size 0. Null sources are a source of their own, last in the order. Null doc_id: key of the empty id. Rows alike
in id and size at the cut share what is left evenly (the remainder of the division isn't taken). An empty table gives none. Very
long texts count whole, and the cut can end inside one. Other columns are kept if they are asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rank import ranked
from .common import Scratch, n_words

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
SEED = "mix-1"
#: Bits of the key at each cut, of 60.
LEVELS, BITS, KEY_BITS = 2, 10, 60


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words for each source: shares by weight of share times all words; no target is above most times its source, and what is over is shared again by weight among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def key(doc_id: Column) -> Column:
    """60 random bits of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{SEED}")).cast("binary")), 1, 15), 16, 10).cast("long")


def goals(spark: SparkSession, sized: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, target, epochs (full ones), rest (words of the last): one row for each source, of any number.

    As targets(): the level is set by all sources that stay below their limit, again until no further one reaches it. Each step is one
    sum over the sources; sums are of integers, so they are the same in any order.
    """
    named = sized.groupBy("source").agg(F.sum("size").alias("n")).withColumn("last", F.col("source").isNull())
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = scratch.keep(ranked(named, ["last", "source"], scratch).select("source", "n", weight.cast("long").alias("w")))
    total = sources.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    level, full = SHARE * (total["n"] or 0) / (total["w"] or 1), 0
    while True:
        over = level * F.col("w") > MOST * F.col("n")
        r = sources.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("w")).first()
        if r["full"] == full or not r["w"]:
            break
        level, full = (SHARE * total["n"] - MOST * r["n"]) / r["w"], r["full"]
    target = F.least(level * F.col("w"), MOST * F.col("n"))
    words = F.round(target).cast("long")
    epochs = F.when(F.col("n") > 0, F.floor(words / F.col("n"))).otherwise(0).cast("long")
    return scratch.keep(sources.select("source", F.col("n").alias("source_size"), target.alias("target"), epochs.alias("epochs"), (words - epochs * F.col("n")).alias("rest")))


def cuts(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """For each source with words left to take: the place (cut_key, cut_id, cut_size) where its budget ends, the words taken of each row there; rows before it are taken whole."""
    ordered = lambda *c: Window.partitionBy("source").orderBy(*c).rowsBetween(Window.unboundedPreceding, -1)
    left = goal.where("rest > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("range"))
    shift = KEY_BITS
    for level in range(LEVELS):
        before, shift = shift, shift - BITS
        inside = sized if not level else sized.join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", before) == F.col("range")), "left_semi")
        sums = inside.groupBy("source", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("ahead", F.coalesce(F.sum("n").over(ordered("part")), F.lit(0)))
        run = run.join(left.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        left = run.where("ahead < left and ahead + n >= left").select("source", (F.col("left") - F.col("ahead")).alias("left"), F.col("part").alias("range"))
    last = sized.join(left.select(F.col("source").alias("s"), "left", "range"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", shift) == F.col("range")))
    alike = last.groupBy("source", "left", "key", "id", "size").agg(F.count("*").alias("rows"))
    run = alike.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(ordered("key", "id", "size")), F.lit(0)))
    end = run.where("ahead < left and ahead + size * rows >= left")
    return end.select("source", F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("left") - F.col("ahead")) / F.col("rows")).alias("cut_taken"))


#: Sources that are told to all tasks; beyond, they are dealt under salts, as one source may hold a third of the documents.
MAX_TOLD, SALTS = 200_000, 32


def mix(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, with the columns in keep: one row for each row of docs.

    A column in keep that has the name of a result (doc_id aside) goes under that name with kept_ before it, as often as is needed.
    The cuts are a row for each source; up to a number they meet the documents by a broadcast, so that texts aren't shuffled.
    """
    scratch = Scratch(spark, "mix")
    keep = [c for c in keep or [] if c != "doc_id"]
    sized = scratch.keep(docs.select("source", n_words(F.col("text")).alias("size"), key(F.col("doc_id")).alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")))
    goal = goals(spark, sized, scratch)
    plan = scratch.keep(goal.join(cuts(sized, goal).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnsRenamed({"source": "goal_source", "source_size": "goal_size", "target": "goal_target"}))
    scratch.drop(sized, goal)
    rows = docs.select(*[docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)], docs["doc_id"].alias("row_id"), docs["source"].alias("row_source"), n_words(docs["text"]).alias("row_size"), key(docs["doc_id"]).alias("row_key"))
    at = F.struct("row_key", F.coalesce(F.col("row_id").cast("string"), F.lit("")), "row_size")
    end = F.struct("cut_key", "cut_id", "cut_size")
    last = F.when(F.col("cut_key").isNull(), 0).when(at < end, F.col("row_size")).when(at == end, F.col("cut_taken")).otherwise(0)
    same = F.col("row_source").eqNullSafe(F.col("goal_source"))
    if plan.limit(MAX_TOLD + 1).count() <= MAX_TOLD:
        joined = rows.join(F.broadcast(plan), same)  # a row for each source
    else:
        each = plan.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("salt", F.pmod(F.col("row_key"), F.lit(SALTS))).join(each, same & (F.col("salt") == F.col("of_salt")))
    results = {"size": F.col("row_size"), "source_size": F.col("goal_size"), "target": F.col("goal_target"), "taken": (F.col("epochs") * F.col("row_size") + last).cast("long")}
    used, names = {*results, "doc_id", *keep}, []
    for c in keep:
        name = c
        while name in results or (name != c and name in used):
            name = f"kept_{name}"
        used.add(name)
        names.append(name)
    kept = [F.col(f"kept_{i}").alias(name) for i, name in enumerate(names)]
    return joined.select(*kept, F.col("row_id").alias("doc_id"), *(v.alias(c) for c, v in results.items()))
