"""Kernels by hand, plans against their twins, decisions on edge cases, sources."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.operators import search, tree, update
from quadrille.plans.layout import Layout
from quadrille.plans.rank import ranked
from quadrille.plans.scratch import Scratch
from quadrille.sources import blocks, osm
from quadrille.sources import points as points_mod
from quadrille.sources.points import checked_dimensions, points


def made(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id long, x double, y double")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "x", "y").collect())


def some_points(seed, n=300):
    r = random.Random(seed)
    out = [(r.randrange(-20, 20) / 2, r.randrange(-20, 20) / 4) for _ in range(n)]
    return out + out[:10] + [(0.0, 0.0), (0.0, -0.0)]


@pytest.mark.parametrize(
    ("a", "b", "meets", "both", "margin"),
    [
        ((0, 0, 2, 2), (3, 3, 4, 4), False, 0, 8),
        ((0, 0, 2, 2), (2, 1, 4, 4), True, 0, 8),
        ((0, 0, 4, 4), (1, 1, 2, 3), True, 2, 16),
        ((0, 0, 2, 2), (0, 0, 2, 2), True, 4, 8),
        ((1, 1, 1, 1), (0, 0, 2, 2), True, 0, 0),
        ((-3, -3, -1, -2), (-2, -4, 0, 0), True, 1, 6),
    ],
)
def test_kernels(spark, a, b, meets, both, margin):
    as_lit = lambda r: g.box(*(F.lit(float(v)) for v in r))
    p, q = as_lit(a), as_lit(b)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    hull = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
    r = spark.range(1).select(g.rect_intersects(p, q), g.rect_intersection_area(p, q), g.rect_margin(p), g.rect_union_area(p, q), g.rect_enlargement(p, q), g.mbr_enlarge(p, q)).first()
    assert r[0] == meets and r[1] == both and r[2] == margin and r[3] == area(a) + area(b) - both and r[4] == area(hull) - area(a) and tuple(r[5]) == hull


def test_ingest_leaves_out_what_has_no_place(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, float("inf")), (5, -1.0, float("-inf"))], "k long, a double, b double")
    assert rows_of(points(df, "a", "b", "k")) == [(1, 1.0, 2.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_twins_and_layout(spark, seed):
    rows = some_points(seed)
    df = made(spark, rows)
    layout = Layout.write(df, Scratch(spark, "t").path(), 6)
    box = (-3.0, -2.0, 4.5, 3.0)
    expected = sorted((i, x, y) for i, (x, y) in enumerate(rows) if box[0] <= x <= box[2] and box[1] <= y <= box[3])
    assert rows_of(search.range_query(df, *box)) == rows_of(search.range_query_linear(df, *box)) == rows_of(layout.range(*box)) == expected
    q = (0.0, 0.0)
    near = sorted((math.sqrt(x * x + y * y), i) for i, (x, y) in enumerate(rows) if x * x + y * y > 0)
    for k in (1, 7, 1000):
        for found in (search.knn_query(df, k, *q, ["id"]), search.knn_query_linear(df, k, *q, ["id"]), layout.knn(k, *q, ["id"])):
            assert [r["id"] for r in found.collect()] == [i for _, i in near[:k]]
    sky = sorted((i, x, y) for i, (x, y) in enumerate(rows) if not any(a <= x and b <= y and (a < x or b < y) for a, b in rows))
    assert rows_of(search.skyline_query(df)) == rows_of(search.skyline_antijoin(df)) == rows_of(layout.skyline()) == sky
    assert rows_of(search.skyline_distinct(df)) == sorted({(x, y): (i, x, y) for i, x, y in reversed(sky)}.values())


def test_coincident_points_count_if_asked_for(spark):
    df = made(spark, [(1, 1), (1, 1), (2, 1)])
    assert [r["id"] for r in search.knn_query(df, 2, 1, 1, ["id"]).collect()] == [2]
    assert [r["id"] for r in search.knn_query(df, 2, 1, 1, ["id"], include_coincident=True).collect()] == [0, 1]


@pytest.mark.parametrize("call", [lambda d: search.range_query(d, 2, 0, 1, 1), lambda d: search.range_query(d, 0, float("nan"), 1, 1), lambda d: search.knn_query(d, 0, 0, 0, ["id"]), lambda d: checked_dimensions(1), lambda d: Layout.write(d, "/nowhere", 1, 1), lambda d: update.insert_record(d, 1, float("nan"), 1), lambda d: update.insert_record(d, 1, 1, 1, 0), lambda d: search.knn_query(d, 1, float("inf"), 0, ["id"]), lambda d: points_mod.vectors(d, "x", "id", 1)])
def test_arguments(spark, call):
    with pytest.raises(ValueError):
        call(made(spark, [(1, 1)]))


def test_updates(spark):
    rows = [(1, 1), (2, 2), (1, 1), (5, 5)]
    layout = Layout.write(made(spark, rows), Scratch(spark, "t").path(), 2)
    assert not layout.delete_point(9, 9)
    layout.insert(spark.createDataFrame([(9, 1.0, 1.0)], "id long, x double, y double"))
    assert layout.delete_point(1, 1) and layout.delete_point(1, 1)
    left = [(1, 2.0, 2.0), (3, 5.0, 5.0), (9, 1.0, 1.0)]
    assert rows_of(layout.points()) == rows_of(search.range_query_linear(layout.points(), 0, 0, 9, 9)) == left
    assert rows_of(layout.skyline()) == [(9, 1.0, 1.0)] and [r["id"] for r in layout.knn(1, 1.5, 1.5, ["id"]).collect()] == [1]
    assert rows_of(layout.compact(Scratch(spark, "t").path(), 1).points()) == left
    df = made(spark, rows)
    assert rows_of(update.delete_point(df, 1, 1)) == [(1, 2.0, 2.0), (2, 1.0, 1.0), (3, 5.0, 5.0)] and df.count() == update.delete_point(df, 7, 7).count()
    assert update.insert_record(df, 8, 0, 0).count() == 5


@pytest.mark.parametrize("capacity", [2, 5, 24])
def test_packing(spark, capacity):
    """Full nodes, the last one with the least fill, at the expense of the one before."""
    least = int(capacity * tree.MIN_FILL)
    for n in (1, capacity, capacity + 1, 2 * capacity - 1, 3 * capacity + least, 4 * capacity + max(least - 1, 0), 7 * capacity):
        expected = [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)
        if len(expected) > 1 and 0 < expected[-1] < least:
            expected[-2:] = [expected[-2] - (least - expected[-1]), least]
        got = spark.range(n).select(tree.packed(F.col("id"), n, capacity).alias("node")).groupBy("node").count().orderBy("node").collect()
        assert [(r["node"], r["count"]) for r in got] == list(enumerate(expected)), n


def plain_choice(p, boxes, leaf_parents):
    """Over (id, xmin, ymin, xmax, ymax)."""
    meet = lambda a, b: max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    area = lambda a: (a[2] - a[0]) * (a[3] - a[1])
    costs = []
    for i, *b in boxes:
        grown = (min(b[0], p[0]), min(b[1], p[1]), max(b[2], p[0]), max(b[3], p[1]))
        over = sum(meet(grown, o) - meet(b, o) for j, *o in boxes if j != i) if leaf_parents else 0
        costs.append((round(over, 9), round(area(grown) - area(b), 9), area(b), i))
    return min(costs)[3]


@pytest.mark.parametrize(("many", "leaf_parents"), [(3, True), (70, True), (70, False), (1200, True)])
def test_choose_subtree(spark, monkeypatch, many, leaf_parents):
    r = random.Random(many)
    boxes = []
    for i in range(many):
        x, y = r.randrange(400) / 4, r.randrange(400) / 4
        boxes.append((i % 3, i, x, y, x + r.randrange(40) / 4, y + r.randrange(40) / 4))
    places = [(r.randrange(-20, 460) / 4, r.randrange(-20, 460) / 4) for _ in range(40)]
    asked = spark.createDataFrame([(i, x, y, i % 4) for i, (x, y) in enumerate(places)], "id long, x double, y double, parent_id long")
    table = spark.createDataFrame(boxes, "parent_id long, node_id long, xmin double, ymin double, xmax double, ymax double")
    one = {r["id"]: r["node_id"] for r in tree.choose_subtree(spark, asked, table.drop("parent_id"), leaf_parents).collect()}
    assert one == {i: plain_choice(p, [b[1:] for b in boxes], leaf_parents) for i, p in enumerate(places)}
    for limit in (tree.MAX_BOXES, 0):
        monkeypatch.setattr(tree, "MAX_BOXES", limit)
        of = {r["id"]: r["node_id"] for r in tree.choose_subtree(spark, asked, table, leaf_parents).collect()}
        assert of == {i: plain_choice(p, [b[1:] for b in boxes if b[0] == i % 4], leaf_parents) for i, p in enumerate(places) if i % 4 < 3}


def test_choice_among_many_boxes_is_not_made_point_by_point(monkeypatch):
    """Points beside strips: the first box by growth overlaps no other more, which all points are asked at once."""
    import pandas as pd

    strips = [(0, i, 10.0 * i, i % 7, 10.0 * i + 9, 100.0 + i % 5) for i in range(300)]
    rows = pd.DataFrame(strips, columns=["parent_id", "node_id", "xmin", "ymin", "xmax", "ymax"])
    r = random.Random(3)
    places = [(10.0 * r.randrange(300) + r.choice([3, 9.25, 9.75]), r.choice([-20.0, 50.0, 130.0])) for _ in range(200)]

    def one_by_one(*a):
        raise AssertionError("point by point")

    monkeypatch.setattr(tree.Blocks if hasattr(tree, "Blocks") else tree.Entries, "_least_overlap", one_by_one)
    entries = tree._entries(rows)[0] if hasattr(tree, "_entries") else tree.Entries(rows)
    x, y = (np.array(v) for v in zip(*places))
    got = entries.best(x, y, True)[0] if hasattr(tree, "_entries") else entries.best(np.zeros(len(x), int), x, y, True)[1]
    assert got.tolist() == [plain_choice(p, [b[1:] for b in strips], True) for p in places]


@pytest.mark.parametrize("seed", range(6))
def test_choice_among_boxes_that_overlap(seed):
    import pandas as pd

    r = random.Random(seed)
    nodes = {7: r.choice([1, 5, 33]), 9: r.choice([2, 64, 200]), 11: 3}
    boxes = []
    for parent, many in nodes.items():
        for i in range(many):
            x, y = r.randrange(400) / 7, r.randrange(400) / 7
            boxes.append((parent, i, x, y, x + r.randrange(41) / 7, y + r.randrange(41) / 7))
    rows = pd.DataFrame(boxes, columns=["parent_id", "node_id", "xmin", "ymin", "xmax", "ymax"]).sample(frac=1, random_state=seed)
    places = [(r.randrange(-20, 440) / 7, r.randrange(-20, 440) / 7) for _ in range(60)]
    parents = [r.choice([7, 8, 9, 11, 12]) for _ in places]
    x, y = (np.array(v) for v in zip(*places))
    for leaf_parents in (True, False):
        known, ids, _ = tree.Entries(rows).best(np.array(parents), x, y, leaf_parents)
        assert known.tolist() == [i for i, p in enumerate(parents) if p in nodes]
        assert ids.tolist() == [plain_choice(places[i], [b[1:] for b in boxes if b[0] == parents[i]], leaf_parents) for i in known]


def test_descent_in_one_pass(spark, monkeypatch):
    """No table is written for a level, and a descent by level ends at the same leaves."""
    scratch = Scratch(spark, "t")
    rows = spark.createDataFrame([(i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(400)], "id long, x double, y double")
    nodes = scratch.keep(tree.tree_nodes(scratch.keep(tree.bulk_load_leaves(rows, 6, scratch)), 3, scratch))
    asked = rows.selectExpr("id", "x * 1.125 - 2 AS x", "y * 1.25 - 5 AS y")
    made_before = scratch.made
    found = sorted(tuple(r) for r in tree.descend(spark, asked, nodes, scratch).select("id", "leaf_id").collect())
    assert scratch.made == made_before and len(found) == 400
    monkeypatch.setattr(tree, "MAX_BOXES", 0)
    assert found == sorted(tuple(r) for r in tree.descend(spark, asked, nodes, scratch).select("id", "leaf_id").collect())


def test_dump_is_in_order(spark):
    scratch = Scratch(spark, "t")
    leaves = scratch.keep(tree.bulk_load_leaves(made(spark, some_points(4, 130)[:130]), 24, scratch))
    path = scratch.path()
    tree.write_dump(tree.tree_dump(tree.tree_nodes(leaves, 4, scratch), leaves), path)
    import glob

    lines = [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f).read().splitlines()]
    assert lines[0].startswith("level 0 node 0 parent -")
    heads = [tuple(map(int, x.split()[1:4:2])) for x in lines if x.startswith("level")]
    assert heads == sorted(heads) and sum(x.startswith("  record") for x in lines) == 130
    last = max(h[0] for h in heads)
    assert all(x.startswith("  record") for x in lines[lines.index(next(x for x in lines if x.startswith(f"level {last}"))) + 1 :][:9])


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 4).flatmap(lambda d: st.lists(st.lists(st.integers(0, 6), min_size=d, max_size=d), min_size=1, max_size=60)))
def test_undominated(rows):
    import numpy as np

    v = np.array(rows, float)
    expected = [i for i, a in enumerate(rows) if not any(all(x <= y for x, y in zip(b, a)) and b != a for b in rows)]
    assert sorted(search._undominated(v, 4).tolist()) == expected


def test_skyline_of_vectors_in_parts(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, [float(r.randrange(12)) for _ in range(3)]) for i in range(300)]
    expected = {i for i, a in rows if not any(all(x <= y for x, y in zip(b, a)) and b != a for _, b in rows)}
    df = spark.createDataFrame(rows, "id long, coords array<double>")
    for limit in (50_000, 7):
        monkeypatch.setattr(search, "MAX_CANDIDATES", limit)
        assert {x["id"] for x in search.skyline_vectors(df.repartition(5)).collect()} == expected
    assert search.skyline_vectors(df.limit(0)).count() == 0 and search.skyline_query(made(spark, [(1, 1)]).limit(0)).count() == 0


def test_insert_is_whole_or_not_there(spark, monkeypatch):
    """A failure between the points and their boxes leaves the layout as it was, and the batch can be run again."""
    from quadrille.plans import layout as module

    held = Layout.write(made(spark, [(1, 1), (2, 2)]), Scratch(spark, "t").path(), 1)
    new = spark.createDataFrame([(7, 3.0, 3.0), (8, float("nan"), 1.0)], "id long, x double, y double")
    describe = module._describe

    def fails(*a):
        raise RuntimeError("lost")

    for batch in ("b-0", None):
        monkeypatch.setattr(module, "_describe", fails)
        with pytest.raises(RuntimeError):
            held.insert(new, batch)
        assert held.points().count() == 2 and held.range(0, 0, 9, 9).count() == 2
        monkeypatch.setattr(module, "_describe", describe)
    held.insert(new, "b-0")
    held.insert(new, "b-0")
    held.insert(spark.createDataFrame([(9, 4.0, 4.0)], "id long, x double, y double"))
    assert sorted(r["id"] for r in held.points().collect()) == sorted(r["id"] for r in held.range(0, 0, 9, 9).collect()) == [0, 1, 7, 9]
    monkeypatch.setattr(module, "MAX_FILES", 1)
    assert held.range(0, 0, 3, 3).count() == 3


@pytest.mark.parametrize("n", [1, 10, 24, 25, 30, 34, 48, 49, 130])
def test_tree(spark, n):
    rows = some_points(3, n)[:n]
    scratch = Scratch(spark, "t")
    leaves = scratch.keep(tree.bulk_load_leaves(made(spark, rows), 24, scratch))
    nodes = tree.tree_nodes(leaves, 4, scratch).collect()
    assert leaves.count() == n and max(r["level"] for r in nodes) == tree.tree_height(n, 24, 4)
    bottom = [r for r in nodes if r["level"] == max(x["level"] for x in nodes)]
    assert sum(r["entries"] for r in bottom) == n and all(9 <= r["entries"] <= 24 for r in bottom if len(bottom) > 1)
    for r in nodes:
        if r["parent_id"] is not None:
            up = next(x for x in nodes if x["level"] == r["level"] - 1 and x["node_id"] == r["parent_id"])
            assert up["xmin"] <= r["xmin"] and up["ymax"] >= r["ymax"]


def test_rank(spark):
    rows = some_points(5, 500)
    got = {r["id"]: r["rank"] for r in ranked(made(spark, rows), ["x", "y", "id"], Scratch(spark, "t"), partitions=7).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda p: p[1])] == [i for _, _, i in sorted((x, y, i) for i, (x, y) in enumerate(rows))]
    assert sorted(got.values()) == list(range(len(rows)))


def test_hilbert_neighbours(spark):
    """On a grid, places that follow each other are next to each other."""
    n = 16
    grid = spark.range(n * n).select((F.col("id") % n + 0.5).alias("x"), (F.floor(F.col("id") / n) + 0.5).alias("y"))
    got = sorted((r["h"], r["x"], r["y"]) for r in grid.select("x", "y", g.hilbert_key(F.col("x"), F.col("y"), F.lit(float(n)), 4).alias("h")).collect())
    assert [h for h, _, _ in got] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        """<?xml version="1.0"?><osm><node id="1" lat="1.5" lon="2"/><node id="2" lat="3" lon="4"><tag k="x" v="y"/><tag k="name:en" v="Café &amp; Co"/></node>
<node id="3" lat="5" lon="6"><tag k="name:en" v=""/></node><node id="4" lat="7" lon="8"><tag k="name" v="n"/></node><way id="9"><nd ref="1"/></way></osm>"""
    )
    got = sorted(tuple(r) for r in osm.osm_scan(spark, str(tmp_path / "a.osm")).collect())
    assert got == [(1, 1.5, 2.0, None), (2, 3.0, 4.0, "Café & Co"), (3, 5.0, 6.0, None), (4, 7.0, 8.0, None)]


def test_blocks(spark, tmp_path):
    rows = [(i, i / 3, -i / 7, None if i % 3 else f"naïve {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "node_id long, x double, y double, name string")
    path = str(tmp_path / "heap.bin")
    blocks.write_blocks(df, path, ["node_id"], 512)
    got = blocks.read_blocks(spark, path).orderBy("record_id").collect()
    assert [(r["node_id"], r["x"], r["y"], r["name"]) for r in got] == rows and max(r["block"] for r in got) > 5
    plain = [(i, 0.0, 0.0, None) for i in range(50)]
    block, slot = blocks.unnamed_location(F.col("id"), 512)
    at = spark.range(50).select(block, slot).collect()
    assert [(r[0], r[1]) for r in at] == [(b, s) for *_, b, s in blocks.decoded(blocks.encoded(iter(plain), 512))]


@pytest.mark.parametrize("new_ids_only", [True, False])
def test_stream(spark, tmp_path, new_ids_only):
    from quadrille.streaming.ingest import ingest

    layout = Layout.write(made(spark, [(1, 1), (2, 2)]), Scratch(spark, "t").path(), 1)
    made(spark, [(9, 9), (8, 8), (7, 7), (6, 6)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, x double, y double").parquet(str(tmp_path / "in"))
    ingest(stream, layout, str(tmp_path / "state"), new_ids_only).awaitTermination()
    expected = [0, 1, 2, 3] if new_ids_only else [0, 0, 1, 1, 2, 3]
    assert sorted(r["id"] for r in layout.points().collect()) == sorted(r["id"] for r in layout.range(0, 0, 9, 9).collect()) == expected
    import shutil

    shutil.rmtree(tmp_path / "state" / "commits")  # the last batch counts as not done and is run again
    ingest(stream, layout, str(tmp_path / "state"), new_ids_only).awaitTermination()
    assert sorted(r["id"] for r in layout.points().collect()) == expected


def test_plans(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    df = points(rows, "l_quantity", "l_extendedprice", ["l_orderkey"])
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    ranged = plan(search.range_query(df, 1, 2, 3, 4))
    assert "GreaterThanOrEqual(l_quantity,1.0)" in ranged and "Exchange" not in ranged and "l_tax" not in ranged
    assert "TakeOrderedAndProject" in plan(search.knn_query(df, 5, 1, 1, ["l_orderkey"]))
    assert "CartesianProduct" not in plan(search.skyline_query(df.withColumn("id", F.col("l_orderkey"))))


def test_library_stands_without_the_subpackage():
    """The rest imports and registers its queries if the subpackage and the pipeline are missing."""
    import subprocess
    import sys

    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('quadrille.llm') or n == 'corpus_pipeline' else f(n, *a); import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert not any(m.startswith('quadrille.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
