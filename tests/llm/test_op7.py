import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import op7_jaccard as op
from quadrille.llm.common import table
from quadrille.llm.components import components
from quadrille.llm.common import Scratch

from ..conftest import DATA
from .util import LOWER, docs, odd_rows, rows_of, words


def shingle_set(text, k=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k=4, percent=85):
    """doc_id -> (n, smallest id reached)."""
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                hi, lo = max(find(i), find(j)), min(find(i), find(j))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, k=4, percent=85):
    got = rows_of(op.component_table(spark, docs(spark, [(i, t, "en", "a") for i, t in rows], True), k, percent))
    expected = brute(rows, k, percent)
    assert len(got) == len(rows)
    assert {(i, n, c) for i, n, c in got if i is not None} == {(i, n, c) for i, (n, c) in expected.items()}


def near_copies(r, n, length=120, edits=2):
    base = [f"w{r.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(length)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_whole_table(spark, duck):
    rows = duck("sf0.001").execute("SELECT doc_id, text FROM documents").fetchall()
    check(spark, rows)


def test_groups_and_chains(spark):
    r = random.Random(3)
    texts = [t for k in (2, 3, 9, 40) for t in near_copies(r, k)] + [" ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 60))) for _ in range(40)]
    # a chain: each is close to the next, the ends are not
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + [f"n{i}a", f"n{i}b", f"n{i}c"]
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"z{r.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    r.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_large_cluster_in_pieces(spark, monkeypatch):
    """A cluster of many pieces, with links between pieces only."""
    for name, value in (("PIECE", 8), ("OFTEN", 3), ("SEEN", 500)):
        monkeypatch.setattr(op, name, value)
    r = random.Random(5)
    texts = near_copies(r, 90, 100, 5) + near_copies(r, 20, 60, 3)
    base = [f"s{i}" for i in range(100)]
    texts += [" ".join(base[:60] + [f"g{j}{x}" for x in range(30)]) for j in range(12) for _ in range(2)]
    check(spark, list(enumerate(texts)))


def test_edges(spark):
    rows = [(i, t) for i, t, _, _ in odd_rows()]
    got = rows_of(op.component_table(spark, docs(spark, odd_rows(), True)))
    assert len(got) == len(rows)
    by = {i: (n, c) for i, n, c in got if i is not None}
    assert by[1][1] == 1 and by[2] == (0, 2) and by[3] == (0, 3) and by[5] == (0, 5) and by[6][0] == 1
    assert all(c is None for i, _, c in got if i is None)
    assert rows_of(op.component_table(spark, docs(spark, []))) == []


def test_same_short_texts(spark):
    check(spark, [(9, "a b"), (4, "A  b"), (5, "a b c"), (6, "a"), (7, "A"), (8, "b a")])


def test_one_of_each(spark):
    rows = [(3, "a b c d e f g", "en", "a"), (1, "a b c d e f g", "en", "b"), (1, "a b c d e f g", "en", "b"), (2, "other text", "en", "a"), (None, "other text", "en", "a"), (5, "", None, None), (6, None, None, None)]
    out = op.one_of_each(spark, docs(spark, rows, True))
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 5, 6, None]
    assert out.columns == docs(spark, rows, True).columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25), min_size=2, max_size=30), st.sampled_from([50, 80, 85]))
def test_tree_loses_no_pair(values, percent):
    from quadrille.llm.textvec import mixed

    sets = [np.unique(mixed(np.array(v, np.uint64) + np.uint64(1))) for v in values]
    points, sizes = np.stack([op.counts(s) for s in sets]), np.array([len(s) for s in sets])
    tree = op.Tree(points, sizes)
    assert sorted(tree.order.tolist()) == list(range(len(sets)))
    for i, a in enumerate(sets):
        near = set(tree.near(points[i], len(a), percent).tolist())
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert j in near


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 400), min_size=1, max_size=300), st.sets(st.integers(1, 400), min_size=1, max_size=300), st.sets(st.integers(1, 400)), st.sampled_from([50, 80, 85]))
def test_prefixes_of_similar_sets_meet(a, b, frequent, percent):
    if 100 * len(a & b) < percent * len(a | b):
        b = a | set(list(b)[: len(a) // 8])
    if 100 * len(a & b) >= percent * len(a | b):
        as_array = lambda s: np.array(sorted(s), np.uint64)
        first = [set(op.prefix(as_array(s), as_array(frequent), percent)[0].tolist()) for s in (a, b)]
        assert len(first[0] & first[1]) >= max(op.in_common(len(a), percent), op.in_common(len(b), percent))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=8, max_size=150), st.lists(st.integers(0, 149), max_size=3), st.sampled_from([80, 85]))
def test_prefixes_by_rarity_meet(numbers, edits, percent):
    """Of two texts that differ in some words, by an order that only the words of a shingle decide."""
    import pandas as pd

    words_ = [f"w{i}" for i in numbers]
    other = [f"x{i}" if i in edits else w for i, w in enumerate(words_)]
    known = op.word_rarities(pd.DataFrame({"cls": op.Words([" ".join(f"w{i}" for i in range(0, 30, 2)).encode()]).hashes().view(np.int64), "often": [3**i for i in range(15)]}))
    (a, ra), (b, rb) = op.ranked_sets_of([" ".join(words_).encode(), " ".join(other).encode()], 4, known)
    assert [x.tolist() for x in (a, b)] == [x.tolist() for x in op.sets_of([" ".join(words_).encode(), " ".join(other).encode()], 4)]
    both, at, bt = np.intersect1d(a, b, return_indices=True)
    assert (ra[at] == rb[bt]).all()
    if 100 * len(both) >= percent * (len(a) + len(b) - len(both)):
        none = np.zeros(0, np.uint64)
        first = [set(op.prefix(s, none, percent, 0, r)[0].tolist()) for s, r in ((a, ra), (b, rb))]
        assert len(first[0] & first[1]) >= max(op.in_common(len(a), percent), op.in_common(len(b), percent))


def test_common_words_bring_few_texts_together(spark, monkeypatch):
    """Texts of common and rare words meet by their rare words: chance meetings don't grow with the square of the texts."""
    r = random.Random(5)
    texts = [" ".join(f"c{r.randrange(14)}" if r.random() < 0.85 else f"w{r.randrange(3000)}" for _ in range(150)) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[i] + " more") for i in range(20)]
    links, hooked = [], op.hooked

    def counted(*a):
        links.append((out := hooked(*a)).count())
        return out

    monkeypatch.setattr(op, "hooked", counted)
    got = {i: c for i, _, c in rows_of(op.component_table(spark, docs(spark, [(i, t, "en", "a") for i, t in rows], True), 4, 85))}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert links[0] < 100, links


def test_texts_are_never_sorted(spark, monkeypatch):
    """More documents than are told to all tasks: texts are dealt to hash tables of ids."""
    r = random.Random(6)
    texts = near_copies(r, 30) + near_copies(r, 10) + ["a b c"]
    df = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)], True)
    expected = sorted(x["doc_id"] for x in op.one_of_each(spark, df).collect())
    monkeypatch.setattr(op, "MAX_TOLD", 0)
    monkeypatch.setattr(op, "MAX_GONE", 0, raising=False)
    out = op.one_of_each(spark, df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(x["doc_id"] for x in out.collect()) == expected and len(expected) < len(texts)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(i, i + 1) for i in range(100, 300)] + [(400, i) for i in range(401, 430)] + [(7, 7)]
    root = {x: x for pair in links for x in pair}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        hi, lo = max(find(a), find(b)), min(find(a), find(b))
        root[hi] = lo
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    none = components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"))
    assert rows_of(none) == []


def test_query(spark):
    from quadrille.llm.queries import queries

    df = queries()["op7_jaccard_components"](spark, f"{DATA}/sf0.001")
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    assert df.count() == table(spark, f"{DATA}/sf0.001", "documents").count()
