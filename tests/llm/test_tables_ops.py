"""Decontamination, the language model, line rules, mixing: plain versions, odd rows."""

import dataclasses
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import op2_decontamination as op2
from quadrille.llm import op3_gru as op3
from quadrille.llm import op4_lines as op4
from quadrille.llm import op8_mixing as op8
from quadrille.llm.common import Scratch, table
from quadrille.llm.queries import queries

from ..conftest import DATA
from .util import LOWER, docs, odd_rows, remainder, rows_of, words

SF = f"{DATA}/sf0.001"


# Decontamination


def plain_words(text):
    import re

    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def plain_pairs(rows, items):
    """Items of fewer than five words are one shingle, of their length."""
    held, classes = [(i, plain_words(t)) for i, t in rows], defaultdict(list)
    for i, t in items:
        if w := plain_words(t):
            k = min(5, len(w))
            classes[k, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))].append(i)
    out = []
    for (k, s), ids in classes.items():
        own = [i for i in ids if i is not None]
        for i, w in held:
            n = len(s & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
            if 100 * n >= 80 * len(s):
                out.append((i, min(own, default=-1), len(s), len(ids), n))
    return sorted(out, key=str)


@pytest.mark.parametrize("dealt", [False, True])
def test_pairs(spark, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(op2, "MAX_HELD", 10)
    r = random.Random(2)
    item = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    items = [(i, item(r.randrange(1, 50))) for i in range(30)]
    items += [(30, items[3][1].upper()), (31, items[3][1] + "!"), (None, items[4][1]), (None, "only here, twice"), (32, ""), (33, None), (34, "secret phrase here"), (35, "w1"), (36, "w2 w3"), (37, "Secret, phrase HERE!"), (3, "the same id, other words of an item")]
    rows = []
    for i in range(60):
        w = item(r.randrange(0, 300)).split()
        for _ in range(r.randrange(3)):
            own = items[r.randrange(30)][1].split()
            if r.random() < 0.6:
                own[r.randrange(len(own))] = "edit"
            at = r.randrange(len(w) + 1)
            w[at:at] = own
        rows.append((i, ", ".join(w)))
    rows += [(60, items[5][1]), (60, items[5][1]), (None, items[6][1]), (61, None), (62, ""), (63, "Only here twice"), (64, "a b c secret phrase here d e f g"), (65, "phrase here"), (66, " ".join(f"u{i}" for i in range(30_000)) + " secret phrase here " + items[7][1])]
    table_ = spark.createDataFrame(items, "item_id long, text string")
    got = op2.search(spark, docs(spark, [(i, t, "en", "a") for i, t in rows], True), table_)
    found = [(x["doc_id"], x["item_id"], x["n_item"], x["n_copies"], x["n_held"]) for x in got.collect()]
    assert sorted(found, key=str) == plain_pairs(rows, items)
    left = op2.clean(spark, docs(spark, [(i, t, "en", "a") for i, t in rows]), table_)
    bad = {i for i, *_ in found}
    assert sorted((x["doc_id"] for x in left.collect()), key=str) == sorted((i for i, _ in rows if i not in bad), key=str)
    if not dealt:
        assert op2.search(spark, docs(spark, odd_rows()), table_.limit(0)).count() == 0 and op2.search(spark, docs(spark, []), table_).count() == 0


def test_pairs_of_the_tables(spark):
    d, b = (table(spark, SF, t).collect() for t in ("documents", "benchmark"))
    got = queries()["op2_decontaminate"](spark, SF).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_copies"], r["n_held"]) for r in got), key=str) == plain_pairs([(r["doc_id"], r["text"]) for r in d], [(r["item_id"], r["text"]) for r in b])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.randoms(use_true_random=False))
def test_signatures_are_long_enough(n, r):
    length, least = op2.signature(n)
    assert 1 <= least <= length <= n
    lacks = set(r.sample(range(n), n - -(-80 * n // 100)))
    assert sum(i not in lacks for i in range(length)) >= least


def test_clean_of_clashing_columns_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    rows = docs(spark, [(1, "x a b c d e f", "en", "a"), (2, "other", "en", "a"), (3, None, None, None)]).withColumns({c: F.lit("z") for c in ("bad_text_key", "item_id", "n_held", "_0")})
    out = op2.clean(spark, rows, items)
    assert out.columns == rows.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]
    assert op2.clean(spark, rows, items.limit(0)).count() == 3 and op2.clean(spark, rows.limit(0), items).count() == 0


# Language model


def test_scores(spark):
    d = table(spark, SF, "documents").collect()
    got = {r["doc_id"]: r for r in queries()["op3_gru_score"](spark, SF).collect()}
    tokens = {r["doc_id"]: [*words((r["text"] or "").translate(LOWER)), None] for r in d}
    c = Counter(t for i, ts in tokens.items() if remainder(i, 7) != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(d)
    for i, ts in tokens.items():
        r = got[i]
        assert r["held_out"] == (remainder(i, 7) == 2) and r["n_tokens"] == len(ts) and r["n_known"] == sum(t in c for t in ts) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(op3, "MAX_HELD", 20)
    got = op3.score(spark, docs(spark, odd_rows(), True)).collect()
    assert len(got) == len(odd_rows()) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_tokens"] == by[2]["n_tokens"] == by[5]["n_tokens"] == 1
    tokens = [[*words((t or "").translate(LOWER)), None] for i, t, *_ in odd_rows()]
    c = Counter(t for ts, (i, *_) in zip(tokens, odd_rows()) if i is not None and remainder(i, 7) != 2 for t in ts)
    n = sum(c.values()) + len(c) + 1
    assert by[4]["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / n) for t in tokens[6]), rel=1e-9)
    assert op3.score(spark, docs(spark, [])).count() == 0
    alone = op3.score(spark, docs(spark, [(None, "a b", "en", "a")])).collect()
    assert alone[0]["train_tokens"] == 0 and alone[0]["base_score"] == 0


def _network(seed=1):
    r = np.random.default_rng(seed)
    m = op3.fresh(r.normal(size=op3.CLASSES), r.normal(size=(op3.HEADS, op3.EACH)))
    m["wc"], m["ww"] = (r.normal(0, 0.3, m[k].shape).astype(np.float32) for k in ("wc", "ww"))
    return m


def test_probabilities_sum_to_one():
    m = _network()
    every = np.arange(op3.END + 1)
    h = np.repeat(np.random.default_rng(2).normal(size=(1, op3.STATE)).astype(np.float32), len(every), 0)
    assert np.exp(op3.outputs(h, every, m)[0]).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_of_a_window():
    m = {k: v.astype(np.float64) for k, v in _network(4).items()}
    r = np.random.default_rng(5)
    x, y = r.integers(0, op3.END, (6, 5)), r.integers(0, op3.END + 1, (6, 5))
    x[3, 2] = op3.END
    state = r.normal(0, 0.5, (5, op3.STATE)).astype(np.float32)
    _, _, g = op3.window({k: v.astype(np.float32) for k, v in m.items()}, x, y, state)

    def loss(m):
        """Step by step in doubles."""
        s, h, total = op3.STATE, state.astype(float), 0.0
        for t in range(len(x)):
            h = h * (x[t] != op3.END)[:, None]
            e, u = m["embed"][x[t]] @ m["wx"] + m["b"], h @ m["wh"]
            z, w = (1 / (1 + np.exp(-(e[:, k : k + s] + u[:, k : k + s]))) for k in (0, s))
            h = (1 - z) * np.tanh(e[:, 2 * s :] + w * u[:, 2 * s :]) + z * h
            for i, token in enumerate(y[t]):
                out = h[i] @ m["wc"] + m["bc"]
                c = op3.class_of(np.array([token]))[0]
                total -= out[c] - np.logaddexp.reduce(out)
                if c < op3.HEADS:
                    out = h[i] @ m["ww"][c] + m["bw"][c]
                    total -= out[token - c * op3.EACH] - np.logaddexp.reduce(out)
        return total

    for k in m:
        at = np.unravel_index(np.argsort(-np.abs(g[k]).ravel())[[0, 3, 11]], g[k].shape)
        for one in zip(*at):
            held, step = m[k][one], 1e-5
            m[k][one] = held + step
            up = loss(m)
            m[k][one] = held - step
            down = loss(m)
            m[k][one] = held
            assert (up - down) / (2 * step) == pytest.approx(g[k][one], rel=2e-3, abs=2e-3), (k, one)


def test_scores_do_not_depend_on_what_is_held(spark, monkeypatch):
    """Beyond the network's words, held tokens only save a join; the end token is always held."""
    rows = table(spark, SF, "documents")
    more = rows.unionByName(docs(spark, [(-1, "", "en", "a"), (-2, "never seen zzzqq before", "en", "a")]))
    before = {r["doc_id"]: r for r in op3.score(spark, more).collect()}
    held = op3.HEADS * op3.EACH + 300
    monkeypatch.setattr(op3, "MAX_HELD", held)
    counts = Scratch(spark, "test-held").keep(op3.count_tokens(rows.select("doc_id", "text")))
    v, *_ = op3.vocabulary(counts)
    assert counts.count() > 2 * held and abs(len(v.hash) - held) < 0.05 * held and v.hash[0] == op3.END_HASH and (v.number >= 0).sum() == op3.HEADS * op3.EACH
    after = op3.score(spark, more).collect()
    for r in after:
        b = before[r["doc_id"]]
        assert r["score"] == pytest.approx(b["score"], rel=1e-6) and r["base_score"] == pytest.approx(b["base_score"], rel=1e-9) and r["n_known"] == b["n_known"]
    assert before[-1]["score"] < 0


@pytest.mark.parametrize("held", [1, 7, 200_000])
def test_probabilities_of_a_position_sum_to_one_in_scores(spark, monkeypatch, held):
    """Without training the network is a unigram model: a text of one word has its probability times that of the end."""
    monkeypatch.setattr(op3, "ROUNDS", 0)
    monkeypatch.setattr(op3, "MAX_HELD", held)
    seen = [f"w{i} w{i % 9} x{i}y" for i in range(60)]
    every = sorted({w for t in seen for w in t.split()})
    unseen = {}
    for i in range(4000):
        w = f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}new{i}"
        unseen.setdefault(int(op3.tail_class(op3.Words([w.encode()]))[0]), w)
    assert len(unseen) == op3.TAILS
    learned = [(i, t, "en", "a") for i, t in zip((i for i in range(1000) if remainder(i, 7) != 2), seen)]
    out = (i for i in range(2000, 9000) if remainder(i, 7) == 2)
    asked = [(next(out), t, "en", "a") for t in ["", *every, *unseen.values()]]
    got = {r["doc_id"]: r["score"] for r in op3.score(spark, docs(spark, learned + asked)).collect()}
    end = 10 ** got[asked[0][0]]
    assert end + sum(10 ** got[i] / end for i, *_ in asked[1:]) == pytest.approx(1, abs=1e-4)


def test_means_of_weights_do_not_depend_on_arrival():
    import pandas as pd

    some = pd.DataFrame({"task": range(5), "tokens": [3, 10, 7, 1, 90], "weights": [op3.packed(_network(i)) for i in range(5)]})
    a, b = op3.averaged(some), op3.averaged(some.iloc[::-1])
    assert all((a[k] == b[k]).all() for k in a)


def test_documents_side_by_side_are_as_alone():
    m, r = _network(), np.random.default_rng(3)
    some = [np.append(r.integers(0, op3.END, n), op3.END) for n in (0, 5, 1, 70, 700)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in some])])
    together = op3.log_likelihoods(m, np.concatenate(some), at)
    for x, expected in zip(some, together):
        h, total, before = np.zeros((1, op3.STATE), np.float32), 0.0, op3.END
        s = op3.STATE
        for t in x:  # one step after another
            g, u = m["embed"][before] @ m["wx"] + m["b"], h @ m["wh"]
            z, w = op3.sigmoid(g[:s] + u[:, :s]), op3.sigmoid(g[s : 2 * s] + u[:, s : 2 * s])
            h = ((1 - z) * np.tanh(g[2 * s :] + w * u[:, 2 * s :]) + z * h).astype(np.float32)
            total += float(op3.outputs(h, np.array([t]), m)[0][0])
            before = t
        assert total == pytest.approx(expected, rel=1e-3, abs=1e-3)


def test_training_learns_an_order():
    stream = np.tile(np.array([5, 60, 110, 7, op3.END], np.int16), 6000)
    m = op3.fresh(np.zeros(op3.CLASSES), np.zeros((op3.HEADS, op3.EACH)))
    at = np.arange(0, 51, 5)
    before = op3.log_likelihoods(m, stream[:50].astype(np.int64), at).sum()
    for _ in range(8):
        m = op3.train(m, stream, 0.02)
    after = op3.log_likelihoods(m, stream[:50].astype(np.int64), at).sum()
    assert after > 0.3 * before


def test_training_learns_from_every_token(spark, monkeypatch):
    """However many training tokens there are, told as a thousand times as many here."""
    rows = table(spark, SF, "documents").select("doc_id", "text")
    v, class_log, word_log = op3.vocabulary(op3.count_tokens(rows).cache())
    learned, averaged = [], op3.averaged

    def seen(pdf):
        learned.append(int(pdf["tokens"].sum()))
        return averaged(pdf)

    monkeypatch.setattr(op3, "averaged", seen)
    op3.trained(spark, rows, dataclasses.replace(v, tokens=1000 * v.tokens), op3.fresh(class_log, word_log), Scratch(spark, "test-training"))
    assert len(learned) == op3.ROUNDS and sum(learned) >= v.tokens


@pytest.mark.parametrize("n", [2, 130, 300, 4500])
def test_training_predicts_every_token(monkeypatch, n):
    """Each token of a stream but the first, also where the lanes don't come out even."""
    told, outputs = [], op3.outputs
    monkeypatch.setattr(op3, "outputs", lambda h, target, *more: told.append(target) or outputs(h, target, *more))
    stream = np.arange(n) % op3.END
    op3.train(op3.fresh(np.zeros(op3.CLASSES), np.zeros((op3.HEADS, op3.EACH))), stream.astype(np.int16))
    got = Counter(np.concatenate(told).tolist())
    assert all(got[t] >= c for t, c in Counter(stream[1:].tolist()).items())


# Line rules


def plain_rules(rows):
    def xx(strings):
        h = 42
        for s in strings:
            h = xxhash.xxh64_intdigest(s.encode(), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    import re

    measured = []
    for i, text, _, host in rows:
        text = text or ""
        w = words(text)
        windows = [xx(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if many[tuple(w[k : k + 8])] > 1 for j in range(8)}
        own = [x for x in text.split("\n") if words(x)]
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ") for x in own]
        measured.append((i, host, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered), min(windows) if windows else xx(w), list(zip(norm, map(len, own)))))
    held, docs_of = defaultdict(set), defaultdict(set)
    for _, host, *_, identity, own in measured:
        docs_of[host].add(identity)
        for x, _ in own:
            held[host, x].add(identity)
    out = []
    for i, host, n, chars, symbols, dup, repeat, _, own in measured:
        gone = [(x, k) for x, k in own if len(held[host, x]) > max(op4.MIN_DOCS, op4.DOC_SHARE * len(docs_of[host]))]
        total = sum(k for _, k in own)
        part = 1 - sum(k for _, k in gone) / total if total else 1.0
        failed = n < 20 or 100 * repeat > 30 * n
        out.append((i, n, chars, symbols, dup, repeat, failed, not failed and part >= op4.KEPT, len({x for x, _ in gone}), round(part, 9)))
    return sorted(out, key=str)


def rule_rows():
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    common = [prose(25), prose(30)]
    rows = [(i, "\n".join([common[0].upper() + " ", prose(40), prose(30), common[1]][: r.randrange(1, 5)]), "en", r.choice(["a", "a", "b", None])) for i in range(150)]
    rows += [(200 + i, common[0] + "\n\n \n" + common[1] + f" x{i % 2}", "en", "a") for i in range(6)]
    rows += [(300 + i, " ".join([prose(9)] * 3) + "\n" + prose(80) + "\r\nx # $\nx # $\n", "en", "a") for i in range(5)]
    return rows + odd_rows()


def test_rules(spark):
    rows = rule_rows()
    got = [(*tuple(r)[:9], round(r[9], 9)) for r in op4.rules(spark, docs(spark, rows, True)).collect()]
    expected = plain_rules(rows)
    assert sorted(got, key=str) == expected
    assert any(e[8] for e in expected) and any(not e[6] and not e[7] for e in expected)
    assert op4.rules(spark, docs(spark, [])).count() == 0


def test_rules_told_under_salts(spark, monkeypatch):
    monkeypatch.setattr(op4, "MAX_TOLD", 0)
    rows = rule_rows()
    got = [(*tuple(r)[:9], round(r[9], 9)) for r in op4.rules(spark, docs(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_rules(rows)


def test_cleaned(spark):
    rows = rule_rows()
    df = docs(spark, rows, True)
    out = op4.cleaned(spark, df)
    got = out.collect()
    verdict = Counter((e[0], e[1]) for e in plain_rules(rows) if e[7])
    assert out.columns == df.columns and len(got) == sum(verdict.values())
    common = rows[0][1].split("\n")[0].strip().lower()
    for r in got:
        if r["source"] == "a" and r["doc_id"] is not None and r["doc_id"] < 150:
            assert common not in r["text"].lower() and r["n_chars"] == len(r["text"])
    clean = [r for r in rows if r[0] is not None and 300 <= r[0]]
    assert {r["text"] for r in got if r["doc_id"] in [c[0] for c in clean]} <= {c[1] for c in clean}


def test_pages_around_one_passage_are_distinct_documents(spark):
    """Their smallest window is mostly one of the passage, yet they are all different texts."""
    r = random.Random(7)
    prose = lambda n: " ".join(f"w{r.randrange(30_000)}" for _ in range(n))
    shared = prose(300)
    rows = [(i, shared + "\n" + prose(12), "en", "a") for i in range(100)]
    copied = prose(60)
    rows += [(1000 + i, copied, "en", "b") for i in range(100)]  # one document
    got = {r["doc_id"]: r for r in op4.rules(spark, docs(spark, rows)).collect()}
    assert all(got[i]["removed_lines"] == 1 and not got[i]["kept"] for i in range(100))
    assert all(got[1000 + i]["removed_lines"] == 0 and got[1000 + i]["kept"] for i in range(100))


def test_long_lines_of_a_large_host(spark, monkeypatch):
    """In under 2 % of the host's documents, but in more than the absolute limit."""
    monkeypatch.setattr(op4, "MOST_DOCS", 25, raising=False)
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(30_000)}" for _ in range(n))
    long, short = prose(40), prose(3)
    rows = [(i, prose(22) + (f"\n{long}\n{short}" if i < 30 else ""), "en", "a") for i in range(2000)]
    got = {r["doc_id"]: r["removed_lines"] for r in op4.rules(spark, docs(spark, rows)).collect()}
    assert got == {i: int(i < 30) for i in range(2000)}


# Mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from([None, *"abcdefg"]), st.integers(0, 1000), min_size=1))
def test_targets(sizes):
    out = op8.targets(sizes)
    assert out.keys() == sizes.keys() and sum(out.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(out[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    names = sorted(s for s in sizes if s) + [None] * (None in sizes)
    level = [out[s] / op8.WEIGHTS[i % 3] for i, s in enumerate(names) if out[s] < 2 * sizes[s] - 1e-6]
    assert not level or max(level) - min(level) < 1e-6 * max(1, max(level))


def test_mix(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(0, 60))), "en", r.choice(["s1", "s1", "s1", "s2", "s3", "é", "Z", None])) for i in range(400)]
    df = docs(spark, rows, True)
    got = op8.mix(spark, df).collect()
    sizes = defaultdict(int)
    source = {i: s for i, _, _, s in rows}
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    goal = op8.targets(dict(sizes))
    taken = defaultdict(int)
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(goal[s]) and 0 <= x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = op8.mix(spark, df.repartition(7)).collect()
    assert sorted(got) == sorted(again)


def test_mix_of_odd_rows(spark):
    rows = docs(spark, odd_rows(), True).withColumn("kept_size", F.lit("also"))
    got = op8.mix(spark, rows, ["doc_id", "text", "size", "kept_size", "taken"])
    assert got.columns == ["text", "kept_kept_size", "kept_size", "kept_taken", "doc_id", "size", "source_size", "target", "taken"] and len(got.collect()) == len(odd_rows())
    assert {(r["kept_kept_size"], r["kept_size"], r["kept_taken"]) for r in got.collect()} == {("other", "also", "other")}
    same = docs(spark, [(1, "a b c", "en", "s")] * 9 + [(2, "a", "en", "t")])
    rows = rows_of(op8.mix(spark, same))
    assert len(rows) == 10 and all(r[4] <= 2 * r[1] for r in rows)
    assert rows_of(op8.mix(spark, docs(spark, []))) == []


def test_mix_of_many_sources(spark, monkeypatch):
    """Sources dealt under salts give the same as sources told to all tasks."""
    r = random.Random(11)
    df = docs(spark, [(i, " ".join("w" for _ in range(r.randrange(30))), "en", f"s{r.randrange(60)}" if i % 3 else "hot") for i in range(500)])
    told = rows_of(op8.mix(spark, df))
    monkeypatch.setattr(op8, "MAX_TOLD", 0)
    assert sorted(rows_of(op8.mix(spark, df))) == sorted(told)


# Pipeline


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, very long texts, columns named as the stages' own, and an empty table, through each stage and all of them."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"the word {i % 977} of tail{i % 31}" for i in range(8000))
    rows = odd_rows() + [(50 + i, f"the quick brown fox number {i} jumps over the lazy dog and runs into the woods where it finds some other animals of number {i}\n{long[:4000]}", "en", "a") for i in range(4)]
    names = ["taken", "size", "target", "source_size", "gone", "again", "bad_text_key", "host", "k1", "left", "frequent", "split", "_0", "_3", "cls", "rows"]
    for some in (rows, []):
        df = docs(spark, some).withColumns({c: F.lit(c) for c in names})
        folder = tmp_path / str(len(some))
        df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        table(spark, SF, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(folder))
            assert len(set(out.columns)) == len(out.columns), name
            assert name == "mixture" or out.columns == now.columns, name
            assert out.count() <= now.count()
            for r in out.collect():
                assert all(r[c] == c for c in names if c not in ("taken", "size", "target", "source_size") or name != "mixture"), name
        got = corpus_pipeline.run(spark, str(folder))
        assert {"taken", "kept_taken", "size", "kept_size"} <= set(got.columns) and (got.count() > 0) == bool(some)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_op7 import brute

    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    before = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    scratch, now = Scratch(spark, "test-pipeline"), table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, now, SF))
        assert after.columns == now.columns
        old, new = ({r["doc_id"]: r for r in x.collect()} for x in (now, after))
        assert new.keys() <= old.keys()
        if name == "line rules":
            kept = {e[0] for e in plain_rules([(i, r["text"], r["lang"], r["source"]) for i, r in old.items()]) if e[7]}
            assert new.keys() == kept
        if name == "near duplicates":
            assert new.keys() == {i for i, (_, c) in brute([(i, r["text"]) for i, r in old.items()], 5, 80).items() if i == c}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            assert old.keys() - new.keys() == {p[0] for p in plain_pairs([(i, r["text"]) for i, r in old.items()], items)}
        now = after
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in now.collect()} <= before.keys()
    assert all(r["taken"] > 0 for r in got)
