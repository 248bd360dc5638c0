"""Toxicity, quality, language, licences, URL rules: plain versions, held-out accuracy, odd rows."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import op1_toxicity, op5_language, op6_urls, op9_licenses, op10_quality
from quadrille.llm.common import table
from quadrille.llm.queries import URL_RULES, queries
from quadrille.llm.textvec import ALNUM, PLAIN, Words

from ..conftest import DATA
from .util import LOWER, docs, odd_rows, remainder, rows_of, words

SF = f"{DATA}/sf0.01"


# Words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB\t \n\u00e9\u65e5\x00!9\x1f\x85"), max_size=40), min_size=1, max_size=6))
def test_words(texts):
    blobs = [t.encode() for t in texts]
    w = Words(blobs, PLAIN)
    h = w.hashes()
    seen = {}
    for k, t in enumerate(texts):
        own = [x.encode() for x in words(t.translate(LOWER))]
        a, b = w.at[k], w.at[k + 1]
        assert [w.text(i) for i in range(a, b)] == own
        for i, x in zip(range(a, b), own):
            assert seen.setdefault(x, h[i]) == h[i]
    assert len(set(map(int, seen.values()))) == len(seen)


def test_long_words_differ():
    w = Words([b"a" * 5000, b"a" * 4999 + b"b", b"a" * 4999, b"a" * 9 + b" " + b"a" * 8], ALNUM)
    assert len(set(w.hashes().tolist())) == 5


# Toxicity and quality


@pytest.mark.parametrize(("name", "target", "accuracy"), [("op1_toxicity_gbt", "toxic", 0.9), ("op10_quality_cnn", "quality", 0.9)])
def test_held_out_accuracy(spark, name, target, accuracy):
    out = queries()[name](spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = out.toPandas()
    assert len(got) == table(spark, SF, "documents").count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: remainder(i, 5) == 0)).all()
    cut = 0.5 if target == "toxic" else 0.3
    assert (got["predicted"] == (got["score"] >= cut)).all()
    both = got[got["held_out"]].merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    assert (both["predicted"] == both[target]).mean() >= accuracy


@pytest.mark.parametrize("op", [op1_toxicity, op10_quality])
def test_odd_rows_and_no_labels(spark, op):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None), (6, 0, 0), (9, 7, 7)], "doc_id long, quality int, toxic int")
    rows = docs(spark, odd_rows(), True)
    for some in (labels, labels.limit(0)):
        out = op.score(rows, op.fit(rows, some)).toPandas()
        assert len(out) == len(odd_rows()) and out["score"].between(0, 1).all() and out["held_out"].notna().all()
        assert np.ptp(out[out["doc_id"] == 1]["score"]) < 1e-5
    empty = docs(spark, [])
    assert op.score(empty, op.fit(empty, labels)).count() == 0


def plain_features(text, lexicon_words, stems):
    """The features of one text, word by word and byte by byte."""
    own = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.lower() if text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in text)):
        for _ in range(3):
            if len(w) > 1 and w[-1] in b".,:;!?\"'()[]":
                w = w[:-1]
            if len(w) > 1 and w[0] in b".,:;!?\"'()[]":
                w = w[1:]
        own.append(w)
    if not own:
        return [0.0] * op1_toxicity.FEATURES
    exact = [w in lexicon_words for w in own]
    stem = [any(len(w) >= k and w[:k] in some for k, some in stems.items()) for w in own]
    bad = [a or b for a, b in zip(exact, stem)]
    you = [w in op1_toxicity.SECOND for w in own]
    dense = max(sum(bad[i : i + op1_toxicity.STRETCH]) for i in range(len(own)))
    close = sum(b and any(you[max(0, i - op1_toxicity.NEAR) : i + op1_toxicity.NEAR + 1]) for i, b in enumerate(bad))
    upper, lower, digit, odd = ([a(b) for b in text] for a in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122 or b >= 128, lambda b: 48 <= b <= 57, lambda b: b in b"*@$#%&|<>=+_~^"))
    letter = [a or b for a, b in zip(upper, lower)]
    inner = sum((odd[i] or digit[i]) and letter[i - 1] and letter[i + 1] for i in range(1, len(text) - 1))
    twice = sum(lower[i] and text[i] == text[i - 1] == text[i - 2] for i in range(2, len(text)))
    n, size, letters = len(own), len(text), max(1, sum(letter))
    return [sum(exact) / n, min(20, sum(exact)), sum(stem) / n, min(20, sum(stem)), dense, close / n, sum(you) / n, sum(upper) / letters, text.count(b"!") / size, text.count(b"?") / size, sum(odd) / size, inner / n, twice / n, sum(digit) / size, np.log1p(n), size / n]


def test_features_by_brute_force():
    r = np.random.default_rng(3)
    some = [b"you", b"You,", b"idiot!", b"(IDIOTIC)", b"fool", b"foolish", b"tree", b"n1ce", b"st*pid", b"\xc3\xa9t\xc3\xa9", b"42", b"sooo", b"...", b"?", b"AAA", b"a"]
    texts = [b" ".join(some[i] for i in r.integers(0, len(some), n)) for n in r.integers(0, 90, 40)] + [b"", b" ", b"4x", b"idiot", b"you", b"1a2", b"\n!\n"]
    r.shuffle(texts)
    words_, stems = {b"idiot", b"fool"}, {4: {b"idio"}, 5: {b"st*pi"}, 6: set()}
    of = lambda some: np.sort(Words([b" ".join(some)]).hashes())
    lexicon = op1_toxicity.Lexicon(of(words_), {k: np.sort(Words([b" ".join(v)]).prefix(k)) for k, v in stems.items()})
    for batch in (texts, texts[7:], texts[-1:]):
        assert op1_toxicity.features(batch, lexicon) == pytest.approx(np.array([plain_features(t, words_, stems) for t in batch]), rel=1e-5)


def test_trees_by_brute_force(monkeypatch):
    monkeypatch.setattr(op1_toxicity, "TREES", 4)
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 3)).astype(np.float32)
    y = 1 / (1 + np.exp(-3 * (x[:, 0] + x[:, 1] ** 2 + r.normal(size=150) - 0.8)))  # not 0 or 1, so that no two cuts are equally good
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, op1_toxicity.BINS + 1)[1:-1]).astype(np.float32)) for c in x.T]
    p = y.mean()
    f = [float(np.log(p / (1 - p)))] * len(y)

    def grow(rows, depth, g, h):
        """The change of each row's value."""
        if depth == op1_toxicity.DEPTH:
            return {i: op1_toxicity.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1) for i in rows}
        best, cut_at = 1e-6, None
        part = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + 1)
        for j, cut in enumerate(cuts):
            for c in cut:
                left, right = [i for i in rows if x[i, j] <= c], [i for i in rows if x[i, j] > c]
                gain = part(left) + part(right) - part(rows)
                if min(sum(h[i] for i in left), sum(h[i] for i in right)) >= 0.5 and gain > best + 1e-12:
                    best, cut_at = gain, (j, c)
        if cut_at is None:
            return grow(rows, depth + 1, g, h)
        j, c = cut_at
        return grow([i for i in rows if x[i, j] <= c], depth + 1, g, h) | grow([i for i in rows if x[i, j] > c], depth + 1, g, h)

    for _ in range(4):
        q = [1 / (1 + np.exp(-v)) for v in f]
        change = grow(range(len(y)), 0, [a - b for a, b in zip(y, q)], [b * (1 - b) for b in q])
        f = [v + change[i] for i, v in enumerate(f)]
    model = op1_toxicity.Boosted(op1_toxicity.Lexicon(np.zeros(0, np.uint64), {}), *op1_toxicity.boost(x, y), np.zeros(1), np.zeros(1))
    assert model.raw(x) == pytest.approx(np.array(f), abs=1e-6)


def test_calibration_does_not_see_the_fold(spark):
    """A word that marks toxic texts of one fold only is in the lexicons of the others' rows, not in the one learned without that fold."""
    rows = [(i, f"mark{i % 3} " * 3 + "plain words here" if i % 2 else "plain words there", i % 2, i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, fold int").selectExpr("doc_id", "cast(text as binary) as text", "y", "fold")
    lexicons = op1_toxicity.learn_lexicons(df, op1_toxicity.Scratch(spark, "test"))
    holds = [[bool(np.isin(Words([b"mark%d" % k]).hashes(), x.words)[0]) for k in range(3)] for x in lexicons]
    assert holds == [[False, True, True], [True, False, True], [True, True, False], [True, True, True]]


def test_repeated_ids_give_one_text_to_learn_from(spark):
    rows = docs(spark, [(i, f"text {i} {k}", "en", "a") for i in (1, 2, 3) for k in range(50)])
    labels = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3)] * 2, "doc_id long, quality int, toxic int")
    got = op1_toxicity.labelled(rows, labels, "toxic").collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in (1, 2, 3) if remainder(i, 5)]


def test_network_by_brute_force():
    m = {k: v.astype(float) for k, v in op10_quality.fresh().items()}
    m["bias"] += 0.1
    texts = [b"", b"ab", "à b ç".encode() * 150, bytes(range(256)) * 3]
    c, hop, wide = op10_quality.CHUNK, op10_quality.HOP, op10_quality.WIDTH
    expected = []
    for t in texts:
        chunks, at = [], 0
        while not at or at - hop + c < len(t):
            chunks.append(t[at : at + c].ljust(c, b" "))
            at += hop
        values = []
        for chunk in chunks:
            seen = [np.concatenate([m["embed"][b] for b in chunk[k : k + wide]]) @ m["filters"] for k in range(0, c - wide + 1, op10_quality.STEP)]
            values.append(np.maximum(np.max(seen, 0) + m["bias"], 0))
        z = np.concatenate([np.mean(values, 0), np.max(values, 0)]) @ m["out"] + m["out_bias"][0]
        expected.append(1 / (1 + np.exp(-z)))
    assert op10_quality.probability(texts, {k: v.astype(np.float32) for k, v in m.items()}) == pytest.approx(expected, abs=1e-5)


def test_isotonic_rises():
    r = np.random.default_rng(1)
    s = r.normal(size=500).round(1)
    at, value = op1_toxicity.isotonic(s, (r.random(500) < 1 / (1 + np.exp(-s))).astype(float))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


def test_chunks_cover_the_text():
    texts = [b"", b"x", bytes(range(256)) * 9, b"y" * op10_quality.CHUNK]
    chunks, of = op10_quality.chunked(texts)
    for k, t in enumerate(texts):
        own = chunks[of == k]
        whole = b"".join([own[0].tobytes()] + [c[op10_quality.CHUNK - op10_quality.HOP :].tobytes() for c in own[1:]])
        assert whole.rstrip(b" ") == t.rstrip(b" ") and len(own) >= 1


def test_gradient_of_the_network():
    m = {k: v.astype(np.float32) for k, v in op10_quality.fresh().items()}
    texts, y = [b"alpha beta " * 70, b"gamma", b"delta ### " * 90], np.array([1, 0, 1], np.float32)
    chunks, of = op10_quality.chunked(texts)
    g = op10_quality.gradients(chunks, of, y, m)

    def loss():
        z = op10_quality.joined(op10_quality.pooled(chunks, m), of) @ m["out"] + m["out_bias"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for k, at in (("out", (3,)), ("bias", (2,)), ("filters", (5, 4)), ("embed", (ord("a"), 1)), ("out_bias", (0,))):
        old, step = m[k][at], 1e-2
        m[k][at] = old + step
        up = loss()
        m[k][at] = old - step
        down = loss()
        m[k][at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3 + 0.1 * abs(g[k][at]), k


# Language


def test_languages(spark):
    got = queries()["op5_language_mixture"](spark, SF).toPandas()
    both = got.merge(table(spark, SF, "documents").toPandas()[["doc_id", "lang"]], on="doc_id")
    assert len(both) == 1000 and both["score"].between(0, 1).all()
    assert (both["held_out"] == both["doc_id"].map(lambda i: remainder(i, 4) == 2)).all()
    assert (both["lang"] == both["lang_pred"])[both["held_out"]].mean() > 0.98


def test_language_of_odd_rows(spark):
    model = op5_language.fit(table(spark, SF, "documents"))
    rows = docs(spark, [*odd_rows(), (20, "1234 !!", "en", "a"), (21, "日本", "en", "a")], True)
    got = {r["doc_id"]: r for r in op5_language.identify(rows, model).collect()}
    assert {i: got[i]["lang_pred"] for i in (2, 3, 5, 20)} == dict.fromkeys((2, 3, 5, 20), "und")
    assert got[21]["lang_pred"] != "und" and got[2]["score"] == 0
    kept = op5_language.accepted(rows, model)
    assert kept.columns == rows.columns and 2 not in [r["doc_id"] for r in kept.collect()]
    nothing = op5_language.fit(docs(spark, []))
    assert {r["lang_pred"] for r in op5_language.identify(rows, nothing).collect()} == {"und"}


def test_mixture_of_two(spark):
    model = op5_language.fit(table(spark, SF, "documents"))
    by = {}
    for r in table(spark, SF, "documents").select("lang", "text").collect():
        by[r["lang"]] = by.get(r["lang"], "") + r["text"][:400] * (len(by.get(r["lang"], "")) < 6000)
    _, score, sets = op5_language.judge([(by["en"][:3000] + " " + by["de"][:3000]).encode()], model)
    assert {x.split(":")[0] for x in sets[0].split(",")} == {"en", "de"} and 0.35 < score[0] < 0.65


def plain_mixture(counts, log_p):
    """A text's proportions by expectation-maximisation, one number after another."""
    languages, n = range(len(log_p)), max(sum(counts), 1)

    def settle(share, rounds):
        for _ in range(rounds):
            new = [0.0] * len(share)
            for b, c in enumerate(counts):
                if c:
                    p = [share[j] * np.exp(float(log_p[j][b])) for j in languages]
                    for j in languages:
                        new[j] += c * p[j] / sum(p)
            share = [x / max(sum(new), 1e-30) for x in new]
        return share, sum(c * np.log(sum(share[j] * np.exp(float(log_p[j][b])) for j in languages)) for b, c in enumerate(counts) if c)

    alone = [sum(c * float(log_p[j][b]) for b, c in enumerate(counts) if c) for j in languages]
    first = max(languages, key=lambda j: alone[j])
    best, value = [float(j == first) for j in languages], alone[first] - op5_language.PENALTY * np.log(n)
    every, _ = settle([1 / len(log_p)] * len(log_p), op5_language.ROUNDS)
    order, failed = sorted(languages, key=lambda j: -every[j]), 0
    for k in range(2, len(log_p) + 1):
        some = [every[j] if j in order[:k] else 0.0 for j in languages]
        some, likely = settle([x / max(sum(some), 1e-30) for x in some], op5_language.ROUNDS // 2)
        if (new := likely - op5_language.PENALTY * k * np.log(n)) > value:
            best, value, failed = some, new, 0
        else:
            failed += 1
            if failed == op5_language.FAILS:
                break
    return best


def test_mixtures_by_brute_force(spark):
    model = op5_language.fit(table(spark, SF, "documents"))
    by = {}
    for r in table(spark, SF, "documents").select("lang", "text").collect():
        by[r["lang"]] = by.get(r["lang"], "") + " " + r["text"][:400] * (len(by.get(r["lang"], "")) < 9000)
    some = [by["en"][:300], by["de"][:2500] + by["fr"][:900], " ".join(by[x][:2200] for x in sorted(by)), "ab", ""]
    grams = op5_language.trigrams([x.encode() for x in some])
    got = op5_language.mixtures(grams, model.log_p)
    for counts, share in zip(grams, got):
        assert share == pytest.approx(plain_mixture(counts.tolist(), model.log_p), abs=2e-3)
    assert (got[2] > 0.05).sum() == 4  # four languages in one text


def test_mixture_of_many_languages():
    """Sets aren't limited to a few languages: here a text has as many as there are."""
    r = np.random.default_rng(3)
    log_p = np.log(np.eye(9, op5_language.BUCKETS).repeat(1, 0) * 0.9 + 0.1 / op5_language.BUCKETS + r.random((9, op5_language.BUCKETS)) * 1e-6).astype(np.float32)
    grams = np.zeros((2, op5_language.BUCKETS), np.int64)
    grams[0, :7], grams[1, 4] = 200, 50
    share = op5_language.mixtures(grams, log_p)
    assert (share[0] > 0.1).sum() == 7 and share[1].argmax() == 4 and share[1].max() > 0.99


# URL rules


HOSTS = st.lists(st.sampled_from(["a", "b", "net", "example", "B", "", "x\x01"]), max_size=4).map(".".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(HOSTS, st.sampled_from(["", "/", "/a", "/a/b", "/b", "/a/a/b"])), max_size=25), st.lists(st.tuples(HOSTS.filter(bool), st.sampled_from(["/", "/a", "/a/", "/a/a", "/b/b", ""]), st.sampled_from(["block", "allow"])), max_size=8))
def test_sweep(urls, rules):
    rules = [op6_urls.Rule(h.lower(), p, v) for h, p, v in rules if "\x01" not in h]
    urls = [(h.lower(), p) for h, p in urls]
    s = op6_urls.Sweep(rules)
    for key, host, path in sorted((op6_urls.turned(h), h, p) for h, p in urls):
        s.to(key)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=op6_urls.better, default=None)
        got = s.best(path)
        assert (got and (got.text, got.verdict)) == (best and (best.text, best.verdict))


def test_urls(spark):
    urls = ["http://WWW.Example.net/en/1?x#y", "https://a.net", "https://a.net/", None, "no scheme", "x://y.org/fr/#/a", "x://net/?", "x://notnet/", "x://example.com/de/?q", "://", "a://b://c.net/"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*urls, urls[0]])] + [(None, urls[0], None, None)], "page_id long, url string, key string, host string")
    expected = [("www.example.net", "/en/1", "example.net/en/", "allow"), ("a.net", "", None, "allow"), ("a.net", "/", "net/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("y.org", "/fr/", "org/fr/", "allow"), ("net", "/", "net/", "block"), ("notnet", "/", None, "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("", "", None, "allow"), ("b:", "//c.net/", None, "allow")]
    table_ = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    for got in (op6_urls.judge(pages, URL_RULES), op6_urls.judge_by_table(pages, table_)):
        rows = sorted(rows_of(got), key=str)
        assert rows == sorted([(i, *e) for i, e in enumerate([*expected, expected[0]])] + [(None, *expected[0])], key=str)
    assert op6_urls.judge(pages.limit(0), []).count() == 0


# Licences


def plain_scan(text):
    text = (text or "").translate(LOWER)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at, labels = [], set()
    for phrase, label in op9_licenses.BASE.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    texts = ["CC BY cc-by cc by-nc 4", "All Rights\nReserved. general public licences General PUBLIC license", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nx", "SPDX-License-Identifier: MIT OR\n", None, "", "cc by", "ccby écc by", "a" * 30_000 + " all rights reserved"]
    rows = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)] + odd_rows(), True)
    got = op9_licenses.licenses(rows).collect()
    assert len(got) == len(texts) + len(odd_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] >= 8} | {r["doc_id"]: r for r in got[: len(texts)]}
    for i, t in enumerate(texts):
        assert tuple(by[i])[1:6] == plain_scan(t), i
        assert set(by[i]["base_labels"].split(",")) - {""} <= set(by[i]["labels"].split(",")) and 0 <= by[i]["score"] <= 1
    assert by[2]["labels"] == "apache-2.0,gpl-2.0 with classpath-exception-2.0,mit,terms:weak-copyleft" and by[2]["terms"] == "weak-copyleft"
    assert by[2]["expressions"] == ["mit apache-2.0 or gpl-2.0 classpath-exception-2.0 with and"]
    assert by[3]["labels"] == "unparsed" and by[3]["terms"] is None
    assert op9_licenses.licenses(docs(spark, [])).count() == 0


def _scan(expression):
    return op9_licenses.scan(f"x y\n// SPDX-License-Identifier: {expression}\nGPL-3.0".encode(), op9_licenses.automaton())


def test_the_value_of_an_expression_decides():
    both, either = _scan("MIT AND GPL-2.0"), _scan("MIT OR GPL-2.0")
    assert both[7] == "strong-copyleft" and either[7] == "permissive" and both[5] != either[5] and both[6] > either[6]
    assert _scan("(a OR MIT) AND (b OR BSD-3-Clause)")[7] == "permissive" and _scan("LGPL-2.1 AND nobody-knows")[7] == "restricted"
    assert _scan("CC-BY-4.0")[7] == "permissive" and _scan("CC-BY-NC-4.0")[7] == "restricted"
    many = " AND ".join(f"(a{i} OR b{i})" for i in range(40))  # 2 to the power of 40 alternatives
    assert _scan(many)[7] == "restricted" and len(_scan(many)[5].split(",")) == 81
    assert _scan(" OR ".join(["MIT"] * 50_000))[7] == "permissive"
    seven = op9_licenses.alternatives(" AND ".join(f"(a{i} OR b{i})" for i in range(7)))
    assert len(seven) == 128 and all(len(x) == 7 for x in seven)


def test_tags_are_read_where_they_stand():
    find = op9_licenses.automaton()
    assert op9_licenses.scan(b"spdx license identifier: MIT", find)[7] is None  # the words, but no tag
    two = op9_licenses.scan("é SPDX-License-Identifier:MIT\r\nspdx license identifier SPDX-LICENSE-IDENTIFIER: GPL-2.0".encode(), find)
    assert two[7] == "strong-copyleft" and two[8] == ["mit", "gpl-2.0"]


def test_licenses_of_the_table(spark):
    got = {r["doc_id"]: tuple(r)[1:6] for r in queries()["op9_license_scan"](spark, f"{DATA}/sf0.001").collect()}
    assert got == {r["doc_id"]: plain_scan(r["text"]) for r in table(spark, f"{DATA}/sf0.001", "documents").collect()}


@pytest.mark.parametrize(("text", "value"), [("MIT", [{"mit"}]), ("a AND b OR c", [{"a", "b"}, {"c"}]), ("a AND (b OR c)", [{"a", "b"}, {"a", "c"}]), ("a OR", None), ("", None), ("(a", None), ("a b", None), ("a)", None), ("a WITH (b OR c)", None), ("a OR a", [{"a"}])])
def test_expressions(text, value):
    got = op9_licenses.alternatives(text)
    assert (got and [set(x) for x in got]) == value
