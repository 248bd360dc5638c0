"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (in all, in the densest stretch, near words that address a second person),
capitals, punctuation and obfuscation rates, lengths. The lexicon holds words and word beginnings that mark toxic texts; it is
learned from the same labelled rows. Scores are calibrated out of fold: for each fold, a lexicon and trees are learned from the
rows of the other folds only.

Null and empty texts have features of 0 and get a score like others. Null doc_id: scored, not held out, not learned from.
Several labels for one doc_id: the largest counts; several texts: the one of the smallest hash is learned from. Repeated rows:
one result each. No labels to learn from: score 0. Equal features get equal scores. Texts of any length are read to their end,
a text above a piece's size alone. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_remainder, remainder
from .textvec import Words, pieces

#: Labelled rows to learn from at most, chosen by hash; lexicon entries at most.
MAX_TRAIN, MAX_LEXICON = 12_000, 4000
#: Lengths in bytes of word beginnings that can be lexicon entries.
STEMS = (4, 5, 6)
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
FEATURES = 16
#: Parts of the labelled rows for calibration.
FOLDS = 3
#: Words that address a second person.
SECOND = b"you your yours yourself ya u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split()
#: Insults that the lexicon holds from the start.
INSULTS = b"idiot idiots idiotic moron morons moronic stupid scum loser losers pathetic worthless trash disgusting clown imbecile jerk bastard filthy vermin".split()
NEAR, STRETCH = 5, 50
#: Log likelihood ratio that a lexicon entry needs.
EVIDENCE = 12


@dataclass
class Lexicon:
    words: np.ndarray
    stems: dict[int, np.ndarray]


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


_TRIM = np.frombuffer(b".,;:!?\"'()[]", np.uint8)


def trimmed(w: Words) -> Words:
    """Words without punctuation at their ends."""
    mark = np.zeros(256, bool)
    mark[_TRIM] = True
    for _ in range(3):
        w.end = w.end - (mark[w.buf[w.end - 1]] & (w.end - w.start > 1))
        w.start = w.start + (mark[w.buf[w.start]] & (w.end - w.start > 1))
    return w


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    w = trimmed(Words(texts))
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    n_docs, h = len(texts), w.hashes()
    of = np.repeat(np.arange(n_docs), np.diff(w.at))
    n, size = np.maximum(np.diff(w.at), 1).astype(float), np.maximum(np.diff(w.offset) - 1, 1).astype(float)

    by_byte = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), w.offset[:-1])
    by_word = lambda mask: np.bincount(of[mask], minlength=n_docs)
    exact = within(h, lexicon.words)
    stem = np.zeros(len(h), bool)
    for k, known in lexicon.stems.items():
        stem |= within(w.prefix(k), known)
    bad = exact | stem
    you = within(h, _SECOND)
    run = np.concatenate([[0], np.cumsum(bad)])
    hi = np.minimum(np.arange(len(h)) + STRETCH, w.at[of + 1]) if len(h) else np.zeros(0, int)
    dense = np.zeros(n_docs)
    np.maximum.at(dense, of, run[hi] - run[:-1])
    seen = np.concatenate([[0], np.cumsum(you)])
    close = bad & (seen[np.minimum(np.arange(len(h)) + NEAR + 1, w.at[of + 1])] > seen[np.maximum(np.arange(len(h)) - NEAR, w.at[of])])
    letter = ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    upper = (raw >= 0x41) & (raw <= 0x5A)
    digit = (raw >= 0x30) & (raw <= 0x39)
    odd = np.isin(raw, np.frombuffer(b"*@$#%&|<>=+_~^", np.uint8))
    inner = odd | digit
    inner[[0, -1]] = False
    inner[1:-1] &= (letter | upper)[:-2] & (letter | upper)[2:]
    twice = np.zeros(len(raw), bool)
    twice[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & letter[2:]
    any_letter = np.maximum(by_byte(letter | upper), 1)
    out = np.zeros((n_docs, FEATURES), np.float32)
    for j, column in enumerate([
        by_word(exact) / n, np.minimum(by_word(exact), 20), by_word(stem) / n, np.minimum(by_word(stem), 20), dense, by_word(close) / n, by_word(you) / n, by_byte(upper) / any_letter,
        by_byte(raw == 0x21) / size, by_byte(raw == 0x3F) / size, by_byte(odd) / size, by_byte(inner) / n, by_byte(twice) / n, by_byte(digit) / size, np.log1p(np.diff(w.at)), size / n,
    ]):
        out[:, j] = column
    out[np.diff(w.at) == 0] = 0
    return out


_SECOND = np.sort(Words([b" ".join(SECOND)]).hashes())
_SEED = np.sort(Words([b" ".join(INSULTS)]).hashes())


# Trees


@dataclass
class Boosted:
    lexicon: Lexicon
    start: float
    #: For each tree and inner node of a full tree: feature and threshold; for each leaf a value.
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    #: Steps of the calibration.
    at: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Trees of a logistic loss, grown level by level on histograms."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start, n_nodes = float(np.log(p / (1 - p))), 2**DEPTH - 1
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)], 1)
    feature, threshold, leaf = np.zeros((TREES, n_nodes), np.int64), np.full((TREES, n_nodes), np.inf, np.float32), np.zeros((TREES, 2**DEPTH))
    f = np.full(len(y), start)
    for t in range(TREES):
        q = 1 / (1 + np.exp(-f))
        g, hess, node = y - q, q * (1 - q), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-6)
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key = (node - first) * BINS + binned[:, j]
                gs, hs = (np.cumsum(np.bincount(key, v, width * BINS).reshape(width, BINS), 1) for v in (g, hess))
                gl, hl, ga, ha = gs[:, : len(cut)], hs[:, : len(cut)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < 0.5) | (ha - hl < 0.5)] = 0
                for k in np.flatnonzero(gain.max(1) > best):
                    best[k] = gain[k].max()
                    feature[t, first + k], threshold[t, first + k] = j, cut[gain[k].argmax()]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        node -= n_nodes
        leaf[t] = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, hess, 2**DEPTH) + 1)
        f += leaf[t][node]
    return start, feature, threshold, leaf


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the places and values of a rising function; each block is smoothed by one count of its kind."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-1][2] == blocks[-2][3] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    at = np.array([p for b in blocks for p in (b[2], b[3] + 1e-9)])
    return at, np.maximum.accumulate(np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks for _ in (0, 1)]))


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: Lexicon) -> Boosted:
    """Calibrates on scores of trees grown without the fold, then grows trees on all rows.

    x: (row, lexicon, feature), by the lexicon learned without each fold, and last by the one learned from all rows.
    """
    if not len(y):
        return Boosted(lexicon, 0.0, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), np.array([0.0]), np.array([0.0]))
    apart = np.zeros(len(y))
    for k in range(FOLDS):
        here = fold == k
        if here.any() and (~here).any():
            apart[here] = Boosted(lexicon, *boost(x[~here, k], y[~here]), np.zeros(1), np.zeros(1)).raw(x[here, k])
    return Boosted(lexicon, *boost(x[:, -1], y), *isotonic(apart, y))


# Over Spark


def labelled(docs: DataFrame, labels: DataFrame, target: str, limit: int = MAX_TRAIN) -> DataFrame:
    """doc_id, y, text of at most limit labelled documents to learn from, the first by a hash of the id; one text of each."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    some = rows.groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(limit)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    found = texts.join(F.broadcast(some), "doc_id")  # limit bounds it
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))


def learn_lexicons(rows: DataFrame, scratch: Scratch) -> list[Lexicon]:
    """Words and word beginnings that many more toxic than other texts hold: a lexicon from all but each fold, and last the one from all rows."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                w, y, fold = trimmed(Words(texts)), np.array(part.column("y").to_pylist(), np.int64), np.array(part.column("fold").to_pylist(), np.int64)
                of = np.repeat(np.arange(len(texts)), np.diff(w.at))
                for kind, keys in [(0, w.hashes()), *((k, w.prefix(k)) for k in STEMS)]:
                    order = np.argsort(keys, kind="stable")
                    k, d = keys[order], of[order]
                    first = (np.diff(k, prepend=0) != 0) | (np.diff(d, prepend=-1) != 0)
                    first &= k != 0
                    k, d = k[first], d[first]
                    for f in range(FOLDS):
                        mine = fold[d] == f
                        key, at = np.unique(k[mine], return_inverse=True)
                        toxic = np.bincount(at, y[d[mine]], len(key)).astype(np.int64)
                        yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(key), pa.int32()), "key": key.view(np.int64), "fold": pa.array([f] * len(key), pa.int32()), "toxic": toxic, "n": np.bincount(at, minlength=len(key)).astype(np.int64)})

    totals = {r["fold"]: (r["y"], r["n"]) for r in rows.groupBy("fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()}
    of_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in range(FOLDS) for c in ("toxic", "n")]
    found = scratch.keep(rows.mapInArrow(entries, "kind int, key long, fold int, toxic long, n long").groupBy("kind", "key").agg(*of_fold))
    lexicons = []
    for apart in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != apart]
        toxic = float(sum(totals.get(k, (0, 0))[0] for k in folds))
        clean = sum(totals.get(k, (0, 0))[1] for k in folds) - toxic
        if not toxic or not clean:
            lexicons.append(Lexicon(_SEED, {}))
            continue
        own = found.select("kind", "key", *(sum((F.col(f"{c}_{k}") for k in folds), F.lit(0)).alias(c) for c in ("toxic", "n")))
        odds = F.log((F.col("toxic") + 0.1) / toxic) - F.log((F.col("n") - F.col("toxic") + 0.5) / clean)
        other = F.col("n") - F.col("toxic")
        evidence = F.col("toxic") * F.log(F.col("toxic") / F.col("n") / (toxic / (toxic + clean))) + F.when(other > 0, other * F.log(other / F.col("n") / (clean / (toxic + clean)))).otherwise(0.0)
        marks = own.where("toxic > 0").withColumns({"odds": odds, "evidence": evidence}).where((F.col("toxic") >= 0.004 * toxic) & (F.col("odds") > 2.5) & (F.col("evidence") > EVIDENCE))
        top = marks.orderBy(F.desc("evidence"), "kind", "key").limit(MAX_LEXICON).toPandas()
        of = {kind: np.sort(top["key"][top["kind"] == kind].to_numpy(np.int64).view(np.uint64)) for kind in (0, *STEMS)}
        lexicons.append(Lexicon(np.union1d(of[0], _SEED), {k: of[k] for k in STEMS}))
    scratch.drop(found)
    return lexicons


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Boosted:
    scratch = Scratch(docs.sparkSession, "toxicity")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = scratch.keep(labelled(docs, labels, "toxic", limit).withColumn("fold", fold))
    lexicons = learn_lexicons(rows, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                x = np.concatenate([features(texts, lexicon) for lexicon in lexicons], 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("fold"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "fold", "x"])

    got = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, fold int, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    scratch.drop(rows)
    x = np.stack(got["x"]) if len(got) else np.zeros((0, (FOLDS + 1) * FEATURES), np.float32)
    return train(x.reshape(len(got), FOLDS + 1, FEATURES), got["y"].to_numpy(float), got["fold"].to_numpy(), lexicons[-1])


def score(docs: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                s = model.score(features(texts, model.lexicon))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", is_remainder(F.col("doc_id"), 5, 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
