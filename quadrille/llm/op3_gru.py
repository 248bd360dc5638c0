"""Language-model scoring by a gated recurrent network in numpy.

Counts of all training tokens are taken in the cluster. The commonest words have a place in the network: their classes are
predicted by one softmax, the words of a class by another. All other words belong to classes by how they begin, predicted
likewise; within such a class a word has its share of the training counts (plus one, with one place for words never seen). So
every text has a probability under one law.

Training is by truncated backpropagation: windows of token streams, with the state carried from one to the next. Every
training document is learned from, at any size of the input, in one of the rounds; each task trains on its part of a round's
documents, and weights are averaged, by tokens, after each round. The network starts from the counts, so that without any
training it is a unigram model.

Scoring runs through each whole document, window by window, with the state carried on, many documents side by side. Words that
aren't in the bounded table that all tasks hold meet the counts by a join.

Null and empty texts: the end token alone. Null doc_id: scored, neither held out nor learned from. Repeated rows: one result
each. No training rows: N = V = 0, all tokens alike in the base; the network is untrained. An empty table gives no rows. A very
long text is scored to its end, alone if it is longer than what is scored side by side. Only doc_id and text are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, is_remainder, remainder
from .textvec import Words, hold, mixed, pieces

#: Classes of common words and words of each; classes of other words; embedding and state.
HEADS, EACH, TAILS, EMBED, STATE = 32, 48, 32, 24, 32
#: Words that each task holds, about.
MAX_HELD = 200_000
#: Bits of a hash by which words are found.
FIRST_BITS = 20
#: Rounds, among which all training documents are dealt; streams and steps of a window; rate of learning.
ROUNDS, LANES, STEPS, RATE = 2, 128, 32, 0.006
#: Tokens of which a task counts the distinct ones before it passes counts on; bytes of text that are scored side by side.
COUNTED, ABREAST = 4_000_000, 16 << 20
#: Bounds of what goes into a softmax, so that no exponential overflows or vanishes.
SPAN = np.float32(60)
#: Rows of a product that are summed at a time.
BLOCK = 256
#: Counts in place of zero, for classes and places without a word.
NONE = 1e-20
#: Hash of the end token.
END_HASH = np.uint64(0)
END = HEADS * EACH + TAILS
CLASSES = HEADS + TAILS + 1

Weights = dict[str, np.ndarray]


def tail_class(w: Words) -> np.ndarray:
    return (mixed(w.prefix(2) + np.uint64(1)) >> np.uint64(64 - TAILS.bit_length() + 1)).astype(np.int32)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and beginnings' classes of all tokens, end tokens included, and where each text's tokens begin."""
    w = Words(texts)
    n = np.diff(w.at)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    h, cls = np.full(at[-1], END_HASH), np.full(at[-1], -1, np.int32)
    words = np.ones(at[-1], bool)
    words[at[1:] - 1] = False
    h[words], cls[words] = np.maximum(w.hashes(), np.uint64(1)), tail_class(w)
    return h, cls, at


# The network


def fresh(class_log: np.ndarray, word_log: np.ndarray, seed: int = 5) -> Weights:
    """Weights whose first predictions are the given logs (of any sum), whatever the state."""
    r = np.random.default_rng(seed)
    class_log, word_log = class_log - np.logaddexp.reduce(class_log), word_log - np.logaddexp.reduce(word_log, 1)[:, None]
    return {k: v.astype(np.float32) for k, v in {
        "embed": r.normal(0, 0.3, (END + 1, EMBED)), "wx": r.normal(0, EMBED**-0.5, (EMBED, 3 * STATE)), "wh": r.normal(0, STATE**-0.5, (STATE, 3 * STATE)), "b": np.zeros(3 * STATE),
        "wc": np.zeros((STATE, CLASSES)), "bc": class_log, "ww": np.zeros((HEADS, STATE, EACH)), "bw": word_log,
    }.items()}


def class_of(token: np.ndarray) -> np.ndarray:
    return np.where(token < HEADS * EACH, token // EACH, token - HEADS * EACH + HEADS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for many rows, in blocks of rows, which are quicker than one product."""
    n = len(a) // BLOCK * BLOCK
    out = np.matmul(a[:n].reshape(-1, BLOCK, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, BLOCK, b.shape[1])).sum(0)
    return out if n == len(a) else out + a[n:].T @ b[n:]


def softmax(z: np.ndarray, of: np.ndarray, w: np.ndarray, back: bool) -> np.ndarray:
    """Log of the share of each row's place `of` among the logits z, made of states and w; if back, z becomes the gradient of the negative sum by the logits, else it is used up."""
    if np.abs(w).sum(-2).max() >= SPAN:  # no part of a state is beyond 1, so else none of the logits is beyond the span
        np.clip(z, -SPAN, SPAN, out=z)
    rows = np.arange(len(z))
    own = z[rows, of]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    own -= np.log(total)
    if back:
        z *= np.reciprocal(total)[:, None]
        z[rows, of] -= 1
    return own


def outputs(h: np.ndarray, target: np.ndarray, m: Weights, back: bool = False) -> tuple[np.ndarray, np.ndarray | None, Weights]:
    """Log probability of each target given the state; if asked for, gradients of the sum of their negatives."""
    cls = class_of(target)
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    cls, target = cls[order], target[order]
    one = np.ones((len(h), STATE + 1), np.float32)  # the last place is for what doesn't depend on the state
    one[:, :STATE] = h[order]
    wc, ww = np.concatenate([m["wc"], m["bc"][None]]), np.concatenate([m["ww"], m["bw"][:, None]], 1)
    z = one @ wc
    log_p = softmax(z, cls, wc, back)
    cut = np.searchsorted(cls, np.arange(HEADS + 1)).tolist()
    parts, n = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b], cut[-1]
    zw = np.empty((n, EACH), np.float32)
    for k, part in parts:
        np.matmul(one[part], ww[k], out=zw[part])
    log_p[:n] += softmax(zw, target[:n] - cls[:n] * EACH, ww, back)
    out = np.empty_like(log_p)
    out[order] = log_p
    if not back:
        return out, None, {}
    g_c, g_w = across(one, z), np.zeros_like(ww)
    dh, by_word, turned = z @ np.ascontiguousarray(m["wc"].T), np.empty((n, STATE), np.float32), np.ascontiguousarray(m["ww"].transpose(0, 2, 1))
    for k, part in parts:
        np.matmul(one[part].T, zw[part], out=g_w[k])
        np.matmul(zw[part], turned[k], out=by_word[part])
    dh[:n] += by_word
    in_order = np.empty_like(dh)
    in_order[order] = dh
    return out, in_order, {"wc": g_c[:-1], "bc": g_c[-1], "ww": g_w[:, :-1], "bw": g_w[:, -1]}


def window(m: Weights, x: np.ndarray, y: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, Weights]:
    """One window of truncated backpropagation. x, y: (steps, lanes) tokens and those that follow; state: (lanes, STATE) before it.

    Returns the state after it, the log probability of each y, and gradients of the sum of their negatives, the first state held fixed.
    """
    s, lanes = STATE, x.shape[1]
    live = (x != END)[:, :, None].astype(np.float32)  # a document starts anew
    ends = (live == 0).any((1, 2)).tolist()
    one = np.ones((x.size, EMBED + 1), np.float32)
    one[:, :EMBED] = m["embed"][x.reshape(-1)]
    wx = np.concatenate([m["wx"], m["b"][None]])
    zr, cand = (one @ wx[:, : 2 * s]).reshape(*x.shape, 2 * s), (one @ wx[:, 2 * s :]).reshape(*x.shape, s)
    w_zr, w_n = np.ascontiguousarray(m["wh"][:, : 2 * s]), np.ascontiguousarray(m["wh"][:, 2 * s :])
    old, new, un = np.empty((3, *x.shape, s), np.float32)
    for t in range(len(x)):
        o = np.multiply(state, live[t], out=old[t])
        both, c, u = zr[t], cand[t], np.matmul(o, w_n, out=un[t])
        both += o @ w_zr
        sigmoid(both)
        c += both[:, s:] * u
        np.tanh(c, out=c)
        state = np.subtract(o, c, out=new[t])
        state *= both[:, :s]
        state += c
    log_p, dh, g = outputs(new.reshape(-1, s), y.reshape(-1), m, True)
    dh = dh.reshape(new.shape)
    z, r = np.ascontiguousarray(zr[:, :, :s]), np.ascontiguousarray(zr[:, :, s:])
    rest = 1 - z
    by_z = old - cand
    by_z *= z
    by_z *= rest
    by_n = np.multiply(cand, cand, out=cand)
    np.subtract(1, by_n, out=by_n)
    by_n *= rest
    by_r = np.subtract(1, r, out=rest)
    by_r *= r
    by_r *= un
    later, back = np.zeros((lanes, s), np.float32), np.ascontiguousarray(m["wh"].T)
    dg, du = np.empty((2, *x.shape, 3 * s), np.float32)
    for t in range(len(x) - 1, -1, -1):
        d = later
        d += dh[t]
        dn = np.multiply(d, by_n[t], out=dg[t][:, 2 * s :])
        np.multiply(d, by_z[t], out=du[t][:, :s])
        np.multiply(dn, by_r[t], out=du[t][:, s : 2 * s])
        np.multiply(dn, r[t], out=du[t][:, 2 * s :])
        d *= z[t]
        d += du[t] @ back
        if ends[t]:
            d *= live[t]
        later = d
    dg[:, :, : 2 * s] = du[:, :, : 2 * s]
    flat, dg = x.reshape(-1), dg.reshape(-1, 3 * s)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    by_wx, by_embed = across(one, dg), np.zeros_like(m["embed"])
    by_embed[flat[order][first]] = np.add.reduceat((dg @ np.ascontiguousarray(m["wx"].T))[order], first)
    g |= {"wh": across(old.reshape(-1, s), du.reshape(-1, 3 * s)), "b": by_wx[-1], "wx": by_wx[:-1], "embed": by_embed}
    return state, log_p, g


def train(m: Weights, stream: np.ndarray, rate: float = RATE) -> Weights:
    """Adam over windows of the stream of tokens, which is cut in lanes side by side; each token but the first is predicted.

    Lanes of like length begin at even distances, so the last ones may overlap by a few tokens.
    """
    n = len(stream) - 1
    if n < 1:
        return m
    lanes = int(np.clip(n // (4 * STEPS), 1, LANES))
    length = -(-n // lanes)
    first_of = np.linspace(0, n - length, lanes).astype(np.int64)
    all_of = np.concatenate([v.ravel() for v in m.values()])  # the weights are views of it
    ends = np.cumsum([v.size for v in m.values()])
    m = {k: all_of[end - v.size : end].reshape(v.shape) for (k, v), end in zip(m.items(), ends)}
    mean, square, step_of, by = np.zeros((4, len(all_of)), np.float32)
    state = np.zeros((lanes, STATE), np.float32)
    for step, begin in enumerate(range(0, length, STEPS), 1):
        at = first_of + np.arange(begin, min(begin + STEPS, length))[:, None]
        x, y = stream[at], stream[at + 1].astype(np.int64)
        state, _, g = window(m, x, y, state)
        np.concatenate([g[k].ravel() for k in m], out=by)
        by /= x.size
        np.clip(by, -1, 1, out=by)
        np.subtract(by, mean, out=step_of)
        step_of *= 0.1
        mean += step_of
        by *= by
        by -= square
        by *= 0.01
        square += by
        np.sqrt(np.divide(square, 1 - 0.99**step, out=by), out=by)
        by += 1e-7
        np.divide(mean, by, out=step_of)
        step_of *= rate / (1 - 0.9**step)
        all_of -= step_of
    return m


def log_likelihoods(m: Weights, token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's tokens (common words in full, others' classes); at: where documents begin."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    start, n = at[:-1][order], n[order]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[at[:-1]] = END
    total, s = np.zeros(len(n)), STATE
    table = m["embed"] @ m["wx"] + m["b"]
    t_zr, t_n = np.ascontiguousarray(table[:, : 2 * s]), np.ascontiguousarray(table[:, 2 * s :])
    w_zr, w_n = np.ascontiguousarray(m["wh"][:, : 2 * s]), np.ascontiguousarray(m["wh"][:, 2 * s :])
    state = np.zeros((len(n), s), np.float32)
    t = 0
    while t < n[0]:
        live = int(np.searchsorted(-n, -t, side="left"))
        until = min(int(n[0]), t + int(np.clip(16_384 // live, 1, 1024)))
        hs, ys, of = [], [], []
        for k in range(t, until):
            b = int(np.searchsorted(-n, -k, side="left"))
            place = start[:b] + k
            x, h = before[place], state[:b]
            zr, c = t_zr[x], t_n[x]
            zr += h @ w_zr
            sigmoid(zr)
            u = h @ w_n
            u *= zr[:, s:]
            c += u
            np.tanh(c, out=c)
            new = np.subtract(h, c, out=u)
            new *= zr[:, :s]
            new += c
            state[:b] = new
            hs.append(new)
            ys.append(token[place])
            of.append(b)
        log_p, _, _ = outputs(np.concatenate(hs), np.concatenate(ys), m)
        parts = np.split(log_p, np.cumsum(of)[:-1])
        for p in parts:
            total[: len(p)] += p
        t = until
    out = np.empty(len(n))
    out[order] = total
    return out


def packed(m: Weights) -> bytes:
    f = io.BytesIO()
    np.savez(f, **m)
    return f.getvalue()


def unpacked(b: bytes) -> Weights:
    with np.load(io.BytesIO(b)) as f:
        return {k: f[k] for k in f.files}


# Counts and vocabulary


@dataclass
class Vocabulary:
    """Words that tasks hold, by hash, with their number in the network (or -1), log10(count + 1); the sums over all words."""

    hash: np.ndarray
    number: np.ndarray
    log_count: np.ndarray
    tokens: int
    distinct: int
    #: log10 of the sum of each class of other words.
    tail_log: np.ndarray

    def __post_init__(self):
        # Where the hashes of each beginning start, so that looking up is a few comparisons.
        begins = self.hash >> np.uint64(64 - FIRST_BITS)
        self.first = np.searchsorted(begins, np.arange(1 << FIRST_BITS, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.unique(begins, return_counts=True)[1].max()) if len(begins) else 0

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token and whether it is held."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at, last = self.first[h >> np.uint64(64 - FIRST_BITS)], len(self.hash) - 1
        at = np.minimum(at, last)
        held = self.hash[at] == h
        open_ = np.flatnonzero(~held)
        for k in range(1, self.most):
            next_ = np.minimum(at[open_] + 1, last)
            at[open_] = next_
            found = self.hash[next_] == h[open_]
            held[open_] = found
            open_ = open_[~found & (self.hash[next_] < h[open_])]
        return at, held

    def numbers(self, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The network's number of each token, its place here, and whether it is held."""
        at, held = self.look_up(h)
        own = self.number[at] if len(self.hash) else np.full(len(h), -1)
        number = np.where(held & (own >= 0), own, HEADS * EACH + cls)
        number[h == END_HASH] = END
        return number, at, held


def told(v: Vocabulary) -> dict:
    """What a task makes the vocabulary from."""
    return {f.name: getattr(v, f.name) for f in fields(v)}


def count_tokens(docs: DataFrame) -> DataFrame:
    """h, cls, n: each token of the texts, by hash, with its beginning's class and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            code, h = pd.factorize(np.concatenate([x for x, _ in held]))
            cls = np.empty(len(h), np.int32)
            cls[code] = np.concatenate([c for _, c in held])
            return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "cls": cls, "n": np.bincount(code, minlength=len(h))})

        for batch in batches:
            for _, texts in pieces(batch):
                h, cls, _ = hashed(texts)
                held.append((h, cls))
                size += len(h)
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long, cls int, n long").groupBy("h").agg(F.max("cls").alias("cls"), F.sum("n").alias("n"))


def held_condition(counts: DataFrame) -> Column:
    """Whether a token is held: the end token always, and about MAX_HELD - 1 words, by count and, among those of the least count held, by a hash."""
    words, room = counts.where(F.col("cls") >= 0), MAX_HELD - 1
    step = F.floor(F.log2("n") * 8)
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).toPandas()  # some hundred rows
    full = int((steps["words"].cumsum() <= room).sum())
    end = F.col("cls") < 0
    if full == len(steps):
        return F.lit(True)
    room -= int(steps["words"][:full].sum())
    last = int(steps["step"][full])
    whole, n = F.lit(False) if not full else step > last, int(steps["words"][full])
    counts_of = words.where(step == last).groupBy("n").agg(F.count("*").alias("words"))
    # Counts of one step differ by a twelfth at most, so there are few where words are many; beyond, the step is cut by the hash alone.
    if counts_of.limit(100_001).count() <= 100_000:
        each = counts_of.orderBy(F.desc("n")).toPandas()
        some = int((each["words"].cumsum() <= room).sum())
        room -= int(each["words"][:some].sum())
        least = int(each["n"][some])
        whole, n, edge = whole | ((step == last) & (F.col("n") > least)), int(each["words"][some]), F.col("n") == least
    else:
        edge = step == last
    share = int((1 << 30) * room / n)
    return end | whole | (edge & (F.pmod(F.xxhash64(F.lit("held"), "h"), F.lit(1 << 30)) < share))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, and logs of counts of classes and of the words of each class, to start the network from.

    The end token is always held, as the network predicts it by itself; every other token that isn't held is a rare word.
    """
    classes = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas().set_index("cls")
    held = counts.where(held_condition(counts)).select("h", "cls", "n").toPandas().sort_values(["n", "h"], ascending=[False, True])
    held = held.assign(h=held["h"].to_numpy(np.int64).view(np.uint64))
    common = held[held["h"] != END_HASH].iloc[: HEADS * EACH]
    number = pd.Series(np.arange(len(common)), index=common["h"])
    word_n = np.zeros(HEADS * EACH)
    word_n[: len(common)] = common["n"]
    n, words = np.zeros(TAILS), np.zeros(TAILS)
    at = classes.index[classes.index >= 0]
    n[at], words[at] = classes["n"][at], classes["words"][at]
    n -= np.bincount(common["cls"], common["n"], TAILS)
    words -= np.bincount(common["cls"], minlength=TAILS)
    ends = int(classes["n"].get(-1, 0))
    held = held.sort_values("h")
    v = Vocabulary(held["h"].to_numpy(np.uint64), held["h"].map(number).fillna(-1).to_numpy(np.int64), np.log10(held["n"].to_numpy(float) + 1), int(classes["n"].sum()), int(classes["words"].sum()), np.log10(n + words + 1))
    heads = word_n.reshape(HEADS, EACH)
    return v, np.log(np.maximum(np.concatenate([heads.sum(1), n + 1, [max(ends, 0.5)]]), NONE)), np.log(np.maximum(heads, NONE))


def trained(spark: SparkSession, docs: DataFrame, v: Vocabulary, m: Weights, scratch: Scratch) -> Weights:
    """Weights after the rounds. Each document is learned from in one of them; a task's tokens are its part of a round's documents."""
    known = spark.sparkContext.broadcast(told(v))
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold()
            v, streams = Vocabulary(**known.value), [np.array([END], np.int16)]
            for batch in batches:
                for _, texts in pieces(batch):
                    h, cls, _ = hashed(texts)
                    streams.append(v.numbers(h, cls)[0].astype(np.int16))
            stream = np.concatenate(streams)
            if len(stream) > 1:
                new = train(now.value, stream, RATE / (turn + 1))
                yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "tokens": [len(stream)], "weights": pa.array([packed(new)], pa.binary())})

        mine = docs.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)) == turn).select(F.col("text").cast("binary").alias("text"))
        each = scratch.keep(mine.mapInArrow(run, "task long, tokens long, weights binary"))
        groups = int(max(1, each.count()) ** 0.5)

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"task": [pdf["task"].min()], "tokens": [pdf["tokens"].sum()], "weights": [packed(averaged(pdf))]})

        some = each.groupBy((F.col("task") % groups).alias("g")).applyInPandas(mean, "task long, tokens long, weights binary").toPandas()
        if len(some):
            m = averaged(some)
        scratch.drop(each)
    return m


def averaged(pdf: pd.DataFrame) -> Weights:
    """The mean by tokens, added in order of tasks, so that reruns agree."""
    pdf = pdf.sort_values("task")
    total, out = float(pdf["tokens"].sum()), {}
    for tokens, b in zip(pdf["tokens"], pdf["weights"]):
        for k, w in unpacked(b).items():
            out[k] = out.get(k, 0) + w * np.float32(tokens / total)
    return out


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    scratch = Scratch(spark, "language-model")
    kind = docs.schema["doc_id"].dataType.simpleString()
    training = docs.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 7) != 2)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = scratch.keep(count_tokens(training))
    v, class_log, word_log = vocabulary(counts)
    m = trained(spark, training, v, fresh(class_log, word_log), scratch)
    known, net = spark.sparkContext.broadcast(told(v)), spark.sparkContext.broadcast(m)

    def scored(rows: list[pa.RecordBatch], texts: list[bytes], first: int, v: Vocabulary) -> pa.RecordBatch:
        part = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        numbers, ats, rare, times, lists, known_n, base, tail = [], [np.zeros(1, np.int64)], [], [], [], [], [], []
        for begin in range(0, len(texts), 512):
            h, cls, at = hashed(texts[begin : begin + 512])
            number, place, held = v.numbers(h, cls)
            logs = np.where(held, v.log_count[place] if len(v.hash) else 0.0, 0.0)
            other = (number >= HEADS * EACH) & (number != END)
            tails = np.where(other, logs - v.tail_log[np.maximum(cls, 0)], 0.0)
            numbers.append(number.astype(np.int16))
            ats.append(ats[-1][-1] + at[1:])
            known_n.append(np.add.reduceat(held, at[:-1], dtype=np.int64))
            base.append(np.add.reduceat(logs, at[:-1]))
            tail.append(np.add.reduceat(tails, at[:-1]))
            # Rare words of each text, once, with their number.
            some = np.flatnonzero(~held & (h != END_HASH))
            of = np.searchsorted(at, some, "right") - 1
            order = np.lexsort([h[some], of])
            value, of = h[some][order], of[order]
            begins = np.flatnonzero(np.append(True, (np.diff(value) != 0) | (np.diff(of) != 0))) if len(value) else np.zeros(0, np.int64)
            rare.append(value[begins].view(np.int64))
            times.append(np.diff(np.append(begins, len(value))))
            lists.append(np.bincount(of[begins], minlength=len(at) - 1))
        at = np.concatenate(ats)
        likely = log_likelihoods(net.value, np.concatenate(numbers).astype(np.int32), at) / np.log(10)
        ends = pa.array(np.append(0, np.cumsum(np.concatenate(lists))), pa.int32())
        row = (TaskContext.get().partitionId() << 36) + first + np.arange(len(texts))
        return pa.RecordBatch.from_arrays([pa.array(row), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(at)), pa.array(np.concatenate(known_n)), pa.array(np.concatenate(base)), pa.array(likely + np.concatenate(tail)), *(pa.ListArray.from_arrays(ends, np.concatenate(x).astype(np.int64)) for x in (rare, times))], names)

    names = ["row", "doc_id", "held_out", "n_tokens", "n_held", "logs", "own", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        rows, texts, size, done, v = [], [], 0, 0, Vocabulary(**known.value)
        for batch in batches:
            for part, some in pieces(batch):
                rows.append(part.drop_columns("text"))
                texts += some
                size += sum(map(len, some))
                if size >= ABREAST:
                    yield scored(rows, texts, done, v)
                    done += len(texts)
                    rows, texts, size = [], [], 0
        if texts:
            yield scored(rows, texts, done, v)

    texts = docs.select("doc_id", is_remainder(F.col("doc_id"), 7, 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    own = scratch.keep(texts.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_held long, logs double, own double, rare array<long>, times array<long>"))
    each = own.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    rare = each.join(counts.select("h", "n"), "h")
    rare = rare.groupBy(F.col("row").alias("of")).agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"), F.sum("times").alias("rare_n"))
    both = own.join(rare, own["row"] == rare["of"], "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    level = float(np.log10(v.tokens + v.distinct + 1))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_held") + F.coalesce("rare_n", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("logs") + logs - F.col("n_tokens") * level).alias("base_score"), (F.col("own") + logs).alias("score"))
