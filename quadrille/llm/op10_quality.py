"""Quality classifier: a byte-level convolutional network in numpy.

The text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned embedding; learned filters
run over the bytes of a chunk and are max-pooled; a document is the mean and the maximum of its chunks' pooled filters, combined
by a learned layer into one probability. A text of any length passes through in batches of chunks.

Null and empty texts: one chunk of blanks, scored like others. Null doc_id: scored, not held out, not learned from. Several
labels for one doc_id: the largest counts; several texts: the one of the smallest hash is learned from. Repeated rows: one
result each. No labels to learn from: score 0.5. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_remainder
from .op1_toxicity import labelled
from .textvec import pieces

#: Labelled rows to learn from at most, chosen by hash.
MAX_TRAIN = 4000
#: Bytes of a chunk and from one chunk to the next; width and step of the filters; embedding and filters.
CHUNK, HOP, WIDTH, STEP, EMBED, FILTERS = 512, 480, 8, 4, 8, 16
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 11
#: Chunks that are worked on at a time.
AT_ONCE = 512

Model = dict[str, np.ndarray]


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, byte) values and the text of each chunk; the last of a text is filled up with blanks."""
    n = [max(1, -(-max(0, len(t) - (CHUNK - HOP)) // HOP)) for t in texts]
    flat = np.frombuffer(b"".join(t.ljust((k - 1) * HOP + CHUNK, b" ") for t, k in zip(texts, n)), np.uint8)
    start = np.concatenate([[0], np.cumsum([(k - 1) * HOP + CHUNK for k in n])])[:-1]
    at = np.concatenate([s + HOP * np.arange(k) for s, k in zip(start, n)])
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[at], np.repeat(np.arange(len(texts)), n)


def convolve(chunks: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the filters (chunk, place, values) and their outputs (chunk, place, filter)."""
    x = np.take(m["embed"], chunks, 0).reshape(len(chunks), -1)
    places = (CHUNK - WIDTH) // STEP + 1
    seen = np.lib.stride_tricks.as_strided(x, (len(x), places, WIDTH * EMBED), (x.strides[0], STEP * EMBED * 4, 4))
    flat = np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBED)
    return flat, (flat @ m["filters"]).reshape(len(x), places, FILTERS)


def pooled(chunks: np.ndarray, m: Model) -> np.ndarray:
    return np.concatenate([np.maximum(convolve(chunks[i : i + AT_ONCE], m)[1].max(1) + m["bias"], 0) for i in range(0, len(chunks), AT_ONCE)])


def joined(chunk_values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks of each text."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    n = np.diff(np.append(first, len(of)))[:, None]
    return np.concatenate([np.add.reduceat(chunk_values, first) / n, np.maximum.reduceat(chunk_values, first)], 1)


def probability(texts: list[bytes], m: Model) -> np.ndarray:
    chunks, of = chunked(texts)
    z = (joined(pooled(chunks, m), of) @ m["out"] + m["out_bias"]).astype(float)
    return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)  # so that a text has one score in any batch


def fresh() -> Model:
    r = np.random.default_rng(SEED)
    return {k: v.astype(np.float32) for k, v in {
        "embed": r.normal(0, 0.5, (256, EMBED)), "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "out": r.normal(0, 0.1, 2 * FILTERS), "out_bias": np.zeros(1),
    }.items()}


def gradients(chunks: np.ndarray, of: np.ndarray, y: np.ndarray, m: Model) -> Model:
    """Of the mean logistic loss over the texts."""
    flat, z = convolve(chunks, m)
    best = z.argmax(1)
    raw = np.take_along_axis(z, best[:, None], 1)[:, 0] + m["bias"]
    v = np.maximum(raw, 0)
    doc = joined(v, of)
    q = 1 / (1 + np.exp(-np.clip(doc @ m["out"] + m["out_bias"], -30, 30)))
    d = ((q - y) / len(y)).astype(np.float32)
    n = np.bincount(of)[:, None]
    to_mean, to_max = d[:, None] * m["out"][:FILTERS], d[:, None] * m["out"][FILTERS:]
    dv = (to_mean / n)[of]
    winners = v == doc[of, FILTERS:]
    shared = np.zeros((len(y), FILTERS), np.float32)
    np.add.at(shared, of, winners)
    dv += winners * (to_max / np.maximum(shared, 1))[of]
    dv *= raw > 0
    places, k = z.shape[1], np.arange(FILTERS)
    rows = (np.arange(len(chunks))[:, None] * places + best).ravel()
    which = np.tile(k, len(chunks))
    of_filters = np.zeros_like(m["filters"])
    for f in k:
        of_filters[:, f] = flat[rows[which == f]].T @ dv[:, f]
    back = m["filters"].T[which] * dv.ravel()[:, None]
    at = best.ravel()[:, None] * STEP + np.arange(WIDTH)
    bytes_there = chunks[np.repeat(np.arange(len(chunks)), FILTERS)[:, None], at]
    of_embed = np.zeros_like(m["embed"])
    np.add.at(of_embed, bytes_there.ravel(), back.reshape(-1, EMBED))
    return {"embed": of_embed, "filters": of_filters, "bias": dv.sum(0), "out": doc.T @ d, "out_bias": d.sum(keepdims=True)}


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam over batches of whole texts, of which a batch holds fewer where they are long."""
    m = fresh()
    if not len(y):
        return m | {"out": np.zeros_like(m["out"])}
    p = np.clip(y.mean(), 0.01, 0.99)
    m["out_bias"] += np.float32(np.log(p / (1 - p)))
    mean, square, step, r = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0, np.random.default_rng(SEED)
    for epoch in range(epochs):
        order = r.permutation(len(y))
        batches: list[list[int]] = [[]]
        size = 0
        for i in order:
            k = 1 + len(texts[i]) // HOP
            if batches[-1] and (len(batches[-1]) == BATCH or size + k > 4 * AT_ONCE):
                batches.append([])
                size = 0
            batches[-1].append(i)
            size += k
        for some in batches:
            step += 1
            chunks, of = chunked([texts[i] for i in some])
            rate = RATE * (1 - epoch / epochs)
            for k, g in gradients(chunks, of, y[some], m).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                m[k] = (m[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, max_bytes: int = 16 << 20) -> Model:
    """Learns on the driver from at most limit labelled rows and max_bytes of text, in order of a hash of the id; a longer text than max_bytes isn't learned from."""
    rows = labelled(docs, labels, "quality", limit).where(F.octet_length("text") <= max_bytes)
    sized = rows.select("doc_id", "y", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    ids = sized["doc_id"][sized["n"].cumsum() <= max_bytes].tolist()
    if not ids:
        return train([], np.zeros(0))
    got = rows.where(F.col("doc_id").isin(ids)).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return train([bytes(t) for t in got["text"]], got["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, limit=1 << 20):
                s = probability(texts, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", is_remainder(F.col("doc_id"), 5, 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
