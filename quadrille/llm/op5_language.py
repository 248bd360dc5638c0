"""Language identification by multilingual mixture inference.

A text is taken as a mixture of languages, each of which emits hashed byte trigrams by its own law. Expectation-maximisation
estimates the proportions for the whole text; among nested sets of languages, the one of highest likelihood less a penalty
for each language is taken, and the largest proportion in it names the text.

Null texts and texts without a letter: `und`, score 0. Null doc_id: neither learned from nor held out. No rows to learn
from: every text is `und`. Repeated rows: judged alike, one result each. Ties go to the language that is first by name. A very
long text is judged by all of its trigrams; an empty table gives no rows. Sets grow by the next likely language until two larger
ones in a row aren't better, whatever the number of languages. Only the columns doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, is_remainder, remainder, small_batches
from .textvec import LOWER, PLAIN, pieces

#: Hashed trigrams; documents of each language to learn from, about (the bound of the sample).
BUCKETS, PER_LANGUAGE = 2048, 800
#: Weight of log(trigrams) for each further language; rounds of expectation-maximisation; larger sets in a row that may fail before a text's search ends.
PENALTY, ROUNDS, FAILS = 4.0, 12, 2
#: Languages whose rates are told to all tasks; more are joined by shuffle.
MAX_LANGUAGES = 10_000
ROWS = 256
_LETTER = re.compile(rb"[A-Za-z]")
_CODE = np.where(PLAIN, LOWER, 0).astype(np.uint32)
_CODE[:0x41] = _CODE[0x5B:0x61] = _CODE[0x7B:0x80] = 0


@dataclass
class Mixture:
    languages: list[str]
    #: (language, bucket), log probabilities.
    log_p: np.ndarray


def trigrams(texts: list[bytes]) -> np.ndarray:
    """(text, bucket) counts of trigrams with a letter in the middle; what isn't a letter counts as one blank."""
    joined = b"  ".join([b"", *texts, b" "])
    code = _CODE[np.frombuffer(joined, np.uint8)]
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), size)
    mid = code[2 : 2 + len(of)]
    gram = (code[1 : 1 + len(of)] * np.uint32(0x9E3779B1)) ^ (mid * np.uint32(0x85EBCA77)) ^ (code[3 : 3 + len(of)] * np.uint32(0xC2B2AE3D))
    gram ^= gram >> np.uint32(15)
    gram = (gram * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    real = mid != 0
    return np.bincount(of[real] * BUCKETS + gram[real], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Mixture:
    """Learns from rows whose crc32(doc_id) mod 4 isn't 2: about per_language of each language, chosen by hash."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    rates = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("rate"))
    taken = rows.join(broadcast_if(rates, MAX_LANGUAGES), "lang").where((F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)) < F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in pieces(batch, rows=ROWS):
                grams, langs = trigrams(texts), np.array(part.column("lang").to_pylist())
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + grams[langs == lang].sum(0)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": n[at]})

    counts = taken.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, bucket long, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    n = np.zeros((len(languages), BUCKETS))
    n[np.searchsorted(languages, found["lang"]) if languages else [], found["bucket"]] = found["n"]
    return Mixture(languages, np.log((n + 0.2) / (n.sum(1, keepdims=True) + 0.2 * BUCKETS)).astype(np.float32))


def mixtures(grams: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each text, of the set with the highest penalised likelihood."""
    c, p = grams.astype(np.float32), np.exp(log_p)
    n = np.maximum(c.sum(1), 1)
    languages = len(log_p)

    def settle(share: np.ndarray, rounds: int, c: np.ndarray = c) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            share = share * ((c / (share @ p + 1e-30)) @ p.T)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
        return share, (c * np.log(share @ p + 1e-30)).sum(1)

    alone = c @ log_p.T
    best = np.eye(languages, dtype=np.float32)[alone.argmax(1)]
    value = alone.max(1) - PENALTY * np.log(n)
    if languages > 1:
        share, _ = settle(np.full((len(c), languages), 1 / languages, np.float32), ROUNDS)
        rank = (-share).argsort(1, kind="stable").argsort(1)
        failed = np.zeros(len(c), np.int64)
        open_ = np.arange(len(c))
        for k in range(2, languages + 1):
            some = np.where(rank[open_] < k, share[open_], 0)
            some, likely = settle(some / np.maximum(some.sum(1, keepdims=True), 1e-30), ROUNDS // 2, c[open_])
            new = likely - PENALTY * k * np.log(n[open_])
            better = new > value[open_]
            best[open_[better]], value[open_[better]] = some[better], new[better]
            failed[open_] = np.where(better, 0, failed[open_] + 1)
            open_ = open_[failed[open_] < FAILS]
            if not len(open_):
                break
    return best


def judge(texts: list[bytes], model: Mixture) -> tuple[list[str], np.ndarray, list[str]]:
    """For each text the language, its proportion, and all languages of the set with their percentage."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), [""] * len(texts)
    share = mixtures(trigrams(texts), model.log_p).astype(float)
    top = share.argmax(1)
    known = np.fromiter(map(has_letter, texts), bool, len(texts))
    named = [model.languages[i] if k else "und" for i, k in zip(top, known)]
    sets = [",".join(f"{model.languages[j]}:{100 * row[j]:.0f}" for j in np.argsort(-row, kind="stable") if row[j] >= 0.005) if k else "" for row, k in zip(share, known)]
    return named, np.where(known, np.clip(share[np.arange(len(top)), top], 0, 1), 0.0), sets


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, rows=ROWS):
                named, score, sets = judge(texts, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(named), pa.array(score), pa.array(sets)], ["doc_id", "held_out", "lang_pred", "score", "langs"])

    rows = docs.select(F.col("doc_id"), is_remainder(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, langs string")


def accepted(docs: DataFrame, model: Mixture, least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns (of any names), that are in one language for least of their text; `und` is rejected."""
    at = f"_{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"_{i}" for i in range(batch.num_columns)])
            for part, texts in pieces(batch, at, rows=ROWS):
                named, score, _ = judge(texts, model)
                yield part.filter(pa.array((np.array(named) != "und") & (score >= least)))

    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
