"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates the
and/or/with expressions after a tag.

A text becomes its words with one blank between them, and the automaton runs once over all of it. At the places where it finds a
tag (`SPDX-License-Identifier:`), an expression follows to the end of the line. Its value is how strict the terms are that one has
to accept: of licences joined by `or` the least strict, of those joined by `and` the strictest, and an exception (`with`) takes off
one step. The labels are all identifiers of the expressions and the value of the strictest one (`terms:permissive`, ...).

The score is the chance that the text carries terms, 1 - product(1 - weight) over labels; the weight of a value rises with it.
Null and empty texts: no words, no labels (empty strings), score 0, no terms. An expression that doesn't parse gives the label
`unparsed` and has no value. Repeated rows: one result each. A very long text is scanned whole, an expression of any length is
evaluated in one pass. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import ALNUM, LOWER, pieces

# Phrases and their labels, and how sure a phrase is of a licence.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
MORE = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons": "cc",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "public domain": "public-domain",
}
# How strict licences are, by the longest beginning of an identifier that is listed; others are restricted.
TERMS = ("permissive", "weak-copyleft", "strong-copyleft", "restricted")
STRICT = {
    **dict.fromkeys(["mit", "bsd", "0bsd", "apache", "isc", "zlib", "cc0", "unlicense", "cc-by", "python", "boost", "bsl"], 0),
    **dict.fromkeys(["lgpl", "mpl", "epl", "cddl"], 1),
    **dict.fromkeys(["gpl", "agpl", "cc-by-sa"], 2),
    **dict.fromkeys(["cc-by-nc", "cc-by-nd"], 3),
}
WEIGHTS = {"terms:permissive": 0.2, "terms:weak-copyleft": 0.5, "terms:strong-copyleft": 0.8, "terms:restricted": 0.95, "reserved": 0.6, "cc": 0.6, "public-domain": 0.5, "unparsed": 0.5}
SURE = 0.9
TAG = "spdx license identifier"
#: Words as the contract has them, as a byte table.
_WORDS = bytes(LOWER[b] if ALNUM[b] else 0x20 for b in range(256))
_TAG_BYTES = b"spdx-license-identifier:"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Identifiers and operators of an expression, lower-cased, operators after what they join (shunting-yard); None if it doesn't parse."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # expected next
    tokens = _TOKEN.findall(expression)
    if not tokens or re.sub(r"[\s]+|[#*/\-]+\s*$", "", _TOKEN.sub("", expression)):
        return None
    plain: list[bool] = []  # of the operands in out, whether they are one identifier

    def join(t: str) -> bool:
        b, a = plain.pop(), plain.pop()
        plain.append(False)
        out.append(t)
        return t != "with" or (a and b)

    for t in map(str.lower, tokens):
        if t in _BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[t]:
                if not join(held.pop()):
                    return None
            held.append(t)
            operand = True
        elif t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                if not join(held.pop()):
                    return None
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(t)
            plain.append(True)
            operand = False
    if operand or "(" in held or not all(join(t) for t in held[::-1]):
        return None
    return out


def folded(order: list[str], of: Callable, **joined: Callable):
    """The value of a postfix expression: of(identifier) of operands; joined by the functions or_, and_ and with_ of two values."""
    stack = []
    for t in order:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(joined[f"{t}_"](a, b))
        else:
            stack.append(of(t))
    return stack[0]


def strictness(order: list[str]) -> int:
    """Place in TERMS of what one has to accept."""

    def of(name: str) -> int:
        known = [k for k in STRICT if name.startswith(k)]
        return STRICT[max(known, key=len)] if known else len(TERMS) - 1

    return folded(order, of, or_=min, and_=max, with_=lambda a, _: max(a - 1, 0))


def alternatives(expression: str) -> list[frozenset[str]] | None:
    """All alternatives of licences that hold together; their number can grow with two to the power of the operators. None if it doesn't parse."""
    order = postfix(expression)
    if order is None:
        return None
    with_ = lambda a, b: [frozenset([f"{next(iter(a[0]))} with {next(iter(b[0]))}"])]
    return folded(order, lambda t: [frozenset([t])], or_=lambda a, b: list(dict.fromkeys(a + b)), and_=lambda a, b: list(dict.fromkeys(x | y for x in a for y in b)), with_=with_)


def names(order: list[str]) -> set[str]:
    """Identifiers of a postfix expression; one with an exception is one name."""
    found: list[str] = []
    for t in order:
        if t == "with":  # stands right after its two identifiers
            b, a = found.pop(), found.pop()
            t = f"{a} with {b}"
        if t not in _BINDS:
            found.append(t)
    return set(found)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in [*BASE.items(), *MORE.items(), (TAG, "")]:
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def expressions(text: bytes, places: list[int]) -> list[str]:
    """What follows the tags that stand at these words of the text, to the end of the line."""
    out, todo = [], sorted(places, reverse=True)
    for i, m in enumerate(_WORD.finditer(text)):
        if todo and i == todo[-1]:
            todo.pop()
            end = m.start() + len(_TAG_BYTES)
            if text[m.start() : end].lower() == _TAG_BYTES:
                stop = re.compile(rb"[\r\n]").search(text, end)
                out.append(text[end : stop.start() if stop else len(text)].decode("utf-8", "replace").strip())
        if not todo:
            break
    return out


def scan(text: bytes, find: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float, str | None, list[str]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, terms, postfix forms of the text's expressions."""
    words = text.translate(_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, at, labels, tags = set(), [], set(), []
    for end, (phrase, label) in find.iter(line):
        begin = end + 1 - len(phrase) - 2
        if phrase == TAG:
            tags.append(begin)
            continue
        labels.add(label)
        if phrase in BASE:
            base.add(label)
            at.append(begin)
    place = lambda p: line.count(" ", 0, p + 1) - 1
    values, forms, told = [], [], set()
    for expression in expressions(text, [place(p) for p in tags]) if tags else []:
        order = postfix(expression)
        if order is None:
            labels.add("unparsed")
            continue
        told |= {x.replace(",", "") for x in names(order)}
        values.append(strictness(order))
        forms.append(" ".join(order))
    terms = TERMS[max(values)] if values else None
    labels |= {f"terms:{terms}"} if terms else set()
    score = 1 - float(np.prod([1 - WEIGHTS.get(x, SURE) for x in sorted(labels)])) if labels else 0.0
    labels |= told  # their weight is that of the value
    return len(words), len(at), place(min(at)) if at else None, place(max(at)) if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, terms, forms


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, terms string, expressions array<string>"
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.list_(pa.string())]


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the result of scan(): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            for part, texts in pieces(batch):
                found = list(zip(*(scan(t, find) for t in texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(found, _TYPES))], ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
