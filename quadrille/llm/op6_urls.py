"""URL filters: a sort-merge range join of urls with host and path rules.

A host is turned round, label by label, so that a rule's host and all its subdomains are one interval of keys. Urls are dealt
by key ranges and sorted; a sweep over both sorted lists keeps a stack of the rules whose interval holds the present key, which
are nested in each other. The paths of a host's rules are intervals too, found by a search and the intervals around. Among rules
whose path starts the url's path, the longest (host and path together) wins; of equal length the one with the longer host, of equal
rules `block`.

Null urls and urls without `://`: host and path are empty, no rule fits. Urls that no rule fits: the default verdict. Repeated
rows: one result each. No rules: all rows get the default verdict. Very long urls are judged whole; an empty table gives no rows.
Other columns of the table, of any name, aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered

#: Between labels of a turned host; sorts before what hosts hold.
SEP = "\x01"
#: Rules that each task may hold; beyond, rules are dealt with the urls.
MAX_HELD = 200_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def turned(host: str) -> str:
    """The host's labels from the last to the first, each with an end."""
    return "".join(label + SEP for label in reversed(host.split("."))) if host else ""


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = lowered(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def better(rule: Rule) -> tuple:
    return len(rule.text), len(rule.host), rule.verdict == "block"


class Paths:
    """Rules of one host: a path's prefix is an interval of paths, and intervals are nested or apart. Of each, the one around it is known."""

    def __init__(self, rules: list[Rule]):
        best: dict[str, Rule] = {}
        for r in sorted(rules, key=better):
            best[r.path] = r
        self.starts = sorted(best)
        self.rules = [best[p] for p in self.starts]
        self.around: list[int] = []
        stack: list[int] = []
        for i, start in enumerate(self.starts):
            while stack and not start.startswith(self.starts[stack[-1]]):
                stack.pop()
            self.around.append(stack[-1] if stack else -1)
            stack.append(i)

    def best(self, path: str) -> Rule | None:
        """The innermost interval that holds the path: that of the last start before it, or one around that."""
        i = bisect_right(self.starts, path) - 1
        while i >= 0 and not path.startswith(self.starts[i]):
            i = self.around[i]
        return self.rules[i] if i >= 0 else None


class Sweep:
    """Goes through keys in rising order; rules of a host lie on the stack while keys are in its interval."""

    def __init__(self, rules: list[Rule]):
        hosts: dict[str, list[Rule]] = {}
        for r in rules:
            hosts.setdefault(turned(r.host), []).append(r)
        self.starts = sorted(hosts)
        self.hosts = {k: Paths(v) for k, v in hosts.items()}
        self.next = 0
        self.stack: list[str] = []

    def to(self, key: str) -> None:
        while self.next < len(self.starts) and self.starts[self.next] <= key:
            start = self.starts[self.next]
            while self.stack and not start.startswith(self.stack[-1]):
                self.stack.pop()
            self.stack.append(start)
            self.next += 1
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()

    def best(self, path: str) -> Rule | None:
        fits = [self.hosts[k].best(path) for k in self.stack]
        return max((r for r in fits if r), key=better, default=None)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of pages."""
    if len(rules) > MAX_HELD:
        raise ValueError(f"more than {MAX_HELD} rules: use judge_by_table")
    host, path = parsed(F.col("url"))
    turned_host = F.when(F.col("host") != "", F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), SEP), F.lit(SEP))).otherwise("")
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", turned_host)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sweep(rules)
        for batch in batches:
            texts, verdicts = [], []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist()):
                s.to(key)
                r = s.best(path)
                texts.append(r and r.text)
                verdicts.append(r.verdict if r else default)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(texts, pa.string()), pa.array(verdicts)], ["page_id", "host", "path", "rule", "verdict"])

    dealt = keyed.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path")
    return dealt.mapInArrow(sweep, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def judge_by_table(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int = 16) -> DataFrame:
    """As judge(), for a table (host, path, verdict) of any number of rules.

    Each host has as many suffixes as labels; those of the urls' distinct (host, path) meet the rules by equality, the urls under
    salts and the rules once for each, so that a host with many pages is spread over tasks. The best rule is then a maximum.
    """
    host, path = parsed(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    one = keyed.where("host <> ''").select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)))
    tails = one.select("host", "path", "salt", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("tail"))
    held = rules.select(F.col("host").alias("tail"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    rank = F.struct(F.length(F.concat("tail", "rule_path")), F.length("tail"), F.col("rule_verdict") == "block", F.concat("tail", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = tails.join(held, ["tail", "salt"]).where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.max(rank).alias("r"))
    found = keyed.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
