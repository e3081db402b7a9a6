"""URL filters by a sort-merge range join.

A rule (host, path) holds for the host, all its subdomains and every path that starts with the rule's.  The
canonical key of a host and path is the host's labels in reverse, a NUL, and the path; a rule is then the
interval of the keys that start with its own key.  A url is looked up under each of its host's suffixes, so a
rule of a parent domain is an interval too.  In each task the sorted keys of a batch and the sorted rules are
swept once, with a stack of the rules that are active (nested intervals) at the key.

Up to RULE_BLOCK rules, urls are swept where they lie and never shuffled.  More rules come in blocks of about that
many: each block is a job of its own, which leaves the distinct urls that it decides with their longest rule in the
shared folder, so that the driver and the tasks hold one block at a time; the best of all blocks is joined to the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import forget, joined_by, stored, unused_name
from .columnar import quoted, string, with_columns

RULE_BLOCK = 200_000
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + "\0" + path


def suffixes(host: str) -> list[str]:
    """The host and its parent domains."""
    at, out = 0, [host]
    while (at := host.find(".", at) + 1) > 0:
        out.append(host[at:])
    return out


def sweep(keys: list[tuple[str, int]], rules: list[tuple[str, str, str]], best: list) -> None:
    """Put each row's longest rule into best; keys (key, row) and rules (key, rule, verdict) are sorted."""
    stack: list[tuple[str, str, str]] = []
    at, n = 0, len(rules)
    for key, row in keys:
        while at < n and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if stack:
            _, rule, verdict = stack[-1]
            if best[row] is None or (len(rule), verdict, rule) > (len(best[row][0]), best[row][1], best[row][0]):
                best[row] = (rule, verdict)


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both are empty if it is null or has no ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOW), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules has host, path and verdict (allow or block).  Of the rules that fit a url the longest wins; among
    equally long ones block wins, then the greater string.  Without a rule, rule is null and verdict the default.
    Null or malformed urls have an empty host and path and fit no rule.  A repeated rule counts once; rules with a
    null field are ignored.  Columns of pages named like a result are replaced.  Very long urls are matched whole,
    repeated rows are judged each.  No rows in, no rows out.
    """
    host, path = parse_url(F.col(quoted(url)))
    new = {"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
    kept = [F.col(quoted(c)) for c in pages.columns if c.lower() not in new]
    out = pages.select(*kept, *[v.alias(k) for k, v in new.items()])
    clean = rules.select("host", "path", "verdict").dropna().distinct()
    blocks = max(1, -(-clean.count() // RULE_BLOCK))
    if blocks == 1:
        return with_columns(out, "path", [string("rule"), string("verdict")], sweeper(sorted_rules(clean)))
    parts, folder = stored(clean.withColumn("block", F.pmod(F.xxhash64("host", "path"), F.lit(blocks))), ["block"])
    urls, found = out.select("host", "path", "rule", "verdict"), []
    for b in range(blocks):
        swept = with_columns(urls, "path", [string("rule"), string("verdict")], sweeper(sorted_rules(parts.where(F.col("block") == b))))
        found.append(stored(swept.where("rule is not null").distinct())[0])
    forget(parts, folder)
    best = F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best")
    decided = reduce(DataFrame.unionByName, found).groupBy(F.struct("host", "path").alias("url")).agg(best)
    names = [F.col(quoted(c)) for c in out.columns if c not in ("rule", "verdict")]
    both = joined_by(out.select(*names), F.struct("host", "path"), decided.select("url", F.col("best").alias(best_name := unused_name(out, "_best"))), "url")
    return both.select(*names, F.col(f"`{best_name}`.rule").alias("rule"), F.coalesce(f"`{best_name}`.verdict", F.lit(default)).alias("verdict"))


def sorted_rules(rules: DataFrame) -> list[tuple[str, str, str]]:
    """(key, rule, verdict) of a block of rules, in the order of the keys."""
    return sorted((canonical(r.host, r.path), r.host + r.path, r.verdict) for r in rules.collect())


def sweeper(rules: list[tuple[str, str, str]]) -> Callable:
    """A kernel that improves rule and verdict by one sorted block of rules."""

    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            hosts, paths, had, verdicts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("host", "path", "rule", "verdict"))
            best = [None if r is None else (r, v) for r, v in zip(had, verdicts, strict=True)]
            sweep(sorted((canonical(s, p), i) for i, (h, p) in enumerate(zip(hosts, paths, strict=True)) if h for s in suffixes(h)), rules, best)
            return [pa.array([b and b[0] for b in best], pa.string()), pa.array([b[1] if b else v for b, v in zip(best, verdicts, strict=True)], pa.string())]

        return work

    return kernel
