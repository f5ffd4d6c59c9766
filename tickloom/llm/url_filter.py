"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence.

A rule is (host, path, verdict). It fits its host and every subdomain, where the url's path starts
with the rule's path. Of the rules that fit, the one with the longest host wins, then the longest
path; at equal keys block beats allow. Urls that no rule fits get ``default``.

The trie is broadcast only if its rules hold at most ``max_trie_bytes``; larger rule sets are
joined: each url is exploded into its host suffixes, the empty one among them, and the path
prefixes of the lengths that occur in the rules, an equi-join that broadcasts nothing. The lengths
are in the plan; rules of N characters in all have at most sqrt(2 N) + 1 of them.

Hosts are compared with A-Z lower-cased on both sides, other letters as they are. A rule with an
empty host fits every url, also one without a host.

Defined cases: a null url, or one without ``://``, has host and path '' and gets the default; an
empty rule list gives the default everywhere; repeated urls are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, free_names

MAX_TRIE_BYTES = 32 << 20


@dataclass
class Node:
    """A host label or whole path segment; ``ends`` are rules by the part of a segment they end in."""

    down: dict[str, Node] = field(default_factory=dict)
    path: Node | None = None
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    root = Node()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.down.setdefault(label, Node())
        node.path = node = node.path or Node()
        *whole, part = path.split("/")
        for segment in whole:
            node = node.down.setdefault(segment, Node())
        if node.ends.get(part, ("", ""))[1] != "block":
            node.ends[part] = (host + path, verdict)
    return root


def lookup(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match."""
    chain, node = [root], root
    for label in reversed(host.split(".")) if host else ():
        node = node.down.get(label)
        if node is None:
            break
        chain.append(node)
    segments = path.split("/")
    for node in reversed(chain):
        best, at = None, node.path
        for segment in segments:
            if at is None:
                break
            if at.ends:
                for n in range(min(len(segment), max(map(len, at.ends))), -1, -1):
                    if (hit := at.ends.get(segment[:n])) is not None:
                        best = hit
                        break
            at = at.down.get(segment)
        if best:
            return best
    return None


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, url: str, rules: list[tuple[str, str, str]], default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """df with host, path, rule and verdict; columns of those names are replaced."""
    df = df.withColumns({"host": url_host(df[url]), "path": url_path(df[url])})
    rules = [(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in rules]
    if sum(len(h) + len(p) + 64 for h, p, _ in rules) > max_trie_bytes:
        spark = df.sparkSession
        return _judge_by_join(df, spark.createDataFrame(rules, "host string, path string, verdict string"), default)
    shared = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [lookup(trie, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    keep, (found,) = [c for c in df.columns if c not in ("rule", "verdict")], free_names(df, "_j")
    return df.withColumn(found, judge("host", "path")).select(*keep, f"{found}.rule", f"{found}.verdict")


def _judge_by_join(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rule sets of any size: joined by (host suffix, path prefix), per distinct (host, path)."""
    keep, (found,) = [c for c in df.columns if c not in ("rule", "verdict")], free_names(df, "_j")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    keys = df.select("host", "path").distinct()
    # rules with an empty host fit every host
    suffix = F.expr("array_distinct(concat(transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.')), array('')))")
    # one literal: an expression for each of many lengths would swell the plan
    known = F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>")
    prefix = F.transform(F.filter(known, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    cand = keys.withColumn("rh", F.explode(suffix)).withColumn("rp", F.explode(prefix))
    one = rules.groupBy(F.col("host").alias("rh"), F.col("path").alias("rp")).agg(F.max("verdict").alias("v"))
    best = cand.join(one, ["rh", "rp"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), F.col("v").alias("verdict")), F.struct(F.length("rh"), F.length("rp"))).alias(found))
    return df.join(best, ["host", "path"], "left").select(*keep, f"{found}.rule", F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"))
