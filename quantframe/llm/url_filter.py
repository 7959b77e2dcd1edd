"""Allow and block lists of URLs by longest match.

A rule is a host and a path; it fits its host and all subdomains where the URL's path starts
with the rule's. Rules lie in a trie over reversed host labels and, from each host's node, path
segments; the last, open segment of a rule's path hangs on its node as a prefix (empty after a
slash). One walk of a URL meets every rule that fits. The longest rule wins (host and path
together, then the longer host); of an allow and a block entry for the same place, block.

The trie is a flat table of edges, broadcast once an executor, up to ``MAX_RULES`` rules and
``MAX_CHARS`` characters, counted before anything is collected. Longer lists stay a table: each
distinct (host, path) is dealt out as its host suffixes times path prefixes, no deeper than the
deepest rule, and meets the rules by equality.

Defined results: a null URL, or one without ``://``, has empty host and path; the host is taken
as it stands between ``://`` and the first of ``/?#``, port and user included; what no rule fits
gets the default verdict; equal URLs stay separate rows; a null host or path of a rule is empty;
an empty list leaves every URL to the default.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name

ALLOW, BLOCK = "allow", "block"
MAX_RULES, MAX_CHARS = 100_000, 8_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Trie:
    """Edges by (node, label) and (node, segment); at a node, the entries by open segment."""

    hosts: dict[tuple[int, str], int] = field(default_factory=dict)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    entries: dict[int, dict[str, tuple[tuple[int, int], str, str]]] = field(default_factory=dict)
    open_lengths: dict[int, list[int]] = field(default_factory=dict)
    labels: int = 0
    segments: int = 0
    nodes: int = 1

    def _step(self, edges: dict[tuple[int, str], int], node: int, part: str) -> int:
        after = edges.get((node, part))
        if after is None:
            after = edges[node, part] = self.nodes
            self.nodes += 1
        return after

    def add(self, host: str, path: str, action: str) -> None:
        labels, (*closed, rest) = host.split("."), path.split("/")
        self.labels, self.segments = max(self.labels, len(labels)), max(self.segments, len(closed))
        node = 0
        for label in reversed(labels):
            node = self._step(self.hosts, node, label)
        for segment in closed:
            node = self._step(self.paths, node, segment)
        here = self.entries.setdefault(node, {})
        if rest not in here or action == BLOCK:
            here[rest] = ((len(host) + len(path), len(host)), host + path, action)
        self.open_lengths[node] = sorted({*self.open_lengths.get(node, []), len(rest)})

    def _fits(self, host: str, path: str) -> Iterator[tuple[tuple[int, int], str, str]]:
        labels = host.rsplit(".", self.labels)[-self.labels :] if self.labels else []
        *closed, rest = path.split("/", self.segments)
        # What the limited split left in one piece still has closed segments in front.
        pieces = [*closed, rest.split("/", 1)[0]]
        node = 0
        for label in reversed(labels):
            node = self.hosts.get((node, label), -1)
            if node < 0:
                return
            at = node
            for i, piece in enumerate(pieces):
                for n in self.open_lengths.get(at, ()):
                    if (entry := self.entries[at].get(piece[:n])) is not None and len(piece) >= n:
                        yield entry
                at = self.paths.get((at, piece), -1) if i < len(closed) else -1
                if at < 0:
                    break

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The rule that wins and its action."""
        best = max(self._fits(host, path), default=None)
        return (None, None) if best is None else best[1:]


def build(rules: Iterable[tuple[str, str, str]]) -> Trie:
    trie = Trie()
    for host, path, action in rules:
        trie.add(host, path, action)
    return trie


FOUND = "struct<rule:string,action:string>"


def _by_trie(pages: DataFrame, host: str, path: str, rules: DataFrame, out: str) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(build(tuple(r) for r in rules.collect()))

    def each(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        return pd.DataFrame([find(h, p) for h, p in zip(hosts, paths)], columns=["rule", "action"])

    return pages.withColumn(out, F.pandas_udf(each, FOUND)(F.col(host), F.col(path)))


def _by_join(pages: DataFrame, host: str, path: str, rules: DataFrame, out: str) -> DataFrame:
    """The same through equality of host suffixes and path prefixes with the rules' own."""
    closed = F.regexp_replace("path", "[^/]*$", "")
    # As text, block comes after allow.
    listed = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    deepest = listed.agg(
        F.max(F.size(F.split("host", r"\."))),
        F.max(F.size(F.split("path", "/")) - 1),
        F.collect_set(F.length("path") - F.length(closed)),
    ).first()
    labels, segments, opened = deepest[0] or 1, deepest[1] or 0, sorted(deepest[2]) or [0]
    parts, pieces = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    starts = F.transform(
        F.sequence(F.lit(0), F.least(F.size(pieces) - 1, F.lit(segments))),
        lambda n: F.length(F.array_join(F.slice(pieces, F.lit(1), n), "/")) + F.when(n > 0, 1).otherwise(0),
    )
    lengths = F.flatten(
        F.transform(starts, lambda s: F.transform(F.array(*map(F.lit, opened)), lambda n: s + n))
    )
    prefixes = F.array_distinct(
        F.transform(lengths, lambda n: F.substring(F.col(path), F.lit(1), n))
    )
    dealt = pages.select(host, path).distinct()
    dealt = dealt.select(host, path, F.explode(suffixes).alias("host"), prefixes.alias("path"))
    dealt = dealt.withColumn("path", F.explode("path"))
    size = F.struct(
        (F.length("host") + F.length("path")).alias("all"),
        F.length("host").alias("host"),
        F.concat("host", "path").alias("rule"),
        F.col("action").alias("action"),
    )
    best = dealt.join(listed, ["host", "path"]).groupBy(host, path).agg(F.max(size).alias(out))
    found = F.struct(F.col(out)["rule"].alias("rule"), F.col(out)["action"].alias("action"))
    return pages.join(best.withColumn(out, found), [host, path], "left")


def with_verdict(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    out: str = "filtered",
    default: str = ALLOW,
    max_rules: int = MAX_RULES,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """``pages`` with a struct (host, path, rule, verdict). ``rules``: (host, path, action). A
    column called like ``out`` is replaced."""
    host, path, found = (free_name(pages, n) for n in ("url_host_", "url_path_", "url_found_"))
    listed = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "action",
    )
    known = F.coalesce(F.col("action").isin(ALLOW, BLOCK), F.lit(False))
    n, chars, odd = listed.agg(
        F.count("*"), F.sum(F.length("host") + F.length("path")), F.count_if(~known)
    ).first()
    if odd:
        raise ValueError(f"{odd} rules neither {ALLOW} nor {BLOCK}")
    way = _by_trie if n <= max_rules and (chars or 0) <= max_chars else _by_join
    parted = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    judged = way(parted, host, path, listed, found)
    verdict = F.struct(
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(found)["rule"].alias("rule"),
        F.coalesce(F.col(found)["action"], F.lit(default)).alias("verdict"),
    )
    return judged.select(*[F.col(f"`{c}`") for c in pages.columns if c != out], verdict.alias(out))
