"""URL filter: a trie over reversed host labels and path segments, broadcast to the executors.

A rule is a host, a path and a verdict. It fits its host and every subdomain of it, where the URL's path
starts with the rule's. Of the rules that fit, the one with most host labels wins, then the one with the
longest path, then block before allow. The trie is as large as the rule list, whose size is checked.

Edge cases: a null URL, or one without ``://``, has empty host and path; an empty path does not start with
``/``; where no rule fits, ``rule`` is null and the verdict is the default. Repeated rows each get their own
result, an empty table an empty one, and other columns pass through, except that columns of the input named
like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that fit in a broadcast trie; a longer list has to be split by the caller.
MAX_RULES = 1_000_000


@dataclass
class _Node:
    """``next``: by host label or by whole path segment. ``ends``: what the path goes on with, and the rule."""

    next: dict[str, _Node] = field(default_factory=dict)
    path: _Node | None = None
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class UrlTrie:
    """Longest match of hosts and paths against rules ``(host, path, verdict)``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Node()
        known: dict[tuple[str, str], str] = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a verdict is allow or block, not {verdict}")
            if known.get((host, path)) != "block":
                known[host, path] = verdict
        if len(known) > MAX_RULES:
            raise ValueError(f"{len(known)} rules; {MAX_RULES} at most are broadcast")
        for (host, path), verdict in known.items():
            node = self.root
            for label in reversed(host.split(".")):
                node = node.next.setdefault(label, _Node())
            node.path = node.path or _Node()
            node = node.path
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.next.setdefault(segment, _Node())
            node.ends.append((rest, f"{host}{path}", verdict))
            node.ends.sort(key=lambda end: -len(end[0]))

    @staticmethod
    def _in_path(node: _Node, path: str) -> tuple[str, str] | None:
        """The rule below node with the longest path that ``path`` starts with."""
        found = None
        segments = path.split("/")
        for k, segment in enumerate(segments):
            found = next(((rule, verdict) for rest, rule, verdict in node.ends if segment.startswith(rest)), found)
            if k == len(segments) - 1 or (after := node.next.get(segment)) is None:
                return found
            node = after
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule, as host and path on end, and its verdict."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.path is not None:
                found = self._in_path(node.path, path) or found
        return found


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with ``host``, ``path``, ``rule`` and ``verdict`` of each URL."""
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in batches:
            found = [match(host, path) or (None, default) for host, path in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url]
    judged = pages.select(*[F.col(f"`{c}`") for c in kept], lower.alias("_host"), path.alias("_path"))
    judged = judged.withColumn("_judged", judge("_host", "_path"))
    return judged.select(*[F.col(f"`{c}`") for c in kept if c not in ("host", "path", "rule", "verdict")], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_judged.rule").alias("rule"), F.col("_judged.verdict").alias("verdict"))
