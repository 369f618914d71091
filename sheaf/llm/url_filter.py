"""URL filtering by the longest matching rule of a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # verdict, host, path

#: Up to so many rules, of at most MAX_RULE characters each, the trie is broadcast; beyond, rules are joined by host.
MAX_TRIE_RULES, MAX_RULE = 200_000, 2048


@dataclass
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    paths: PathNode | None = None


@dataclass
class PathNode:
    segments: dict[str, PathNode] = field(default_factory=dict)
    #: Rules whose last segment is this, perhaps only the start of the url's segment.
    ends: list[tuple[str, Rule]] = field(default_factory=list)


def _length(rule: Rule) -> tuple[int, int, int]:
    """Longest host, then longest path; of equal ones a block entry wins."""
    return rule[1].count(".") + 1, len(rule[2]), rule[0] == "block"


def build(rules: Iterable[Rule]) -> Node:
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule[1].split(".")):
            node = node.labels.setdefault(label, Node())
        node.paths = at = node.paths or PathNode()
        *whole, last = rule[2].split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, PathNode())
        at.ends.append((last, rule))
    return root


def lookup(root: Node, host: str, path: str) -> Rule | None:
    best: Rule | None = None
    node: Node | None = root
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        at = node.paths
        for segment in segments:
            if at is None:
                break
            for start, rule in at.ends:
                if segment.startswith(start) and (best is None or _length(rule) > _length(best)):
                    best = rule
            at = at.segments.get(segment)
    return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first :// and the next / ? or #, A-Z in lower case; from there up to ? or #. Both empty without ://."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, lower), F.regexp_extract(url, pattern, 2)


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule (host and path of the entry that decides, else null), verdict.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with its path. The entry
    with the most host labels wins, then the longest path, then block. Without an entry the verdict is the default.

    The trie is broadcast up to max_trie_rules entries; more are joined on each suffix of a host. Null urls and such
    without :// have an empty host and path. Identifiers may be null or repeat; other columns are ignored.
    """
    if any(v not in ("allow", "block") or len(h) + len(p) > MAX_RULE for v, h, p in rules):
        raise ValueError(f"a rule is (allow or block, host, path) of at most {MAX_RULE} characters")
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if len(rules) > max_trie_rules:
        return _joined(urls, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(rules)
    kind = urls.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = build(trie.value)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [lookup(root, h, p) for h, p in zip(hosts, paths, strict=True)]
            rule = pa.array([r and r[1] + r[2] for r in found], pa.string())
            verdict = pa.array([r[0] if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(urls: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by an equality join on host suffixes; each distinct (host, path) is judged once."""
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(h, p, v, h.count(".") + 1, len(p), v == "block") for v, h, p in rules],
        "at string, start string, verdict string, labels int, length int, blocks boolean",
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    distinct = urls.select("host", "path").distinct()
    best = (
        distinct.withColumn("at", F.explode(suffixes))
        .join(table, "at")
        .filter(F.expr("startswith(path, start)"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("at", "start").alias("rule"), "verdict"), F.struct("labels", "length", "blocks")).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
