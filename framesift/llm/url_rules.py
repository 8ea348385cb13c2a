"""URL verdicts: a trie over reversed host labels and path segments, longest match first between allow and block entries.

A rule has a host, which stands for itself and all its subdomains, and a path, with which the url's path starts; an empty host or path
fits all. The rule with the longest host wins, then the one with the longest path; of an allow and a block entry with equal host and
path the block entry counts. A url that no rule fits gets the default verdict.

The trie is broadcast if the rules' bytes are within a bound that is checked first. Longer lists stay tables: urls are taken apart into
the same labels and segments and meet the rules in equi-joins, salted, as a top-level domain is part of many urls.

Null url, or one without `://`: empty host and path, which rules with an empty host and path alone fit. Null hosts, paths or verdicts
of rules: empty, empty, no rule. Repeated rows: a row each. Null page_id: kept null. Empty tables: no rows, or the default for all.
Only page_id and url are read, so other columns may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

ALLOW, BLOCK = "allow", "block"
#: Rules of the query: verdict, host, path.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
#: Bytes of hosts and paths up to which the rules are broadcast as a trie.
MOST_BYTES = 8 << 20
SALTS = 16
_PATHS = object


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


class Trie:
    """Flat maps, so that its depth doesn't matter when it is sent: edges by node and label, and where rules end. Below the node of a
    host hang the nodes of its paths. A rule's path ends within a segment: its tail is a beginning of the url's segment there."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.edges: dict[tuple, int] = {}
        self.ends: dict[tuple[int, str], tuple[str, str]] = {}
        self.tails: dict[int, list[int]] = {}
        self.size = 1
        for verdict, host, path in rules:
            node = 0
            for label in reversed(host.split(".")) if host else ():
                node = self._child(node, label)
            node = self._child(node, None)
            *folders, tail = path.split("/")
            for segment in folders:
                node = self._child(node, segment)
            if self.ends.get((node, tail), ("",))[0] != BLOCK:
                self.ends[node, tail] = (verdict, host + path)
            if len(tail) not in self.tails.setdefault(node, []):
                self.tails[node] = sorted([*self.tails[node], len(tail)], reverse=True)

    def _child(self, node: int, label: str | None) -> int:
        got = self.edges.setdefault((node, label), self.size)
        self.size += got == self.size
        return got

    def _by_path(self, node: int, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for s in segments:
            for n in self.tails.get(node, ()):
                if len(s) >= n and (found := self.ends.get((node, s[:n]))):
                    best = found
                    break
            node = self.edges.get((node, s))
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest match."""
        segments = path.split("/")
        node, best = 0, None
        for label in [None, *reversed(host.split("."))]:
            node = node if label is None else self.edges.get((node, label))
            if node is None:
                break
            if (paths := self.edges.get((node, None))) is not None:
                best = self._by_path(paths, segments) or best
        return best


def clean(rules: DataFrame) -> DataFrame:
    """(verdict, host, path), a row for each host and path."""
    host = F.translate(F.coalesce("host", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    known = rules.where(F.col("verdict").isin(ALLOW, BLOCK)).select("verdict", host.alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    return known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select("verdict", "host", "path")


def by_trie(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (page_id, url, host, path) with rule and verdict, null where none fits."""
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in sliced(it, 20_000):
            got = [find(h, p) or (None, None) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict(dict(zip(b.schema.names, b.columns, strict=True)) | {"rule": pa.array([r for _, r in got], pa.string()), "verdict": pa.array([v for v, _ in got], pa.string())})

    return urls.mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string")


def by_joins(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a list of any length. Distinct urls are taken apart into (host and its parents) x (folders of the path), as many rows as
    labels times segments; they find the lengths of the tails that rules have there, and then the rules."""
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int")
    r = rules.select("verdict", F.col("host").alias("r_host"), F.regexp_extract("path", "^(?s)(.*/)?", 0).alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("tail"))
    lengths = salted(r.groupBy("r_host", "folder").agg(F.collect_set(F.length("tail")).alias("lengths")))
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    one = urls.select("host", "path").distinct().withColumn("labels", labels).withColumn("segments", segments).withColumn("salt", salt("host", "path"))
    one = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("labels")))).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("segments") - 1)))
    one = one.select(
        "host", "path", "salt", F.array_join(F.slice("labels", F.col("i") + 1, F.size("labels")), ".").alias("r_host"),
        F.when(F.col("k") == 0, "").otherwise(F.concat(F.array_join(F.slice("segments", F.lit(1), F.col("k")), "/"), F.lit("/"))).alias("folder"), F.get("segments", F.col("k")).alias("segment"), (F.size("labels") - F.col("i")).alias("depth"),
    )
    one = one.join(lengths, ["r_host", "folder", "salt"]).withColumn("n", F.explode("lengths")).where("n <= length(segment)").withColumn("tail", F.substr("segment", F.lit(1), F.col("n"))).drop("lengths", "segment")
    found = one.join(salted(r), ["r_host", "folder", "tail", "salt"])
    longest = F.max(F.struct("depth", F.length("folder").alias("f"), "n", "verdict", F.concat("r_host", "folder", "tail").alias("rule")))
    best = salted(found.groupBy("host", "path").agg(longest.alias("best")))
    got = urls.withColumn("salt", salt("page_id")).join(best, ["host", "path", "salt"], "left")
    return got.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, url, host, path, the rule that decides (null for none) and the verdict of every page; rules: verdict, host, path."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumn("host", host).withColumn("path", path)
    rules = clean(rules)
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    if size <= most_bytes:
        got = by_trie(urls, [tuple(r) for r in rules.collect()])  # at most most_bytes
    else:
        got = by_joins(urls, rules)
    return got.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op11_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (SELECT n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM raw),
fits AS (
  SELECT p.n, arg_max(r.verdict, length(r.host || r.path)) AS verdict, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""
