"""URL rules by a sort-merge range join.

A host's labels are reversed and each closed by a separator (``a.example.org`` -> ``org. example. a.``), so the
hosts of a rule's subtree are the keys that start with the rule's key: an interval of the sorted keys. Pages
and rules are dealt by key ranges, a rule to every range that its interval meets. Each task then makes one
sweep over its sorted rows with a stack of the rules whose intervals hold the current key; nested subtrees
nest on the stack. The path rules of one host are a sorted list in which every rule points to the longest
other rule that it starts with, so a page's longest path rule is found by a binary search and a short climb.

Range borders come from a bounded sample of keys and only decide how evenly the work is dealt. Where a
border key repeats, one key fills several ranges, and its pages are dealt among them by their id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class Rule(NamedTuple):
    """A verdict for the pages of a host and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: What a page gets that no rule fits.
DEFAULT = "allow"
#: At most about so many keys are sampled for the range borders, cut to so many characters.
SAMPLE, BORDER_CHARS = 20_000, 200
#: Closes a label; it sorts before every character that a key holds.
SEP = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(tail, r"\A([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by the separator."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEP), F.lit(SEP))


def _rules(spark: SparkSession, rules) -> DataFrame:
    return rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _borders(keys: DataFrame, ranges: int) -> list[str]:
    """Sorted keys between the ranges, repeated where one key fills more than one of them."""
    rows = keys.count()
    taken = keys.sample(fraction=min(1.0, SAMPLE / max(rows, 1)), seed=11).select(F.substring("key", 1, BORDER_CHARS).alias("k")).limit(4 * SAMPLE)
    found = sorted(r.k for r in taken.collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def _deal(borders: list[str]):
    """Gives each page the number of its range, each rule a row for every range that its interval meets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, (key, salt, kind) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("key", "salt", "kind")], strict=True)):
                first = bisect_left(borders, key)
                if kind:
                    own = (first + salt % (bisect_right(borders, key) - first + 1),)
                else:
                    own = range(first, bisect_left(borders, key + "\U0010ffff") + 1)
                rows += [i] * len(own)
                parts += own
            kept = batch.drop_columns(["salt"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *kept.columns], ["part", *kept.schema.names])

    return deal


class _Node(NamedTuple):
    """A host on the stack: its key and its path rules in order, with the place of the longest rule each starts with."""

    key: str
    paths: list
    texts: list
    verdicts: list
    above: list


def _node(key: str, rules: list[tuple[str, str, str]]) -> _Node:
    """rules: (path, rule text, verdict). Of equal rules one that blocks counts."""
    best: dict[str, tuple[str, str]] = {}
    for path, text, verdict in rules:
        if path not in best or verdict == "block":
            best[path] = (text, verdict)
    paths = sorted(best)
    above, open_ = [], []
    for i, path in enumerate(paths):
        while open_ and not path.startswith(paths[open_[-1]]):
            open_.pop()
        above.append(open_[-1] if open_ else -1)
        open_.append(i)
    return _Node(key, paths, [best[p][0] for p in paths], [best[p][1] for p in paths], above)


def _longest(node: _Node, path: str) -> int:
    """Place of the longest path rule that ``path`` starts with, or -1."""
    at = bisect_right(node.paths, path) - 1
    while at >= 0 and not path.startswith(node.paths[at]):
        at = node.above[at]
    return at


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, kind): rules (kind 0) before the pages (kind 1) of the same key."""
    stack: list[_Node] = []
    part, waiting, waiting_key = None, [], None
    for batch in batches:
        out_rule, out_verdict, pages = [], [], []
        cols = [batch.column(n).to_pylist() for n in ("part", "key", "kind", "path", "rule", "verdict")]
        for i, (p, key, kind, path, rule, verdict) in enumerate(zip(*cols, strict=True)):
            if p != part:
                stack, waiting, waiting_key, part = [], [], None, p
            if waiting and (kind == 1 or key != waiting_key):
                while stack and not waiting_key.startswith(stack[-1].key):
                    stack.pop()
                stack.append(_node(waiting_key, waiting))
                waiting = []
            if kind == 0:
                waiting_key = key
                waiting.append((path, rule, verdict))
                continue
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            best = (-1, None, None)
            for node in stack:  # from the widest to the narrowest: of equal lengths the narrower host counts
                if (at := _longest(node, path)) >= 0 and len(node.texts[at]) >= best[0]:
                    best = (len(node.texts[at]), node.texts[at], node.verdicts[at])
            pages.append(i)
            out_rule.append(best[1])
            out_verdict.append(best[2])
        if pages:
            kept = batch.take(pa.array(pages, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("page_id"), kept.column("host"), kept.column("path"), pa.array(out_rule, pa.string()), pa.array(out_verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """Each row of ``pages`` (page_id, url) with host, path, the longest rule that fits and its verdict.

    rules: tuples or a DataFrame (host, path, verdict). A rule fits its host and all subdomains if the path
    starts with its own; the longest rule text (host + path) wins, of equally long ones that of the narrower
    host, of equal ones one that blocks. Without a rule the verdict is ``default``. A null url, or one without
    ``://``, has an empty host and path. Null and repeated page ids pass through as rows of their own.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    points = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(points, 4 * n)
    kind = dict(pages.dtypes)["page_id"]
    shape = f"part int, key string, kind int, page_id {kind}, host string, path string, rule string, verdict string"
    none = F.lit(None).cast("string")
    dealt = points.select("key", F.xxhash64("page_id", "path").alias("salt"), F.lit(1).alias("kind"), "page_id", "host", "path", none.alias("rule"), none.alias("verdict")).mapInArrow(_deal(borders), shape)
    ruled = _rules(spark, rules).select(host_key(F.col("host")).alias("key"), F.lit(None).cast("long").alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict").mapInArrow(_deal(borders), shape)
    every = dealt.unionByName(ruled)
    rows = every.repartitionByRange(n, "part").sortWithinPartitions("part", "key", "kind")
    out = rows.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op1_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path
  FROM h
), r(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
