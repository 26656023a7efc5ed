"""Operator 5: URL filters by a sort-merge range join.

A url's host labels are reversed (``org.example.en.``), so that a rule for a host and all of its subdomains becomes
one interval of keys, [prefix, prefix + highest code point). Spark range-partitions and sorts the urls by key; each
task merges its sorted urls with the sorted rule intervals in one sweep and keeps a stack of the nested rules that are
active. Of the rules on the stack whose path the url's path starts with, the longest (host + path) wins.

A hot host is spread over tasks, because path and row id follow the host in the sort order. The rules are a Python
list on the driver; they are sent in blocks of at most ``RULES_PER_BLOCK``. More blocks are more sweeps, each of which is
stored before the next one sorts the rows again, so that no task holds more than one block.

Defined cases: a null url or one without ``://`` has an empty host and path and matches no rule; equal urls are judged
alike; two rules of equal length that both fit: the greater rule string wins, a repeated rule counts once and its first
action holds; no rules or no rows give null rules or an empty result. Other columns are carried through unless they are
named like an output column, which replaces them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, prepare, stored, table

RULES_PER_BLOCK = 100_000
#: Verdict of a url that no rule fits.
DEFAULT = "allow"
#: (action, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = ("host", "path", "rule", "verdict")
_ESCAPES = (("\x02", "\x02\x03"), ("\x01", "\x02\x02"))


def host_key(host: str) -> str:
    """Canonical key: labels reversed, each closed by U+0001, so that a host's subtree is a range of keys. A U+0001 or U+0002 of the
    host's own is escaped by U+0002, so that no label can look closed."""
    for mark, escaped in _ESCAPES:
        host = host.replace(mark, escaped)
    return "".join(label + "\x01" for label in reversed(host.split("."))) if host else ""


def with_host_and_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    # a newline in a url is a character like others: both classes above take it
    return df.withColumns({"host": host, "path": path})


def _intervals(rules) -> list[tuple[str, str, str, str]]:
    """(key prefix, path, rule, action) in the order of the sweep."""
    seen: dict[str, tuple] = {}
    for action, host, path in rules:
        host = host.translate(str.maketrans(_UPPER, _LOWER))
        seen.setdefault(host + path, (host_key(host), path, host + path, action))
    return sorted(seen.values())


def sweep(keys, paths, intervals: list[tuple[str, str, str, str]], at: int, stack: list):
    """Yield ((rule, action) or None, next interval) of each (key, path), keys ascending. ``at``, ``stack``: where the
    sweep stands; the stack goes on from batch to batch."""
    for key, path in zip(keys, paths, strict=True):
        while at < len(intervals) and intervals[at][0] <= key:
            prefix = intervals[at][0]
            while stack and not prefix.startswith(stack[-1][0]):
                stack.pop()
            stack.append(intervals[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for _, start, rule, action in stack:
            if path.startswith(start) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
                best = (rule, action)
        yield best, at


def url_filter(df: DataFrame, rules=RULES, url_col: str = "url", default: str = DEFAULT, rules_per_block: int = RULES_PER_BLOCK) -> DataFrame:
    """Add host, path, rule and verdict to the rows of ``df``."""
    spark = df.sparkSession
    prepare(spark)
    kept = [c for c in df.columns if c.lower() not in _OUT]
    parted = with_host_and_path(df.withColumn("_url", F.col(f"`{url_col}`")).select(*(F.col(f"`{c}`") for c in kept), "_url"), "_url").drop("_url")
    host = F.col("host")
    for mark, escaped in _ESCAPES:
        host = F.replace(host, F.lit(mark), F.lit(escaped))
    labels = F.reverse(F.split(host, r"\."))
    keyed = parted.withColumn("_key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(labels, "\x01"), F.lit("\x01"))))
    keyed = keyed.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in kept if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = keyed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    names = out.columns
    intervals = _intervals(rules)
    earlier = None
    for i in range(0, len(intervals), rules_per_block):
        block = intervals[i : i + rules_per_block]

        def run(batches, block=block):
            at, stack = 0, []
            for batch in batches:
                found = {c: batch.column(names.index(c)).to_pylist() for c in ("_key", "path", "rule", "verdict")}
                new_rules, verdicts = found["rule"], found["verdict"]
                for i, (best, at) in enumerate(sweep(found["_key"], found["path"], block, at, stack)):
                    if best and (new_rules[i] is None or (len(best[0]), best[0]) > (len(new_rules[i]), new_rules[i])):
                        new_rules[i], verdicts[i] = best
                cols = {**{c: batch.column(k) for k, c in enumerate(names)}, "rule": pa.array(new_rules, pa.string()), "verdict": pa.array(verdicts, pa.string())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

        out = out.repartitionByRange(n, "_key", "path", "_tie").sortWithinPartitions("_key", "path", "_tie").mapInArrow(run, out.schema)
        if i + rules_per_block < len(intervals):
            out = stored(out, "url-rules")
            discard(spark, earlier)
            earlier = out
    return out.select(*(F.col(f"`{c}`") for c in kept), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(action, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)
"""

QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {"op5_url_filter": ORACLE}
