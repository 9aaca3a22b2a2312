"""URL filters by a sort-merge range join.

A rule (host, path) covers its host and all subdomains where the path starts with the rule's.
A url is looked up once for each suffix of its host, as the canonical key "reversed labels,
space, path"; a rule's key is a prefix of such keys, that is, an interval, and intervals of
prefixes nest. Keys of rules and urls are sorted together across range partitions; a sweep
over each partition keeps the stack of rules that are open, the innermost of which is the
longest that fits. What is open at a partition's start follows from the ends of the earlier
ones. Of a url's look-ups the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, checkpoint, lower_ascii, materialize, shuffle_partitions, without

#: (host, path, verdict): the rules that the query applies.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BROADCAST_ROWS = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(" "), path)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's last key and the rules of its own that are open there."""
    stack: list[str] = []
    last = None
    for b in batches:
        for key, is_url in zip(b["key"], b["is_url"], strict=True):
            while stack and not key.startswith(stack[-1]):
                stack.pop()
            if not is_url:
                stack.append(key)
            last = key
    if last is not None:
        yield pd.DataFrame({"p": [TaskContext.get().partitionId()], "last": [last], "open": [stack]})


def _sweep(incoming):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[str] = list(incoming.value.get(TaskContext.get().partitionId(), ()))
        for b in batches:
            hits = []
            for key, is_url, host, path in zip(b["key"], b["is_url"], b["host"], b["path"], strict=True):
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                if not is_url:
                    stack.append(key)
                elif stack:
                    hits.append((host, path, stack[-1]))
            yield pd.DataFrame(hits, columns=["host", "path", "rule_key"])

    return run


def range_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: (key, host, path), rules: (key), both of canonical keys. Gives (host, path, rule_key) where a rule is a prefix of key: the longest such."""
    events = rules.select("key", F.lit(False).alias("is_url"), F.lit("").alias("host"), F.lit("").alias("path"))
    events = events.unionByName(urls.select("key", F.lit(True).alias("is_url"), "host", "path"))
    # Sorted by bytes as Spark sorts strings, rules first; checkpointed, so that both sweeps see the same partitions.
    parts = shuffle_partitions(events.sparkSession)
    events = checkpoint(events.repartitionByRange(parts, "key", "is_url", "host", "path").sortWithinPartitions("key", "is_url", "host", "path"))
    ends = events.mapInPandas(_ends, "p int, last string, open array<string>").collect()  # a row for each partition
    incoming, open_rules = {}, []
    for r in sorted(ends, key=lambda r: r.p):
        incoming[r.p] = list(open_rules)
        open_rules = [x for x in open_rules if r.last.startswith(x)] + list(r.open)
    incoming = events.sparkSession.sparkContext.broadcast(incoming)
    return events.mapInPandas(_sweep(incoming), "host string, path string, rule_key string")


def literal_rules(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; input columns with these names are replaced.

    rules: (host, path, verdict); paths start with "/". rule is the winner's host followed by its path, or null, and
    the verdict is then the default. The rule with most characters wins; of two, the one with the longer host. A rule
    given twice counts once, with the alphabetically first verdict (allow before block). Rules with a null host, path
    or verdict, or an empty host, are ignored. Null urls and urls without "://" have an empty host and path and no rule.
    """
    rules = rules.select(lower_ascii(F.col("host")).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")).filter("rh <> '' and rp is not null and rv is not null")
    rules = materialize(rules.groupBy("rh", "rp").agg(F.min("rv").alias("rv")).withColumn("key", _key(_labels(F.col("rh")), F.col("rp"))), "url-rules")
    rows = without(pages, *[c for c in ("host", "path", "rule", "verdict") if c != url_col]).withColumn("__tw_url", F.col(f"`{url_col}`").cast("string"))
    host, path = host_and_path(F.col("__tw_url"))
    rows = rows.withColumns({"__tw_host": host, "__tw_path": path})

    # Distinct urls, looked up once for each suffix of the host that has rules.
    urls = rows.select(F.col("__tw_host").alias("host"), F.col("__tw_path").alias("path")).filter("host <> ''").distinct()
    labels = _labels(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))
    looked = urls.withColumn("suffix", F.explode(suffixes))
    hosts = broadcast_if(rules.select(F.array_join(_labels(F.col("rh")), ".").alias("suffix")).distinct(), BROADCAST_ROWS)
    looked = looked.join(hosts, "suffix", "left_semi").select(F.concat("suffix", F.lit(" "), "path").alias("key"), "host", "path")
    hits = range_join(looked, rules.select("key")).join(broadcast_if(rules, BROADCAST_ROWS), F.col("rule_key") == F.col("key"))
    rule = F.concat("rh", "rp")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("rv").alias("verdict")), F.struct(F.length(rule), F.length("rh"), rule)).alias("b"))
    best = best.select(F.col("host").alias("__tw_h"), F.col("path").alias("__tw_p"), F.col("b.rule").alias("__tw_rule"), F.col("b.verdict").alias("__tw_verdict"))

    out = rows.join(best, (F.col("__tw_host") == F.col("__tw_h")) & (F.col("__tw_path") == F.col("__tw_p")), "left")
    out = out.withColumn("__tw_verdict", F.coalesce("__tw_verdict", F.lit(default))).drop("__tw_url", "__tw_h", "__tw_p")
    return out.withColumnsRenamed({"__tw_host": "host", "__tw_path": "path", "__tw_rule": "rule", "__tw_verdict": "verdict"})
