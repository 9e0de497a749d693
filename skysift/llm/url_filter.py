"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule is ``host/path-prefix`` with an action. It fits a URL whose host is the rule's or one of its
subdomains and whose path starts with the rule's path. For each URL the candidate keys are its host
suffixes and path prefixes of the (depth, length) shapes that occur in the list. The Bloom filter, of any
list, is tested inside the scan stage, so that only possible hits are joined. The join removes false
positives; the longest rule wins, and of equally long ones that of the longer host.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule. Repeated
rows stay repeated. A null or empty rule is ignored; equal rules with two actions count as ``block``. URLs of
any length are read whole. Columns of ``pages`` other than those asked for, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.bloom import may_contain
from skysift.llm.common import ascii_lower, written

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL_PARTS, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def listed(rules: DataFrame, rule: str = "rule", action: str = "action") -> DataFrame:
    """Rules as (key, rule, action), one row per distinct rule."""
    r = rules.select(F.col(rule).alias("rule"), F.col(action).alias("action")).filter(F.length("rule") > 0)
    r = r.groupBy("rule").agg(F.max("action").alias("action"))
    host = ascii_lower(F.substring_index("rule", "/", 1))
    return r.select(F.concat(host, F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")).alias("key"), "rule", "action")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Judge each row's URL: ``keep`` columns, url, host, path, rule, verdict."""
    table = written(listed(rules))
    shapes = table.select(
        F.size(F.split(F.substring_index("key", "/", 1), r"\.")).alias("depth"),
        (F.length("key") - F.length(F.substring_index("key", "/", 1))).alias("length"),
    )
    shapes = sorted(tuple(x) for x in shapes.distinct().collect())  # bounded by host depth times URL length
    may_be_listed = may_contain(table, "key")

    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url).alias("u"))
    keys = [f"k{i}" for i in range(len(keep))]
    # Equal rows are judged once; this also deals out a hot page or host by whole rows.
    rows = rows.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"host": url_host(F.col("u")), "path": url_path(F.col("u"))})
    parts = F.split("host", r"\.")
    wanted = [
        F.when(
            (F.size(parts) >= depth) & (F.length("path") >= length) & (F.length("host") > 0),
            F.concat(F.array_join(F.slice(parts, -depth, depth), "."), F.substring(F.col("path"), 1, length)),
        )
        for depth, length in shapes
    ]
    candidates = F.array_compact(F.array(*wanted)) if wanted else F.array().cast("array<string>")
    probes = rows.select(*keys, "u", "copies", "host", "path", F.posexplode_outer(candidates).alias("at", "key"))
    # a row's first candidate stands for it in any case; the join decides
    probes = probes.filter(F.col("at").isNull() | (F.col("at") == 0) | may_be_listed(F.col("key"))).drop("at")
    joined = probes.join(table, "key", "left")
    longest = F.max_by("found", F.struct(F.length("found.rule"), F.length(F.substring_index("found.rule", "/", 1))))
    best = (
        joined.withColumn("found", F.when(F.col("rule").isNotNull(), F.struct("rule", "action")))
        .groupBy(*keys, "u", "copies", "host", "path")
        .agg(longest.alias("found"))
    )
    out = best.select(*[F.col(k).alias(c) for k, c in zip(keys, keep)], F.col("u").alias(url), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict"), "copies")
    return out.withColumn("copies", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
