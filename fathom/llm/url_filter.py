"""URL filters as a sort-merge range join, in DataFrame operations only.

A url's key is its host with the labels reversed, each ended by a dot:
`blog.example.net` becomes `net.example.blog.`. A rule's host with all its
subdomains is then the interval from `net.example.` up to, not including,
`net.example/` ('/' follows '.' directly). Intervals of rules are nested or
apart, so a sweep over sorted keys keeps a stack: an interval's start pushes
its rules, its end takes them off. The stack after each of these boundaries is made once, by a sweep over the (bounded) rules.
Urls and boundaries are then merged by key and each url takes the stack of
the last boundary before it; of that stack the longest rule whose path begins the
url's path wins.

The sweep runs in `lanes` side by side: urls are dealt by a hash of the page,
never by host, so a hot host is spread, and every lane holds all boundaries
(at most two a rule).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules up to which every lane holds all boundaries.
MOST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str = "/"


def url_host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: list[Rule]) -> list[tuple[str, int, list[Rule]]]:
    """(key, opens, stack): from this key on, the rules of these open intervals hold, outermost first. Sorted; ends come before starts."""
    own: dict[str, list[Rule]] = {}
    for r in sorted(set(rules), key=lambda r: (r.host, r.path, r.verdict)):
        own.setdefault(".".join(reversed(r.host.split("."))) + ".", []).append(r)
    stack, out = [], []
    for key, opens, low in sorted([(low, 1, low) for low in own] + [(low[:-1] + "/", 0, low) for low in own]):
        if opens:
            stack.append(own[low])
        else:
            stack.pop()
        out.append((key, opens, [r for held in stack for r in held]))
    return out


_STACK = "array<struct<host: string, path: string, verdict: string>>"


def _marks(spark, rules: list[Rule]) -> DataFrame:
    listed = json.dumps([{"key": key, "opens": opens, "stack": [{"host": r.host, "path": r.path, "verdict": r.verdict} for r in stack]} for key, opens, stack in boundaries(rules)])
    return spark.range(1).select(F.explode(F.from_json(F.lit(listed), f"array<struct<key: string, opens: int, stack: {_STACK}>>")).alias("m")).select("m.*")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", lanes: int | None = None) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path; the longest wins: by host, then by path, then a block. Null urls and urls without :// have an
    empty host and path, no rule and the default verdict, like any url that no rule fits. Repeats and null page_ids
    are kept; other columns are ignored; no rules means defaults only.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    spark = pages.sparkSession
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = _marks(spark, rules).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    rows = urls.withColumn("lane", F.pmod(F.xxhash64("page_id", "path", "host"), F.lit(lanes)).cast("int")).withColumn("key", host_key(F.col("host")))
    merged = marks.select("lane", "key", "opens", "stack", *[F.lit(None).cast(t).alias(c) for c, t in urls.dtypes]).unionByName(rows.select("lane", "key", F.lit(2).alias("opens"), F.lit(None).cast(_STACK).alias("stack"), *urls.columns))
    sweep = Window.partitionBy("lane").orderBy("key", "opens").rowsBetween(Window.unboundedPreceding, 0)
    swept = merged.withColumn("stack", F.last("stack", True).over(sweep)).where("opens = 2")
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["host"]).alias("a"), F.length(r["path"]).alias("b"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
