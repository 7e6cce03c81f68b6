"""Allow and block rules on web addresses.

A rule has a host and a path. It fits an address if the host is the rule's or below it
and the path starts with the rule's. An address is expanded into host suffixes with
path prefixes, of those sizes (labels, characters) only that rules have, so that there
are never more expressions than rules. An expression meets rules by the first
PREFIX hex digits of its SHA-256; equal whole digests confirm. The longest rule (host
and path together) wins, of equal ones that with the longer host; of rules
with one host and path `block` wins.

Rules are broadcast if their count, taken first, is at most BROADCAST_RULES: a row has two
hashes and two short strings cut to no more than ROW_BYTES. More rules, or longer ones, meet by a
shuffle. Addresses are judged once for each host and path.

Defined cases: a null address, or one without ://, has an empty host and path and fits no
rule. Hosts are lower-cased (A-Z) on both sides; ports, user names and odd characters stay in
the host. Rules with a null, repeated rules and an empty table of rules are fine: what fits
no rule gets `default`. Rows keep their number, repeated ones included. Columns
named like a result (host, path, rule, verdict) are left out; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, named, packed, unpacked

PREFIX = 8
BROADCAST_RULES = 50_000
ROW_BYTES = 400
RESULTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    end = lambda c, marks: F.regexp_extract(c, f"^[^{marks}]*", 0)
    host = F.coalesce(end(rest, "/?#"), F.lit(""))
    after = rest.substr(F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.coalesce(end(after, "?#"), F.lit(""))


def _hashed(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.col("expression").cast("binary"), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX))


def _rules(rules: DataFrame) -> DataFrame:
    """One row for each host and path: expression, its hashes, sizes and the action."""
    clean = rules.select("action", ascii_lower(F.col("host")).alias("host"), "path").where("action IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL AND host <> ''")
    one = clean.groupBy("host", "path").agg(F.when(F.bool_or(F.col("action") == "block"), "block").otherwise(F.min("action")).alias("action"))
    sizes = one.withColumn("labels", F.size(F.split("host", r"\."))).withColumn("chars", F.length("path")).withColumn("host_chars", F.length("host"))
    return _hashed(sizes.withColumn("expression", F.concat("host", "path"))).drop("host", "path")


def judge(urls: DataFrame, url: str, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Each row of urls with host, path, rule (the host and path of the one that wins, else null) and verdict."""
    others = tuple(c for c in urls.columns if c not in RESULTS)
    host, path = host_and_path(named(urls, url).cast("string"))
    rows = urls.select(packed(urls, RESULTS).alias("row"), host.alias("host"), path.alias("path"))
    listed = _rules(rules).select("expression", "digest", "prefix", "action", "labels", "chars", "host_chars")
    shapes, many, longest = listed.agg(F.collect_set(F.struct("labels", "chars")), F.count("*"), F.max(F.octet_length("expression") + F.octet_length("action"))).first()
    small = many <= broadcast_rules and (longest or 0) + 100 <= ROW_BYTES
    shape = F.array(*(F.struct(F.lit(a).alias("labels"), F.lit(c).alias("chars")) for a, c in shapes)) if shapes else F.expr("array()").cast("array<struct<labels:int,chars:int>>")

    pages = rows.select("host", "path").distinct().withColumn("parts", F.split("host", r"\."))
    each = pages.withColumn("shape", F.explode(F.filter(shape, lambda s: (s["labels"] <= F.size("parts")) & (s["chars"] <= F.length("path")))))
    suffix = F.expr("substring_index(host, '.', -shape.labels)")
    expressions = _hashed(each.select("host", "path", F.concat(suffix, F.col("path").substr(F.lit(1), F.col("shape.chars"))).alias("expression"))).drop("expression")
    known = listed.select(F.col("prefix"), F.col("digest").alias("full"), F.col("expression").alias("rule"), "action", "host_chars")
    hits = expressions.join(F.broadcast(known) if small else known.hint("merge"), "prefix").where("digest = full")
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "host_chars"))
    decided = hits.groupBy("host", "path").agg(best.alias("best"))

    out = rows.join(decided, ["host", "path"], "left")
    results = [F.col("host"), F.col("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")]
    return out.select(*unpacked("row", list(others), {}), *results)
