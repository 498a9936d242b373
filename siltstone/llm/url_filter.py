"""URL filters: rules over hosts and paths, looked up by hashed expressions, in DataFrame operations only.

A rule is a host, whose subdomains it covers, and a path with which a URL's path must start.  Each URL is expanded into
expressions, a suffix of its host and a prefix of its path: one for each shape (labels of the host, characters of the
path) that some rule has, since no other can equal a rule.  Expressions meet rules by a short prefix of their SHA-256;
of those that meet, the full digests decide.  The longest rule that fits wins.

Only digests and row numbers travel, each once.  Rules of one prefix are copied to SALTS parts and a URL goes to one of
them by its row number, so an expression that a third of all URLs share is dealt out; a list small enough for Spark's
own broadcast threshold is not shuffled at all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import durable, pick

#: Hex digits of the hash prefix on which expressions and rules meet.
PREFIX = 8
#: Parts that the URLs of one prefix are dealt to.
SALTS = 16


def _lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host after the first `://` up to `/`, `?` or `#`, the path then up to `?` or `#`.

    Both are empty where the URL is null or has no `://`.
    """
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _labels(host: str) -> Column:
    return F.size(F.split(host, "[.]"))


def _shapes(shapes: list[tuple[int, int]]) -> Column:
    kind = "array<struct<labels: int, chars: int>>"
    return F.from_json(F.lit(json.dumps([{"labels": n, "chars": c} for n, c in sorted(shapes)])), kind) if shapes else F.lit(None).cast(kind)


def prepared(rules: DataFrame) -> DataFrame:
    """rule, labels, chars, digest, prefix, blocks, size of each rule (host, path, verdict).

    Rules of equal host and path count once; where they differ in their verdicts, block wins.  A null host or path
    reads as empty; a rule whose verdict is neither allow nor block raises.
    """
    rules = pick(rules, host="host", path="path", verdict="verdict")
    rules = rules.select(_lower(F.coalesce(F.col("host").cast("string"), F.lit(""))).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string"))
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict") == "block").otherwise(F.raise_error(F.concat(F.lit("no verdict: "), F.coalesce("verdict", F.lit("null")))).cast("boolean"))
    rules = rules.withColumn("blocks", known).groupBy("host", "path").agg(F.max("blocks").alias("blocks")).withColumn("rule", F.concat("host", "path"))
    digest = F.sha2(F.col("rule").cast("binary"), 256)
    return rules.select("rule", _labels("host").alias("labels"), F.length("path").alias("chars"), digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"), "blocks", F.length("rule").alias("size"), F.length("host").alias("host_size"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id_col, host, path, rule (host and path of the longest rule that fits, else null), verdict (its, else default).

    Of two rules of equal length the one of the longer host wins.  Null ids, repeated rows and URLs without a host each
    return; without rules every URL gets the default; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pick(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    rules = durable(prepared(rules))
    shapes = [(r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect()]  # lengths only, however many rules
    fits = F.filter(_shapes(shapes), lambda s: (s["labels"] <= _labels("host")) & (s["chars"] <= F.length("path")))
    expressions = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.left(F.col("path"), s["chars"])))
    asked = rows.select("row", F.explode(F.transform(expressions, lambda e: F.sha2(e.cast("binary"), 256))).alias("asked"))
    asked = asked.withColumn("prefix", F.substring("asked", 1, PREFIX)).withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = asked.join(salted, ["prefix", "salt"])
    rank = F.struct("size", "host_size", "blocks", "rule")
    best = met.groupBy("row").agg(F.max(F.when(F.col("asked") == F.col("digest"), rank)).alias("best"))
    verdict = F.when(F.col("best.blocks"), "block").when(F.col("best").isNotNull(), "allow").otherwise(default)
    return rows.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
