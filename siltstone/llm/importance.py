"""Importance resampling towards a target distribution, by hashed features and exact ranks of integer scores.

Features are runs of words, hashed into buckets.  A bucket's gain is the logarithm of how much likelier it is in the
target than in the whole; a document's weight is the sum of its features' gains, looked up in one array.  Weight plus
Gumbel noise of seed and id is the score, and the highest scores are a draw without replacement in proportion to
exp(weight).

Scores are whole numbers, so ranks come from their histogram: counts summed from the highest score down are the rank
at which each score begins, and the score in which the draw ends is the cutoff.  Rows from the cutoff up are numbered
by id within their score.  The histogram is summed in ranges of scores, of which only totals (one number for each range)
come to the driver; a score that many rows share is numbered in ranges of ids.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import durable, numbered, pick, ranges

#: Words of lower-cased texts: digits, letters and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none where it is null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _features(taken: Column, runs: int) -> Column:
    """All runs of 1 to `runs` consecutive words, joined by one space, repeats included."""

    def of(n: int) -> Column:
        starts = F.when(F.size(taken) >= n, F.sequence(F.lit(1), F.size(taken) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(taken, i, n), " "))

    return F.concat(taken, *map(of, range(2, runs + 1))) if runs > 1 else taken


def _buckets(features: Column, buckets: int) -> Column:
    return F.transform(features, lambda f: F.crc32(f.cast("binary")) % buckets)


def bucket_counts(texts: DataFrame, buckets: int, runs: int, text_col: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket; counts are summed in each task before they travel."""
    found = pick(texts, text=text_col).select(F.explode(_buckets(_features(words(F.col("text").cast("string")), runs), buckets)).alias("b"))
    out = [0] * buckets
    for r in found.groupBy("b").count().collect():  # one row for each bucket
        out[r.b] = r["count"]
    return out


def gains(spark, whole: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of B buckets, in doubles."""
    b, s, t = float(len(whole)), float(sum(whole)), float(sum(target))
    both = spark.createDataFrame(list(enumerate(zip(whole, target, strict=True))), "b int, n struct<s: long, t: long>")
    ratio = (F.col("n.t").cast("double") + 1.0) * F.lit(s + b) / ((F.col("n.s").cast("double") + 1.0) * F.lit(t + b))
    return [r.g for r in both.select("b", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("g")).orderBy("b").collect()]


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256("seed:id"); a null id reads as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: list[int], runs: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score of each row; a text without words has weight 0."""
    taken = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), words(F.col("text").cast("string")).alias("words"))
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    found = taken.select("id", F.size("words").cast("long").alias("n_words"), _buckets(_features(F.col("words"), runs), len(gain)).alias("buckets"))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda sofar, b: sofar + F.get(table, b.cast("int")))
    found = found.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return found.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def ranked(scored: DataFrame, draw: Column | None = None, percent: int = 10) -> DataFrame:
    """The rows (id, score, ...) with rank: 1, 2, 3... for the floor(percent / 100 of all rows) highest scores, else null.

    Ties go to the smaller id, null first, then to the row of the smaller other columns.
    """
    if draw is not None:
        out = scored.filter(draw)
        return ranked(out, percent=percent).unionByName(scored.filter(~draw).withColumn("rank", F.lit(None).cast("long")))
    others = [c for c in scored.columns if c not in ("id", "score")]
    histogram = ranges(scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")), F.col("score").desc()).withColumn("range", F.shiftright("_at", 33).cast("int"))
    totals = {r.range: r.n for r in histogram.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row for each range
    wanted = sum(totals.values()) * percent // 100
    before = list(accumulate((totals.get(k, 0) for k in range(max(totals, default=-1) + 1)), initial=0))
    base = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("range"))
    above = Window.partitionBy("range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    first = histogram.withColumn("first", base + F.coalesce(F.sum("n").over(above), F.lit(0)))
    first = durable(first.filter(F.col("first") < wanted).select("score", "first"))
    cutoff = first.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    taken = numbered(scored.filter(F.col("score") >= cutoff), ["score"], ["id", *others], first).drop("size")
    rank = F.when(F.col("pos") < wanted, F.col("pos") + 1)
    return taken.withColumn("rank", rank).drop("pos").unionByName(scored.filter(F.col("score") < cutoff).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    buckets: int = 10_000,
    runs: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Per row: id_col, n_words, n_features, weight, score and rank, null where the row is not drawn.

    Of the N rows with at least least_words words the floor(percent N / 100) highest scores are drawn.  Null and empty
    texts have no features and weight 0; null ids and repeated rows each return and take ranks of their own; an empty
    target has no features and gains come from the whole alone; an empty table gives no rows.
    """
    gain = gains(docs.sparkSession, bucket_counts(docs, buckets, runs, text_col), bucket_counts(target, buckets, runs, target_col))
    scored = durable(weigh(docs, gain, runs, seed, id_col, text_col))
    return ranked(scored, F.col("n_words") >= least_words, percent).withColumnRenamed("id", id_col)
