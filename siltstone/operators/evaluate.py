"""Retrieval quality: labels, recall, success and reciprocal rank, reports by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (4, 8, 16)


def score(ranked: DataFrame, relevant: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """query_id, recall and success at each level, and mrr, for ranked (query_id, study, rank) and relevant (query_id, study).

    Depth counts ranked rows, so repeats of a study use it up; recall counts distinct relevant studies.  Queries without
    ranked or relevant rows score 0.
    """
    wanted = relevant.distinct().withColumn("hit", F.lit(True))
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    first = ranked.groupBy("query_id", "study").agg(F.min("rank").alias("rank"))
    hits = first.join(wanted, ["query_id", "study"])
    found = hits.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in levels])
    ids = ranked.select("query_id").union(relevant.select("query_id")).distinct()
    out = ids.join(size, "query_id", "left").join(found, "query_id", "left")
    return out.select(
        "query_id",
        *[F.round(F.coalesce(F.col(f"h{k}") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias(f"recall_{k}") for k in levels],
        *[F.coalesce((F.col(f"h{k}") > 0).cast("int"), F.lit(0)).alias(f"success_{k}") for k in levels],
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def report(scored: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Means over all rows and over each group, at 4 places, in one pass: scope, name, n and the values."""
    own = [F.when(F.grouping(g) == 0, F.lit(g)) for g in groups], [F.when(F.grouping(g) == 0, F.col(g).cast("string")) for g in groups]
    scope, name = (F.coalesce(*held, F.lit("all")) for held in own)
    sets = scored.groupingSets([[], *[[F.col(g)] for g in groups]], *[F.col(g) for g in groups])
    found = sets.agg(F.count(F.lit(1)).alias("n"), *[F.bround(F.avg(v), 4).alias(v) for v in values], scope.alias("scope"), name.alias("name"))
    return found.select("scope", "name", "n", *values)


def score_levels(ranked: DataFrame, strict: DataFrame, family: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """score() by strict labels and, as family_*, by family labels; a query without family labels keeps its strict ones."""
    without = strict.join(family.select("query_id").distinct(), "query_id", "left_anti")
    wide = score(ranked, family.select("query_id", "study").unionByName(without.select("query_id", "study")), levels)
    wide = wide.select("query_id", *[F.col(c).alias(f"family_{c}") for c in wide.columns if c != "query_id"])
    return score(ranked, strict, levels).join(wide, "query_id", "full").fillna(0)


def silver_labels(rows: DataFrame, corpus: DataFrame, study: str) -> DataFrame:
    """Rows whose study, without its source's prefix, the corpus holds."""
    return rows.withColumn("study", F.regexp_replace(study, "^ERA_", "")).join(corpus.select("study").distinct(), "study", "left_semi")


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """line: each row as a line of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
