"""Data quality: profiles, missing values, duplicates, tables of counts, correlations, invariants."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, minimum, maximum, mean: one aggregate over all columns."""
    found = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{c}").cast("double").alias(a) for n, a in (("min", "minimum"), ("max", "maximum"), ("avg", "mean"))]) for c in columns]
    return found.select(F.inline(F.array(*rows))).withColumn("mean", F.round("mean", 6))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing."""
    found = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, n_duplicates: rows beyond the first of each combination."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct, exact.  Each column is expanded to one row, so that one shuffle serves all."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    return long.filter("value is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def stats_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sample standard deviation."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 3).alias("mean"), F.round(F.stddev_samp(value), 3).alias("std"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each pair, zero where there is none."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def largest_group(df: DataFrame, key: str) -> DataFrame:
    """n_groups, max_rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("max_rows"))


def correlated(df: DataFrame, columns: list[str], above: float) -> DataFrame:
    """left, right, r of column pairs whose correlation exceeds `above` either way; one pass."""
    pairs = list(combinations(columns, 2))
    found = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)]
    return found.select(F.inline(F.array(*rows))).filter(F.abs("r") > above)


def all_close(a: Column, b: Column, rtol: float = 1e-4, atol: float = 1e-8) -> Column:
    """An aggregate: whether all pairs agree."""
    return F.bool_and(F.abs(a - b) <= atol + rtol * F.abs(b))


def mode_with_fallback(df: DataFrame, narrow: str, wide: str, value: str) -> DataFrame:
    """narrow, value: the mode within each narrow group; ties go to the least value; a group without values takes its wide group's."""
    def modes(key):
        counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(f"{key}_mode"))

    groups = df.select(narrow, wide).distinct()
    joined = groups.join(modes(narrow), narrow, "left").join(modes(wide), wide, "left")
    return joined.select(narrow, F.coalesce(f"{narrow}_mode", f"{wide}_mode").alias(value))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """column, code: distinct values in order, from 0; codes come from ranks of the distinct values only."""
    from pyspark.sql import Window

    return df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Add column_code; values without a code get -1."""
    named = codes.select(F.col(column).alias("_value"), F.col("code").alias(f"{column}_code"))
    return df.join(named, df[column] == F.col("_value"), "left").drop("_value").fillna({f"{column}_code": -1})
