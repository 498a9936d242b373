"""Preparing paired observations: scope, bounds, means, outliers, duplicates, union of sources, staged counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inclusive bounds of valid points: latitude, longitude.
LAT, LON = (3.3, 14.9), (32.9, 48.2)


def in_bounds(lat: Column, lon: Column) -> Column:
    """Within the extent; zero coordinates count as missing."""
    return lat.between(*LAT) & lon.between(*LON) & (lat != 0) & (lon != 0)


def positive_means(treated: Column, control: Column) -> Column:
    return (treated > 0) & (control > 0)


def no_outlier(treated: Column, control: Column, most: float = 20) -> Column:
    """Increases beyond `most` times are dropped, large reductions are kept."""
    return (control > 0) & (treated / F.nullif(control, F.lit(0.0)) <= most)


def canonical(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Replace raw labels by canonical ones (labels: raw, label), matched trimmed and in lower case; others are out of scope."""
    key = labels.select(F.lower(F.trim("raw")).alias("_key"), "label")
    return df.withColumn("_key", F.lower(F.trim(column))).join(key, "_key").withColumn(column, F.col("label")).drop("_key", "label")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Raw column names as canonical ones; names that are not there are passed over."""
    return df.withColumnsRenamed(names)


def without(df: DataFrame, leaks: list[str]) -> DataFrame:
    """Rows without the columns that tell the answer."""
    return df.drop(*leaks)


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal in the given columns; a None asks for nothing."""
    return reduce(lambda out, kv: out.filter(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if v is not None), df)


def at_points(df: DataFrame, lat: str, lon: str, sample) -> DataFrame:
    """df with what sample (a function of distinct points (lat, lon)) finds: each point is sampled once."""
    return df.join(sample(df.select(lat, lon).distinct()), [lat, lon], "left")


def crop_name(raw: Column, synonyms: dict[str, str]) -> Column:
    """A crop in one spelling: trimmed, single spaces, lower case, synonyms replaced, first letter large; blank is null."""
    low = F.nullif(F.trim(F.regexp_replace(F.lower(raw), r"\s+", " ")), F.lit(""))
    if synonyms:
        low = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]), low), low)
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20))


def crop_group(name: Column, groups: dict[str, list[str]], other: str = "Other") -> Column:
    """The group of a crop; names that join several crops are intercrops."""
    several = F.regexp_like(name, F.lit(r"(?i)[/+&]|\bintercrop|\band\b"))
    found = reduce(lambda out, kv: out.when(F.lower(name).isin([c.lower() for c in kv[1]]), kv[0]), groups.items(), F.when(several, "Intercrop"))
    return F.when(name.isNotNull(), found.otherwise(other))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """stage, step, n: rows left after each step, in one pass."""
    passed = [reduce(lambda a, b: a & b, [c for _, c in steps[: i + 1]]) for i in range(len(steps))]
    counts = df.agg(F.count(F.lit(1)).alias("n0"), *[F.count_if(p).alias(f"n{i + 1}") for i, p in enumerate(passed)])
    names = ["all", *[n for n, _ in steps]]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("stage"), F.lit(n).alias("step"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)])
    return counts.select(F.inline(rows))


def tagged_union(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of all sources under each other, with a source column and keys prefixed by it."""
    tagged = [df.withColumn("source", F.lit(s)).withColumn(key, F.concat(F.lit(f"{s}_"), F.col(key).cast("string"))) for s, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def strip_prefix(column: Column, prefix: str) -> Column:
    return F.regexp_replace(column, f"^{prefix}_", "")


def drop_exact(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first of rows that are equal in the columns."""
    first = Window.partitionBy(*columns).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def insert_after(df: DataFrame, new: str, after: str) -> DataFrame:
    """Move a column behind another."""
    names = [c for c in df.columns if c != new]
    at = names.index(after) + 1
    return df.select(*names[:at], new, *names[at:])


def missing_names(flags: dict[str, Column]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
