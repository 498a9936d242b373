"""Deterministic sampling by md5 order: quotas by stratum, round robin over cells, blinded packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def scan_caps(df: DataFrame, order: str, wanted: Column, scan: int, keep: int) -> DataFrame:
    """The first `keep` wanted ones of the first `scan` rows in order; the caps are what is asked for.

    Each task keeps only its own first rows, so no more than `scan` of them meet.
    """
    return df.orderBy(order).limit(scan).filter(wanted).orderBy(order).limit(keep)


def quota(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each stratum, by md5 order."""
    order = Window.partitionBy(*strata).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= n)


def quota_by_study(df: DataFrame, strata: list[str], study: str, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each stratum by md5 order, a row of each study before a second one of any."""
    order = hash_order(F.col(key), seed)
    turn = F.row_number().over(Window.partitionBy(*strata, study).orderBy(order, key))
    picked = df.withColumn("_turn", turn)
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_turn", order, key))
    return picked.withColumn("pick", place).filter(F.col("pick") <= n).drop("_turn")


def build_report(rows: DataFrame, picked: DataFrame, strata: list[str]) -> DataFrame:
    """n, n_cells and the distinct values of each stratum among picked rows, and n_skipped: rows that were not picked."""
    cells = F.count_distinct(F.concat_ws("|", *strata)).alias("n_cells")
    found = picked.agg(F.count(F.lit(1)).alias("n"), cells, *[F.count_distinct(s).alias(f"n_{s}") for s in strata])
    return found.crossJoin(rows.agg(F.count(F.lit(1)).alias("_all"))).withColumn("n_skipped", F.col("_all") - F.col("n")).drop("_all")


def round_robin(df: DataFrame, cells: list[str], key: str, n: int) -> DataFrame:
    """n rows that take one of each cell in turn; a top-n, so no global sort."""
    place = F.row_number().over(Window.partitionBy(*cells).orderBy(key))
    return df.withColumn("round", place).orderBy("round", *cells).limit(n)


def packets(df: DataFrame, key: str, conditions: tuple[str, str], seed: str) -> DataFrame:
    """key, label X or Y, condition, item_code: each item in both conditions, which of them is X by md5 parity."""
    digit = F.conv(F.substring(hash_order(F.col(key), seed), 1, 1), 16, 10).cast("int")
    first, second = (F.lit(c) for c in conditions)
    pair = F.array(
        F.struct(F.lit("X").alias("label"), F.when(digit % 2 == 0, first).otherwise(second).alias("condition")),
        F.struct(F.lit("Y").alias("label"), F.when(digit % 2 == 0, second).otherwise(first).alias("condition")),
    )
    coded = F.substring(F.md5(F.concat(F.lit(f"{seed}:code:"), F.col(key).cast("string"))), 1, 8)
    return df.select(key, coded.alias("item_code"), F.inline(pair))
