"""Folds by group, leave-fold-out baselines, and error metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(key: Column, seed: str = "") -> Column:
    """0 to 255 from the first two digits of an md5; the same in any SQL engine."""
    digits = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return F.conv(F.substring(digits, 1, 2), 16, 10).cast("long")


def hash_fold(key: Column, folds: int, seed: str = "") -> Column:
    """A fold by a group's hash: no pass over the groups, at any number of them."""
    return F.pmod(hash_number(key, seed), F.lit(folds))


def _loads(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, list[int]]]:
    """For each size, largest first: the folds' loads before its groups are dealt.

    Groups of one size go to the least of load + k * size, so all of them are counted at once, by the level they reach.
    """
    load, out = [0] * folds, []
    for size, n in sizes:
        out.append((size, list(load)))
        low, high = 0, max(load) + n * size
        while low < high:  # the least level at which the folds take n groups
            mid = (low + high) // 2
            if sum(max(0, (mid - x) // size + 1) for x in load) >= n:
                high = mid
            else:
                low = mid + 1
        taken = [max(0, (low - 1 - x) // size + 1) for x in load]
        left = n - sum(taken)
        for i in range(folds):  # those at the level itself, by number of fold
            if left and load[i] <= low and (low - load[i]) % size == 0:
                taken[i] += 1
                left -= 1
        load = [x + t * size for x, t in zip(load, taken, strict=True)]
    return out


def _turns(load: list[int], size: int, n: int) -> list[tuple[int, int, list[int]]]:
    """Stretches (from, until, folds) of n groups of one size: within one, folds take turns in a fixed order.

    A stretch ends where the level reaches the load of a fold that took no part so far, so there is one a fold at most.
    """
    levels, out, start = sorted(set(load)), [], 0
    for level, until in zip(levels, [*levels[1:], None], strict=True):
        first = sorted((x - (x - level) // size * size, f) for f, x in enumerate(load) if x <= level)
        count = n - start if until is None else sum(max(0, -((r - until) // size)) for r, _ in first)
        if min(count, n - start) > 0:
            out.append((start, min(n, start + count), [f for _, f in first]))
        start += count
    return out


def _places(df: DataFrame, within: str, by: str, parts: int) -> DataFrame:
    """Add place, from 0: a row's number within `within` in order of `by`, whose values differ, in even parts of the values.

    The parts end at the values of least hash, a fixed sample of bounded size.
    """
    ends = sorted(r[0] for r in df.filter(F.col(by).isNotNull()).orderBy(F.xxhash64(by)).limit(parts - 1).select(by).collect())
    part = F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda x: x <= F.col(by))) if ends else F.lit(0)
    rows = df.withColumn("_part", F.when(F.col(by).isNull(), 0).otherwise(part))
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(within, "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    own = F.row_number().over(Window.partitionBy(within, "_part").orderBy(by)) - 1
    return rows.withColumn("_own", own).join(counted, [within, "_part"]).withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def greedy_folds(df: DataFrame, group: str, folds: int, parts: int = 128) -> DataFrame:
    """group, n, fold: groups by size, largest first (ties by name), each to the fold with the fewest rows so far.

    Only the distinct sizes, with how many groups have them, come to the driver: N rows have at most sqrt(2 N) of them.
    Within a size the k-th group by name takes the k-th turn of the folds; groups of one size are numbered in `parts`
    ranges of their names, so no task holds all of them.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    counted = [(r["n"], r["c"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).toLocalIterator()]
    turns = [(size, *t) for (size, load), (_, n) in zip(_loads(counted, folds), counted, strict=True) for t in _turns(load, size, n)]
    turns = df.sparkSession.createDataFrame(turns, "n long, start long, until long, folds array<int>")
    named = _places(sizes, "n", group, parts).join(turns, "n").filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("until")))
    return named.select(group, "n", F.get("folds", ((F.col("place") - F.col("start")) % F.size("folds")).cast("int")).cast("long").alias("fold"))


def shuffle_split(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """Add test: whether a row's group is among the given share of the groups, rounded up, by md5 order."""
    groups = df.select(group).distinct()
    n = groups.count()
    order = F.md5(F.concat(F.lit(seed), F.col(group).cast("string")))
    test = groups.orderBy(order, group).limit(math.ceil(n * share)).withColumn("test", F.lit(True))
    return df.join(test, group, "left").withColumn("test", F.coalesce("test", F.lit(False)))


def fold_means(df: DataFrame, fold: str, actual: str, predicted: str) -> DataFrame:
    """n_folds, r2, rmse: the plain means of each fold's own figures."""
    own = df.groupBy(fold).agg(*metrics(actual, predicted))
    return own.agg(F.count(F.lit(1)).alias("n_folds"), F.round(F.avg("r2"), 6).alias("r2"), F.round(F.avg("rmse"), 6).alias("rmse"))


def oof_mean(df: DataFrame, keys: list[str], fold: str, value: str) -> DataFrame:
    """Add predicted: the mean over the other folds of the same keys, else over the other folds at all.

    One pass: sums of the key less the fold's own.
    """
    own = df.groupBy(*keys, fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    over, other = Window.partitionBy(*keys), Window.partitionBy(F.lit(0))
    out = own.withColumn("rest_s", F.sum("s").over(over) - F.col("s")).withColumn("rest_n", F.sum("n").over(over) - F.col("n"))
    whole = df.groupBy(fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = whole.select(fold, ((F.sum("s").over(other) - F.col("s")) / F.nullif(F.sum("n").over(other) - F.col("n"), F.lit(0))).alias("overall"))
    found = out.join(F.broadcast(whole), fold).select(*keys, fold, F.coalesce(F.when(F.col("rest_n") > 0, F.col("rest_s") / F.nullif("rest_n", F.lit(0))), "overall").alias("predicted"))
    return df.join(found, [*keys, fold])


def metrics(actual: str, predicted: str) -> list[Column]:
    """n, r2, rmse as aggregates over a group; r2 from sums, so one pass serves all groups."""
    y, p = F.col(actual), F.col(predicted)
    rss, tss = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return [F.count(F.lit(1)).alias("n"), F.round(1 - rss / F.nullif(tss, F.lit(0.0)), 6).alias("r2"), F.round(F.sqrt(rss / F.count(y)), 6).alias("rmse")]


def sums(label: str) -> list[Column]:
    """n, the label, apart: the number of a group's labels, their sum, and their squared deviations from their mean."""
    return [F.count(label).alias("n"), F.sum(label).alias(label), (F.var_pop(label) * F.count(label)).alias("apart")]


def summed_metrics(label: str, predicted: str) -> list[Column]:
    """As metrics(), over rows that each stand for many of one prediction, put together by sums()."""
    n, mean = F.col("n"), F.col(label) / F.col("n")
    rss = F.sum(F.col("apart") + n * F.pow(mean - F.col(predicted), 2))
    tss = F.sum(F.col("apart") + n * F.pow(mean, 2)) - F.pow(F.sum(label), 2) / F.sum(n)
    return [F.sum(n).alias("n"), F.round(1 - rss / F.nullif(tss, F.lit(0.0)), 6).alias("r2"), F.round(F.sqrt(rss / F.sum(n)), 6).alias("rmse")]
