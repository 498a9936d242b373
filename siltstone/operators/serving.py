"""What answers are made of: query texts, set-up stages, changed slots, coverage, acquisition, contexts, study statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltstone.operators import grid
from siltstone.operators.prepare import LAT, LON, missing_names

#: Other names that studies use for an indicator.
SYNONYMS = {"water use efficiency": ("water productivity",), "SOM content": ("soil organic matter",), "soil loss": ("soil erosion",)}


def query_text(practice: Column, family: Column, indicator: Column, belt: Column, crop: Column, rain: Column, slope: Column, country: str = "Ethiopia") -> Column:
    """The retrieval query of a recommendation; blank parts and zero rain are left out, numbers rounded half to even."""
    other = reduce(lambda out, kv: F.when(indicator == kv[0], F.lit(" ".join(kv[1]))).otherwise(out), SYNONYMS.items(), F.lit(None).cast("string"))
    whole = lambda x: F.bround(x, 0).cast("bigint").cast("string")
    parts = [
        practice, family, F.concat(F.lit("effect on "), indicator), other, F.lit(country), belt, crop,
        F.when(rain != 0, F.concat(whole(rain), F.lit(" mm annual rainfall"))), F.when(slope.isNotNull(), F.concat(whole(slope), F.lit("% slope"))),
    ]
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def stage(lat: Column, lon: Column, family: Column, indicator: Column, reopened: Column) -> Column:
    """What a user is to give next."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(lat.isNull() | lon.isNull(), "location").when(reopened | blank(family), "challenge").when(blank(indicator), "objective").otherwise("complete")


def slots_changed(new: Mapping[str, Column], old: Mapping[str, Column], at: tuple[Column, Column], was: tuple[Column, Column], tolerance: float = 1e-4) -> Column:
    """Whether a turn states something else than the recommendation before; what it leaves out is no change."""
    named = [v.isNotNull() & (v != "") & ~v.eqNullSafe(old[k]) for k, v in new.items()]
    moved = at[0].isNotNull() & at[1].isNotNull() & F.coalesce((F.abs(at[0] - was[0]) > tolerance) | (F.abs(at[1] - was[1]) > tolerance), F.lit(True))
    return reduce(lambda a, b: a | b, [*named, moved])


def clarification(family: Column, indicator: Column, located: Column, asks: Mapping[str, str]) -> Column:
    """A request for what is missing, after what was understood; null if nothing is."""
    missing = missing_names({"challenge": family.isNull(), "objective": indicator.isNull(), "location": ~located})
    known = F.array_compact(F.array(F.when(family.isNotNull(), F.concat(F.lit("challenge "), short_family(family))), F.when(indicator.isNotNull(), F.concat(F.lit("objective "), indicator))))
    wanted = F.transform(missing, lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in asks.items() for x in kv]), m))
    understood = F.when(F.size(known) > 0, F.concat(F.lit("I understood "), F.array_join(known, ", "), F.lit(". "))).otherwise("")
    return F.when(F.size(missing) > 0, F.concat(understood, F.lit("Please share "), F.array_join(wanted, "; "), F.lit(".")))


def short_family(family: Column) -> Column:
    return F.regexp_replace(family, r"(?i)\s+and management$", "")


def error_kind(message: Column) -> Column:
    """What a failure is shown as: itself where it explains itself, a limit, or a general one."""
    low = F.lower(message)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(has("outside") & has("ethiopia"), "location").when(has("not supported", "objective"), "unsupported").when(has("429", "rate limit", "resource exhausted"), "limit").otherwise("general")


def coverage(records: DataFrame, pdf: Column, xml: Column, abstract: Column) -> DataFrame:
    """tier, n: the best text that each record has."""
    tier = F.when(pdf, "pdf").when(xml, "xml").when(abstract, "abstract").otherwise("metadata")
    return records.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def needs_retry(doi: Column, pdf: Column, xml: Column, abstract: Column) -> Column:
    return doi & ~((pdf | xml) & abstract)


def first_success(candidates: DataFrame, key: str, priority: str, ok: str, value: str) -> DataFrame:
    """key, value of the first source, in order of priority, that delivered."""
    return candidates.filter(ok).groupBy(key).agg(F.min_by(value, priority).alias(value))


def contexts(points: DataFrame, layers: Mapping[str, DataFrame], radius: int, rounded: int = 3, whole: tuple[str, ...] = ("land_cover",)) -> DataFrame:
    """point_id and a column for each layer: the point's cell, or the nearest valid one, rounded half to even or, for the
    layers in `whole`, as a whole number.  All layers are stacked and searched together, and each cell of a point once."""
    found = grid.nearest_layers(points, grid.stack(layers), list(layers), radius)
    put = [(F.col(n).cast("int") if n in whole else F.bround(n, rounded)).alias(n) for n in layers]
    return points.select("point_id", "row", "col").join(found, ["row", "col"]).select("point_id", *put)


def counters(answers: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many answers there are, and how many each flag holds for."""
    return answers.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()])


def run_steps(spark, steps: Mapping[str, object]) -> DataFrame:
    """step, status, message: each step is called in order; one that fails is recorded and the others still run."""
    done = []
    for name, step in steps.items():
        try:
            step()
            done.append((name, "done", None))
        except Exception as error:  # a step's own failure is its result
            done.append((name, "failed", str(error)[:500]))
    return spark.createDataFrame(done, "step string, status string, message string")


def metadata(df: DataFrame, family: str, practice: str, indicator: str) -> DataFrame:
    """family, practices, indicators: what can be asked for, with the bounds of valid points."""
    found = df.groupBy(F.col(family).alias("family")).agg(F.array_sort(F.collect_set(practice)).alias("practices"), F.array_sort(F.collect_set(indicator)).alias("indicators"))
    return found.withColumn("bounds", F.array(*[F.lit(float(x)) for x in (*LAT, *LON)]))


def signed_ranks(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """n, median_difference, w_plus, w_minus, z, effect: the signed-rank statistics of paired scores; ties share mean ranks.

    z is the normal approximation of w_plus with the correction for ties, effect the rank-biserial correlation; both are
    null where every pair is equal.  Ranks come from counts of equal distances, so only distinct distances are ordered.
    """
    d = pairs.select((F.col(left) - F.col(right)).alias("d")).filter("d is not null")
    counted = d.filter("d <> 0").groupBy(F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("rank", before + (F.col("n") + 1) / 2)
    n, total = F.col("n").cast("double"), lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = ranked.agg(total(F.col("rank") * F.col("up")).alias("w_plus"), total(F.col("rank") * (n - F.col("up"))).alias("w_minus"), total(n).alias("m"), total(n * n * n - n).alias("ties"))
    m, both = F.col("m"), F.col("w_plus") + F.col("w_minus")
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    z = (F.col("w_plus") - m * (m + 1) / 4) / F.nullif(spread, F.lit(0.0))
    sums = sums.select("w_plus", "w_minus", z.alias("z"), ((F.col("w_plus") - F.col("w_minus")) / F.nullif(both, F.lit(0.0))).alias("effect"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.percentile("d", 0.5).alias("median_difference")).crossJoin(F.broadcast(sums))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """The two-sided probability of a normal z, or of one further out; null stays null."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def nominal_alpha(ratings: DataFrame, item: str, value: str) -> DataFrame:
    """alpha: Krippendorff's agreement for categories over items with two ratings or more."""
    cells = ratings.filter(F.col(value).isNotNull()).groupBy(item, value).agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy(item).agg(F.sum("c").alias("m")).filter("m > 1")
    held = cells.join(items, item)
    observed = held.agg(F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("do"), F.sum("c").alias("n"))
    totals = held.groupBy(value).agg(F.sum("c").alias("t"))
    expected = totals.crossJoin(F.broadcast(observed)).agg(F.first("do").alias("do"), F.first("n").alias("n"), F.sum(F.col("t") * (F.col("n") - F.col("t"))).alias("de"))
    return expected.select(F.round(1 - (F.col("n") - 1) * F.col("do") / F.nullif(F.col("de"), F.lit(0)), 6).alias("alpha"))


def ordinal_alpha(ratings: DataFrame, item: str, value: str) -> DataFrame:
    """alpha: Krippendorff's agreement for ordered categories over items with two ratings or more; null if all are equal.

    The ordinal distance of two categories is the distance of their mean ranks, so sums of squares serve for all pairs.
    """
    cells = ratings.filter(F.col(value).isNotNull()).groupBy(item, value).agg(F.count(F.lit(1)).alias("c"))
    held = cells.join(cells.groupBy(item).agg(F.sum("c").alias("m")).filter("m > 1"), item)
    totals = held.groupBy(value).agg(F.sum("c").cast("double").alias("t"))
    order, whole = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(F.lit(0))
    places = totals.select(value, (F.sum("t").over(order) - F.col("t") / 2 - F.sum("t").over(whole) / 2).alias("x"))
    x, c = F.col("x"), F.col("c")
    items = held.join(places, value).groupBy(item).agg(F.sum(c).alias("m"), F.sum(c * x).alias("s"), F.sum(c * x * x).alias("q"))
    sums = items.agg(F.sum((F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("do"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    de = F.col("n") * F.col("q") - F.col("s") * F.col("s")
    return sums.select(F.round(1 - (F.col("n") - 1) * F.col("do") / F.nullif(de, F.lit(0.0)), 6).alias("alpha"))
