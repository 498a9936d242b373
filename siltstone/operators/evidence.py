"""Evidence ranking: candidates, counts, group-mean scores, direction, ranked and nested recommendations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.numbers import effect_text, pct_change

#: The indicators, with the direction that is good.
DIRECTIONS = {"yield": 1, "biomass yield": 1, "income": 1, "water use efficiency": 1, "SOM content": 1, "soil loss": -1, "runoff": -1}


def direction(indicator: Column, signs: Mapping[str, int]) -> Column:
    """+1 where more is better, -1 where less is; an unknown indicator is an error."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in signs.items() for x in pair]), indicator)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown indicator: "), F.coalesce(indicator, F.lit("null")))).cast("int"))


def goal_word(sign: Column) -> Column:
    return F.when(sign > 0, "increase").otherwise("reduce")


def evidence(df: DataFrame, family: str, practice: str, indicator: str, value: str) -> DataFrame:
    """family, practice, indicator, n_evidence, mean: groups with at least one observation."""
    grouped = df.filter(F.col(value).isNotNull()).groupBy(F.col(family).alias("family"), F.col(practice).alias("practice"), F.col(indicator).alias("indicator"))
    return grouped.agg(F.count(F.lit(1)).alias("n_evidence"), F.avg(value).alias("mean"))


def candidates(df: DataFrame, family: str, practice: str, indicator: str) -> DataFrame:
    """All practices of each family with every indicator seen in the data, and their evidence, which may be 0."""
    practices = df.select(F.col(family).alias("family"), F.col(practice).alias("practice")).distinct()
    kinds = df.select(F.col(indicator).alias("indicator")).distinct()
    n = df.groupBy(F.col(family).alias("family"), F.col(practice).alias("practice"), F.col(indicator).alias("indicator")).agg(F.count(F.lit(1)).alias("n"))
    return practices.crossJoin(F.broadcast(kinds)).join(n, ["family", "practice", "indicator"], "left").fillna({"n": 0})


def rank(scored: DataFrame, signs: Mapping[str, int]) -> DataFrame:
    """Add log_ratio (4 places, which is what is ranked), pct_change, direction and rank; ties go by name."""
    sign = direction(F.col("indicator"), signs)
    scored = scored.withColumn("log_ratio", F.bround("mean", 4)).withColumn("pct_change", pct_change(F.col("mean"))).withColumn("direction", sign.cast("int"))
    order = Window.partitionBy("family", "indicator").orderBy((F.col("direction") * F.col("log_ratio")).desc(), F.col("practice").asc())
    return scored.withColumn("rank", F.row_number().over(order))


def recommend(ranked: DataFrame, top: int = 3) -> DataFrame:
    """One nested row for each family and indicator: what to recommend, and the ranking behind it.

    family, indicator, recommendations array<struct<practice, effect>>, details struct<n_candidates, n_grounded, ranked array>.
    """
    effect = effect_text(F.col("pct_change"), goal_word(F.col("direction")), F.col("indicator"))
    line = F.struct("rank", "practice", "pct_change", "log_ratio", "n_evidence", effect.alias("effect"))
    folded = ranked.groupBy("family", "indicator").agg(F.array_sort(F.collect_list(line)).alias("ranked"))
    short = F.transform(F.slice("ranked", 1, top), lambda x: F.struct(x["practice"].alias("practice"), x["effect"].alias("effect")))
    count = F.size("ranked").cast("long")
    return folded.select("family", "indicator", short.alias("recommendations"), F.struct(count.alias("n_candidates"), F.size(F.filter("ranked", lambda x: x["n_evidence"] > 0)).cast("long").alias("n_grounded"), F.col("ranked")).alias("details"))


def first_match(lookup: DataFrame, key: str, value: str, order: str, wanted: DataFrame, column: str) -> DataFrame:
    """wanted with the value of the first row, in order, whose key is equal in lower case; null where there is none."""
    found = lookup.filter(F.col(key).isNotNull()).groupBy(F.lower(key).alias("_low")).agg(F.min_by(value, order).alias(value))
    return wanted.join(found, F.lower(column) == F.col("_low"), "left").drop("_low")


def score_candidates(named: DataFrame, contexts: DataFrame, model, n: str = "n") -> DataFrame:
    """Candidates (family, practice, indicator, n) in each context, with the model's log ratio as mean: context columns,
    family, practice, indicator, n_evidence, mean.  Contexts are few and stated; they are paired with the family's candidates,
    and one of a family or an indicator without candidates is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown family or indicator: "), F.concat_ws(", ", "family", "indicator"))).cast("string")
    paired = contexts.join(named, ["family", "indicator"], "left").withColumn("practice", F.coalesce("practice", unknown))
    scored = model.transform(paired.withColumnRenamed(n, "n_evidence"))
    return scored.withColumn("mean", F.col("prediction")).select(*[c for c in contexts.columns if c not in ("family", "indicator")], "family", "practice", "indicator", "n_evidence", "mean")


def recommend_by_model(scored: DataFrame, request: str, signs: Mapping[str, int], confidence: DataFrame, top: int = 3) -> DataFrame:
    """request, family, indicator, recommendations, goal_direction, details of scored candidates with evidence.

    Practices are ranked by the model's log ratio (4 places) in the indicator's good direction within their family; those
    without evidence count as candidates only, and a request none of whose candidates has evidence is an error.
    confidence: (indicator, confidence); a missing one is low.
    """
    sign = direction(F.col("indicator"), signs).cast("int")
    rows = scored.withColumns({"log_ratio": F.bround("mean", 4), "pct_change": pct_change(F.col("mean")), "direction": sign})
    order = F.struct((-F.col("direction") * F.col("log_ratio")).alias("k"), "practice", "pct_change", "log_ratio", "n_evidence")
    folded = rows.groupBy(request, "family", "indicator", "direction").agg(F.count(F.lit(1)).alias("n_candidates"), F.array_sort(F.collect_list(F.when(F.col("n_evidence") > 0, order))).alias("ranked"))
    none = F.concat(F.lit("no evidence for "), "family", F.lit(" with "), "indicator")
    grounded = F.when(F.size("ranked") > 0, F.size("ranked").cast("long")).otherwise(F.raise_error(none).cast("long"))
    goal, best = goal_word(F.col("direction")), F.slice("ranked", 1, top)
    lines = F.transform(best, lambda x: F.struct(x["practice"].alias("practice"), effect_text(x["pct_change"], goal, F.col("indicator")).alias("effect")))
    shown = F.transform(best, lambda x: F.struct(x["practice"].alias("practice"), x["pct_change"].alias("pct_change"), x["log_ratio"].alias("log_ratio"), x["n_evidence"].alias("n_evidence")))
    out = folded.withColumn("n_grounded", grounded).join(confidence, "indicator", "left")
    details = F.struct(F.coalesce("confidence", F.lit("low")).alias("confidence"), shown.alias("ranked"), "n_candidates", "n_grounded")
    return out.select(request, "family", "indicator", goal.alias("goal_direction"), lines.alias("recommendations"), details.alias("details"))


def outside_family(ranked: DataFrame, df: DataFrame, family: str, practice: str) -> DataFrame:
    """Ranked rows whose practice the data do not have in that family; must be empty."""
    return ranked.join(df.select(F.col(family).alias("family"), F.col(practice).alias("practice")).distinct(), ["family", "practice"], "left_anti")


def supported(pairs: DataFrame, counts: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(family, indicator) pairs with evidence that no exclusion names, most evidence first."""
    held = pairs.join(counts, ["family", "indicator"]).filter("n > 0")
    return held.join(exclusions, ["family", "indicator"], "left_anti").orderBy(F.desc("n"), "family", "indicator")


def practices_by_family(df: DataFrame, family: str, practice: str) -> DataFrame:
    return df.groupBy(F.col(family).alias("family")).agg(F.array_sort(F.collect_set(practice)).alias("practices"))


def is_beneficial(pct: Column, sign: Column) -> Column:
    """Zero counts as beneficial both ways."""
    return F.when(sign > 0, pct >= 0).otherwise(pct <= 0)
