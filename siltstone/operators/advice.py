"""From requests at points to answers: context, candidates, features, a model's scores, and what is recommended."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import evidence as ev
from siltstone.operators import grid
from siltstone.operators.serving import contexts

#: What stands for a crop that is not given.
NO_CROP = "Unspecified"


def point_contexts(requests: DataFrame, layers: Mapping[str, DataFrame], radius: int, belts: DataFrame | None, belt: str, whole: tuple[str, ...], left: float, top: float, res: float) -> DataFrame:
    """request and a column for each layer at the request's point; the layer `belt` is a code of belts (code, name), where 0 is none."""
    row, col = grid.cell_of(F.col("lat"), F.col("lon"), left, top, res)
    points = requests.select(F.col("request").alias("point_id"), row.alias("row"), col.alias("col"))
    held = {n: cells.filter("value <> 0") if n == belt else cells for n, cells in layers.items()}
    found = contexts(points, held, radius, whole=(*whole, belt)).withColumnRenamed("point_id", "request")
    if belts is None:
        return found
    return found.join(belts.select(F.col("code").alias(belt), F.col("name").alias("_belt")), belt, "left").withColumn(belt, F.col("_belt")).drop("_belt")


def _mode(rows: DataFrame, keys: list[str], value: str, name: str, number: Column) -> DataFrame:
    """The most frequent value by keys; ties go to the least."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(number.alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(name))


def candidate_features(requests: DataFrame, rows: DataFrame, many: str | None = None) -> DataFrame:
    """request, family, practice, indicator, crop, crop_group, asked_group, n_evidence: every practice of a request's family.

    requests: request, family, indicator, crop; rows: the evidence with family, practice, indicator, crop, crop_group and
    place, its order.  The crop group is that of the first row of the crop, in any case, else the usual one of the
    practice with the indicator, else the family's.  A family that the evidence has not is an error.  many: a column that
    tells how many rows a row stands for, its place being the first of theirs.
    """
    number = F.sum(many) if many else F.count(F.lit(1))
    group = rows.filter(F.col("crop").isNotNull()).groupBy(F.lower("crop").alias("_crop")).agg(F.min_by("crop_group", "place").alias("asked_group"))
    asked = requests.withColumn("crop", F.nullif("crop", F.lit(""))).join(group, F.lower("crop") == F.col("_crop"), "left").drop("_crop")
    practices = rows.select("family", "practice").distinct()
    n = rows.groupBy("family", "practice", "indicator").agg(number.alias("n_evidence"))
    paired = asked.join(practices, "family", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown family: "), F.coalesce("family", F.lit("null")))).cast("string")
    paired = paired.withColumn("practice", F.coalesce("practice", unknown)).join(n, ["family", "practice", "indicator"], "left").fillna({"n_evidence": 0})
    paired = paired.join(_mode(rows, ["family", "practice", "indicator"], "crop_group", "_own", number), ["family", "practice", "indicator"], "left").join(_mode(rows, ["family"], "crop_group", "_wide", number), "family", "left")
    return paired.withColumns({"crop_group": F.coalesce("asked_group", "_own", "_wide"), "crop": F.coalesce("crop", F.lit(NO_CROP))}).drop("_own", "_wide")


def advise(
    requests: DataFrame,
    rows: DataFrame,
    layers: Mapping[str, DataFrame],
    model,
    confidence: DataFrame,
    signs: Mapping[str, int],
    radius: int = 120,
    belts: DataFrame | None = None,
    belt: str = "aez_belt",
    whole: tuple[str, ...] = ("land_cover",),
    top: int = 3,
    left: float = grid.LEFT,
    upper: float = grid.TOP,
    res: float = grid.RES,
    many: str | None = None,
) -> DataFrame:
    """request, query, recommendations, details: for each request (request, lat, lon, family, indicator, crop) what to do.

    The context of the point, from the nearest valid cells of all layers, and the features of every practice of the
    family go through the model (transform() with `prediction`, a log ratio); practices with evidence are ranked in
    the indicator's good direction, and the first `top` are recommended.  details has the context, the crop's group, the
    confidence, the ranking, how many candidates there are and have evidence, and the ranking's scope.  An unknown family
    or indicator, and a request none of whose practices has evidence, are errors.  many: as in candidate_features().
    """
    context = point_contexts(requests, layers, radius, belts, belt, whole, left, upper, res)
    scored = model.transform(candidate_features(requests, rows, many).join(context, "request")).withColumn("mean", F.col("prediction"))
    names = [c for c in context.columns if c != "request"]
    found = ev.recommend_by_model(scored, "request", signs, confidence, top)
    shared = scored.groupBy("request").agg(F.any_value("asked_group").alias("crop_group"), *[F.any_value(c).alias(c) for c in names])
    told = requests.select("request", "lat", "lon", F.nullif("crop", F.lit("")).alias("crop"))
    out = found.join(shared, "request").join(told, "request")
    n, grounded = F.col("details.n_candidates").cast("string"), F.col("details.n_grounded").cast("string")
    scope = F.concat(F.lit("Practices ranked within '"), "family", F.lit("' ("), n, F.lit(" known, "), grounded, F.lit(" with evidence for '"), "indicator", F.lit("')."))
    query = F.struct("lat", "lon", "family", "indicator", "crop", "goal_direction")
    details = F.struct(F.struct(*names).alias("context"), "crop_group", "details.confidence", "details.ranked", "details.n_candidates", "details.n_grounded", scope.alias("ranking_scope"))
    return out.select("request", query.alias("query"), "recommendations", details.alias("details"))
