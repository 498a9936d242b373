"""Requests at points answered as a whole: contexts, crop groups, ranking, errors; the search of all layers at once."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from siltstone.operators import advice, boosting, grid, serving

ROWS = [
    (1, "F1", "terrace", "soil loss", "Teff", "Cereals", -0.5), (2, "F1", "terrace", "soil loss", "maize", "Cereals", -0.4), (3, "F1", "bund", "soil loss", "Bean", "Pulses", -0.7),
    (4, "F1", "mulch", "yield", "Bean", "Pulses", 0.2), (5, "F1", "mulch", "yield", "teff", "Other", 0.3), (6, "F2", "tree", "yield", "Coffee", "Cash", 0.1), (7, "F1", "terrace", "yield", None, "Cereals", 0.1),
]
EVIDENCE = "place long, family string, practice string, indicator string, crop string, crop_group string, effect double"
REQUEST = "request long, lat double, lon double, family string, indicator string, crop string"
SIGNS = {"soil loss": -1, "yield": 1}
FORMULA = "select *, length(practice) * -0.1 + coalesce(rain, 0) * 0.001 + length(crop_group) * 0.01 as prediction from __THIS__"


def answers(spark, requests, model=None, **options):
    model = model or SQLTransformer(statement=FORMULA)
    layers = {
        "rain": spark.createDataFrame([(0, 0, 100.0), (3, 3, float("nan")), (5, 5, 300.0)], "row long, col long, value double"),
        "land_cover": spark.createDataFrame([(0, 1, 7.0)], "row long, col long, value double"),
        "aez_belt": spark.createDataFrame([(0, 0, 0.0), (1, 1, 2.0), (5, 5, 9.0)], "row long, col long, value double"),
    }
    belts = spark.createDataFrame([(1, "dry"), (2, "moist")], "code int, name string")
    sure = spark.createDataFrame([("yield", "high")], "indicator string, confidence string")
    found = advice.advise(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(ROWS, EVIDENCE), layers, model, sure, SIGNS, 3, belts, left=0.0, upper=10.0, res=1.0, **options)
    return {r.request: r for r in found.collect()}


def test_an_answer_as_a_whole(spark):
    got = answers(spark, [(1, 9.5, 0.5, "F1", "soil loss", "TEFF"), (2, 4.5, 5.5, "F1", "yield", ""), (3, -50.0, 0.5, "F2", "yield", None)])
    one = got[1]
    assert one.query.asDict() == {"lat": 9.5, "lon": 0.5, "family": "F1", "indicator": "soil loss", "crop": "TEFF", "goal_direction": "reduce"}
    assert one.details.context.asDict() == {"rain": 100.0, "land_cover": 7, "aez_belt": "moist"}
    assert (one.details.crop_group, one.details.confidence, one.details.n_candidates, one.details.n_grounded) == ("Cereals", "low", 3, 2)
    # terrace: -0.7 + 0.1 + 0.07 = -0.53, bund: -0.4 + 0.1 + 0.07 = -0.23; mulch has no evidence of soil loss
    assert [(r.practice, r.log_ratio, r.n_evidence) for r in one.details.ranked] == [("terrace", -0.53, 2), ("bund", -0.23, 1)]
    assert [r.effect for r in one.recommendations] == ["~41% reduce in soil loss", "~20% reduce in soil loss"]
    assert one.details.ranking_scope == "Practices ranked within 'F1' (3 known, 2 with evidence for 'soil loss')."
    two = got[2]
    assert two.query.crop is None and two.details.crop_group is None and two.details.context.asDict() == {"rain": 300.0, "land_cover": None, "aez_belt": None}
    # mulch's own groups tie and the least name counts: Other; terrace with yield: Cereals
    assert [(r.practice, r.log_ratio) for r in two.details.ranked] == [("mulch", -0.15), ("terrace", -0.33)]
    assert got[3].details.context.asDict() == {"rain": None, "land_cover": None, "aez_belt": None} and got[3].details.confidence == "high"


def test_what_cannot_be_answered_is_an_error(spark):
    for bad, words in (((1, 9.5, 0.5, "F9", "yield", None), "unknown family: F9"), ((1, 9.5, 0.5, "F1", "income", None), "unknown indicator"), ((1, 9.5, 0.5, "F2", "soil loss", None), "no evidence")):
        with pytest.raises(Exception, match=words):
            answers(spark, [bad])
    assert answers(spark, []) == {}


def test_an_answer_by_a_fitted_model(spark):
    rows = spark.createDataFrame(ROWS, EVIDENCE)
    model = boosting.fit(rows, ["practice", "family", "indicator", "crop", "crop_group"], [], "effect", rounds=3, least=1, depth=2)
    got = answers(spark, [(1, 9.5, 0.5, "F1", "soil loss", "unseen crop")], model, top=1)
    assert [r.practice for r in got[1].recommendations] == ["bund"] and len(got[1].details.ranked) == 1


# ---------------------------------------------------------------- all layers at once


def test_the_transform_equals_a_search_of_all_cells():
    rng = np.random.default_rng(3)
    for radius, share in ((3, 0.2), (7, 0.02), (5, 0.0)):
        values = np.where(rng.random((40, 40)) < share, rng.random((40, 40)), np.nan)
        row, col = rng.integers(radius, 40 - radius, 200), rng.integers(radius, 40 - radius, 200)
        got, d2 = grid.distance_transform(values, row, col, radius)
        for k, (r, c) in enumerate(zip(row, col, strict=True)):
            near = [((i - r) ** 2 + (j - c) ** 2, i, j) for i in range(r - radius, r + radius + 1) for j in range(c - radius, c + radius + 1) if not np.isnan(values[i, j])]
            want = min(near, default=None)
            assert (np.isnan(got[k]) and np.isnan(d2[k])) if want is None else (got[k], d2[k]) == (values[want[1], want[2]], want[0])


def test_layers_are_searched_together_over_tiles(spark):
    rng = random.Random(8)
    cells = lambda n: spark.createDataFrame(sorted({(rng.randrange(-40, 90), rng.randrange(-40, 90)) for _ in range(n)}), "row long, col long").withColumn("value", F.col("row") * 100.0 + F.col("col"))
    layers = {"a": cells(300), "b": cells(25), "c": cells(0 + 1).filter("row > 1000")}
    points = spark.createDataFrame([(i, rng.randrange(-45, 95), rng.randrange(-45, 95)) for i in range(150)] + [(200, 5, 5), (201, 5, 5)], "point_id long, row long, col long")
    found = grid.nearest_layers(points, grid.stack(layers), ["a", "b", "c"], 20, tile=16)
    got = {(r.row, r.col): r for r in found.collect()}
    for name in "abc":
        want = grid._nearest(points, layers[name], 20, "value").join(points, "point_id").collect()
        assert all((got[r.row, r.col][name], got[r.row, r.col][f"d2_{name}"]) == (r.value, r.d2) for r in want)
    shuffles = lambda names: grid.nearest_layers(points, grid.stack({n: layers[n] for n in names}), list(names), 20)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles("abc") == shuffles("a")  # as many for three layers as for one
    assert serving.contexts(points, layers, 20, whole=("b",)).count() == points.count()
