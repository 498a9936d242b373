"""Histogram boosting against a plain version on small rows: categories, missing values, folds, long runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import boosting, crossval, models


def draw(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c, x, z = rng.choice("abcde"), rng.choice([None, *range(12)]), rng.choice([math.nan, 0.5, 1.5, 2.5])
        y = {"a": 3.0, "b": -1.0, "c": 0.5, "d": 7.0, "e": 2.0}[c] + (0 if x is None else (x - 6) ** 2 / 5) + rng.random()
        out.append((c if rng.random() > 0.1 else None, None if x is None else float(x), z, y, i % 3))
    return out


SCHEMA = "c string, x double, z double, y double, fold int"


def plain_boosting(rows, keep, rounds, step, l2, least, depth):
    """Trees as nested tuples over the rows' own values; an independent version with sets and loops."""
    train = [r for r in rows if keep(r)]
    base = sum(r[3] for r in train) / len(train)
    missing = lambda v: v is None or v != v
    sums, trees = {id(r): base for r in train}, []

    def side(split, r):
        f, members, missing_left = split
        v = r[f]
        return missing_left if missing(v) or (f == 0 and v not in members[1]) else v in members[0]

    def grow(held, level, value):
        best = None
        if level < depth:
            g = lambda rs: sum(sums[id(r)] - r[3] for r in rs)
            worth = lambda rs: g(rs) ** 2 / (len(rs) + l2)
            for f in range(3):
                gone = [r for r in held if missing(r[f])]
                by = {}
                for r in held:
                    if not missing(r[f]):
                        by.setdefault(r[f], []).append(r)
                order = sorted(by, key=lambda v: (g(by[v]) / (len(by[v]) + l2), v)) if f == 0 else sorted(by)
                for ml in (False, True) if gone else (None,):
                    for k in range(1, len(order) + 1):
                        left = [r for v in order[:k] for r in by[v]] + (gone if ml else [])
                        right = [r for v in order[k:] for r in by[v]] + ([] if ml else gone)
                        if min(len(left), len(right)) < least:
                            continue
                        gain = worth(left) + worth(right) - worth(held)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            to_left = len(left) > len(right) if ml is None else ml
                            members = set(order[:k]) if f == 0 else {v for v in range(-100, 100) for v in (v, v + 0.5) if v <= order[k - 1]}
                            best = gain, (f, (members, set(order)), to_left), left, right
        if best is None:
            return value
        leaf = lambda rs: -step * sum(sums[id(r)] - r[3] for r in rs) / (len(rs) + l2)
        _, split, left, right = best
        return split, grow(left, level + 1, leaf(left)), grow(right, level + 1, leaf(right))

    def predict(tree, r):
        while isinstance(tree, tuple):
            tree = tree[1] if side(tree[0], r) else tree[2]
        return tree

    for _ in range(rounds):
        trees.append(grow(train, 0, 0.0))
        for r in train:
            sums[id(r)] += predict(trees[-1], r)
    return lambda r: base + sum(predict(t, r) for t in trees)


OPTIONS = {"rounds": 6, "step": 0.4, "l2": 1.0, "least": 8, "depth": 3}


def test_a_fitted_model_predicts_as_the_plain_version(spark, tmp_path):
    rows = draw(240)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = boosting.fit(df, ["c"], ["x", "z"], "y", **OPTIONS)
    plain = plain_boosting(rows, lambda r: True, **OPTIONS)
    asked = [*rows[:60], ("unseen", 3.0, 0.5, 0.0, 0), (None, None, None, 0.0, 0)]
    got = [r.prediction for r in model.transform(spark.createDataFrame(asked, SCHEMA).coalesce(1)).collect()]
    assert got == pytest.approx([plain(r) for r in asked], abs=1e-9)
    model.save(spark, str(tmp_path / "m"))
    again = boosting.Boosted.load(spark, str(tmp_path / "m"))
    assert [r.prediction for r in again.transform(spark.createDataFrame(asked, SCHEMA).coalesce(1)).collect()] == got


def test_folds_grow_together_as_models_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SETTLE", 2)
    rows = draw(240, 2)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {SCHEMA}").repartition(4)
    got = {r.i: r.predicted for r in boosting.out_of_fold(df, ["c"], ["x", "z"], "y", "fold", 3, ["i", "c"], **OPTIONS).collect()}
    plain = [plain_boosting(rows, lambda r, k=k: r[4] != k, **OPTIONS) for k in range(3)]
    assert [got[i] for i in range(len(rows))] == pytest.approx([plain[r[4]](r) for r in rows], abs=1e-9)


def test_many_rounds_do_not_lengthen_the_lineage(spark, monkeypatch):
    rows = spark.createDataFrame(draw(90, 3), SCHEMA).coalesce(1)
    sizes = []
    real = boosting._histograms

    def measured(table, *rest):
        sizes.append(len(table._jdf.queryExecution().logical().toString()))
        return real(table, *rest)

    monkeypatch.setattr(boosting, "_histograms", measured)
    monkeypatch.setattr(boosting, "SETTLE", 5)
    model = boosting.fit(rows, ["c"], ["x", "z"], "y", rounds=40, depth=1, least=5)
    assert len(model.trees) == 40 and max(sizes[5:]) <= sizes[5] * 1.1


def test_edges_of_boosting(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = boosting.fit(none, ["c"], ["x"], "y", rounds=2)
    assert [r.prediction for r in model.transform(spark.createDataFrame(draw(2), SCHEMA)).collect()] == [0.0, 0.0]
    same = spark.createDataFrame([("a", 1.0, 1.0, 5.0, 0)] * 50 + [("a", 1.0, 1.0, None, 0)], SCHEMA)
    assert {r.prediction for r in boosting.fit(same, ["c"], ["x"], "y", rounds=2).transform(same).collect()} == {5.0}
    with pytest.raises(ValueError, match="more than 3 categories"):
        boosting.fit(spark.createDataFrame(draw(50), SCHEMA), ["c"], [], "y", bins=3)


def test_unseen_categories_have_code_minus_one(spark):
    train = spark.createDataFrame([("b", 1.0), ("it's", 2.0), ("a\"\\", 3.0)], "c string, y double")
    coded = models.Codes(["c"]).fit(train).transform(spark.createDataFrame([("a\"\\",), ("b",), ("it's",), ("new",), (None,)], "c string"))
    assert [r.c_code for r in coded.collect()] == [0.0, 1.0, 2.0, -1.0, -1.0]


def test_the_better_kind_is_chosen_and_kept(spark, tmp_path):
    rows = spark.createDataFrame(draw(300, 4), SCHEMA).filter("x is not null")
    kinds = {"flat": models.forest(trees=1, depth=1), "boosting": models.boosting(rounds=8, step=0.4, least=5, depth=3)}
    model, figures = models.select_and_refit(rows, kinds, ["c"], ["x"], "y", "fold", 3, "fold")
    assert {r.model for r in figures.collect()} == {"boosting"} and figures.filter("scope = 'all'").first().r2 > 0.5
    models.save(model, figures, str(tmp_path / "m"))
    again, _ = models.load(spark, str(tmp_path / "m"))
    assert again.transform(rows).agg(*crossval.metrics("y", "prediction")).first() == model.transform(rows).agg(*crossval.metrics("y", "prediction")).first()
    assert again.transform(rows).filter(F.col("prediction").isNull()).isEmpty()
