"""Random forests against a plain version on small rows: bootstrap by rows, kinds of rows, folds, categories, passes."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import forests, models

SCHEMA = "c string, x double, y double, fold int"


def draw(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, math.nan, *map(float, range(6))]), rng.randrange(40) / 4, i % 3) for i in range(n)]
    return [(c, x, y + (0 if c is None else 9 * "abc".index(c)) + (0 if x is None or x != x else x * x), k) for c, x, y, k in rows]


def plain_tree(rows, leaf, depth):
    """A prediction by bins, of rows (bins, n, y) with y the sum of labels of n."""
    n, total = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    for f in range(len(rows[0][0])) if depth else ():
        for cut in range(64):
            left, right = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
            sides = [(sum(r[1] for r in side), sum(r[2] for r in side)) for side in (left, right)]
            if min(k for k, _ in sides) < leaf:
                continue
            gain = sum(s * s / k for k, s in sides) - total * total / n
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, cut, left, right
    if best is None:
        return lambda bins: total / n
    _, f, cut, *sides = best
    below = [plain_tree(side, leaf, depth - 1) for side in sides]
    return lambda bins: below[bins[f] > cut](bins)


def test_a_tree_is_the_plain_one_of_its_bootstrap(spark, monkeypatch):
    kept = []
    real = forests._kinds
    monkeypatch.setattr(forests, "_kinds", lambda *a: kept.append(real(*a)) or kept[-1])
    df = spark.createDataFrame(draw(300), SCHEMA).repartition(5)
    held = models.out_of_fold(df, "fold", 3, models.pipeline(models.forest(trees=1, leaf=4, depth=3), ["c"], ["x"], "y"))
    kinds = [(tuple(r.bins), r.fold, r.n[0], r.y[0]) for r in kept[0].collect()]
    plain = [plain_tree([(b, n, y) for b, k, n, y in kinds if k != m and n], 4, 3) for m in range(3)]
    bins = lambda c, x: (0 if c is None else 1 + "abc".index(c), 5 if x is None or x != x else int(x))
    got = held.collect()
    assert len(got) == 300
    assert [r.predicted for r in got] == pytest.approx([plain[r.fold](bins(r.c, r.x)) for r in got], abs=1e-9)


def test_the_bootstrap_is_by_rows_and_of_any_partitioning(spark):
    rows = [("ab"[i % 2], float(i % 2), float(i % 7), i % 3) for i in range(6000)] + [("a", 0.0, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    bins = forests.binning(df, ["c"], ["x"], "fold", 3, 64)
    totals = []
    for shape in (df.coalesce(1), df.repartition(7)):
        found = forests._kinds(shape, bins, "y", "fold", 20, 42).groupBy("bins", "fold").agg(*[F.sum(F.get(c, F.lit(t))).alias(f"{c}{t}") for c in "ny" for t in range(20)])
        totals.append(sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in found.collect()))
    assert totals[0] == totals[1] and len(totals[0]) == 6
    n = np.array([r[2:22] for r in totals[0]], float)
    assert abs(n.mean() - 1000) < 20 and 20 < n.std() < 45  # Poisson of 1000 rows; all rows alike would give 1000, not 32
    many = forests.bootstrap(np.arange(2000), np.zeros(2000, int), 50).ravel()
    share = Counter(many.tolist())
    assert all(abs(share[k] / many.size - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(6))


def test_batches_that_share_a_kind_go_on_in_it(spark):
    df = spark.createDataFrame([("a", 1.0, float(i), 0) for i in range(500)], SCHEMA)
    bins = forests.binning(df, ["c"], ["x"], "fold", 3, 64)
    sums = lambda: [sum(r.y[t] for r in forests._kinds(df, bins, "y", "fold", 4, 42).collect()) for t in range(4)]
    whole = sums()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sums() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_levels_read_kinds_of_rows(spark, monkeypatch):
    seen, passes, real, tally = [], [], forests._grow, forests._histograms
    monkeypatch.setattr(forests, "_grow", lambda kinds, *rest: seen.append(kinds.count()) or real(kinds, *rest))
    monkeypatch.setattr(forests, "_histograms", lambda *a: passes.append(a[3]) or tally(*a))
    rows = spark.createDataFrame([("ab"[i % 2], float(i % 4), float(i % 2 * 8 + i % 4), i % 3) for i in range(1200)], SCHEMA)
    stages = models.pipeline(models.forest(trees=6, depth=4), ["c"], ["x"], "y")
    first = sorted(map(tuple, models.out_of_fold(rows, "fold", 3, stages).collect()))
    assert seen == [12] and len(first) == 1200
    assert len(passes) == len(set(passes)) <= 4  # a pass a level for the trees of all folds
    monkeypatch.setattr(forests, "CELLS", 20)
    passes.clear()
    again = sorted(map(tuple, models.out_of_fold(rows, "fold", 3, stages).collect()))
    assert len(passes) > len(set(passes)) and [r[4] for r in again] == pytest.approx([r[4] for r in first], abs=1e-9)


def test_categories_of_one_fold_only_are_unseen_there(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0), ("b", 2.0, 1.0, 1), ("b", 2.0, 1.0, 0), ("z", 3.0, 1.0, 2)], SCHEMA)
    bins = forests.binning(df, ["c"], ["x"], "fold", 3, 64)
    c, x = pa.array(["a", "a", "b", "z", "z", "new", None]), pa.array([1.0, 2.0, 2.5, 2.6, None, math.nan, 0.0])
    found = bins.bins([c, x], np.array([0, 1, 0, 2, -1, 1, 1]))
    assert found.tolist() == [[0, 0], [1, 1], [2, 1], [0, 2], [3, 2], [0, 2], [0, 0]]


def test_edges_of_forests(spark):
    stages = models.pipeline(models.forest(trees=3, depth=2), ["c"], ["x"], "y")
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(draw(9), SCHEMA)
    assert {r.prediction for r in stages.fit(none).transform(some).collect()} == {0.0}
    assert models.out_of_fold(none, "fold", 3, stages).collect() == []
    same = spark.createDataFrame([("a", 1.0, 5.0, 0)] * 50 + [("a", 1.0, None, 0)], SCHEMA)
    assert {r.prediction for r in stages.fit(same).transform(same).collect()} == {5.0}
    many = spark.createDataFrame([(f"c{i:03d}", float(i), float(i), 0) for i in range(300)], SCHEMA)
    held = forests.binning(many, ["c"], ["x"], None, 1, 64)
    assert [len(e) + 1 <= 64 for e in held.edges] == [True, True] and min(len(e) for e in held.edges) > 55


def test_deals_are_scored_where_the_rows_are(spark, monkeypatch):
    """the importance of a forest's columns needs no row for each deal, and is what scoring such rows gives."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", None]), float(rng.randrange(40)), rng.choice([None, 1.5, 2.5]), rng.random(), "w") for _ in range(900)]
    rows = [(c, x, z, None if i % 90 == 0 else x + 9 * (c == "a") + u, w) for i, (c, x, z, u, w) in enumerate(rows)]
    df = spark.createDataFrame(rows, "c string, x double, z double, y double, w string")
    model = forests.fit(df.filter("y is not null"), ["c"], ["x", "z"], "y", trees=6, depth=5)

    class Other:
        transform = staticmethod(model.transform)

    columns = ["x", "c", "z", "w"]
    monkeypatch.setattr(models, "SLOT", 100)
    want = {r["column"]: r.importance for r in models.permutation_importance(Other, df, columns, "y", repeats=3).collect()}
    assert want["x"] > 0.5 and want["c"] > 0.01 and want["w"] == 0

    def whole(self, df):
        raise AssertionError("rows of deals")

    monkeypatch.setattr(forests.Grown, "transform", whole)
    for cells in (forests.CELLS, 10):  # all combinations of cells in a table, or too many for one
        monkeypatch.setattr(forests, "CELLS", cells)
        got = {r["column"]: r.importance for r in models.permutation_importance(model, df, columns, "y", repeats=3).collect()}
        assert all(abs(got[c] - want[c]) < 1e-5 for c in columns)


def test_draws_by_their_first_bits_are_those_of_the_whole_number():
    steps = np.array(forests._STEPS, np.uint64)
    near = np.concatenate([steps, steps - np.uint64(1), np.random.default_rng(1).integers(0, 2**64, 100_000, np.uint64)])
    first = near >> np.uint64(48)
    plain = sum((near >= s).astype(np.uint8) for s in steps)
    sure = ~forests._EDGE[first]
    assert (forests._DRAWS[first][sure] == plain[sure]).all() and not sure[: 2 * len(steps)].all()
