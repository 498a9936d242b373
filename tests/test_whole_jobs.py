"""Queries and operators do their whole job, at sizes where a bound once was."""

import html

from pyspark.sql import functions as F

from siltstone.functions import markup, text
from siltstone.operators import boosting, chunking, grid, ground, models


def test_term_weights_returns_every_term(spark, tmp_path):
    from siltstone.plans import registry

    spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "d"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["term_weights"](spark, str(tmp_path)).collect()
    assert sorted((r.term, r.df) for r in found) == [("a", 1), ("b", 2), ("c", 1), ("d", 1)]


def test_importance_scores_all_deals_in_one_pass(spark, monkeypatch):
    class Line:
        calls = 0

        def transform(self, df):
            self.calls += 1
            return df.withColumn("prediction", F.col("x") * 2)

    rows = spark.createDataFrame([(float(i % 50), float(i % 7), "c", float(i % 50) * 2) for i in range(400)], "x double, noise double, c string, y double")
    for slot in (8192, 50):
        monkeypatch.setattr(models, "SLOT", slot)
        model = Line()
        got = {r["column"]: r.importance for r in models.permutation_importance(model, rows, ["x", "noise", "c"], "y", repeats=4).collect()}
        assert model.calls == 1 and got["noise"] == got["c"] == 0 and 1.6 < got["x"] < 2.4  # values of no relation lose 2


def test_nearest_looks_once_at_each_place(spark):
    points = spark.range(5000).select(F.col("id").alias("point_id"), (F.col("id") % 3).alias("row"), F.lit(1).cast("long").alias("col"))
    points = points.unionByName(spark.createDataFrame([(7, None, 1), (7, 50, 1)], "point_id long, row long, col long"))
    cells = spark.createDataFrame([(0, 1, 5.0), (3, 1, 6.0), (2, 1, None)], "row long, col long, value double")
    found = grid.nearest_valid(points, cells, 2)
    assert sorted(tuple(r) for r in found.groupBy("value", "d2").count().na.fill(-1).collect()) == [(-1.0, -1, 2), (5.0, 0, 1667), (5.0, 1, 1667), (6.0, 1, 1666)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [row" in plan[plan.index("Generate") :].split("Join")[0]  # only places go through the search


def test_second_list_keeps_forty_others_of_large_labels(spark, tmp_path):
    from siltstone.plans import retrieval as plans

    rows = [(i, i % 2, [1.0]) for i in range(0, 400)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = plans.second(spark, str(tmp_path))
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in found.collect())
    want = [(q, k + 1, i) for q in range(0, 400, 50) for k, i in enumerate([i for i in range(0, 400, 2) if i != q][:40])]
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "place" in plan  # each label's first are taken before queries meet them


def test_citations_carry_snippets_only(spark, tmp_path):
    from siltstone.plans import registry

    spark.createDataFrame([(i, f"s{i % 2}", str(i) * 500) for i in range(4)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.queries()["citations_dedupe"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(0, "s0", 1, 1, "0" * 240), (0, "s1", 2, 1, "3" * 240), (1, "s1", 1, 1, "3" * 240)]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "substring(text" in below


def test_inverted_index_keeps_rows_apart_and_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setattr(chunking, "INDEXED", 3)
    docs = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, None), (3, " "), (4, "c a c d e c")], "i long, t string")
    found = chunking.inverted(docs, "i", text.words(F.col("t")))
    got = sorted((r.i, sorted((p.word, p.positions) for p in r.postings)) for r in found.collect())
    assert got == [(1, [("a", [0, 2]), ("b", [1])]), (1, [("b", [0])]), (2, []), (3, []), (4, [("a", [1]), ("c", [0, 2, 5]), ("d", [3]), ("e", [4])])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_references_go_through_python(spark):
    raw = ["a &amp; b", "&notit; &lt;p&gt;x", "&#65;&#x42 &#0; &", "&nosuch; &amp;amp;", "none", "", "&amp", "é&eacute;&&lt", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").select("i", markup.unescape(F.col("x")).alias("y"))
    assert {r.i: r.y for r in rows.collect()} == {i: x if x is None else html.unescape(x) for i, x in enumerate(raw)}
    assert "ArrowEvalPython [_unescaped(CASE" in rows._jdf.queryExecution().optimizedPlan().toString() and "regexp_extract_all" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_audit_finds_each_sentences_numbers_once(spark):
    docs = spark.createDataFrame([(1, "It is 12. Twenty of 30. None. Twelve.", [12.0])], "i long, t string, allowed array<double>")
    found = ground.audit(docs, "i", "t", "allowed")
    assert [r.verdict for r in found.orderBy("sentence_idx").collect()] == ["pass", "fail_both", "pass", "pass"]
    plan = ground.audit_summary(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2


def test_trees_grow_on_kinds_of_rows(spark, monkeypatch):
    grow, seen = boosting._grow, []

    def counted(rows, *rest):
        seen.append(rows.count())
        return grow(rows, *rest)

    monkeypatch.setattr(boosting, "_grow", counted)
    rows = spark.createDataFrame([("ab"[i % 2], i % 3, float(i % 2) + i % 5) for i in range(600)], "c string, fold int, y double")
    out = boosting.out_of_fold(rows, ["c"], [], "y", "fold", 3, rounds=1, step=1.0, l2=0.0, least=1, depth=1).collect()
    assert seen == [6] and len(out) == 600
    assert {(round(r.predicted - 2, 6), r.y % 1) for r in out} == {(0.0, 0.0), (1.0, 0.0)}


def test_rows_put_together_teach_and_score_as_they_do_alone(spark, monkeypatch):
    """boosting over sums by kind gives the trees, predictions and figures of the rows, and the query makes its rows once."""
    from siltstone.operators import crossval
    from siltstone.plans import advice

    rows = [("abc"[i * i % 3], "xy"[i // 7 % 2], i % 7 % 3, None if i % 50 == 0 else float(i % 11 + 5 * (i * i % 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "c string, by string, fold int, y double")
    kinds, settings = ["c", "by"], {"boosting": models.boosting(rounds=3, step=0.3, depth=2)}
    put = df.groupBy(*kinds, "fold").agg(*crossval.sums("y")).filter("n > 0")
    (one, a), (two, b) = (models.select_and_refit(*x, settings, kinds, [], "y", "fold", 3, "by", summed=s) for x, s in (((df.filter("y is not null"),), False), ((put,), True)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 3
    score = lambda m: [r.prediction for r in m.transform(put.select("c", "by", "fold")).orderBy("c", "by", "fold").collect()]
    assert all(abs(x - y) < 1e-9 for x, y in zip(score(one), score(two), strict=True))
    made, whole = [], advice._rows
    monkeypatch.setattr(advice, "_rows", lambda *x: made.append(whole(*x)) or made[-1])
    found = advice.fitted_advice(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "lineitem" not in " ".join(found.inputFiles())
