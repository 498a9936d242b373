"""Literal rows for what depends on order, patterns, rounding and state."""

import math
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions import climate, numbers, places, text
from siltstone.operators import chunking, classify, crossval, evaluate, evidence, grid, ground, models, prepare, quality, retrieval, sampling, serving, slots
from siltstone.sources import files
from siltstone.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, text.clean_html(t), t="&lt;p&gt;A &amp;amp; b&lt;/p&gt;  <i>c</i>") == "A & b c"
    assert one(spark, text.clean_html(t), t="<p> </p>") is None
    assert one(spark, text.dehyphenate(t), t="soil ero-\nsion") == "soil erosion"
    assert one(spark, text.trim_references(t), t="a\nReferences\nb\nReferences\nc") == "a\nReferences\nb"
    assert one(spark, text.trim_references(t), t="no heading") == "no heading"
    assert one(spark, text.clean_jats(t), t="<article><front><title>Meta</title></front><body><p>One</p><fig><p>x</p></fig><p>Two <xref>[1]</xref></p></body><back><p>b</p></back></article>").split() == ["One", "Two"]
    assert one(spark, text.clean_jats(t), t="<p>no body</p>\nReferences\nA") == "no body"
    assert one(spark, text.paragraphs(t), t="a\n\n\nb\n2.1 Results\nc\nIV x") == ["a", "b", "2.1 Results\nc", "IV x"]
    assert one(spark, text.norm_match(t), t="  Water-use / Efficiency;; now ") == "water use efficiency now"
    assert one(spark, places.norm_place(t), t="Debré  Márkos!") == "debre markos"
    assert one(spark, text.occurrences(t, "aa"), t="aaaaa") == 2
    assert one(spark, text.slug(t), t="10.1016/j.x (2)") == "10_1016_j_x_2"
    assert one(spark, text.year_of(t), t="in 1899 and 2019, 2020") == 2019
    assert one(spark, text.url_of(t), t="see https://a.b/c). Then") == "https://a.b/c"
    assert one(spark, text.title_of(t, 2), t=" a b c") == "a b…"
    assert one(spark, text.pieces(t, 3), t="abcdefgh") == ["abc", "def", "gh"] and one(spark, text.pieces(t), t="") == []
    assert one(spark, text.ellipsis(t), t="x" * 23) == "x" * 20 + "…"
    assert one(spark, text.strip_leaks(t), t="a<think>b</think>\n\n\n\nc```py\nd```") == "a\n\nc"
    assert one(spark, text.sentences(t), t="# Head\n1. First one. Second!\n- **bold** item; more") == ["Head", "First one.", "Second!", "bold item;", "more"]
    index = F.array(F.struct(F.lit("b").alias("word"), F.array(F.lit(1), F.lit(3)).alias("positions")), F.struct(F.lit("a").alias("word"), F.array(F.lit(0), F.lit(2)).alias("positions")))
    assert one(spark, text.inverted_to_text(index)) == "a b a b"


def test_numbers(spark):
    v = F.col("v")
    assert one(spark, numbers.tokens(F.col("t")), t="up 12.5% in 3 of [2] and [G4] trials") == ["12.5", "3"]
    assert one(spark, numbers.word_tokens(F.col("t")), t="Twenty plots, half of them doubled") == ["twenty", "half", "doubled"]
    assert sorted(one(spark, numbers.variants(v), v=-12.345)) == [-12.345, -12.34, -12.3, -12.0, 12.0, 12.345]
    assert one(spark, numbers.grounded(F.lit("7"), F.array(F.lit(1.0)))) and not one(spark, numbers.grounded(F.lit("11"), F.array(F.lit(1.0))))
    assert one(spark, numbers.grounded(F.lit("12.3"), numbers.variants(F.lit(12.34))))
    assert [one(spark, numbers.confidence(v), v=x) for x in (0.1, 0.0, -0.1)] == ["high", "medium", "low"]
    assert one(spark, numbers.pct_change(v), v=math.log(1.5)) == 50.0
    assert one(spark, numbers.effect_text(v, F.lit("increase"), F.lit("yield")), v=-12.5) == "~12% increase in yield"
    assert [one(spark, numbers.signed_pct(v), v=x) for x in (3.0, 0.0, -2.5)] == ["+3.0%", "0.0%", "-2.5%"]
    assert one(spark, numbers.log_ratio(F.lit(0.0), F.lit(1.0))) is None


def test_preparation(spark):
    rows = spark.createDataFrame([(9.0, 38.0, 2.0, 1.0), (0.0, 38.0, 2.0, 1.0), (9.0, 38.0, 30.0, 1.0), (9.0, 60.0, 1.0, 1.0), (9.0, 38.0, -1.0, 1.0)], "lat double, lon double, t double, c double")
    steps = [("bounds", prepare.in_bounds(F.col("lat"), F.col("lon"))), ("positive", prepare.positive_means(F.col("t"), F.col("c"))), ("outlier", prepare.no_outlier(F.col("t"), F.col("c")))]
    assert [(r.stage, r.n) for r in prepare.funnel(rows, steps).collect()] == [(0, 5), (1, 3), (2, 2), (3, 1)]
    assert prepare.insert_after(rows, "c", "lat").columns == ["lat", "c", "lon", "t"]
    assert quality.duplicates(spark.createDataFrame([(1,), (1,), (2,)], "a int"), ["a"]).first().n_duplicates == 1


def test_rank_ties_go_by_name(spark):
    scored = spark.createDataFrame([("f", "b", "yield", 3, 0.20001), ("f", "a", "yield", 1, 0.20002), ("f", "c", "yield", 1, 0.5), ("f", "z", "soil loss", 1, -0.1), ("f", "y", "soil loss", 1, 0.4)], "family string, practice string, indicator string, n_evidence long, mean double")
    ranked = evidence.rank(scored, evidence.DIRECTIONS)
    assert [r.practice for r in ranked.filter("indicator = 'yield'").orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.practice for r in ranked.filter("indicator = 'soil loss'").orderBy("rank").collect()] == ["z", "y"]
    nested = evidence.recommend(ranked, 1).filter("indicator = 'soil loss'").first()
    assert nested.recommendations[0].effect == "~10% reduce in soil loss" and nested.details.n_candidates == 2


def test_greedy_folds_balance(spark):
    rows = spark.createDataFrame([(g,) for g, n in zip("abcd", (5, 4, 3, 3), strict=True) for _ in range(n)], "g string")
    assert {r.g: r.fold for r in crossval.greedy_folds(rows, "g", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_greedy_folds_by_brute_force(spark):
    import random

    rng = random.Random(3)
    for folds, sizes in ((3, [40, 7, 7, 7] + [3] * 9 + [1] * 50), (4, [rng.randrange(1, 9) for _ in range(60)]), (5, [2, 2]), (2, [])):
        groups = [(f"g{i:03d}", n) for i, n in enumerate(sizes)]
        rows = spark.createDataFrame([(g,) for g, n in groups for _ in range(n)], "g string")
        load, expected = [0] * folds, {}
        for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
            expected[g] = load.index(min(load))
            load[expected[g]] += n
        assert {r.g: r.fold for r in crossval.greedy_folds(rows, "g", folds, parts=4).collect()} == expected


def test_oof_mean_leaves_the_fold_out(spark):
    rows = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 3.0), ("p", 1, 5.0), ("q", 0, 10.0)], "k string, fold int, y double")
    got = {(r.k, r.fold): r.predicted for r in crossval.oof_mean(rows, ["k"], "fold", "y").collect()}
    assert got == {("p", 0): 4.0, ("p", 1): 1.0, ("q", 0): 4.0}


def test_trees_learn_and_importance_finds_the_column(spark):
    rows = spark.createDataFrame([("a" if i % 2 else "b", float(i % 7), float(i * 37 % 11), float(i % 7) * 3, i % 3) for i in range(200)], "c string, x double, noise double, y double, fold int")
    stages = models.pipeline(models.forest(trees=10, depth=5), ["c"], ["x", "noise"], "y")
    assert models.out_of_fold(rows, "fold", 3, stages).agg(*crossval.metrics("y", "predicted")).first().r2 > 0.6
    assert models.permutation_importance(stages.fit(rows), rows, ["x", "noise"], "y").first()["column"] == "x"


def test_nearest_valid_ties_and_reach(spark):
    cells = spark.createDataFrame([(5, 4, 1.0), (4, 5, 2.0), (0, 0, 9.0), (5, 5, None)], "row long, col long, value double")
    points = spark.createDataFrame([(1, 5, 5), (2, 2, 2), (3, 40, 40)], "point_id long, row long, col long")
    assert {r.point_id: r.value for r in grid.nearest_valid(points, cells, 2).collect()} == {1: 2.0, 2: 9.0, 3: None}
    assert {r.point_id: r.value for r in grid.sample_or_nearest(points, cells, 1).collect()} == {1: 2.0, 2: None, 3: None}


def test_rasters(spark, tmp_path):
    cells = grid.grid(spark, 4, 4).withColumn("value", (F.col("row") * 4 + F.col("col")).cast("double"))
    rises = {(r.row, r.col): (r.dz_row, r.dz_col) for r in grid.gradients(cells).collect()}
    assert rises[(0, 0)] == rises[(2, 3)] == (4.0, 1.0)
    files.write_tiles(cells, str(tmp_path / "t"), 2)
    assert files.read_window(spark, str(tmp_path / "t"), (1, 2), (2, 3), 2).count() == 4
    target = spark.createDataFrame([(1, 0.5, 0.25), (2, 3.5, 3.5)], "target_id long, y double, x double")
    assert {r.target_id: r.value for r in grid.bilinear(target, cells).collect()} == {1: 2.25, 2: 15.0}


def test_climate(spark):
    assert abs(one(spark, climate.day_hours(F.lit(0.0), F.lit(3))) - 12) < 1e-9
    assert one(spark, climate.tile_name(F.lit(-1.0), F.lit(38.7))) == "S03E036"
    assert one(spark, climate.evapotranspiration(F.lit(-3.0), F.lit(10.0), F.lit(9.0), F.lit(1))) == 0.0


def test_retrieval_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, s, i + 1) for i, s in enumerate("ABACD")], "query_id long, study string, rank int")
    got = evaluate.score(ranked, spark.createDataFrame([(1, "C"), (1, "Z"), (2, "A")], "query_id long, study string")).filter("query_id = 1").first()
    assert (got.recall_4, got.success_4, got.mrr) == (0.5, 1, 0.25)


def test_fusion_ties(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    lexical = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in retrieval.fuse(dense, lexical, 5).orderBy("rank").collect()] == [11, 10, 12]


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "soil water"), (2, "soil"), (3, "tree"), (4, "tree fruit"), (5, "grass")], "i long, t string")
    asked = spark.createDataFrame([(1, "water"), (2, "water water")], "q long, t string")
    got = {r.query_id: r.score for r in retrieval.bm25(asked, docs, "q", "t", "i", "t").collect()}
    assert abs(got[2] - 2 * got[1]) < 1e-5


def test_bm25_by_broadcast_and_by_join(spark, monkeypatch):
    texts = [(i, " ".join("abcdefgh"[(i * j) % 8] for j in range(1, 2 + i % 7))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "d long, t string").repartition(3)
    asked = spark.createDataFrame([(1, "a b b"), (2, "zzz"), (3, "h c a"), (4, None)], "q int, t string")
    near = [tuple(r) for r in retrieval.bm25(asked, docs, "q", "t", "d", "t", 7).orderBy("query_id", "rank").select("query_id", "doc_id", "score", "rank").collect()]
    monkeypatch.setattr(retrieval, "MOST_ASKED", 0)
    far = [tuple(r) for r in retrieval.bm25(asked, docs, "q", "t", "d", "t", 7).orderBy("query_id", "rank").select("query_id", "doc_id", "score", "rank").collect()]
    assert near == far and {r[0] for r in near} == {1, 3}
    named = retrieval.bm25(asked, docs.withColumn("d", F.col("d").cast("string")), "q", "t", "d", "t", 7)
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == len(near)


def test_cosine_leaves_out_what_has_no_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [2.0, 2.0]), (6, [1.0]), (7, [None, 1.0])]
    vectors = spark.createDataFrame(rows, "i long, v array<double>")
    found = retrieval.cosine(vectors.filter("i in (1, 2)"), vectors, "i", "v", 5, size=2, asked=1).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found) == [(1, 1, 4, 0.707107), (1, 2, 5, 0.707107)]


def test_chunks(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10))), (2, "")], "d long, t string")
    assert [r.n_words for r in chunking.windows(rows, "d", "t", 4, 3).orderBy("pos").collect()] == [4, 4, 4]
    packed = chunking.greedy(spark.createDataFrame([(1, "a b c\nd e f\ng"), (2, "x")], "d long, t string"), "d", F.split("t", "\n"), 5, 2).orderBy("d", "pos").collect()
    assert [(r.d, r.chunk) for r in packed] == [(1, "a b c"), (1, "b c d e f"), (1, "e f g"), (2, "x")]
    assert one(spark, F.struct(*chunking.keyword_stats(F.lit("bund and bund, mulch"), ["bund", "mulch", "tree"]))) == (2, 3)


def test_greedy_chunks_follow_the_source_rule(spark):
    import random

    def packed(paragraphs, size, carry):
        chunks, cur = [], []
        for words in paragraphs:
            if len(words) > size:
                chunks += [cur] if cur else []
                cur, i = [], 0
                while True:
                    chunks.append(words[i : i + size])
                    if i + size >= len(words):
                        break
                    i += size - carry
                continue
            if cur and len(cur) + len(words) > size:
                chunks.append(cur)
                cur = cur[-carry:]
            cur = cur + words
        return [" ".join(c) for c in chunks + ([cur] if len(cur) > carry or not chunks else []) if c]

    rng = random.Random(2)
    texts = {i: [[f"W{i}x{j}y{k}" for k in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))] for j in range(rng.randrange(1, 12))] for i in range(60)}
    rows = spark.createDataFrame([(i, "\n".join(" ".join(p) for p in ps)) for i, ps in texts.items()], "d long, t string")
    got = chunking.greedy(rows, "d", F.split("t", "\n"), 12, 4).collect()
    assert {i: [r.chunk for r in sorted((r for r in got if r.d == i), key=lambda r: r.pos)] for i in texts} == {i: packed(ps, 12, 4) for i, ps in texts.items()}


def test_recommendation_by_a_model(spark):
    import pytest
    from pyspark.ml.feature import SQLTransformer

    rows = spark.createDataFrame([("F", "p", "yield"), ("F", "p", "yield"), ("F", "q", "soil loss"), ("F", "r", "yield")], "family string, practice string, indicator string")
    model = SQLTransformer(statement="select *, case practice when 'p' then 0.1 when 'q' then 0.5 else 0.2 end * rain as prediction from __THIS__")
    asked = spark.createDataFrame([(1, "F", "yield", 1.0), (2, "F", "yield", -1.0)], "request long, family string, indicator string, rain double")
    scored = evidence.score_candidates(evidence.candidates(rows, "family", "practice", "indicator"), asked, model)
    sure = spark.createDataFrame([("soil loss", "high")], "indicator string, confidence string")
    got = {r.request: r for r in evidence.recommend_by_model(scored, "request", evidence.DIRECTIONS, sure).collect()}
    assert [x.practice for x in got[1].recommendations] == ["r", "p"] and [x.practice for x in got[2].recommendations] == ["p", "r"]
    assert got[1].recommendations[0].effect == "~22% increase in yield" and got[1].details.confidence == "low"
    assert (got[1].details.n_candidates, got[1].details.n_grounded, got[1].details.ranked[0].log_ratio) == (3, 2, 0.2)
    bare = scored.withColumn("n_evidence", F.lit(0).cast("long"))
    with pytest.raises(Exception, match="no evidence for F with yield"):
        evidence.recommend_by_model(bare, "request", evidence.DIRECTIONS, sure).collect()
    with pytest.raises(Exception, match="unknown indicator: x"):
        evidence.recommend_by_model(scored.withColumn("indicator", F.lit("x")), "request", evidence.DIRECTIONS, sure).collect()


def test_models_are_chosen_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([("a" if i % 2 else "b", float(i % 7), float(i % 7) * 3, i % 3) for i in range(120)], "c string, x double, y double, fold int")
    kinds = {"deep": models.forest(trees=10, depth=6), "flat": models.forest(trees=1, depth=1)}
    model, figures = models.select_and_refit(rows, kinds, ["c"], ["x"], "y", "fold", 3, "c")
    assert {(r.scope, r.model) for r in figures.collect()} == {("all", "deep"), ("a", "deep"), ("b", "deep")}
    models.save(model, figures, str(tmp_path / "m"))
    again, held = models.load(spark, str(tmp_path / "m"))
    assert sorted(r.prediction for r in again.transform(rows).collect()) == sorted(r.prediction for r in model.transform(rows).collect())
    assert {(r.scope, r.n, r.confidence) for r in held.collect()} == {(r.scope, r.n, r.confidence) for r in figures.collect()}


def test_wide_and_narrow_searches_agree(spark):
    import random

    rng = random.Random(7)
    cells = spark.createDataFrame(sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(60)}), "row long, col long").withColumn("value", F.col("row") * 100.0 + F.col("col"))
    points = spark.createDataFrame([(i, rng.randrange(80), rng.randrange(80)) for i in range(80)], "point_id long, row long, col long")
    wide = {r.point_id: (r.value, r.d2) for r in grid.nearest_valid(points, cells, 30).collect()}
    assert wide == {r.point_id: (r.value, r.d2) for r in grid._nearest(points, cells, 30, "value").collect()}
    both = grid.stack({"a": cells, "b": cells.filter("row < 40")})
    assert both.count() == cells.count() and both.filter("b is null").count() == cells.filter("row >= 40").count()


def test_long_gazetteers_give_the_same_places(spark, monkeypatch):
    names = spark.createDataFrame([(1, "ambo", "Ambo"), (2, "addis", "Addis"), (3, "addis ababa", "Ababa"), (4, "x", "X"), (5, "bo", "Bo")], "pos int, alias string, place string")
    texts = spark.createDataFrame([(1, "bamboo plots"), (2, "Addis, Ambo"), (3, "in addis ababa"), (4, "fax"), (5, "hobo"), (6, "none"), (7, ""), (8, None)], "i long, t string")
    short = {(r.i, r.place) for r in classify.gazetteer(texts, "i", "t", names).collect()}
    monkeypatch.setattr(classify, "NAME_BYTES", 150)
    assert {(r.i, r.place) for r in classify.gazetteer(texts, "i", "t", names).collect()} == short and len(short) == 5


def test_gazetteers_of_any_script_and_both_ways(spark, monkeypatch):
    names = spark.createDataFrame([(1, "አዲስ አበባ", "Addis"), (2, "Debre-Márkos", "Debre"), (3, "wolaita sodo", "Wolaita"), (4, "sodo", "Sodo"), (5, "sodo town", "Town")], "pos int, alias string, place string")
    texts = [(1, "ከአዲስ አበባ!", None), (2, "near DEBRE márkos", None), (3, "none", ["Mars", "wolait"]), (4, "none", ["sodo"]), (5, None, ["to sodo town now"]), (6, "", []), (7, "none", ["sod"]), (8, "ﬁne ²", ["?"])]
    texts = spark.createDataFrame(texts, "i long, t string, p array<string>")
    want = {1: "Addis", 2: "Debre", 3: "Wolaita", 4: "Sodo", 5: "Town", 7: "Wolaita"}
    assert {r.i: r.place for r in classify.gazetteer(texts, "i", "t", names, F.col("p")).collect()} == want
    monkeypatch.setattr(classify, "NAME_BYTES", 150)
    assert {r.i: r.place for r in classify.gazetteer(texts, "i", "t", names, F.col("p")).collect()} == want
    assert places.folded("ﬁne ² Ａ_b") == "fine 2 a_b"


def test_a_hundred_thousand_aliases(spark):
    import random

    rng = random.Random(11)
    listed = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 12))), f"p{i}") for i in range(100_000)]
    texts = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(30))) for i in range(20)]
    got = {r.i: r.place for r in classify.gazetteer(spark.createDataFrame(texts, "i long, t string"), "i", "t", spark.createDataFrame(listed, "pos long, alias string, place string")).collect()}
    best = lambda t: min(((-len(a), i, p) for i, a, p in listed if a in t), default=(0, 0, None))[2]
    assert got == {i: p for i, t in texts if (p := best(t))}


def test_an_index_is_built_once_and_read_again(spark, tmp_path, monkeypatch):
    import math as m
    import random
    from collections import Counter

    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.randrange(0, 40))) if i % 17 else None) for i in range(300)]
    asked = [(q, " ".join(rng.choices(vocabulary, k=5))) for q in range(12)] + [(99, "unheard of")]
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", 500)
    docs = spark.createDataFrame(texts, "d long, t string").repartition(3)
    retrieval.build_index(docs, "d", "t").write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() > 3 and max(r.n for r in index.selectExpr("aggregate(dl, 0, (a, x) -> a + x) as n").collect()) < 500 + 40
    tf = {i: Counter((t or "").split()) for i, t in texts}
    df = Counter(w for c in tf.values() for w in c)
    assert {r.term: r.df for r in retrieval.document_counts(index).collect()} == dict(df)
    assert {(r.id, r.term, r.tf, r.dl) for r in retrieval.postings(index).collect()} == {(i, w, n, c.total()) for i, c in tf.items() for w, n in c.items()}
    n, avg = len(texts), sum(c.total() for c in tf.values()) / len(texts)
    raw = {w: m.log(n - x + 0.5) - m.log(x + 0.5) for w, x in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = set()
    for q, text in asked:
        score = {i: round(sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / avg)) for w in text.split() if c[w]), 6) for i, c in tf.items()}
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted((-s, i) for i, s in score.items() if s > 0)[:7])}
    assert {(r.query_id, r.d, r["rank"]) for r in retrieval.search(spark.createDataFrame(asked, "q long, t string"), index, "q", "t", "d", 7).collect()} == want
    monkeypatch.setattr(retrieval, "_SCORES", 1)
    assert {(r.query_id, r.d, r["rank"]) for r in retrieval.search(spark.createDataFrame(asked, "q long, t string"), index, "q", "t", "d", 7).collect()} == want


def test_sources_of_records_and_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "chunk_id string, v double")
    files.add_vectors(rows, str(tmp_path / "v"))
    files.add_vectors(rows.unionByName(spark.createDataFrame([("c", 3.0)], "chunk_id string, v double")), str(tmp_path / "v"))
    assert sorted(r.chunk_id for r in files.stored_ids(spark, str(tmp_path / "v")).collect()) == ["a", "b", "c"]
    found = spark.createDataFrame([("p1", bytearray(b"%PDF1")), ("p2", bytearray(b"junk")), ("p3", bytearray(b"junk"))], "path string, content binary")
    again = spark.createDataFrame([("p2", bytearray(b"%PDF2")), ("p3", bytearray(b""))], "path string, content binary")
    good, bad = files.readable(found, b"%PDF", again)
    assert sorted(r.path for r in good.collect()) == ["p1", "p2"] and [r.path for r in bad.collect()] == ["p3"]
    lookup = files.lookup(spark.createDataFrame([("1", "x"), ("2", "y"), ("1", "z")], "k string, n string").coalesce(1), "k", "n")
    assert {r.code: r.name for r in lookup.collect()} == {1: "z", 2: "y"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"d": 1}\n{"d": 2}\n')
    query = files.read_stream(spark, str(tmp_path / "in"), "d int").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.n_rows for r in events.latencies(spark, query).collect()) == 2
    shaped = files.shape_works(spark.createDataFrame([(1, "{bad"), (2, '{"issued": {"date-parts": [[null]]}}')], "k int, j string"), "j", "k").collect()
    assert all(r.year is None and r.doi is None for r in shaped)


def test_steps_that_fail_are_recorded(spark):
    from siltstone.operators import serving

    done = []
    out = serving.run_steps(spark, {"a": lambda: done.append(1), "b": lambda: 1 / 0, "c": lambda: done.append(2)}).collect()
    assert [(r.step, r.status) for r in out] == [("a", "done"), ("b", "failed"), ("c", "done")] and done == [1, 2]


def test_rules(spark):
    t = F.col("t")
    at = classify.coordinates(t)
    assert tuple(one(spark, at, t="farm at 9.03, 38.74")) == (9.03, 38.74)
    assert one(spark, at, t="in 55, 12 then 9.03 38.74") is None
    assert one(spark, at, t="no numbers") is None
    assert one(spark, classify.first_word(t, classify.CROPS), t="Wheat and TEFF, maizes") == "Teff"
    found, multi, none = classify.by_priority(t, {"A": ["tree"], "B": ["feed"]}, ["A", "B"], "C")
    assert one(spark, F.struct(found, multi, none), t="Fodder TREE feed") == ("A", True, False)
    assert one(spark, F.struct(found, multi, none), t="nothing") == ("C", False, True)
    assert one(spark, classify.place_candidates(t), t="my plot near Debre Markos and the river, in Ab") == ["Debre Markos"]
    assert one(spark, F.struct(*classify.intents(t)), t="Why this?") == (True, False)
    names = spark.createDataFrame([(1, "ambo", "Ambo"), (2, "addis", "Addis")], "pos int, alias string, place string")
    texts = spark.createDataFrame([(1, "bamboo plots"), (2, "Addis, Ambo")], "i long, t string")
    assert {r.i: r.place for r in classify.gazetteer(texts, "i", "t", names).collect()} == {1: "Ambo", 2: "Addis"}


def test_slots_of_a_conversation(spark):
    said = [
        (1, 1, "My farm at 9.03, 38.74 grows teff"), (1, 2, "runoff on the steep slope"), (1, 3, "ok"), (2, 1, "I lose ground to erosion control"),
        (2, 2, "the soil is gone"), (3, 1, None), (4, 1, "increase income"),
    ]
    rows = slots.conversation_slots(spark.createDataFrame(said, "c int, n int, t string"), "c", "n", "t").collect()
    found = {(r.c, r.n): (r.family, r.indicator, r.lat, r.crop) for r in rows}
    assert found[1, 1] == (None, None, 9.03, "Teff")
    assert found[1, 2] == found[1, 3] == (slots.EROSION, "runoff", 9.03, "Teff")
    assert found[2, 2] == (slots.EROSION, "soil loss", None, None)
    assert found[3, 1] == (None, None, None, None)
    assert found[4, 1] == (slots.CROP, "income", None, None)
    label = slots.family_label(F.col("f"), F.lit("yield"), F.lit("Increase crop yield"))
    assert [one(spark, label, f=x) for x in (slots.FOREST, slots.CROP)] == ["Increase crop & tree productivity", "Increase crop yield"]


def test_expert_statistics(spark):
    pairs = spark.createDataFrame([(x, 0.0) for x in (1.0, 2.0, -2.0, 3.0, 0.0)], "a double, b double")
    row = serving.signed_ranks(pairs, "a", "b").first()
    assert (row.n, row.w_plus, row.w_minus, row.effect) == (5, 7.5, 2.5, 0.5)
    assert math.isclose(row.z, (7.5 - 5) / math.sqrt(4 * 5 * 9 / 24 - 6 / 48))
    assert math.isclose(one(spark, serving.two_sided_p(F.col("z")), z=-1.959963985), 0.05, rel_tol=1e-6)
    assert serving.signed_ranks(pairs.filter("a = b"), "a", "b").first().z is None
    rated = spark.createDataFrame([(i, v) for i, vs in enumerate([(1, 1), (2, 3), (3, 3), (1, 2), (3,)]) for v in vs], "i int, v int")
    totals, units = {1: 3, 2: 2, 3: 3}, [(1, 1), (2, 3), (3, 3), (1, 2)]
    far = lambda c, k: (sum(totals[g] for g in range(min(c, k), max(c, k) + 1)) - (totals[c] + totals[k]) / 2) ** 2
    expected = 1 - 7 * sum(far(a, b) for a, b in units if a != b) / sum(totals[a] * totals[b] * far(a, b) for a in totals for b in totals if a < b)
    assert math.isclose(serving.ordinal_alpha(rated, "i", "v").first().alpha, round(expected, 6))
    assert serving.ordinal_alpha(rated.filter("v = 1"), "i", "v").first().alpha is None


def test_grounding(spark):
    allowed = ground.allowed_numbers(F.lit('{"pct": 12.34, "n": -3}'))
    assert one(spark, ground.all_grounded(F.lit("about 12.3% over 9 sites"), allowed))
    assert one(spark, ground.ungrounded(F.lit("grew 55% [2]"), allowed)) == ["55"]
    texts = spark.createDataFrame([(1, "Gain of 12.3%. Then forty more; 77 too.")], "i long, t string").withColumn("a", allowed)
    assert [r.verdict for r in ground.audit(texts, "i", "t", "a").orderBy("sentence_idx").collect()] == ["pass", "fail_wordform", "fail_digits"]
    assert sorted(one(spark, ground.allowed_numbers(F.lit("2019-03"), values=F.array(F.lit(-3.0))))) == [-3.0, 3.0, 2019.0]
    held = [F.array(F.lit("A gain of 12 percent, twenty sites.")), F.array(F.lit("Or 25."))]

    def claim(sentence):
        return one(spark, ground.audit_claims(F.lit(sentence), F.array().cast("array<double>"), *held))

    assert claim("No numbers [1].") is None
    assert tuple(claim("Twenty sites gained 12% [1].")) == (2, "pass", "yes")
    assert tuple(claim("They gained 25% [1].")) == (1, "pass", "no") and tuple(claim("They gained 25% [G1].")) == (1, "pass", "yes")
    assert tuple(claim("They gained 33% [7].")) == (1, "fail_digits", "no_marker") and tuple(claim("Thirty of 33 [1]")) == (2, "fail_both", "no")


def test_sampling_is_deterministic(spark):
    rows = spark.range(100).withColumn("cell", F.col("id") % 7)
    picks = [sorted(r.id for r in sampling.quota(rows.repartition(n), ["cell"], "id", 2, "42").collect()) for n in (1, 5)]
    assert picks[0] == picks[1] and len(picks[0]) == 14
    assert [r.cell for r in sampling.round_robin(rows, ["cell"], "id", 9).orderBy("round", "cell").collect()] == [*range(7), 0, 1]


def test_rate_limit_ignores_refused(spark):
    rows = spark.createDataFrame([(1, i, datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 59, 61, 62))], "u long, e long, ts timestamp")
    got = events.rate_limit(rows, "u", "e", "ts", 60, 2).orderBy("e").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, False]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 70))], "u long, e long, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    windowed = events.tumbling(source, "ts", "1 minute", ["u"], "e").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    windowed.awaitTermination()
    assert sorted(r.n for r in spark.sql("select * from windows").collect()) == [1, 3]


def test_looks_at_unknown_sources(spark):
    rows = spark.createDataFrame([("x" * 200, 1), ("2.5", 2), ("n/a", 3)], "s string, n int")
    assert [len(r.s) for r in files.inspect(rows.orderBy("n"), 1).collect()] == [160]
    assert [r.v for r in rows.orderBy("n").select(files.sniffed(F.col("s")).alias("v")).collect()] == [None, 2.5, None]
    assert [r.line for r in evaluate.markdown(rows.filter("n > 1").orderBy("n"), ["n", "s"]).collect()] == ["| 2 | 2.5 |", "| 3 | n/a |"]
    cells = spark.createDataFrame([(1.0,), (-9999.0,), (float("nan"),), (None,)], "v double")
    assert [r.b for r in cells.select(grid.is_nodata(F.col("v"), -9999.0).alias("b")).collect()] == [False, True, True, True]
    assert [r.b for r in cells.select(grid.is_nodata(F.col("v")).alias("b")).collect()] == [False, False, True, True]


def test_article_markup_is_read_by_structure(spark):
    from siltstone.functions import markup

    t = F.col("t")
    nested = "<body><p>A &#8211; b&eacute; &lt;i&gt;</p><table-wrap><fig><fig>in</fig>x</fig><p>cell</p></table-wrap><p>C<xref ref-type='bibr'>1</xref>d</p></body>"
    assert one(spark, text.clean_jats(t), t=nested).split() == ["A", "–", "bé", "<i>", "C", "d"]
    assert one(spark, text.clean_jats(t), t="<sub-article><abstract><title>T</title>x<!-- <fig> --></abstract></sub-article><body a='>'>y<fig/>z</body>").split() == ["T", "x", "y", "z"]
    assert markup.article_text("<p>open <fig> stays</p>").split() == ["open", "stays"] and markup.article_text("") == ""
    assert markup.article_text("<body><![CDATA[a <b> &amp;]]></body>").strip() == "a <b> &amp;"
    assert markup.article_text("<BODY><P>up</P></BODY>").split() == ["up"]
    assert one(spark, text.clean_html(t), t="&#x41;&#66; &copy 5 &notin; x &amp;lt;b&amp;gt; y") == "AB © 5 ∉ x y"


def test_numbers_of_nested_records(spark):
    from siltstone.functions import nested

    record = F.struct(F.lit(-1.5).alias("a2"), F.lit(True).alias("b"), F.array(F.struct(F.lit("x 7 and 8.25").alias("c"), F.lit(None).cast("int").alias("d9"))).alias("list"), F.create_map(F.lit("k10"), F.array(F.lit(11))).alias("m"))
    assert one(spark, nested.record_numbers(record)) == [-1.5, 2.0, 7.0, 8.25, 9.0, 10.0, 11.0]
    assert one(spark, nested.json_numbers(F.col("t")), t='{"1e3": [1e3, false, null, "2019-03"]}') == [1.0, 3.0, 1000.0, 2019.0]
    assert one(spark, nested.json_numbers(F.lit(None).cast("string"))) is None
    allowed = ground.allowed_numbers(F.lit("in 3 plots"), record=record)
    held = spark.range(1).select(allowed.alias("a"))
    assert held.select(ground.ungrounded(F.lit("1.5 and 8.2 but not 12.5 of 10"), F.col("a")).alias("u")).first().u == ["12.5"]


def test_sse_blocks(spark):
    rows = spark.createDataFrame([("event: token\ndata: a\n\nbroken\n\ndata: b",)], "t string")
    assert [(r.event, r.data) for r in events.parse_sse(rows, "t").orderBy("seq").collect()] == [("token", "a"), ("message", "b")]


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"era_code": "A", "title": "x"}\n\n{"era_code": "A", "title": "y", "year": 2019}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "m.jsonl"), files.MANIFEST_SCHEMA).filter("era_code is not null").withColumn("n", F.monotonically_increasing_id())
    assert [(r.title, r.doi) for r in files.latest(rows, "era_code", "n").collect()] == [("y", None)]
    files.write_csv(rows, str(tmp_path / "c"), ["title", "era_code"])
    assert files.read_csv_strings(spark, str(tmp_path / "c")).columns == ["title", "era_code"]
    at = files.replace_json(rows.select("title"), str(tmp_path / "j"))
    files.append_json(rows.select("title"), at)
    assert spark.read.json(at).count() == 4
    assert rows.select(files.first_filled(rows, ["nothing", "TITLE"]).alias("x")).first()["x"] in ("x", "y")


def test_a_list_that_just_fills_up_keeps_its_least_score_as_floor():
    best, floor = [(np.zeros(0, object), np.zeros(0))], np.zeros(1)
    for scores, ids in (([3.0, 9.0], [1, 2]), ([5.0], [3])):
        retrieval._merge(best, floor, np.array([0]), np.array([scores]), np.array(ids), 2)
        assert floor[0] == min(sorted(best[0][1])[-2:])
    assert sorted(zip(best[0][0].tolist(), best[0][1].tolist(), strict=True)) == [(2, 9.0), (3, 5.0)]
