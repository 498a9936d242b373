"""The registered queries on the smallest tables: against their SQL, or against brute force where they have none."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siltstone.llm import queries as q
from siltstone.llm import registry
from siltstone.llm.sql import SQL
from siltstone.llm.toxicity import score, train
from test_operators import brute_components, brute_print

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


def test_fingerprints_and_components(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op4_simhash(spark, FOLDER).collect()}
    prints = {i: brute_print(t, 4) for i, t in texts.items()}
    roots = brute_components(prints, 4)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in texts}


def test_token_ids(spark, texts):
    import base64

    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = {i: (len(e), digest(" ".join(map(str, e)).encode()), digest(t.encode())) for i, t in texts.items() for e in [library.encode_ordinary(t)]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op5_byte_bpe(spark, FOLDER).collect()} == want


def test_toxicity_columns(spark, texts):
    found = q.op8_toxicity(spark, FOLDER)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())


def test_nearest_vectors(spark, duck):
    x = {i: np.array(v, float) for i, v in duck.execute("select vec_id, embedding from embeddings").fetchall()}
    got, hits, total = {}, 0, 0
    for r in q.op9_collision_ann(spark, FOLDER).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(got) == {i for i in x if i % 100 == 0}
    for i, found in got.items():
        away = sorted((math.sqrt(((x[i] - v) ** 2).sum()), j) for j, v in x.items() if j != i)[:10]
        assert [found[k] for k in sorted(found)] == sorted(found.values()) and sorted(found) == list(range(1, 11))
        assert all(abs(s - math.sqrt(((x[i] - x[j]) ** 2).sum())) < 1e-12 for s, j in found.values())
        hits, total = hits + len({j for _, j in away} & {j for _, j in found.values()}), total + 10
    assert hits >= 0.9 * total


# ---------------------------------------------------------------- the pipeline's stages


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxicity_stage_keeps_what_scores_low(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), ~q.held_out(F.col("id")))
    assert ids(P.toxicity(spark, docs, FOLDER)) == ids(score(docs, model).filter("score < 0.5"))


def test_line_stage_removes_what_the_sql_removes(spark, duck):
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in P.line_dedup(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER).collect()}
    found = duck.execute(f"select doc_id, kept_sha256 from ({SQL['op10_line_spread']})").fetchall()
    assert got == dict(found)


def test_mixing_stage_takes_the_rows_of_the_sql(spark, duck):
    from siltstone.llm.sql import mix_sql

    rows = duck.execute(f"select doc_id from ({mix_sql(P.MIX_SHARE, P.MIX_EPOCHS)}) where epochs > 0 or partial > 0 or n_tokens = 0").fetchall()
    assert ids(P.mixing(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)) == sorted(i for (i,) in rows)


def test_the_whole_run(spark):
    got = P.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert rows_of(got.columns, got.collect()) == rows_of(docs.columns, docs.collect())
    assert got.count() > 100
