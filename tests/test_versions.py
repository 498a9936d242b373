"""Versions that switch whole, and streams that are killed and started again."""

from datetime import datetime, timedelta

import pytest

from siltstone.sources import versions

T0 = datetime(2024, 1, 1)


def test_readers_see_one_whole_version(spark, tmp_path):
    at = str(tmp_path / "store")
    assert versions.current(spark, at) is None
    with pytest.raises(ValueError, match="nothing"):
        versions.read_current(spark, at)
    first = versions.publish(spark.range(3), at)
    reader = versions.read_current(spark, at)
    second = versions.publish(spark.range(5), at)
    assert reader.count() == 3 and versions.read_current(spark, at).count() == 5 and versions.current(spark, at) == second
    versions.switch(spark, at, first)
    assert versions.read_current(spark, at).count() == 3
    assert versions.expire(spark, at, 1) == [] and versions.current(spark, at) == first
    versions.switch(spark, at, second)
    assert versions.expire(spark, at, 1) == [first]
    with pytest.raises(ValueError, match="no whole version"):
        versions.switch(spark, at, first)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        versions.publish(spark.range(5).selectExpr("1 / (id - 3) as x"), at)
    assert versions.read_current(spark, at).count() == 5


def test_vector_stores_are_dropped_and_rebuilt(spark, tmp_path):
    at = str(tmp_path / "vectors")
    rows = lambda *ids: spark.createDataFrame([(i, float(len(i))) for i in ids], "chunk_id string, v double")
    versions.extend_vectors(rows("a", "b", "b"), at)
    versions.extend_vectors(rows("b", "c"), at)
    assert sorted(r.chunk_id for r in versions.read_current(spark, at).collect()) == ["a", "b", "c"]
    versions.rebuild_vectors(rows("x", "x", "y"), at)
    assert sorted(r.chunk_id for r in versions.read_current(spark, at).collect()) == ["x", "y"]
    assert len(versions._names(spark, f"{at}/versions")) == 1


def test_a_killed_stream_gives_each_record_once(spark, tmp_path, monkeypatch):
    source, at = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "k long, ts timestamp, v string"

    def arrive(*rows):
        spark.createDataFrame([(k, T0 + timedelta(hours=h), v) for k, h, v in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        query = versions.ingest(spark.readStream.schema(schema).parquet(source), at, "k", "ts", "1 hour")
        try:
            assert query.awaitTermination(90)
        finally:
            query.stop()

    arrive((1, 0, "a"), (2, 0, "b"), (2, 0, "b"))
    run()
    arrive((2, 0, "b"), (3, 1, "c"))
    commit = versions._commit
    monkeypatch.setattr(versions, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        run()  # the batch is written but not in the ledger
    assert sorted(r.k for r in versions.ingested(spark, at).collect()) == [1, 2]
    monkeypatch.setattr(versions, "_commit", commit)
    run()
    arrive((1, 60, "long after"), (4, 60, "d"))
    run()
    assert sorted(r.k for r in versions.ingested(spark, at).collect()) == [1, 2, 3, 4]
