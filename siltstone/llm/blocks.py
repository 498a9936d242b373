"""Searches of a query set over all vectors: candidates in bounded groups in memory, query blocks streamed past them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import pick

#: Bytes of a group's candidates, in memory at once; queries of a block.
GROUP_BYTES, BLOCK = 32 << 20, 512
_PACKED = pa.schema([("dim", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """id, v of rows whose id and vector have no null and only finite components; all-zero vectors only if `zero`."""
    v = F.col("v").cast("array<double>")
    rows = pick(vectors, id=id_col, v=vec_col).select(F.col("id").cast("long"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))


def _pack(kind: int, most: int):
    """Rows with id, v, g to packed blocks of equal dimension and g."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            dim = np.diff(v.offsets.to_numpy())
            values, ids, group = v.flatten().to_numpy(), batch.column("id").to_numpy(), batch.column("g").to_numpy()
            first = np.cumsum(dim) - dim
            for d, g in np.unique(np.column_stack([dim, group]), axis=0).tolist():
                rows = np.flatnonzero((dim == d) & (group == g))
                for a in range(0, len(rows), most):
                    some = rows[a : a + most]
                    data = values[first[some][:, None] + np.arange(d)]
                    yield pa.record_batch(
                        [pa.array([d], pa.int32()), pa.array([g], pa.int32()), pa.array([kind], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([data.astype("<f8").tobytes()], pa.binary())],
                        schema=_PACKED,
                    )

    return run


def _read(row, d: int):
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, d)


def search(
    vectors: DataFrame,
    queries: Column,
    make_index: Callable,
    k: int,
    largest: bool,
    score_type: str,
    id_col: str,
    vec_col: str,
    zero: bool,
) -> DataFrame:
    """The k best of all vectors for each row for which `queries` (over id_col) holds: query_id, rank, vec_id, score.

    make_index(ids, matrix) holds a group and is asked index(query_id, vector, k) for ids and scores, best first.  Only
    vectors of the same dimension meet; a query's own id is no candidate.  Queries with an equal id count once.
    Candidates are dealt by id to groups of about GROUP_BYTES at most and every group meets all query blocks; a group's
    candidates are in memory, its queries come as a stream.
    """
    rows = usable(vectors, id_col, vec_col, zero)
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(8.0 * F.size("v") + 8), F.lit(0.0))).first()
    session = vectors.sparkSession
    groups = max(-(-int(size) // GROUP_BYTES), min(session.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    asked = rows.withColumn(id_col, F.col("id")).filter(queries).groupBy("id").agg(F.min("v").alias("v"))
    pack = "dim int, g int, kind int, ids binary, vectors binary"
    here = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).mapInArrow(_pack(0, 4096), pack)
    there = asked.withColumn("g", F.lit(0)).mapInArrow(_pack(1, BLOCK), pack).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(batches):
        at, index, held = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["g"], row["dim"])
                if key != at:
                    at, index, held = key, None, []
                if row["kind"] == 0:
                    held.append(_read(row, row["dim"]))
                    continue
                if index is None and held:
                    order = np.argsort(np.concatenate([x[0] for x in held]), kind="stable")
                    index = make_index(np.concatenate([x[0] for x in held])[order], np.concatenate([x[1] for x in held])[order])
                    held = []
                if index is None:
                    continue
                found = [(q, *index(q, v, k)) for q, v in zip(*_read(row, row["dim"]), strict=True)]
                size = [len(x[1]) for x in found]
                yield pa.record_batch(
                    [pa.array(np.repeat([x[0] for x in found], size).astype(np.int64)), pa.array(np.concatenate([x[1] for x in found]).astype(np.int64)), pa.array(np.concatenate([x[2] for x in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    met = here.unionByName(there).repartitionById(groups, "g").sortWithinPartitions("g", "dim", "kind")
    best = met.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = F.col("score").desc() if largest else F.col("score").asc()
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
