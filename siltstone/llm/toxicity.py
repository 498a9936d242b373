"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic rows are the positives; all training rows, whatever their label, are the unlabelled text.
Features are hashed words and word beginnings of 3 to 6 bytes, present or not.  Features that positives hold clearly
more often than unlabelled text are kept.  A linear classifier minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss: the second term is what unlabelled text says about clean text once the toxic share in it, the
class prior, is taken out; where it would turn negative, which only overfitting can do, its gradient is reversed.

Which features are kept is counted over all training rows, in Spark.  The risk is minimised over at most MOST_POSITIVE
confirmed rows and MOST_UNLABELLED rows of the unlabelled text, chosen by the least hash of seed and id at any input
size; only their kept features, at most MOST_FEATURES a row, come to the driver.  Scoring reads every row; the model
(under 1 MB) is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import chunks, durable, mix, pick, utf8, word_hashes

#: Bounds of the training sample.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 9000
#: Feature space; beginnings of words, in bytes; features kept at most, and what they must show.
SPACE, STEMS, MOST_FEATURES, MIN_POSITIVE, MIN_Z = 1 << 18, (3, 4, 5, 6), 4096, 3, 4.0

_GAP = np.ones(256, bool)
_GAP[128:] = False
for _a, _b in ("09", "AZ", "az"):
    _GAP[ord(_a) : ord(_b) + 1] = False


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and features of every word of a text column, with repeats; letters A-Z count as a-z."""
    data, offsets = utf8(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~_GAP[data]
    full = offsets[1:] > offsets[:-1]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[offsets[:-1][full]] = inside[offsets[:-1][full]]
    start = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    edge[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    end = np.flatnonzero(edge) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    rows, found = [row], [word_hashes(data, start, end)]
    for k in STEMS:
        long = end - start > k
        rows.append(row[long])
        found.append(mix(word_hashes(data, start[long], start[long] + k) ^ np.uint64(k << 56)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - 18)).astype(np.int32)


def distinct(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows.astype(np.int64) * SPACE + found)
    return both // SPACE, (both % SPACE).astype(np.int32)


@dataclass
class Model:
    """Weights over the feature space, most of them zero, and an intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, found = features(column)
        some = self.weights[found] != 0
        rows, found = distinct(rows[some], found[some])
        total = self.intercept + np.bincount(rows, self.weights[found], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _chosen(keys: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` of the keys (id, sig), by the least hash; a threshold leaves about twice as many before any moves."""
    keys = keys.distinct()
    least = F.pmod(F.xxhash64(F.lit(seed), "id", "sig"), F.lit(1 << 30))
    share = min(1.0, 2.0 * (most + 50) / max(keys.count(), 1))
    return durable(keys.filter(least < int(share * (1 << 30))).orderBy(least, "id", "sig").limit(most))


def _texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """A text for each chosen key: their number is bounded, so their broadcast is small and only their texts move."""
    return rows.join(F.broadcast(chosen), ["id", "sig"], "left_semi").groupBy("id", "sig").agg(F.first("text").alias("text")).select("text")


def _counts(texts: DataFrame) -> DataFrame:
    """feature, n: the number of texts that hold each feature, counted in each task before anything moves."""

    def run(batches):
        held, rows = np.zeros(SPACE, np.int64), 0
        for table in chunks(batches, 4 << 20):
            held += np.bincount(distinct(*features(table.column("text")))[1], minlength=SPACE)
            rows += table.num_rows
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.r_[some, -1]), pa.array(np.r_[held[some], rows])], names=["feature", "n"])

    return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def select(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """The features that n_p positive texts hold clearly more often than n_u unlabelled ones, the clearest first."""
    pooled = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    keep = np.flatnonzero((z >= MIN_Z) & (in_p >= MIN_POSITIVE))
    return keep[np.argsort(-z[keep], kind="stable")][:MOST_FEATURES]


def _lists(texts: DataFrame, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers and numbers in `keep` of the kept features of each text, and how many texts there are."""
    number = np.full(SPACE, -1, np.int32)
    number[keep] = np.arange(len(keep))

    def run(batches):
        for table in chunks(batches, 4 << 20):
            rows, found = distinct(*features(table.column("text")))
            rows, found = rows[number[found] >= 0], number[found[number[found] >= 0]]
            ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=table.num_rows))]
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))], names=["found"])

    column = texts.mapInArrow(run, "found array<int>").toArrow().column("found").combine_chunks()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(), len(column)


def descend(positive: tuple, unlabelled: tuple, n: int, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of least risk; each side is (row, feature, number of rows), features run from 0 to n."""
    (p_row, p, n_p), (u_row, u, n_u) = positive, unlabelled
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        g_p = b + np.bincount(p_row, w[p], minlength=n_p)
        g_u = b + np.bincount(u_row, w[u], minlength=n_u)
        s_p, s_u = 1 / (1 + np.exp(-np.clip(g_p, -40, 40))), 1 / (1 + np.exp(-np.clip(g_u, -40, 40)))
        slope_p, slope_u = prior * s_p * (1 - s_p) / n_p, s_u * (1 - s_u) / n_u
        if s_u.mean() >= prior * s_p.mean():
            d_p, d_u = -2 * slope_p, slope_u
        else:  # the risk of clean text went below zero: climb back
            d_p, d_u = slope_p, -slope_u
        grad = np.append(np.bincount(p, d_p[p_row], minlength=n) + np.bincount(u, d_u[u_row], minlength=n) + decay * w / max(n, 1), d_p.sum() + d_u.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]  # no kept feature speaks for clean text
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, training: Column, prior: float | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the rows for which `training` (over id) holds.  The prior is the toxic share of their labels, if not given.

    An id with several labels is toxic if one of them is; null ids and labels teach nothing; texts that repeat an id
    count once for each different text in the samples, each in the counts.  Without positives or unlabelled rows every
    score is the prior's.
    """
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("sig"))
    rows = rows.filter(F.col("id").isNotNull() & training)
    keys = durable(rows.select("id", "sig"))
    marks = pick(labels, id=id_col, toxic=label_col).select(F.col("id").cast("long"), F.col("toxic").cast("int")).filter(F.col("id").isNotNull() & training & F.col("toxic").isNotNull())
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marks.agg(F.avg("toxic")).first()[0] or 0.0
    prior = min(max(float(prior), 1e-4), 1 - 1e-4)
    toxic = marks.filter("toxic = 1").select("id")
    positive, unlabelled = (_texts(rows, _chosen(k, most, seed)) for k, most in ((keys.join(toxic, "id", "left_semi"), MOST_POSITIVE), (keys, MOST_UNLABELLED)))
    positive = durable(positive)
    counted = [dict(np.stack([t.column(c).to_numpy() for c in ("feature", "n")], axis=1).tolist()) for t in (_counts(x).toArrow() for x in (positive, rows.select("text")))]
    n_p, n_u = (c.pop(-1, 0) for c in counted)
    weights = np.zeros(SPACE)
    if not n_p or not n_u:
        return Model(weights, float(np.log(prior / (1 - prior))))
    in_p, in_u = np.zeros(SPACE), np.zeros(SPACE)
    for held, c in ((in_p, counted[0]), (in_u, counted[1])):
        held[list(c)] = list(c.values())
    keep = select(in_p, n_p, in_u, n_u)
    weights[keep], intercept = descend(_lists(positive, keep), _lists(unlabelled, keep), len(keep), prior)
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id_col, the columns of `carry`, and score of every row; null and empty texts get the intercept's."""
    held, carry = docs.sparkSession.sparkContext.broadcast(model), carry or []
    rows = pick(docs, id=id_col, text=text_col, **{f"carried{i}": c for i, c in enumerate(carry)})
    rows = rows.withColumns({"id": F.col("id").cast("long"), "text": F.col("text").cast("string")})

    def run(batches):
        for table in chunks(batches, 4 << 20):
            columns = [table.column(n).combine_chunks() for n in names]
            yield pa.record_batch([*columns, pa.array(held.value.scores(table.column("text")))], names=[*names, "score"])

    names = rows.drop("text").columns
    schema = rows.select(*names).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema).toDF(id_col, *carry, "score")
