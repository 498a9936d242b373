"""Gradient boosting on histograms: squared error, native categories, L2, missing values; all folds in one pass.

Columns become bins once: numbers by their quantiles, categories by their code, and one bin for what is missing or was
not seen in training.  A level of the trees is one aggregation: each task adds up gradients and rows by (fold, node,
column, bin) and Spark adds up the tasks.  What comes to the driver is bounded by those four, never by rows; it picks the
splits.  A number splits at a bin, a category between bins in the order of their mean gradient, and what is missing goes
to the side that gains more.  A leaf is worth -G / (H + l2), times the step.

Every row is outside the training rows of one fold's trees, so the trees of all folds grow side by side: as many passes
as for one model.  Rows of equal bins and fold have equal gradients but for their labels, so trees grow on such rows put
together, with their number and the sum of their labels; the rounds then depend on how many kinds of rows there are.
Their sums so far are settled in the shared folder every SETTLE rounds; in between, the few trees since then are applied
again.  The rows themselves meet the trees once, for the out-of-fold prediction.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import settled

#: The bin of what is missing, so there are as many bins for values at most.
MISSING = 255
#: Rounds after which the rows' sums are written.
SETTLE = 10


@dataclass
class Tree:
    """Nodes in heap order: feature (-1 at a leaf), the bins that go left, value."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros((n, 256), bool), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at]
            down = row[f[row] >= 0]
            if not len(down):
                return at
            left = self.left[at[down], bins[down, f[down]]]
            at[down] = 2 * at[down] + 2 - left
            row = down

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class Binning:
    """How columns become bins: the values of each category by code, the edges of each number."""

    categories: dict[str, list[str]]
    numbers: dict[str, list[float]]

    @property
    def columns(self) -> list[str]:
        return [*self.categories, *self.numbers]

    def bins(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.full((len(frame), len(self.columns)), MISSING, np.uint8)
        for i, (c, values) in enumerate(self.categories.items()):
            codes = pd.Index(values, dtype=object).get_indexer(frame[c].astype(object)) if values else np.full(len(frame), -1)
            out[:, i] = np.where(codes < 0, MISSING, codes)
        for i, (c, edges) in enumerate(self.numbers.items(), len(self.categories)):
            x = frame[c].to_numpy(float, na_value=np.nan)
            out[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(edges, x, "left"))
        return out


def binning(df: DataFrame, categories: list[str], numbers: list[str], bins: int = MISSING) -> Binning:
    """The bins of a table's columns; more than `bins` categories in a column are an error.

    A number of few distinct values has an edge at each, others at approximate quantiles; both are found in one pass.
    """
    bins = min(bins, MISSING)
    named: dict[str, list[str]] = {}
    for c in categories:
        seen = [r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().limit(bins + 1).collect()]
        if len(seen) > bins:
            raise ValueError(f"{c} has more than {bins} categories")
        named[c] = sorted(seen)
    if not numbers:
        return Binning(named, {})
    shares = [k / bins for k in range(1, bins)]
    usable = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numbers}
    row = df.agg(*[F.percentile_approx(x, shares, 100_000).alias(c) for c, x in usable.items()], *[F.max(x).alias(f"_top_{c}") for c, x in usable.items()]).first()
    edges = {c: sorted({e for e in row[c] or [] if e < row[f"_top_{c}"]}) for c in numbers}
    return Binning(named, edges)


@dataclass
class Boosted:
    """A fitted model; transform() adds `prediction` to a table that has its columns."""

    binning: Binning
    base: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        bins = self.binning.bins(frame)
        return self.base + sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))

    def transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)
        names = self.binning.columns

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.value.predict(pd.concat(columns, axis=1, keys=names)))

        kinds = [F.col(c).cast("string") for c in self.binning.categories] + [F.col(c).cast("double") for c in self.binning.numbers]
        return df.withColumn("prediction", predicted(*kinds))

    def save(self, spark, path: str) -> None:
        """One line of JSON in the folder."""
        trees = [{"feature": t.feature.tolist(), "left": [np.flatnonzero(x).tolist() for x in t.left], "value": t.value.tolist()} for t in self.trees]
        line = json.dumps({"categories": self.binning.categories, "numbers": self.binning.numbers, "base": self.base, "trees": trees})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> Boosted:
        held = json.loads(spark.read.text(path).first()[0])
        out = cls(Binning(held["categories"], held["numbers"]), held["base"])
        for t in held["trees"]:
            left = np.zeros((len(t["feature"]), 256), bool)
            for node, bins in enumerate(t["left"]):
                left[node, bins] = True
            out.trees.append(Tree(np.array(t["feature"], np.int16), left, np.array(t["value"])))
        return out


def best_split(g: np.ndarray, n: np.ndarray, categorical: np.ndarray, l2: float, least: int) -> tuple[float, int, np.ndarray, tuple] | None:
    """gain, column, bins that go left, (G, n) of the left side of a node's best split; None if nothing gains.

    g, n: sums of gradients and rows by (column, bin).  Ties go to the first column, the first bin, missing to the right.
    """
    total, rows = g[0].sum(), n[0].sum()
    worth = lambda s, k: s * s / (k + l2)
    best = None
    for f in range(len(g)):
        order = np.arange(MISSING)
        if categorical[f]:
            order = order[n[f, :MISSING] > 0]
            order = order[np.argsort(g[f, order] / (n[f, order] + l2), kind="stable")]
        gs, ns = np.cumsum(g[f, order]), np.cumsum(n[f, order])
        for missing_left in (False, True) if n[f, MISSING] else (False,):
            left_g, left_n = gs + missing_left * g[f, MISSING], ns + missing_left * n[f, MISSING]
            gain = worth(left_g, left_n) + worth(total - left_g, rows - left_n) - worth(total, rows)
            gain[(left_n < least) | (rows - left_n < least)] = -np.inf
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > 1e-12 * max(1.0, abs(worth(total, rows))) and (best is None or gain[k] > best[0] + 1e-12):
                left = np.zeros(256, bool)
                left[order[: k + 1]] = True
                left[MISSING] = missing_left if n[f, MISSING] else 2 * left_n[k] > rows
                if categorical[f]:
                    left[: MISSING][n[f, :MISSING] == 0] = left[MISSING]  # not seen here: as missing
                best = float(gain[k]), f, left, (left_g[k], left_n[k])
    return best


def _rows(df: DataFrame, bins: Binning, label: str, fold: str | None, carry: list[str], many: str | None) -> DataFrame:
    """bins (a byte for each column), y, fold, n, and the columns of carry."""
    context = df.sparkSession.sparkContext.broadcast(bins)
    kinds = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(bins.categories)]
    kinds += [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(bins.numbers, len(kinds))]
    own = F.col(fold).cast("int") if fold else F.lit(-1)
    rows = df.select(*kinds, F.col(label).cast("double").alias("y"), own.alias("fold"), _many(many).alias("n"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(carry)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = pd.DataFrame({c: b.column(f"c{i}").to_pandas() for i, c in enumerate(context.value.columns)})
            packed = pa.array([x.tobytes() for x in context.value.bins(frame)], pa.binary())
            rest = [b.column(k) for k in range(len(context.value.columns), b.num_columns)]
            yield pa.RecordBatch.from_arrays([packed, *rest], ["bins", *b.schema.names[len(context.value.columns) :]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if not f.name.startswith("c"))
    return rows.mapInArrow(code, f"bins binary, {kept}")


def _kinds(rows: DataFrame, base: list[float]) -> DataFrame:
    """bins, fold, n and y, the number of such rows and the sum of their labels, and sums (one for each model)."""
    return settled(rows.groupBy("bins", "fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("sums", _start(base)))


def _many(many: str | None) -> Column:
    return F.col(many).cast("long") if many else F.lit(1).cast("long")


def _start(base: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in base])


def _matrix(batch: pa.RecordBatch, models: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and sums of a batch."""
    packed = batch.column("bins")
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(batch) + 1]
    bins = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(batch), -1)
    return bins, batch.column("sums").flatten().to_numpy().reshape(len(batch), models)


def _add(sums: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    return sums + sum((np.stack([t.predict(bins) for t in trees], 1) for trees in rounds), np.zeros_like(sums))


def _histograms(rows: DataFrame, recent: list[list[Tree]], growing: list[Tree], level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and rows of training rows by (model, node of the level, column, bin): one aggregation."""
    models, nodes, first = len(growing), 2**level, 2**level - 1
    shared = rows.sparkSession.sparkContext.broadcast((recent, growing))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = np.zeros((models, nodes * width * 256)), np.zeros((models, nodes * width * 256), np.int64)
        recent, growing = shared.value
        for b in batches:
            if not len(b):
                continue
            bins, sums = _matrix(b, models)
            sums, y, fold, many = _add(sums, bins, recent), *(b.column(c).to_numpy() for c in ("y", "fold", "n"))
            for m, tree in enumerate(growing):
                at = tree.nodes(bins) - first
                here = (at >= 0) & (fold != m)
                cells = ((at[here, None] * width + np.arange(width)) * 256 + bins[here]).ravel()
                g[m] += np.bincount(cells, np.repeat(many[here] * sums[here, m] - y[here], width), g.shape[1])
                n[m] += np.bincount(cells, np.repeat(many[here], width), n.shape[1]).astype(np.int64)
        model, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(model * n.shape[1] + cell), pa.array(g[model, cell]), pa.array(n[model, cell])], ["cell", "g", "n"])

    found = rows.select("bins", "sums", "y", "fold", "n").mapInArrow(tally, "cell long, g double, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
    g, n = np.zeros(models * nodes * width * 256), np.zeros(models * nodes * width * 256, np.int64)
    cell = found.column("cell").to_numpy()
    g[cell], n[cell] = found.column("g").to_numpy(), found.column("n").to_numpy()
    shared.unpersist()
    return g.reshape(models, nodes, width, 256), n.reshape(models, nodes, width, 256)


def _grow(rows: DataFrame, recent: list[list[Tree]], models: int, categorical: np.ndarray, depth: int, step: float, l2: float, least: int) -> list[Tree]:
    """One tree for each model, level by level."""
    trees = [Tree.empty(depth) for _ in range(models)]
    for level in range(depth):
        g, n = _histograms(rows, recent, trees, level, len(categorical))
        split = False
        for m, tree in enumerate(trees):
            for k in range(2**level):
                node = 2**level - 1 + k
                if level and tree.feature[(node - 1) // 2] < 0:
                    continue
                if level == 0:
                    tree.value[0] = -step * g[m, 0, 0].sum() / (n[m, 0, 0].sum() + l2)
                if found := best_split(g[m, k], n[m, k], categorical, l2, least):
                    _, f, left, (left_g, left_n) = found
                    tree.feature[node], tree.left[node], split = f, left, True
                    right_g, right_n = g[m, k, 0].sum() - left_g, n[m, k, 0].sum() - left_n
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = -step * left_g / (left_n + l2), -step * right_g / (right_n + l2)
        if not split:
            break
    return trees


def _train(df: DataFrame, bins: Binning, label: str, fold: str | None, folds: int, carry: list[str], many: str | None, rounds: int, step: float, l2: float, least: int, depth: int):
    """The rows with their bins, each model's base and trees."""
    models = folds if fold else 1
    y, own = F.col(label).cast("double"), F.col(fold).cast("int") if fold else F.lit(-1)
    per = {r.f: (r.s, r.n) for r in df.groupBy(own.alias("f")).agg(F.sum(y).alias("s"), F.coalesce(F.sum(F.when(y.isNotNull(), _many(many))), F.lit(0)).alias("n")).collect()}
    outside = lambda m: [v for k, v in per.items() if k != m]
    base = [sum(s or 0.0 for s, _ in outside(m)) / max(1, sum(n for _, n in outside(m))) for m in range(models)]
    rows = _rows(df.filter(y.isNotNull()), bins, label, fold, carry, many)
    kinds = _kinds(rows, base)
    categorical = np.array([True] * len(bins.categories) + [False] * len(bins.numbers))
    trees: list[list[Tree]] = []
    recent: list[list[Tree]] = []
    for done in range(1, rounds + 1):
        grown = _grow(kinds, recent, models, categorical, depth, step, l2, least)
        recent.append(grown)
        trees.append(grown)
        if done % SETTLE == 0 or done == rounds:
            kinds, recent = settled(_summed(kinds, recent, models)) if done < rounds else kinds, []
    return rows, base, trees


def _summed(rows: DataFrame, rounds: list[list[Tree]], models: int) -> DataFrame:
    """The rows with the rounds' trees added to their sums."""
    shared = rows.sparkSession.sparkContext.broadcast(rounds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                bins, sums = _matrix(b, models)
                new = pa.FixedSizeListArray.from_arrays(_add(sums, bins, shared.value).ravel(), models).cast(pa.list_(pa.float64()))
                yield b.set_column(b.schema.get_field_index("sums"), "sums", new)

    return rows.mapInArrow(add, rows.schema)


def fit(df: DataFrame, categories: list[str], numbers: list[str], label: str, rounds: int = 400, step: float = 0.06, l2: float = 1.0, least: int = 20, depth: int = 5, bins: int = MISSING, many: str | None = None) -> Boosted:
    """A model of all rows with a label.  A table without rows gives one that predicts 0.

    many: a column that tells how many rows a row stands for; its label is then the sum of theirs.
    """
    binned = binning(df, categories, numbers, bins)
    _, base, trees = _train(df, binned, label, None, 1, [], many, rounds, step, l2, least, depth)
    return Boosted(binned, base[0], [t[0] for t in trees])


def out_of_fold(
    df: DataFrame, categories: list[str], numbers: list[str], label: str, fold: str, folds: int, carry: list[str] | None = None, rounds: int = 400, step: float = 0.06, l2: float = 1.0, least: int = 20, depth: int = 5, bins: int = MISSING, many: str | None = None
) -> DataFrame:
    """label, fold, the columns of carry and predicted, by the trees that have not seen the row's fold.

    Bins come from all rows, as they hold no labels; rows without a label are left out.  many: as in fit().
    """
    kept = [c for c in carry or [] if c not in (label, fold)]
    rows, base, grown = _train(df, binning(df, categories, numbers, bins), label, fold, folds, kept, many, rounds, step, l2, least, depth)
    rows = _summed(rows.withColumn("sums", _start(base)), grown, folds)
    return rows.select(F.col("y").alias(label), F.col("fold").alias(fold), *[F.col(f"x{i}").alias(c) for i, c in enumerate(kept)], F.get("sums", F.col("fold")).alias("predicted"))
