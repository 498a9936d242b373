"""Random forests on histograms: variance reduction, bootstrap by rows, columns drawn anew at each node; all folds in one pass.

Columns become bins once: numbers at their quantiles, categories by the place of their name, the first bin for a category
that training rows have not.  Rows of equal bins and fold are put together: each row draws, for each tree, how often its
bootstrap holds it (Poisson of mean one), and a kind of rows keeps the sums of these numbers and of the labels they stand
for.  That is the bootstrap of the rows themselves, and trees need no more of them.  The levels then depend on how many kinds of
rows there are; the rows themselves are read to count categories, to find quantiles, to draw, and to be predicted.

A draw follows from the row's kind and its place in the kind by label, so a table gives the same draws however it is
partitioned.  The trees of all folds grow side by side, a level at a time: each task adds up labels and rows by (tree,
node, column, bin), Spark adds up the tasks, and the driver picks the splits.  What comes to it at once is bounded by CELLS.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import settled

#: Cells of histograms that are added up at once; deeper levels of many trees take several passes.
CELLS = 4_000_000
#: Tasks that add up histograms, at most; twice the cores, where these are more.
TASKS = 32
#: A cut that no bin exceeds: the node is a leaf.
LEAF = 255

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _poisson_steps() -> list[np.uint64]:
    """64-bit numbers from which on a draw of mean one is at least 1, 2, ..."""
    total, steps = 0.0, []
    for k in range(18):
        total += math.exp(-1) / math.factorial(k)
        if total >= 1 - 2.0**-52:
            break
        steps.append(np.uint64(int(total * 2.0**64)))
    return steps


_STEPS = _poisson_steps()
#: A draw by its first 16 bits; where a step lies among numbers that share them, the rest decides.
_DRAWS = sum((np.arange(1 << 16) > int(step) >> 48 for step in _STEPS), np.zeros(1 << 16, np.uint8))
_EDGE = np.isin(np.arange(1 << 16), [int(step) >> 48 for step in _STEPS])


def bootstrap(seeds: np.ndarray, places: np.ndarray, trees: int) -> np.ndarray:
    """How often each tree's bootstrap holds a row, by its kind's seed and its place in the kind: (rows, trees)."""
    x = seeds.astype(np.uint64)[:, None] + (places.astype(np.uint64)[:, None] * np.uint64(trees) + np.arange(1, trees + 1, dtype=np.uint64)) * _STEP
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    first = x >> np.uint64(48)
    out, edge = _DRAWS.take(first), _EDGE.take(first)
    out[edge] = sum(((x[edge] >= step).view(np.uint8) for step in _STEPS), np.zeros(edge.sum(), np.uint8))
    return out


@dataclass
class Trees:
    """Complete trees in heap order, a row each: column and cut (bins beyond it go right) of nodes, values of nodes and leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        return cls(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), LEAF, np.uint8), np.zeros((trees, 2 ** (depth + 1) - 1)))

    def reach(self, tree: int, bins: np.ndarray, level: int) -> np.ndarray:
        """The node of a level that each row comes to; beyond a leaf, the leftmost below it."""
        at, flat, start = np.zeros(len(bins), np.int64), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(level):
            right = flat.take(start + self.feature[tree].take(at)) > self.cut[tree].take(at)
            at <<= 1
            at += 1
            at += right
        return at

    def predict(self, bins: np.ndarray, trees: range) -> np.ndarray:
        depth = (self.value.shape[1] + 1).bit_length() - 2
        return sum((self.value[t].take(self.reach(t, bins, depth)) for t in trees), np.zeros(len(bins))) / max(1, len(trees))


@dataclass
class Cells:
    """The bins of each column that no cut of a forest tells apart, as cells; the predictions of all that cells can be together."""

    cuts: list[np.ndarray]
    trees: Trees
    table: np.ndarray | None

    @classmethod
    def of(cls, trees: Trees, columns: int) -> Cells:
        inner = trees.cut < LEAF
        cuts = [np.unique(trees.cut[inner & (trees.feature == i)]) for i in range(columns)]
        found = cls(cuts, trees, None)
        if math.prod(found.sizes) <= CELLS:
            every = np.indices(found.sizes, np.uint8).reshape(columns, math.prod(found.sizes)).T
            found.table = found.predict(every)
        return found

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    def cells(self, bins: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, bins[:, i], "left") for i, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def predict(self, cells: np.ndarray) -> np.ndarray:
        """As the trees predict any row of these cells."""
        bins = np.stack([np.append(c, c[-1] + 1 if len(c) else 0).astype(np.uint8)[cells[:, i]] for i, c in enumerate(self.cuts)], 1)
        return self.trees.predict(bins, range(len(self.trees.value)))

    def dealt(self, cells: np.ndarray, column: int | None = None, order: np.ndarray | None = None) -> np.ndarray:
        """Predictions of rows of cells; of a column, if one is given, each row takes the cell of the row that the order names."""
        own = cells if column is None else cells.copy()
        if column is not None:
            own[:, column] = cells[order, column]
        if self.table is None:
            some, place = np.unique(own, axis=0, return_inverse=True)
            return self.predict(some)[place.reshape(-1)]
        steps = np.cumprod([1, *self.sizes[:0:-1]])[::-1]
        return self.table.take(sum(own[:, i] * np.int64(step) for i, step in enumerate(steps)))


@dataclass
class Binning:
    """The names of each category in order, the folds outside which each was seen, and the edges of every column's bins."""

    categories: dict[str, list[str]]
    seen: dict[str, np.ndarray]
    numbers: list[str]
    edges: list[np.ndarray]

    def bins(self, columns: list[pa.Array], fold: np.ndarray) -> np.ndarray:
        """A byte for each row and column; a category that the trees of the row's own fold have not met goes to the first bin."""
        out = np.empty((len(fold), len(self.edges)), np.uint8)
        for i, (c, names) in enumerate(self.categories.items()):
            code = pc.fill_null(pc.index_in(columns[i], pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False)
            if len(names):
                seen = self.seen[c]
                code = np.where(seen[np.clip(fold, -1, seen.shape[0] - 2), code], code, -1)
            out[:, i] = np.searchsorted(self.edges[i], code, "left")
        for i in range(len(self.categories), len(self.edges)):
            out[:, i] = np.searchsorted(self.edges[i], columns[i].to_numpy(zero_copy_only=False).astype(float), "left")
        return out


def _edges(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between values, all of them if they fit into the bins, else at even shares of the rows."""
    if len(values) > bins:
        share = np.cumsum(counts) * bins / counts.sum()
        ends = np.unique(np.searchsorted(share, np.arange(1, bins), "left"))
        ends = ends[ends < len(values) - 1]
    else:
        ends = np.arange(len(values) - 1)
    return (values[ends] + values[ends + 1]) / 2


def binning(df: DataFrame, categories: list[str], numbers: list[str], fold: str | None, folds: int, bins: int) -> Binning:
    """Bins by all rows, as they hold no labels: one pass counts the categories, one finds the quantiles of the numbers.

    The names of categories come to the driver, so their number is to stay in the thousands.
    """
    bins = min(bins, LEAF)
    own = F.col(fold).cast("int") if fold else F.lit(-1)
    named: dict[str, list[str]] = {}
    seen: dict[str, np.ndarray] = {}
    edges: list[np.ndarray] = []
    if categories:
        each = df.select(own.alias("fold"), F.posexplode(F.array(*[F.col(c).cast("string") for c in categories])).alias("i", "name")).filter("name is not null")
        found = each.groupBy("i", "name", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
        for i, c in enumerate(categories):
            per = [(r["name"], r["fold"], r["n"]) for r in found if r["i"] == i]
            named[c] = sorted({name for name, _, _ in per})
            place = {name: k for k, name in enumerate(named[c])}
            n = np.zeros(len(named[c]))
            seen[c] = np.zeros((folds + 1, len(named[c])), bool)  # the last row: trees of all rows
            for name, k, count in per:
                n[place[name]] += count
                seen[c][[m for m in range(folds) if m != k] + [-1], place[name]] = True
            codes = np.arange(len(named[c]), dtype=float)
            edges.append(np.concatenate([[-0.5], _edges(codes, n, bins - 1)]))
    if numbers:
        shares = [k / (16 * bins) for k in range(16 * bins + 1)]
        usable = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numbers}
        row = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"_{i}") for i, x in enumerate(usable.values())]).first()
        edges += [_edges(*np.unique(np.array(row[f"_{i}"] or [], float), return_counts=True), bins) for i in range(len(numbers))]
    return Binning(named, seen, numbers, edges)


def _columns(bins: Binning) -> list:
    return [F.col(c).cast("string") for c in bins.categories] + [F.col(c).cast("double") for c in bins.numbers]


def _kinds(df: DataFrame, bins: Binning, label: str, fold: str | None, trees: int, seed: int) -> DataFrame:
    """bins (a byte for each column), fold, and for each tree n and y: rows in its bootstrap and the sum of their labels.

    A kind's rows meet in one partition, in order of their labels, and pass as a stream; a kind that two batches share
    gives two rows, which add up to the same.
    """
    shared = df.sparkSession.sparkContext.broadcast(bins)
    own = F.col(fold).cast("int") if fold else F.lit(-1)
    width = len(bins.edges)
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(_columns(bins))], own.alias("fold"), F.col(label).cast("double").alias("y")).filter("fold is not null and y is not null and not isnan(y)")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column("fold").to_numpy()
            found = shared.value.bins([b.column(i) for i in range(width)], np.full(len(fold), -1))
            yield pa.RecordBatch.from_arrays([_packed(found), b.column("fold"), b.column("y")], ["bins", "fold", "y"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for b in batches:
            if not len(b):
                continue
            kind, fold, y = (b.column(c).to_numpy() for c in ("kind", "fold", "y"))
            found = _unpacked(b.column("bins"))
            new = np.ones(len(b), bool)
            new[1:] = (fold[1:] != fold[:-1]) | (found[1:] != found[:-1]).any(1)
            starts = np.flatnonzero(new)
            place = np.arange(len(b)) - starts[np.cumsum(new) - 1]
            first = starts[1] if len(starts) > 1 else len(b)
            if last == (fold[0], found[0].tobytes()):
                place[:first] += before
            last, before = (fold[-1], found[-1].tobytes()), int(place[-1]) + 1
            held = bootstrap(kind, place, trees)
            n = np.add.reduceat(held, starts, 0, np.int32)
            s = np.add.reduceat(held * y[:, None], starts, 0)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(x.ravel(), trees).cast(pa.list_(pa.from_numpy_dtype(x.dtype)))
            yield pa.RecordBatch.from_arrays([_packed(found[starts]), pa.array(fold[starts]), lists(n), lists(s)], ["bins", "fold", "n", "y"])

    coded = rows.mapInArrow(code, "bins binary, fold int, y double").withColumn("kind", F.xxhash64("bins", "fold", F.lit(seed)))
    met = coded.repartition("kind").sortWithinPartitions("kind", "fold", "bins", "y")
    kinds = settled(met.mapInArrow(draw, "bins binary, fold int, n array<int>, y array<double>"))
    return kinds.coalesce(max(TASKS, 2 * kinds.sparkSession.sparkContext.defaultParallelism))  # each task has histograms of its own


def _packed(bins: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((np.arange(len(bins) + 1) * bins.shape[1]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, ends, pa.py_buffer(np.ascontiguousarray(bins))])


def _unpacked(packed: pa.Array) -> np.ndarray:
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(packed), -1)


def _histograms(kinds: DataFrame, grown: Trees, pairs: list[tuple[int, int, int]], level: int, drawn: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of labels by (tree, node of the level, drawn column, bin) of the pairs (model, tree of it, tree at all)."""
    nodes, some, first = 2**level, drawn.shape[2], 2**level - 1
    size = nodes * some * bins
    part = Trees(*(x[[at for *_, at in pairs]] for x in (grown.feature, grown.cut, grown.value)))
    shared = kinds.sparkSession.sparkContext.broadcast((part, drawn))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, drawn = shared.value
        n, s = np.zeros((len(pairs), size)), np.zeros((len(pairs), size))
        for b in batches:
            if not len(b):
                continue
            found, fold = _unpacked(b.column("bins")), b.column("fold").to_numpy()
            many, y = (b.column(c).flatten().to_numpy().reshape(len(b), -1) for c in ("n", "y"))
            for p, (m, t, _) in enumerate(pairs):
                here = np.flatnonzero((fold != m) & (many[:, t] > 0))
                own = found[here]
                node = part.reach(p, own, level) - first
                w, v = many[here, t], y[here, t]
                for j in range(some):
                    cell = (node * some + j) * bins + own[np.arange(len(own)), drawn[p, :, j].take(node)]
                    n[p] += np.bincount(cell, w, size)
                    s[p] += np.bincount(cell, v, size)
        pair, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pair * size + cell), pa.array(n[pair, cell]), pa.array(s[pair, cell])], ["cell", "n", "s"])

    found = kinds.mapInArrow(tally, "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    n, s = np.zeros(len(pairs) * size), np.zeros(len(pairs) * size)
    cell = found.column("cell").to_numpy()
    n[cell], s[cell] = found.column("n").to_numpy(), found.column("s").to_numpy()
    shared.unpersist()
    return n.reshape(len(pairs), nodes, some, bins), s.reshape(len(pairs), nodes, some, bins)


def best_splits(n: np.ndarray, s: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes' histograms (..., column, bin): place of the column, last bin of the left side, and the sides' means.

    The side holds -1 as the place where nothing gains or a side would have fewer rows than `leaf`.  Ties go to the first.
    """
    left_n, left_s = np.cumsum(n, -1)[..., :-1], np.cumsum(s, -1)[..., :-1]
    rows, total = n.sum(-1)[..., None], s.sum(-1)[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = total**2 / rows
        gain = left_s**2 / left_n + (total - left_s) ** 2 / (rows - left_n) - whole
        gain = np.where((left_n >= leaf) & (rows - left_n >= leaf) & (gain > 1e-12 * np.maximum(1.0, np.abs(whole))), gain, -np.inf)
        flat = gain.reshape(*gain.shape[:-2], -1)
        best = flat.argmax(-1)
        column, cut = np.divmod(best, gain.shape[-1])
        pick = lambda x: np.take_along_axis(np.broadcast_to(x, gain.shape).reshape(flat.shape), best[..., None], -1)[..., 0]
        left, right = pick(left_s) / pick(left_n), pick(total - left_s) / pick(rows - left_n)
    return np.where(np.isneginf(pick(gain)), -1, column), cut, left, right


def _grow(kinds: DataFrame, bins: Binning, models: int, trees: int, leaf: int, depth: int, seed: int) -> Trees:
    """The trees of all models, those of a model side by side."""
    width, most = len(bins.edges), max((len(e) + 1 for e in bins.edges), default=1)
    some = width if trees == 1 else math.ceil(width / 3)
    grown = Trees.empty(models * trees, depth)
    open_ = np.ones((models * trees, 1), bool)
    rng = np.random.default_rng(seed)
    every = [(m, t, m * trees + t) for m in range(models) for t in range(trees)]
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        drawn = rng.random((len(every), nodes, width)).argsort(-1)[..., :some]
        split = np.zeros((len(every), nodes, 2), bool)
        step = max(1, CELLS // (nodes * some * most))
        growing = [p for p in every if open_[p[2]].any()]
        for k in range(0, len(growing), step):
            pairs = growing[k : k + step]
            at = [p[2] for p in pairs]
            n, s = _histograms(kinds, grown, pairs, level, drawn[at], most)
            if level == 0:
                grown.value[at, 0] = s[:, 0, 0].sum(-1) / np.maximum(1, n[:, 0, 0].sum(-1))
            column, cut, left, right = best_splits(n, s, leaf)
            column = np.where(open_[at], column, -1)
            own = grown.value[at, first : first + nodes]
            gains = column >= 0
            grown.feature[at, first : first + nodes] = np.where(gains, np.take_along_axis(drawn[at], np.maximum(column, 0)[..., None], -1)[..., 0], 0)
            grown.cut[at, first : first + nodes] = np.where(gains, cut, LEAF)
            grown.value[at, 2 * first + 1 : 2 * (first + nodes) + 1 : 2] = np.where(gains, left, own)
            grown.value[at, 2 * first + 2 : 2 * (first + nodes) + 2 : 2] = np.where(gains, right, own)
            split[at] = gains[..., None]
        for p in set(range(len(every))) - {p[2] for p in growing}:  # leaves hand their value on
            grown.value[p, 2 * first + 1 : 2 * (first + nodes) + 1 : 2] = grown.value[p, first : first + nodes]
        open_ = split.reshape(len(every), -1)
    return grown


def _mean(df: DataFrame, label: str) -> float:
    found = df.agg(F.avg(F.when(~F.isnan(F.col(label).cast("double")), F.col(label).cast("double")))).first()[0]
    return found or 0.0


@dataclass
class Grown:
    """A fitted forest; transform() adds `prediction` to a table that has its columns."""

    binning: Binning
    trees: Trees

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", _predicted(df, self.binning, self.trees, None, 1))

    def errors(self, df: DataFrame, label: str, columns: list[str], key: str, slot: str, order) -> DataFrame:
        """column, deal, rss: the squared errors of the rows as they are (-1, 0), and with the values of each column dealt anew.

        A deal stays among the rows of one slot; order(key of the first row, rows) gives the deals' orders of its rows by key.
        Rows pass as cells, and all their deals are scored where they are: what a slot returns is a row for each.
        """
        width, names = len(self.binning.edges), [*self.binning.categories, *self.binning.numbers]
        shared = df.sparkSession.sparkContext.broadcast((self.binning, Cells.of(self.trees, width)))
        places = [names.index(c) if c in names else None for c in columns]
        rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(_columns(self.binning))], F.col(label).cast("double").alias("y"), F.col(key).alias("key"), F.col(slot).alias("slot"))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            binning, cells = shared.value
            for b in batches:
                found = cells.cells(binning.bins([b.column(i) for i in range(width)], np.full(len(b), -1)))
                yield pa.RecordBatch.from_arrays([_packed(found), *(b.column(c) for c in ("y", "key", "slot"))], ["cells", "y", "key", "slot"])

        def score(held: pa.Table) -> pa.Table:
            _, cells = shared.value
            held = held.sort_by("key")
            known = np.asarray(held.column("y").is_valid())
            own, y = _unpacked(held.column("cells").combine_chunks()), held.column("y").to_numpy()[known]
            rss = lambda p: float(((y - p[known]) ** 2).sum())
            plain = rss(cells.dealt(own))
            out = [(-1, 0, plain)]
            for k, some in enumerate(order(held.column("key")[0].as_py(), len(held))):
                out += [(i, k, plain if at is None else rss(cells.dealt(own, at, some))) for i, at in enumerate(places)]
            column, deal, lost = zip(*out, strict=True)
            return pa.table({"column": pa.array(column, pa.int32()), "deal": pa.array(deal, pa.int32()), "rss": pa.array(lost, pa.float64())})

        coded = rows.mapInArrow(code, "cells binary, y double, key long, slot long")
        return coded.groupBy("slot").applyInArrow(score, "column int, deal int, rss double").groupBy("column", "deal").agg(F.sum("rss").alias("rss"))

    def save(self, spark, path: str) -> None:
        """One line of JSON in the folder."""
        b, t = self.binning, self.trees
        held = {"categories": b.categories, "numbers": b.numbers, "edges": [e.tolist() for e in b.edges], "feature": t.feature.tolist(), "cut": t.cut.tolist(), "value": t.value.tolist()}
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> Grown:
        held = json.loads(spark.read.text(path).first()[0])
        seen = {c: np.ones((2, len(names)), bool) for c, names in held["categories"].items()}
        bins = Binning(held["categories"], seen, held["numbers"], [np.array(e, float) for e in held["edges"]])
        return cls(bins, Trees(np.array(held["feature"], np.int64), np.array(held["cut"], np.uint8), np.array(held["value"], float)))


def _predicted(df: DataFrame, bins: Binning, grown: Trees, fold: str | None, models: int):
    """The mean of the trees that have not seen a row's fold, of all trees without folds."""
    shared = df.sparkSession.sparkContext.broadcast((bins, grown))
    trees, folded = len(grown.value) // models, fold is not None

    @F.arrow_udf("double")
    def predicted(own: pa.Array, *columns: pa.Array) -> pa.Array:
        bins, grown = shared.value
        fold = own.to_numpy()
        found = bins.bins(list(columns), fold)
        out = np.zeros(len(fold))
        for m in range(models):
            here = np.flatnonzero(fold == m) if folded else np.arange(len(fold))
            out[here] = grown.predict(found[here], range(m * trees, (m + 1) * trees))
        return pa.array(out)

    return predicted(F.col(fold).cast("int") if fold else F.lit(-1), *_columns(bins))


def fit(df: DataFrame, categories: list[str], numbers: list[str], label: str, trees: int = 150, leaf: int = 3, depth: int = 12, seed: int = 42, bins: int = 64) -> Grown:
    """A forest of all rows with a label.  A table without rows gives one that predicts 0."""
    binned = binning(df, categories, numbers, None, 1, bins)
    return Grown(binned, _grow(_kinds(df, binned, label, None, trees, seed), binned, 1, trees, leaf, depth, seed))


def out_of_fold(df: DataFrame, categories: list[str], numbers: list[str], label: str, fold: str, folds: int, trees: int = 150, leaf: int = 3, depth: int = 12, seed: int = 42, bins: int = 64) -> DataFrame:
    """The rows of the folds with `predicted` by the forest that has not seen the row's fold."""
    binned = binning(df, categories, numbers, fold, folds, bins)
    grown = _grow(_kinds(df, binned, label, fold, trees, seed), binned, folds, trees, leaf, depth, seed)
    return df.filter(F.col(fold).between(0, folds - 1)).withColumn("predicted", _predicted(df, binned, grown, fold, folds))
