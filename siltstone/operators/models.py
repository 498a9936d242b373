"""Tree models over encoded rows: out-of-fold prediction, selection by R2, permutation importance."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.numbers import confidence
from siltstone.operators import boosting as trees
from siltstone.operators import forests
from siltstone.operators.crossval import metrics, summed_metrics
from siltstone.session import settled

#: Rows among which the values of a column are dealt anew.
SLOT = 8192


@dataclass(frozen=True)
class Forest:
    """The settings of a random forest; see siltstone.operators.forests."""

    trees: int = 150
    leaf: int = 3
    depth: int = 12
    seed: int = 42
    bins: int = 64


forest = Forest


@dataclass(frozen=True)
class Boosting:
    """The settings of histogram boosting; see siltstone.operators.boosting."""

    rounds: int = 400
    step: float = 0.06
    l2: float = 1.0
    least: int = 20
    depth: int = 5
    bins: int = trees.MISSING


boosting = Boosting


class Codes(Estimator):
    """Adds <column>_code: the place of a category among the training rows' in order of name, -1 for any other and for null.

    The categories become a literal of the fitted stage, so their number is to stay in the thousands.
    """

    def __init__(self, columns: list[str]) -> None:
        super().__init__()
        self.columns = columns

    def _fit(self, df: DataFrame) -> SQLTransformer:
        seen = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in self.columns]).first()
        quoted = lambda c: json.dumps(seen[c]).replace("\\", "\\\\").replace("'", "\\'")
        code = lambda c: f"cast(coalesce(array_position(from_json('{quoted(c)}', 'array<string>'), cast(`{c}` as string)) - 1, -1) as double) as `{c}_code`"
        return SQLTransformer(statement=f"select *, {', '.join(map(code, self.columns))} from __THIS__")


@dataclass(frozen=True)
class Stages:
    """A regressor of siltstone with its columns; fit() gives a model with transform(), as a pipeline's does."""

    regressor: Forest | Boosting
    categories: list[str]
    numbers: list[str]
    label: str

    def fit(self, df: DataFrame):
        return fit(df, self.regressor, self.categories, self.numbers, self.label)


def pipeline(regressor, categories: list[str], numbers: list[str], label: str) -> Pipeline | Stages:
    """Categories by their codes, -1 where training rows have them not, assembled and regressed."""
    if isinstance(regressor, (Forest, Boosting)):
        return Stages(regressor, categories, numbers, label)
    codes = [f"{c}_code" for c in categories]
    return Pipeline(stages=[*([Codes(categories)] if categories else []), VectorAssembler(inputCols=[*codes, *numbers], outputCol="features", handleInvalid="keep"), regressor.copy({regressor.labelCol: label})])


def out_of_fold(df: DataFrame, fold: str, folds: int, stages: Pipeline | Stages) -> DataFrame:
    """Rows with the prediction of the model that has not seen their fold."""
    if isinstance(stages, Stages):
        return held_out(df, stages.regressor, stages.categories, stages.numbers, stages.label, fold, folds)
    parts = [stages.fit(df.filter(F.col(fold) != k)).transform(df.filter(F.col(fold) == k)).select(*df.columns, F.col("prediction").alias("predicted")) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def fit(df: DataFrame, regressor, categories: list[str], numbers: list[str], label: str, many: str | None = None):
    """A fitted model with transform(), of any kind; many: the column of how many rows a row stands for, for boosting only."""
    if isinstance(regressor, Boosting):
        return trees.fit(df, categories, numbers, label, **asdict(regressor), many=many)
    if many:
        raise ValueError("only boosting takes rows that stand for many")
    if isinstance(regressor, Forest):
        return forests.fit(df, categories, numbers, label, **asdict(regressor))
    return pipeline(regressor, categories, numbers, label).fit(df)


def held_out(df: DataFrame, regressor, categories: list[str], numbers: list[str], label: str, fold: str, folds: int, many: str | None = None) -> DataFrame:
    """Rows with `predicted` by a model of any kind that has not seen their fold; many: as in fit()."""
    if isinstance(regressor, Boosting):
        return trees.out_of_fold(df, categories, numbers, label, fold, folds, df.columns, **asdict(regressor), many=many).select(*df.columns, "predicted")
    if many:
        raise ValueError("only boosting takes rows that stand for many")
    if isinstance(regressor, Forest):
        return forests.out_of_fold(df, categories, numbers, label, fold, folds, **asdict(regressor))
    return out_of_fold(df, fold, folds, pipeline(regressor, categories, numbers, label))


def select_and_refit(df: DataFrame, regressors: dict, categories: list[str], numbers: list[str], label: str, fold: str, folds: int, by: str, summed: bool = False):
    """The regressor of highest out-of-fold R2, fitted on all rows, and its figures.

    Returns (fitted model, figures): figures has scope ("all" or a value of `by`), model, n, r2, rmse, confidence.
    summed: rows of equal categories, numbers, fold and `by` are put together already, by crossval.sums().
    """
    many, figure = ("n", summed_metrics) if summed else (None, metrics)
    held = {name: settled(held_out(df, r, categories, numbers, label, fold, folds, many)) for name, r in regressors.items()}
    name = best_by_r2(held, label, figure).first()["model"]
    whole = held[name].agg(*figure(label, "predicted")).withColumn("scope", F.lit("all"))
    parts = held[name].groupBy(F.col(by).cast("string").alias("scope")).agg(*figure(label, "predicted"))
    figures = whole.unionByName(parts).select("scope", F.lit(name).alias("model"), "n", "r2", "rmse", confidence(F.col("r2")).alias("confidence"))
    return fit(df, regressors[name], categories, numbers, label, many), figures


def save(model, figures: DataFrame, path: str) -> None:
    """A fitted model and its figures under one folder."""
    if isinstance(model, (trees.Boosted, forests.Grown)):
        model.save(figures.sparkSession, f"{path}/{'boosted' if isinstance(model, trees.Boosted) else 'forest'}")
    else:
        model.write().overwrite().save(f"{path}/model")
    figures.coalesce(1).write.mode("overwrite").json(f"{path}/figures")


def load(spark, path: str):
    """The fitted model and its figures that save() wrote."""
    schema = "scope string, model string, n long, r2 double, rmse double, confidence string"
    figures = spark.read.schema(schema).json(f"{path}/figures")
    for name, kind in (("boosted", trees.Boosted), ("forest", forests.Grown)):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return kind.load(spark, f"{path}/{name}"), figures
    return PipelineModel.load(f"{path}/model"), figures


def best_by_r2(scores: dict[str, DataFrame], label: str, figure=metrics) -> DataFrame:
    """model, n, r2, rmse of the model with the highest R2."""
    rows = [df.agg(*figure(label, "predicted")).withColumn("model", F.lit(m)) for m, df in scores.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("r2"), "model").limit(1)


def permutation_importance(model, df: DataFrame, columns: list[str], label: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """column, importance: the R2 lost, on average, when a column's values are dealt anew.

    Rows are dealt by hash to slots of about SLOT rows, a single one for a small table, and each deal stays in a slot, so
    no task holds more.  All deals of all columns are scored in one pass; what comes back is a row for each.  A forest of
    siltstone.operators.forests scores its deals where the rows are, and reads df twice; for any other model they are rows of
    their own.
    """
    names, place = df.columns, {c: i for i, c in enumerate(columns)}
    forest = isinstance(model, forests.Grown) and label not in place
    rows = (df if forest else settled(df)).withColumn("_row", F.xxhash64(*[F.col(c) for c in names]))
    n, tss = rows.agg(F.count(F.lit(1)), F.var_pop(label) * F.count(label)).first()
    slots = n // SLOT + 1
    spread = rows.withColumn("_slot", F.pmod(F.xxhash64("_row", F.lit(f"{seed}:slot")), F.lit(slots)))

    def orders(first: int, some: int):
        rng = np.random.default_rng([seed, first & 0xFFFFFFFF])
        return (rng.permutation(some) for _ in range(repeats))

    def deal(held: pa.Table) -> pa.Table:
        held = held.sort_by("_row")
        some = held.select(names)
        mark = lambda t, c, k: t.append_column("_column", pa.array(np.full(len(t), c, np.int32))).append_column("_deal", pa.array(np.full(len(t), k, np.int32)))
        out = [mark(some, -1, 0)]
        for k, order in enumerate(orders(held.column("_row")[0].as_py(), len(some))):
            for c, i in place.items():
                out.append(mark(some.set_column(names.index(c), c, some.column(c).take(order)), i, k))
        return pa.concat_tables(out)

    if forest:
        found = model.errors(spread, label, columns, "_row", "_slot", orders)
        found = found.select("column", "deal", F.round(1 - F.col("rss") / F.nullif(F.lit(tss).cast("double"), F.lit(0.0)), 6).alias("r2"))
    else:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        dealt = spread.groupBy("_slot").applyInArrow(deal, f"{kinds}, _column int, _deal int")
        found = model.transform(dealt).groupBy(F.col("_column").alias("column"), F.col("_deal").alias("deal")).agg(*metrics(label, "prediction"))
    r2 = {(r["column"], r["deal"]): r["r2"] for r in found.collect()}
    lost = [(c, float(sum(r2[-1, 0] - r2[i, k] for k in range(repeats)) / repeats)) for c, i in place.items()]
    return df.sparkSession.createDataFrame(lost, "column string, importance double").orderBy(F.desc("importance"))
