"""Requests at points, answered from rasters and evidence by a model."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import advice as operator
from siltstone.operators import models
from siltstone.operators.crossval import hash_fold, sums
from siltstone.plans.analysis import SIGNS
from siltstone.plans.base import Plans
from siltstone.session import written
from siltstone.sources.files import table

plans = Plans()

#: The grid of the requests, how far a valid cell may be, the belts, and which orders each layer has values of.
_LEFT, _TOP, _RES, _REACH = 30.0, 15.0, 0.25, 40
_BELTS = [(1, "dry"), (2, "moist"), (3, "wet"), (4, "frost")]
_LAYERS = {"rain": ("o_custkey % 4 = 0", "o_totalprice * 2"), "slope": ("o_custkey % 49 = 0", "o_totalprice / 1000"), "aez_belt": ("o_custkey % 7 = 0 and o_custkey % 5 <> 0", "o_custkey % 5")}
_CROPS = [None, "RED", "nothing", "Blue"]
_PREDICTED = "cast(substring(practice, 7) as double) * 0.013 - coalesce(rain, 0) * 0.0000001 + length(crop_group) * 0.01 + coalesce(length(aez_belt), 0) * 0.001 - length(crop) * 0.0001"

_SQL = f"""with rows as (select r_name as family, p_brand as practice, l_returnflag as indicator, split_part(p_name, ' ', 1) as crop, p_type as crop_group, l_orderkey * 10 + l_linenumber as place
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
p as (select s_suppkey as request, r_name as family, ['A', 'N', 'R'][s_suppkey % 3 + 1] as indicator, [null, 'RED', 'nothing', 'Blue'][s_suppkey % 4 + 1] as crop,
  s_suppkey * 13 % (select max(o_orderkey) // 500 from orders) as row, s_suppkey * 37 % 500 as col from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
c as (select o_orderkey // 500 as row, o_orderkey % 500 as col, * from orders),
x as (select request, {', '.join(f"arg_min({v}, ((c.row - p.row) * (c.row - p.row) + (c.col - p.col) * (c.col - p.col)) * 1000000000000 + c.row * 1000 + c.col) filter ({ok}) as {n}0" for n, (ok, v) in _LAYERS.items())}
  from p left join c on abs(c.row - p.row) <= {_REACH} and abs(c.col - p.col) <= {_REACH} group by 1),
ctx as (select request, round_even(rain0, 3) as rain, round_even(slope0, 3) as slope, case cast(aez_belt0 as int) {' '.join(f"when {k} then '{v}'" for k, v in _BELTS)} end as aez_belt from x),
first as (select lower(crop) as k, arg_min(crop_group, place) as asked_group from rows group by 1),
n as (select family, practice, indicator, count(*) as n from rows group by 1, 2, 3),
own as (select family, practice, indicator, crop_group from (select *, row_number() over (partition by family, practice, indicator order by n desc, crop_group) as k from (select family, practice, indicator, crop_group, count(*) as n from rows group by all)) where k = 1),
wide as (select family, crop_group from (select *, row_number() over (partition by family order by n desc, crop_group) as k from (select family, crop_group, count(*) as n from rows group by all)) where k = 1),
f as (select request, p.family, q.practice, p.indicator, coalesce(p.crop, 'Unspecified') as crop, p.crop is null as bare, asked_group, coalesce(asked_group, own.crop_group, wide.crop_group) as crop_group, coalesce(n.n, 0) as n_evidence, rain, slope, aez_belt
  from p join (select distinct family, practice from rows) q using (family) left join first on first.k = lower(p.crop) left join n on n.family = p.family and n.practice = q.practice and n.indicator = p.indicator
  left join own on own.family = p.family and own.practice = q.practice and own.indicator = p.indicator join wide on wide.family = p.family join ctx using (request)),
s as (select *, {_PREDICTED} as mean, case indicator when 'R' then -1 else 1 end as direction from f),
r as (select *, row_number() over (partition by request order by direction * round_even(mean, 4) desc, practice) as rank from s where n_evidence > 0),
m as (select request, count(*) as n_candidates from s group by 1)
select request, family, indicator, any_value(case when bare then null else crop end) as crop, any_value(asked_group) as crop_group, any_value(rain) as rain, any_value(slope) as slope, any_value(aez_belt) as aez_belt,
  case when any_value(direction) > 0 then 'increase' else 'reduce' end as goal_direction, case indicator when 'A' then 'high' when 'R' then 'medium' else 'low' end as confidence, any_value(n_candidates) as n_candidates, count(*) as n_grounded,
  'Practices ranked within ''' || family || ''' (' || any_value(n_candidates) || ' known, ' || count(*) || ' with evidence for ''' || indicator || ''').' as ranking_scope,
  string_agg(practice || ': ~' || cast(cast(round_even(abs(round_even((exp(mean) - 1) * 100, 1)), 0) as bigint) as varchar) || '% ' || case when direction > 0 then 'increase' else 'reduce' end || ' in ' || indicator, '; ' order by rank) filter (where rank <= 3) as top
from r join m using (request) group by request, family, indicator"""


def _rows(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_places(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    return line.select(
        "family", F.col("p_brand").alias("practice"), F.col("l_returnflag").alias("indicator"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("crop"), F.col("p_type").alias("crop_group"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
        F.col("l_suppkey").alias("study"), F.log(F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))).alias("effect"),
    )


def _places(spark, d) -> DataFrame:
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return place.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("family"))


def _requests(spark, d) -> DataFrame:
    last = table(spark, d, "orders").agg(F.expr("max(o_orderkey) div 500").alias("last"))
    key = F.col("s_suppkey")
    row, col = key * 13 % F.col("last"), key * 37 % 500
    kind = F.element_at(F.array(*map(F.lit, "ANR")), (key % 3 + 1).cast("int"))
    crop = F.element_at(F.array(*map(F.lit, _CROPS)), (key % 4 + 1).cast("int"))
    lat, lon = _TOP - _RES * (row + 0.5), _LEFT + _RES * (col + 0.5)
    return _places(spark, d).join(F.broadcast(last), F.lit(True)).select(key.alias("request"), lat.alias("lat"), lon.alias("lon"), "family", kind.alias("indicator"), crop.alias("crop"))


def _advise(spark, d, rows: DataFrame, model, confidence: DataFrame, many: str | None = None) -> DataFrame:
    cells = table(spark, d, "orders").withColumns({"row": F.expr("o_orderkey div 500"), "col": F.col("o_orderkey") % 500})
    layers = {n: cells.filter(ok).select("row", "col", F.expr(v).cast("double").alias("value")) for n, (ok, v) in _LAYERS.items()}
    belts = spark.createDataFrame(_BELTS, "code int, name string")
    found = operator.advise(_requests(spark, d), rows, layers, model, confidence, SIGNS, _REACH, belts, whole=(), left=_LEFT, upper=_TOP, res=_RES, many=many)
    lines = F.transform("recommendations", lambda x: F.concat(x["practice"], F.lit(": "), x["effect"]))
    context = [F.col(f"details.context.{n}").alias(n) for n in _LAYERS]
    return found.select("request", "query.family", "query.indicator", "query.crop", "details.crop_group", *context, "query.goal_direction", "details.confidence", "details.n_candidates", "details.n_grounded", "details.ranking_scope", F.array_join(lines, "; ").alias("top"))


@plans.add(_SQL)
def point_advice(spark, d):
    """From points to answers, by a model that is a formula here, so that SQL can follow it."""
    model = SQLTransformer(statement=f"select *, {_PREDICTED} as prediction from __THIS__")
    return _advise(spark, d, _rows(spark, d), model, spark.createDataFrame([("A", "high"), ("R", "medium")], "indicator string, confidence string"))


@plans.add()
def fitted_advice(spark, d):
    """The same by histogram boosting over categories, fitted on all rows, with the confidence of its out-of-fold R2.

    Only counts, first places and sums of effects by categories and fold count, so the rows are joined and put together once.
    """
    kinds, settings = ["family", "practice", "indicator", "crop", "crop_group"], models.boosting(rounds=5, step=0.3, depth=3)
    rows = _rows(spark, d).withColumn("fold", hash_fold(F.col("study"), 3))
    rows = written(rows.groupBy(*kinds, "fold").agg(F.count(F.lit(1)).alias("lines"), F.min("place").alias("place"), *sums("effect")))
    model, figures = models.select_and_refit(rows.filter("n > 0"), {"boosting": settings}, kinds, [], "effect", "fold", 3, "indicator", summed=True)
    return _advise(spark, d, rows, model, figures.filter("scope <> 'all'").select(F.col("scope").alias("indicator"), "confidence"), "lines")
