"""Serving: scenarios, contexts, stages, messages, coverage and study statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import sampling, serving
from siltstone.plans import analysis, rasters
from siltstone.plans.base import Plans
from siltstone.sources.files import table

plans = Plans()


@plans.add("""select o_orderkey, trim(o_clerk || ' F effect on ' || ind || coalesce(' ' || syn, '') || ' Ethiopia' || case when rain <> 0 then ' ' || cast(round_even(rain, 0) as bigint) || ' mm annual rainfall' else '' end || ' ' || cast(round_even(slope, 0) as bigint) || '% slope') as q
  from (select o_orderkey, o_orderpriority as o_clerk, case o_orderstatus when 'O' then 'soil loss' when 'F' then 'yield' else 'SOM content' end as ind,
    case o_orderstatus when 'O' then 'soil erosion' when 'P' then 'soil organic matter' end as syn, case when o_orderkey % 7 = 0 then 0 else (o_orderkey % 97) * 10 + 0.5 end as rain, (o_orderkey % 31) + 0.5 as slope from orders)""")
def query_texts(spark, d):
    """Retrieval queries composed of a recommendation's parts."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    indicator = F.when(status == "O", "soil loss").when(status == "F", "yield").otherwise("SOM content")
    rain = F.when(key % 7 == 0, 0.0).otherwise((key % 97) * 10 + 0.5)
    text = serving.query_text(F.col("o_orderpriority"), F.lit("F"), indicator, F.lit(""), F.lit(None).cast("string"), rain, (key % 31) + 0.5)
    return table(spark, d, "orders").select("o_orderkey", text.alias("q"))


@plans.add("""select c_custkey, case when c_acctbal < 0 then 'location' when c_custkey % 5 = 0 or c_custkey % 3 = 0 then 'challenge' when c_custkey % 2 = 0 then 'objective' else 'complete' end as stage from customer""")
def setup_stage(spark, d):
    key = F.col("c_custkey")
    at = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    found = serving.stage(at, at, F.when(key % 3 != 0, F.col("c_mktsegment")), F.when(key % 2 != 0, F.col("c_name")), key % 5 == 0)
    return table(spark, d, "customer").select("c_custkey", found.alias("stage"))


@plans.add("""select s_suppkey, s_suppkey % 4 = 1 or s_suppkey % 6 = 2 as changed from supplier""")
def slots_changed(spark, d):
    key = F.col("s_suppkey")
    new = {"family": F.when(key % 4 == 1, "b").when(key % 4 == 2, "a"), "crop": F.lit("")}
    lat = F.when(key % 6 == 2, F.lit(9.001)).when(key % 6 == 3, F.lit(9.00005))
    found = serving.slots_changed(new, {"family": F.lit("a"), "crop": F.lit("teff")}, (lat, F.lit(38.0)), (F.lit(9.0), F.lit(38.0)))
    return table(spark, d, "supplier").select("s_suppkey", found.alias("changed"))


@plans.add("""select c_custkey, case when m = '' then null else case when k = '' then '' else 'I understood ' || k || '. ' end || 'Please share ' || m || '.' end as message from (select c_custkey,
  array_to_string(list_filter([case when c_custkey % 2 = 0 then 'challenge Crop production' end, case when c_custkey % 3 = 0 then 'objective yield' end], lambda x: x is not null), ', ') as k,
  array_to_string(list_filter([case when c_custkey % 2 <> 0 then 'your challenge' end, case when c_custkey % 3 <> 0 then 'your objective' end, case when c_acctbal < 0 then 'your location' end], lambda x: x is not null), '; ') as m from customer)""")
def clarifications(spark, d):
    """What to ask a user for."""
    key = F.col("c_custkey")
    asks = {"challenge": "your challenge", "objective": "your objective", "location": "your location"}
    text = serving.clarification(F.when(key % 2 == 0, "Crop production and management"), F.when(key % 3 == 0, "yield"), F.col("c_acctbal") >= 0, asks)
    return table(spark, d, "customer").select("c_custkey", text.alias("message"))


@plans.add("select kind, count(*) as n from (select case event_type when 'error' then 'limit' when 'click' then 'location' when 'view' then 'unsupported' else 'general' end as kind from events) group by 1")
def error_kinds(spark, d):
    kind = F.col("event_type")
    message = F.when(kind == "error", "HTTP 429").when(kind == "click", "Point is Outside of Ethiopia").when(kind == "view", "pair not supported").otherwise("?")
    return table(spark, d, "events").select(serving.error_kind(message).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@plans.add("""select tier, count(*) as n, count(*) filter (where retry) as n_retry from (select case when doc_id % 5 = 0 then 'pdf' when doc_id % 3 = 0 then 'xml' when doc_id % 2 = 0 then 'abstract' else 'metadata' end as tier,
  doc_id % 7 <> 0 and not ((doc_id % 5 = 0 or doc_id % 3 = 0) and doc_id % 2 = 0) as retry from documents) group by 1""")
def corpus_coverage(spark, d):
    """The best text that each study has, and those to fetch again."""
    key = F.col("doc_id")
    pdf, xml, abstract = key % 5 == 0, key % 3 == 0, key % 2 == 0
    rows = table(spark, d, "documents").select("doc_id")
    retry = serving.needs_retry(key % 7 != 0, pdf, xml, abstract)
    tiers = serving.coverage(rows, pdf, xml, abstract)
    again = serving.coverage(rows.filter(retry), pdf, xml, abstract).withColumnRenamed("n", "n_retry")
    return tiers.join(again, "tier", "left").fillna({"n_retry": 0})


@plans.add("select user_id, arg_min(value, event_id) as value from events where event_type <> 'error' group by 1")
def first_success(spark, d):
    """The first of a chain of sources that delivered."""
    tried = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return serving.first_success(tried, "user_id", "event_id", "ok", "value")


@plans.add(rasters.plans.sql["sample_or_nearest"].replace("point_id, best.value from", "point_id, round_even(best.value, 3) as price, k.cls as class from").replace(
    "left join best using (point_id)", "left join best using (point_id) left join (select p.point_id, (select c.class from cells c where abs(c.row - p.row) <= 8 and abs(c.col - p.col) <= 8 order by (c.row - p.row) * (c.row - p.row) + (c.col - p.col) * (c.col - p.col), c.row, c.col limit 1) as cls from points p) k using (point_id)"))
def point_contexts(spark, d):
    """Every layer's value at each point, from the nearest valid cell where its own has none."""
    cells = rasters.cells(spark, d)
    layers = {"price": cells.select("row", "col", "value"), "class": cells.select("row", "col", F.col("class").alias("value"))}
    return serving.contexts(rasters.points(spark, d), layers, 8)


#: Eleven layers over the orders as cells, each valid where its number divides; the last ones have a value in few cells.
_LAYERS, _REACH = {f"layer{i}": 1 + 3 * i * i for i in range(11)}, 120


def layer_cells(spark, d) -> dict[str, DataFrame]:
    rows = table(spark, d, "orders").select(F.expr("o_orderkey div 500").alias("row"), (F.col("o_orderkey") % 500).alias("col"), "o_totalprice", "o_custkey")
    return {n: rows.filter(F.col("o_custkey") % k == 0).select("row", "col", (F.col("o_totalprice") * (i + 1)).alias("value")) for i, (n, k) in enumerate(_LAYERS.items())}


@plans.add(f"""with p as (select s_suppkey, s_suppkey * 13 % (select max(o_orderkey) // 500 from orders) as row, s_suppkey * 37 % 500 as col from supplier),
c as (select o_orderkey // 500 as row, o_orderkey % 500 as col, o_totalprice as v, o_custkey as k from orders)
select s_suppkey, {', '.join(f"round_even(cast((arg_min(v, ((c.row - p.row) * (c.row - p.row) + (c.col - p.col) * (c.col - p.col)) * 1000000000000 + c.row * 1000 + c.col) filter (k % {k} = 0)) * {i + 1} as double), 3) as {n}" for i, (n, k) in enumerate(_LAYERS.items()))}
from p left join c on abs(c.row - p.row) <= {_REACH} and abs(c.col - p.col) <= {_REACH} group by 1""")
def layer_contexts(spark, d):
    """Suppliers as points in eleven layers at once, each from the nearest valid cell within 120."""
    cells = layer_cells(spark, d)
    last = table(spark, d, "orders").agg(F.expr("max(o_orderkey) div 500").alias("last"))
    points = table(spark, d, "supplier").join(F.broadcast(last), F.lit(True)).select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") * 13 % F.col("last")).alias("row"), (F.col("s_suppkey") * 37 % 500).alias("col"))
    return serving.contexts(points, cells, _REACH, whole=()).withColumnRenamed("point_id", "s_suppkey")


@plans.add(f"with {analysis._OBSERVED} select family, string_agg(distinct practice, ',' order by practice) as practices, string_agg(distinct indicator, ',' order by indicator) as indicators from observed group by 1")
def metadata(spark, d):
    found = serving.metadata(analysis.observed(spark, d), "family", "practice", "indicator")
    return found.select("family", F.array_join("practices", ",").alias("practices"), F.array_join("indicators", ",").alias("indicators"))


@plans.add("""with p as (select doc_id, lang, source, row_number() over (partition by lang, source order by md5('42' || cast(doc_id as varchar)), doc_id) as k from documents where doc_id in (select doc_id from labels)),
s as (select * from p where k <= 2) select 'S' || lpad(cast(row_number() over (order by lang, source, k) as varchar), 3, '0') as scenario_id, doc_id, lang, source from s""")
def scenarios(spark, d):
    """Evaluation scenarios: a quota of labelled documents from each cell, numbered in order."""
    from pyspark.sql import Window

    held = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    picks = sampling.quota(held, ["lang", "source"], "doc_id", 2, "42")
    place = F.row_number().over(Window.orderBy("lang", "source", "pick"))
    return picks.select(F.concat(F.lit("S"), F.lpad(place.cast("string"), 3, "0")).alias("scenario_id"), "doc_id", "lang", "source")


@plans.add("""with d as (select l_quantity - l_tax * 500 as d from lineitem), nz as (select d, abs(d) as a, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from d where d <> 0),
t as (select sum(c * c * c - c) as ties from (select cast(count(*) as double) as c from nz group by a)),
s as (select cast(count(*) as double) as m, coalesce(sum(r) filter (where d > 0), 0) as w_plus, coalesce(sum(r) filter (where d < 0), 0) as w_minus from nz)
select (select count(*) from d) as n, (select round(median(d), 6) from d) as median_difference, w_plus, w_minus,
  round((w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 6) as z, round((w_plus - w_minus) / (w_plus + w_minus), 6) as effect from s, t""")
def signed_ranks(spark, d):
    """Signed-rank statistics of paired scores."""
    pairs = table(spark, d, "lineitem").select("l_quantity", (F.col("l_tax") * 500).alias("other"))
    found = serving.signed_ranks(pairs, "l_quantity", "other")
    return found.withColumns({c: F.round(c, 6) for c in ("median_difference", "z", "effect")})


@plans.add("""with c as (select l_orderkey as item, l_returnflag as v, count(*) as c from lineitem group by 1, 2), m as (select item, sum(c) as m from c group by 1 having sum(c) > 1), h as (select * from c join m using (item)),
t as (select v, sum(c) as t from h group by 1), n as (select sum(c) as n, sum(c * (m - c) / (m - 1)) as d from h) select round(1 - (any_value(n) - 1) * any_value(d) / sum(t * (n - t)), 6) as alpha from t, n""")
def agreement(spark, d):
    """Agreement of ratings over items."""
    return serving.nominal_alpha(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@plans.add("""with r as (select l_orderkey as item, cast(floor(l_quantity / 10) as int) as v from lineitem), c as (select item, v, count(*) as c from r group by 1, 2),
m as (select item, sum(c) as m from c group by 1 having sum(c) > 1), h as (select * from c join m using (item)), t as (select v, cast(sum(c) as double) as t from h group by 1),
d as (select a.v as x, b.v as y, any_value(a.t) as tx, any_value(b.t) as ty, power(sum(g.t) - (any_value(a.t) + any_value(b.t)) / 2, 2) as d2 from t a join t b on a.v < b.v join t g on g.v between a.v and b.v group by 1, 2),
o as (select sum(a.c * b.c * d2 / (a.m - 1)) as o from h a join h b on a.item = b.item and a.v < b.v join d on d.x = a.v and d.y = b.v)
select round(1 - ((select sum(t) from t) - 1) * (select o from o) / sum(tx * ty * d2), 6) as alpha from d""")
def ordinal_agreement(spark, d):
    """Agreement of ordered ratings over items."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 10).cast("int").alias("v"))
    return serving.ordinal_alpha(rows, "l_orderkey", "v")
