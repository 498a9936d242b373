"""Grid operators over a raster that the part table stands for: size as row, brand number as column, some cells empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import climate
from siltstone.operators import grid
from siltstone.plans.base import Plans
from siltstone.sources.files import table

plans = Plans()

_CELLS = """cells as (select p_size as row, cast(substr(p_brand, 7) as bigint) as col,
  case when min(p_partkey) % 3 = 0 then null else round(avg(p_retailprice), 6) end as value, min(p_partkey) % 5 as class from part group by 1, 2)"""
_POINTS = "points as (select c_custkey as point_id, c_custkey % 60 as row, (c_custkey * 7) % 30 as col from customer)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_size").cast("long").alias("row"), F.substring("p_brand", 7, 9).cast("long").alias("col"), "p_partkey", "p_retailprice")
    found = part.groupBy("row", "col").agg(F.min("p_partkey").alias("k"), F.round(F.avg("p_retailprice"), 6).alias("v"))
    return found.select("row", "col", F.when(F.col("k") % 3 != 0, F.col("v")).alias("value"), (F.col("k") % 5).alias("class"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 60).alias("row"), (F.col("c_custkey") * 7 % 30).alias("col"))


@plans.add(f"with {_CELLS}, {_POINTS} select point_id, row, col, value from points left join cells using (row, col)")
def point_cell_sample(spark, d):
    return grid.sample(points(spark, d), cells(spark, d).select("row", "col", "value"))


def _nearest_sql(radius: int) -> str:
    return f"""with {_CELLS}, {_POINTS}, met as (select point_id, value, (c.row - p.row) * (c.row - p.row) + (c.col - p.col) * (c.col - p.col) as d2, c.row, c.col
  from points p join cells c on abs(c.row - p.row) <= {radius} and abs(c.col - p.col) <= {radius} where value is not null),
best as (select * from (select *, row_number() over (partition by point_id order by d2, row, col) as k from met) where k = 1)
select point_id, best.value, best.d2 from points left join best using (point_id)"""


@plans.add(_nearest_sql(4))
def nearest_valid(spark, d):
    return grid.nearest_valid(points(spark, d), cells(spark, d), 4)


@plans.add(_nearest_sql(8).replace("select point_id, best.value, best.d2 from points", "select point_id, best.value from points"))
def sample_or_nearest(spark, d):
    """A point's own cell, or the nearest valid one in reach."""
    return grid.sample_or_nearest(points(spark, d), cells(spark, d), 8)


@plans.add("""select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def zonal_remap(spark, d):
    """Codes to attributes through two small lookups."""
    zones = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("code"), "n_name", "r_name")
    return grid.remap(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("code")), "code", zones).select("s_suppkey", "n_name", "r_name")


@plans.add("select n_nationkey, cast(round(cast((min(c_acctbal) + max(c_acctbal)) / 2 as decimal(18, 4)), 2) as double) as midpoint, split_part(n_name, '_', 1) as zone from nation join customer on n_nationkey = c_nationkey group by 1, n_name")
def interval_midpoints(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    found = joined.groupBy("n_nationkey", "n_name").agg(F.round(((F.min("c_acctbal") + F.max("c_acctbal")) / 2).cast("decimal(18,4)"), 2).cast("double").alias("midpoint"))
    return found.select("n_nationkey", "midpoint", F.split_part("n_name", F.lit("_"), F.lit(1)).alias("zone"))


@plans.add(f"""with {_CELLS}, t as (select c_custkey as target_id, c_custkey % 59 + (c_custkey % 10) / 10.0 as y, (c_custkey * 7) % 29 + (c_custkey % 7) / 7.0 as x from customer),
four as (select target_id, floor(y) + i as row, floor(x) + j as col,
  (case i when 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case j when 1 then x - floor(x) else 1 - (x - floor(x)) end) as w
  from t, (values (0), (1)) a(i), (values (0), (1)) b(j))
select target_id, round(sum(w * value) / nullif(sum(case when value is not null then w end), 0), 6) as value from four left join cells using (row, col) group by 1""")
def resample_bilinear(spark, d):
    """Values between cell centres; weights of empty neighbours go to the others."""
    key = F.col("c_custkey")
    targets = table(spark, d, "customer").select(key.alias("target_id"), (key % 59 + (key % 10) / 10.0).alias("y"), (key * 7 % 29 + (key % 7) / 7.0).alias("x"))
    return grid.bilinear(targets, cells(spark, d)).withColumn("value", F.round("value", 6))


@plans.add(f"""with {_CELLS}, n as (select row // 5 as row, col // 5 as col, class as value, count(*) as c from cells group by 1, 2, 3)
select row, col, value from (select *, row_number() over (partition by row, col order by c desc, value) as k from n) where k = 1""")
def resample_mode(spark, d):
    return grid.majority(cells(spark, d).select("row", "col", F.col("class").alias("value")), 5)


@plans.add(f"with {_CELLS} select row // 4 as row, col // 4 as col, round(avg(value), 6) as value from cells group by 1, 2")
def decimate_mean(spark, d):
    return grid.decimate(cells(spark, d), 4, False).withColumn("value", F.round("value", 6))


@plans.add(f"""with {_CELLS} select br as row, bc as col, class as value from (select row // 4 as br, col // 4 as bc, class, row_number() over (partition by row // 4, col // 4 order by row, col) as k from cells) where k = 1""")
def decimate_first(spark, d):
    return grid.decimate(cells(spark, d).select("row", "col", F.col("class").alias("value")), 4, True)


def _tiles(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("tile"), F.col("p_size").cast("long").alias("row"), F.substring("p_brand", 7, 9).cast("long").alias("col"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("value"))


def _mosaic_sql(order: str) -> str:
    return f"""select row, col, value from (select p_size as row, cast(substr(p_brand, 7) as bigint) as col, p_retailprice as value,
  row_number() over (partition by p_size, p_brand order by p_partkey {order}) as k from part where p_partkey % 3 <> 0) where k = 1"""


@plans.add(_mosaic_sql("desc"))
def mosaic_last(spark, d):
    """Later tiles overwrite where they have values."""
    return grid.mosaic(_tiles(spark, d), True)


@plans.add(_mosaic_sql("asc"))
def mosaic_first(spark, d):
    return grid.mosaic(_tiles(spark, d), False)


@plans.add(f"""with {_CELLS}, n as (select row, col, value, lag(value) over r as rb, lead(value) over r as ra, lag(1) over r as hrb, lead(1) over r as hra,
  lag(value) over c as cb, lead(value) over c as ca, lag(1) over c as hcb, lead(1) over c as hca from cells
  window r as (partition by col order by row), c as (partition by row order by col)),
g as (select row, col, case when hrb is null and hra is null then null when hrb is null then ra - value when hra is null then value - rb else (ra - rb) / 2 end as dr,
  case when hcb is null and hca is null then null when hcb is null then ca - value when hca is null then value - cb else (ca - cb) / 2 end as dc from n)
select row, col, round(sqrt(power(dc / (0.00225 * 111320.0 * cos(radians(14.901 - 0.00225 * (row + 0.5)))), 2) + power(dr / (0.00225 * 111320.0), 2)) * 100, 6) as slope from g""")
def slope_pct(spark, d):
    """Slope of the surface, null beside empty cells."""
    rises = grid.gradients(cells(spark, d))
    return rises.select("row", "col", F.round(climate.slope_pct(F.col("dz_row"), F.col("dz_col"), grid.center_lat(F.col("row")), grid.RES), 6).alias("slope"))


@plans.add(f"with {_CELLS} select round(100 * avg(case when value is null then 0.0 else 1.0 end), 6) as valid_pct, min(value) as minimum, max(value) as maximum, round(median(value), 6) as median from cells")
def raster_coverage(spark, d):
    return grid.coverage(cells(spark, d))


@plans.add(f"with {_CELLS} select class, count(*) as n from cells group by 1")
def class_histogram(spark, d):
    return cells(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_MONTHS = "months as (select c_nationkey as row, month(o_orderdate) as col, avg(o_totalprice) as value from orders join customer on o_custkey = c_custkey group by 1, 2)"


def _months(spark, d):
    """Mean order value by nation and month."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("row"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("value")).withColumn("col", F.lit(0))


@plans.add(f"with {_MONTHS} select row, 0 as col, round(case when avg(value) > 0 then 100 * stddev_pop(value) / avg(value) end, 6) as cv from months group by 1")
def monthly_cv(spark, d):
    return grid.monthly_cv(_months(spark, d))


@plans.add(f"with {_MONTHS} select row, 0 as col, round(case when count(value) = 12 then sum(value) end, 6) as total, round(case when count(value) = 12 then avg(value) end, 6) as mean from months group by 1")
def monthly_total(spark, d):
    return grid.monthly_total(_months(spark, d))


_DAYS = "[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]"
_MID = "[15, 45, 74, 105, 135, 162, 198, 228, 258, 288, 318, 344]"


@plans.add(f"""with {_MONTHS}, m as (select row, col as month, 4 + row * 0.4 as lat, value / 1000 as rain, value / 8000 as temp from months),
h as (select *, sum(power(greatest(temp, 0) / 5.0, 1.514)) over (partition by row) as heat from m),
p as (select *, (24.0 / pi()) * acos(greatest(-1.0, least(1.0, -tan(radians(lat)) * tan(radians(23.45 * sin(radians(360.0 * (284 + {_MID}[month]) / 365.0))))))) as hours,
  case when temp > 26.5 then -415.85 + 32.24 * temp - 0.43 * temp * temp when temp > 0 and heat > 0
  then 16.0 * power(10.0 * temp / heat, 6.75e-7 * power(heat, 3) - 7.71e-5 * power(heat, 2) + 1.792e-2 * heat + 0.49239) else 0.0 end as base from h)
select row, round(sum(greatest(base, 0) * (hours / 12.0) * ({_DAYS}[month] / 30.0)), 4) as pet,
  least(cast(sum(case when rain >= 0.5 * greatest(base, 0) * (hours / 12.0) * ({_DAYS}[month] / 30.0) and temp > 5.0 then {_DAYS}[month] else 0 end) as double), 365.0) as growing_days from p group by 1""")
def growing_days(spark, d):
    """Yearly evapotranspiration and growing days of each nation, rain and temperature made of its order values."""
    from pyspark.sql import Window

    m = _months(spark, d).select("row", "month", (4 + F.col("row") * 0.4).alias("lat"), (F.col("value") / 1000).alias("rain"), (F.col("value") / 8000).alias("temp"))
    m = m.withColumn("heat", F.sum(climate.heat_term(F.col("temp"))).over(Window.partitionBy("row")))
    m = m.withColumn("pet", climate.evapotranspiration(F.col("temp"), F.col("heat"), F.col("lat"), F.col("month")))
    grows = F.when(climate.growing(F.col("rain"), F.col("pet"), F.col("temp")), climate.days(F.col("month"))).otherwise(0.0)
    return m.groupBy("row").agg(F.round(F.sum("pet"), 4).alias("pet"), F.least(F.sum(grows), F.lit(365.0)).alias("growing_days"))


@plans.add("""select s_suppkey, case when lat >= 0 then 'N' else 'S' end || lpad(cast(abs(cast(floor(lat / 3) * 3 as bigint)) as varchar), 2, '0') ||
  case when lon >= 0 then 'E' else 'W' end || lpad(cast(abs(cast(floor(lon / 3) * 3 as bigint)) as varchar), 3, '0') as tile
  from (select s_suppkey, s_acctbal / 200 as lat, s_acctbal / 60 as lon from supplier)""")
def tile_names(spark, d):
    lat, lon = F.col("s_acctbal") / 200, F.col("s_acctbal") / 60
    return table(spark, d, "supplier").select("s_suppkey", climate.tile_name(lat, lon).alias("tile"))


@plans.add("""select c_custkey, cast(floor((cast(14.901 as double) - lat) / cast(0.00225 as double)) as bigint) as row, cast(floor((lon - cast(32.9 as double)) / cast(0.00225 as double)) as bigint) as col
  from (select c_custkey, cast(3.3 as double) + (c_custkey % 1000) * cast(0.0113 as double) as lat, 33 + (c_custkey % 777) * cast(0.0191 as double) as lon from customer)""")
def point_cells(spark, d):
    """The cells of points on the reference grid."""
    key = F.col("c_custkey")
    row, col = grid.cell_of(3.3 + (key % 1000) * 0.0113, 33 + (key % 777) * 0.0191)
    return table(spark, d, "customer").select("c_custkey", row.alias("row"), col.alias("col"))
