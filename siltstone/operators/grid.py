"""Rasters as cells (row, col, value): sampling, nearest valid cells, remapping, resampling, mosaics, gradients."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The radius up to which a point looks at all cells around it.
FINE = 8
#: Points whose columns are looked at together within a tile.
_TOGETHER = 4096
#: Kilometres of a degree.
KM_LAT, KM_LON = 110.57, 111.32
#: The reference grid: left edge, top edge, degrees of a cell, rows, columns.
LEFT, TOP, RES, ROWS, COLS = 32.9, 14.901, 0.00225, 5156, 6800


def cell_of(lat: Column, lon: Column, left: float = LEFT, top: float = TOP, res: float = RES) -> tuple[Column, Column]:
    """row and col of the cell that a point is in."""
    return F.floor((F.lit(top) - lat) / res).cast("long"), F.floor((lon - F.lit(left)) / res).cast("long")


def center_lat(row: Column, top: float = TOP, res: float = RES) -> Column:
    return F.lit(top) - res * (row + 0.5)


def grid(spark, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """All cells of a grid."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))


def zone_cells(zones: DataFrame, south: float, west: float, north: float, east: float, res: float = 1 / 480) -> DataFrame:
    """Zones (lat_min, lon_min, lat_max, lon_max, area_km2) with whether they lie in a raster's extent, and about how many of its cells they cover."""
    inside = (F.col("lat_min") >= south) & (F.col("lon_min") >= west) & (F.col("lat_max") <= north) & (F.col("lon_max") <= east)
    return zones.withColumn("within_extent", inside).withColumn("n_cells", F.round(F.col("area_km2") / (KM_LAT * KM_LON * res * res)).cast("long"))


def is_nodata(value: Column, nodata: float | None = None) -> Column:
    """Null, not a number, or the layer's mark."""
    bad = value.isNull() | F.isnan(value)
    return bad if nodata is None else bad | (value == nodata)


def sample(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (with row, col) with the values of their cells; a join on the cell, for all bands at once."""
    return points.join(cells, ["row", "col"], "left")


def nearest_valid(points: DataFrame, cells: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """point_id, value, d2 of the nearest cell with a value within `radius` cells either way; ties in row-major order.

    A narrow search is an equi-join on blocks of radius cells; a wide one is the transform of nearest_layers().  Either
    looks once at each place that points are at.  Points without a valid cell in reach have null.
    """
    if radius <= FINE:
        return _nearest(points, cells, radius, value)
    found = nearest_layers(points, cells, [value], radius).select("row", "col", F.col(value), F.col(f"d2_{value}").alias("d2"))
    return points.select("point_id", "row", "col").join(found, ["row", "col"]).select("point_id", value, "d2")


def _nearest(points: DataFrame, cells: DataFrame, radius: int, value: str) -> DataFrame:
    side = max(radius, 1)
    valid = cells.filter(F.col(value).isNotNull()).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("v"), F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc"))
    around = F.array(*[F.struct((F.floor(F.col("row") / side) + i).alias("br"), (F.floor(F.col("col") / side) + j).alias("bc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    looks = points.select("row", "col").distinct().select("row", "col", F.inline(around))
    met = looks.join(valid, ["br", "bc"]).filter((F.abs(F.col("r") - F.col("row")) <= radius) & (F.abs(F.col("c") - F.col("col")) <= radius))
    d2 = (F.col("r") - F.col("row")) * (F.col("r") - F.col("row")) + (F.col("c") - F.col("col")) * (F.col("c") - F.col("col"))
    best = met.groupBy("row", "col").agg(F.min_by(F.struct(F.col("v"), d2.alias("d2")), F.struct(d2, F.col("r"), F.col("c"))).alias("b"))
    return points.join(best, ["row", "col"], "left").select("point_id", F.col("b.v").alias(value), F.col("b.d2").alias("d2"))


def _columns(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the nearest row with a valid cell in its column, at or above it and at or below it; far away if none."""
    rows, far = np.arange(len(valid))[:, None], 1 << 20
    up = np.maximum.accumulate(np.where(valid, rows, -far), 0)
    down = np.minimum.accumulate(np.where(valid, rows, far)[::-1], 0)[::-1]
    return up, down


def distance_transform(values: np.ndarray, row: np.ndarray, col: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The value and squared distance of the valid cell nearest to each place of a dense tile; not a number if none is in reach.

    Two passes: down the columns once for all places, then along a place's row over the 2 radius + 1 nearest rows found
    there.  values has a margin of radius cells around all places.
    """
    up, down = _columns(~np.isnan(values))
    width, (height, line) = np.arange(-radius, radius + 1), values.shape
    value, d2 = np.full(len(row), np.nan), np.full(len(row), np.nan)
    for first in range(0, len(row), _TOGETHER):
        r, c = row[first : first + _TOGETHER, None], col[first : first + _TOGETHER, None] + width
        above, below = r - up[r, c], down[r, c] - r
        near = np.where(above <= below, r - above, r + below)
        away = np.minimum(above, below)
        key = np.where(away <= radius, ((away * away + width * width) * height + near) * line + c, np.iinfo(np.int64).max)
        best = key.argmin(1)
        at = np.flatnonzero(away[np.arange(len(r)), best] <= radius)
        best = best[at]
        value[first + at] = values[near[at, best], c[at, best]]
        d2[first + at] = away[at, best] ** 2 + width[best] ** 2
    return value, d2


def nearest_layers(points: DataFrame, cells: DataFrame, layers: list[str], radius: int, tile: int | None = None) -> DataFrame:
    """row, col of the points' cells, each once, with the nearest valid value of every layer and its squared distance, d2_<layer>.

    cells: row, col and the layers, null or not a number where a cell has no value.  A cell goes to each tile within
    `radius` of it, if some point lies in that tile; a tile with its margin is transformed in one task, for all layers.
    So there are as many shuffles for eleven layers as for one, and a tile's size is bounded by its sides.
    """
    side = tile or max(64, 4 * radius)
    block = lambda c: F.floor(c / side)
    at = points.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct().withColumns({"ti": block(F.col("row")), "tj": block(F.col("col"))})
    spread = cells.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), *[F.nanvl(F.col(n).cast("double"), F.lit(None)).alias(f"v{i}") for i, n in enumerate(layers)])
    for name, place in (("ti", "r"), ("tj", "c")):
        spread = spread.withColumn(name, F.explode(F.sequence(block(F.col(place) - radius), block(F.col(place) + radius))))
    spread = spread.join(at.select("ti", "tj").distinct(), ["ti", "tj"], "left_semi")
    n = len(layers)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["row", "col", *[f"{k}{i}" for i in range(n) for k in ("v", "d")]]
        row, col = asked.column("row").to_numpy(), asked.column("col").to_numpy()
        if not len(row):
            return pa.table([pa.array([], t) for t in [pa.int64()] * 2 + [pa.float64(), pa.int64()] * n], names)
        top, left = row[0] // side * side - radius, col[0] // side * side - radius
        r, c = held.column("r").to_numpy() - top, held.column("c").to_numpy() - left
        out = [row, col]
        for i in range(n):
            values = np.full((side + 2 * radius, side + 2 * radius), np.nan)
            values[r, c] = held.column(f"v{i}").to_numpy()
            value, d2 = distance_transform(values, row - top, col - left, radius)
            none = np.isnan(value)
            out += [pa.array(value, mask=none), pa.array(np.nan_to_num(d2).astype(np.int64), mask=none)]
        return pa.table(out, names)

    schema = ", ".join(["row long", "col long", *[f"v{i} double, d{i} long" for i in range(n)]])
    found = at.groupBy("ti", "tj").cogroup(spread.groupBy("ti", "tj")).applyInArrow(search, schema)
    return found.toDF("row", "col", *[x for name in layers for x in (name, f"d2_{name}")])


def stack(layers: dict[str, DataFrame]) -> DataFrame:
    """row, col and a column for each layer (row, col, value): one shuffle for all layers; cells that a layer lacks are null."""
    tagged = [df.select("row", "col", F.lit(i).alias("k"), F.col("value").cast("double").alias("v")) for i, df in enumerate(layers.values())]
    one = lambda i: F.max(F.when(F.col("k") == i, F.col("v")))
    return reduce(DataFrame.unionByName, tagged).groupBy("row", "col").agg(*[one(i).alias(n) for i, n in enumerate(layers)])


def sample_or_nearest(points: DataFrame, cells: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """point_id, value: of the cell itself, or of the nearest valid one."""
    return nearest_valid(points, cells.select("row", "col", value), radius, value).select("point_id", value)


def remap(cells: DataFrame, code: str, attributes: DataFrame) -> DataFrame:
    """Cells with the attributes of their code; the lookup table is small and bounded by the number of classes."""
    return cells.join(attributes, code, "left")


def decimate(cells: DataFrame, k: int, categorical: bool, value: str = "value") -> DataFrame:
    """A coarser raster: the mean of k by k cells, or the value of the first of them for classes."""
    block = cells.select(F.floor(F.col("row") / k).alias("brow"), F.floor(F.col("col") / k).alias("bcol"), "row", "col", value)
    pick = F.min_by(value, F.struct("row", "col")) if categorical else F.avg(value)
    return block.groupBy(F.col("brow").alias("row"), F.col("bcol").alias("col")).agg(pick.alias(value))


def bilinear(targets: DataFrame, source: DataFrame, value: str = "value") -> DataFrame:
    """Targets (target_id, y, x in fractional source cells, at cell centres) with interpolated values.

    Weights of neighbours without a value go to the others; no neighbour with a value gives null.
    """
    y0, x0 = F.floor("y"), F.floor("x")
    dy, dx = F.col("y") - y0, F.col("x") - x0
    four = F.array(*[F.struct((y0 + i).alias("row"), (x0 + j).alias("col"), ((dy if i else 1 - dy) * (dx if j else 1 - dx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    met = targets.select("target_id", F.inline(four)).join(source.select("row", "col", F.col(value).alias("v")), ["row", "col"], "left")
    held = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return met.groupBy("target_id").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(held, F.lit(0.0))).alias(value))


def majority(cells: DataFrame, k: int, value: str = "value") -> DataFrame:
    """The most frequent class of k by k cells; ties go to the least."""
    counted = cells.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col"), value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("row", "col").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def mosaic(tiles: DataFrame, last_wins: bool, value: str = "value") -> DataFrame:
    """One value for each cell of overlapping tiles (tile, row, col): of the last valid tile, or of the first."""
    pick = F.max_by if last_wins else F.min_by
    return tiles.filter(F.col(value).isNotNull()).groupBy("row", "col").agg(pick(value, "tile").alias(value))


def gradients(cells: DataFrame, value: str = "value") -> DataFrame:
    """Add dz_row and dz_col: central differences, one-sided at the edges; null beside a cell without a value."""
    def rise(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        back, ahead = F.lag(F.struct(value)).over(w), F.lead(F.struct(value)).over(w)
        one = F.when(back.isNull(), ahead[value] - F.col(value)).when(ahead.isNull(), F.col(value) - back[value])
        return F.coalesce(one, F.when(back.isNotNull() & ahead.isNotNull(), (ahead[value] - back[value]) / 2))

    return cells.withColumn("dz_row", rise("row", "col")).withColumn("dz_col", rise("col", "row"))


def coverage(cells: DataFrame, value: str = "value") -> DataFrame:
    """valid_pct, minimum, maximum, median (interpolated)."""
    return cells.agg(
        F.round(100 * F.avg(F.col(value).isNotNull().cast("double")), 6).alias("valid_pct"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.round(F.percentile(value, 0.5), 6).alias("median")
    )


def monthly_cv(cells: DataFrame, value: str = "value") -> DataFrame:
    """100 * population standard deviation / mean over the months of a cell; null where the mean is not positive."""
    return cells.groupBy("row", "col").agg(F.round(F.when(F.avg(value) > 0, 100 * F.stddev_pop(value) / F.avg(value)), 6).alias("cv"))


def monthly_total(cells: DataFrame, months: int = 12, value: str = "value") -> DataFrame:
    """Sum and mean over the months; a month without a value leaves none."""
    full = F.count(value) == months
    return cells.groupBy("row", "col").agg(F.round(F.when(full, F.sum(value)), 6).alias("total"), F.round(F.when(full, F.avg(value)), 6).alias("mean"))
