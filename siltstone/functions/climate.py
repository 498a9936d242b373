"""Climate and terrain expressions: day length, evapotranspiration, growing days, slope, tile names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of the months and their middle day of the year.
DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MID_DAYS = (15, 45, 74, 105, 135, 162, 198, 228, 258, 288, 318, 344)


def _of_month(values: tuple, month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), month.cast("int"))


def days(month: Column) -> Column:
    return _of_month(DAYS, month)


def day_hours(lat: Column, month: Column) -> Column:
    """Hours from sunrise to sunset at a latitude in the middle of a month (1 to 12)."""
    tilt = F.radians(23.45 * F.sin(F.radians(360.0 * (284 + _of_month(MID_DAYS, month)) / 365.0)))
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(lat)) * F.tan(tilt)))
    return (24.0 / math.pi) * F.acos(x)


def heat_term(temp: Column) -> Column:
    """A month's part of the yearly heat index."""
    return F.pow(F.greatest(F.coalesce(temp, F.lit(0.0)), F.lit(0.0)) / 5.0, 1.514)


def evapotranspiration(temp: Column, heat: Column, lat: Column, month: Column) -> Column:
    """Thornthwaite's potential evapotranspiration in mm for a month's mean temperature and the yearly heat index."""
    t = F.coalesce(temp, F.lit(0.0))
    a = 6.75e-7 * F.pow(heat, 3) - 7.71e-5 * F.pow(heat, 2) + 1.792e-2 * heat + 0.49239
    base = F.when(t > 26.5, -415.85 + 32.24 * t - 0.43 * t * t).when((t > 0) & (heat > 0), 16.0 * F.pow(10.0 * t / heat, a)).otherwise(0.0)
    return F.greatest(base, F.lit(0.0)) * (day_hours(lat, month) / 12.0) * (days(month) / 30.0)


def growing(rain: Column, pet: Column, temp: Column) -> Column:
    return (rain >= 0.5 * pet) & (temp > 5.0)


def slope_pct(dz_row: Column, dz_col: Column, lat: Column, res: float) -> Column:
    """Slope in percent from rises for a pixel, on a geographic grid of res degrees."""
    gx = dz_col / (res * 111320.0 * F.cos(F.radians(lat)))
    gy = dz_row / (res * 111320.0)
    return F.sqrt(gx * gx + gy * gy) * 100.0


def tile_name(lat: Column, lon: Column, step: int = 3) -> Column:
    """The name of the tile that a point is in, by its lower left corner."""
    a, b = F.floor(lat / step) * step, F.floor(lon / step) * step
    north = F.when(a >= 0, "N").otherwise("S")
    east = F.when(b >= 0, "E").otherwise("W")
    return F.concat(north, F.lpad(F.abs(a).cast("string"), 2, "0"), east, F.lpad(F.abs(b).cast("string"), 3, "0"))
