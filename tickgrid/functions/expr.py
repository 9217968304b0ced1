"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = (ax - bx).cast("double"), (ay - by).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def sector(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("int")


def packed(sx: Column, sy: Column) -> Column:
    """One number for a sector: x in the low 16 bits, y above."""
    return sx.cast("long").bitwiseOR(F.shiftleft(sy.cast("long"), 16))


def heat_colour(value: Column, low: Column, high: Column) -> Column:
    """Blue over green to red as packed RGB; null gives 0, values outside the scale are clamped."""
    ratio = 2 * F.least(F.greatest((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    blue = F.floor(F.greatest(F.lit(0.0), 255 * (1 - ratio)))
    red = F.floor(F.greatest(F.lit(0.0), 255 * (ratio - 1)))
    green = 255 - blue - red
    return F.coalesce((red * 65536 + green * 256 + blue).cast("long"), F.lit(0).cast("long"))


def firepower(hp: Column, max_hp: Column, weapons: list[tuple[Column, Column, Column]], cap: float = 800.0) -> Column:
    """Health ratio times (damage + 1) * sqrt(range + 1) / rate of fire, summed over (damage, range, rof), at most ``cap``."""
    ratio = F.coalesce(hp, F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce(max_hp, F.lit(0.0)))
    total = F.lit(0.0)
    for damage, reach, rof in weapons:
        total = total + F.coalesce(ratio * (damage + 1) * F.sqrt(reach + 1) / F.greatest(rof, F.lit(1.0)), F.lit(0.0))
    return F.least(F.lit(cap), total)


def recency(age: Column) -> Column:
    """Weight of what was seen ``age`` ago: from .75 down to .25, never seen counts .25."""
    return F.coalesce(F.least(F.lit(0.75), F.greatest(F.lit(0.25), 1 - age / 600)), F.lit(0.25))
