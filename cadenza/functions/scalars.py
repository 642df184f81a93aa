"""Column functions for measurements: decibels, centring, distances, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decibels(power: Column, factor: float = 10.0) -> Column:
    """factor * log10(power); undefined, so null, at zero or below."""
    return F.when(power > 0, factor * F.log10(power))


def relative_decibels(power: Column, most: Column, floor_db: float) -> Column:
    """Decibels of power, not below floor_db under the greatest power; the least positive double stands for silence."""
    return 10.0 * F.log10(F.greatest(power, most * F.lit(10.0 ** (floor_db / 10)), F.lit(2.2250738585072014e-308)))


def doubles(array: Column) -> Column:
    return F.transform(array, lambda x: x.cast("double"))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def centred(array: Column) -> Column:
    """An array without its mean; unaffected by gain in decibels. The mean is taken once: an array of one item holds it."""
    wide = doubles(array)
    return F.flatten(F.transform(F.array(total(wide) / F.nullif(F.size(wide), F.lit(0))), lambda mean: F.transform(wide, lambda x: x - mean)))


def rms_distance(a: Column, b: Column) -> Column:
    """Root mean square of the difference; null where the arrays differ in length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(total(squares) / F.size(a)))


def significant(x: Column, digits: int = 7) -> Column:
    """x rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.rint(x * scale) / scale)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def greatest_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two positive longs: 92 steps suffice for any."""
    begin = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), begin, step, lambda s: s["a"])
