"""Numeric helpers: finite tests, clamping, guarded ratios and the rounding family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
LARGE = 2.0**52  # from here on doubles have no half


def as_column(value: Column | str | float) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def clamp(c: Column, low: float, high: float) -> Column:
    """Limit to a range; null stays null (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(part: Column, whole: Column, default: float | None = None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(default).cast("double"))


def percentage(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    """Share of a whole in percent; ``default`` where the whole is not positive."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(default).cast("double"))


def half_up(c: Column, digits: int = 0) -> Column:
    """floor(x·10ᵈ + ½)/10ᵈ, the same in every IEEE engine; NaN, infinities and numbers too large for a fraction stay."""
    scale = float(10**digits)
    return F.when(F.abs(c) < LARGE / scale, F.floor(c * scale + 0.5).cast("double") / scale).otherwise(c.cast("double"))


def half_even(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def half_up_decimal(c: Column, digits: int) -> Column:
    """Half up on the shortest decimal text of the number."""
    return F.round(c, digits)


def encode_percentage(c: Column) -> Column:
    """Hundredths of a percent, 65535 where there is no value.

    Both factors stay single precision: the encoder's contract is defined on float32.
    """
    limited = F.least(F.greatest(c.cast("float"), F.lit(0.0).cast("float")), F.lit(100.0).cast("float"))
    hundredths = F.rint((limited * F.lit(100.0).cast("float")).cast("float")).cast("int")
    return F.when(finite(c), hundredths).otherwise(F.lit(65535))


def decode_percentage(code: Column) -> Column:
    return F.when(code != 65535, code / 100.0)


def band(c: Column, bands: list[tuple]) -> Column:
    """Id of the first band whose inclusive limits hold the value; gaps and nulls are ``no-data``."""
    chosen = F.lit("no-data")
    for name, low, high, *_ in reversed(bands):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (c >= low)
        if high is not None:
            inside = inside & (c <= high)
        chosen = F.when(finite(c) & inside, F.lit(name)).otherwise(chosen)
    return chosen


def ramp(c: Column, stops: list[tuple[float, str]]) -> Column:
    """Colour of a value on a piecewise linear ramp, as #rrggbb; beyond the ends the end colour."""
    def channel(text: str, at: int) -> int:
        return int(text[1 + 2 * at:3 + 2 * at], 16)

    def mix(at: int) -> Column:
        value = F.lit(float(channel(stops[0][1], at)))
        for (x0, c0), (x1, c1) in zip(stops, stops[1:]):
            a, b = channel(c0, at), channel(c1, at)
            value = F.when(c >= x0, a + (F.least(c, F.lit(x1)) - x0) / (x1 - x0) * (b - a)).otherwise(value)
        return F.lpad(F.lower(F.hex(F.floor(value + 0.5).cast("int"))), 2, "0")

    return F.when(finite(c), F.concat(F.lit("#"), mix(0), mix(1), mix(2)))
