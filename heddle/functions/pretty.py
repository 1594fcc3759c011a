"""Human-readable values: counts, bytes, rates, times, clock ticks, truth values, lists.

Every function takes a numeric Column and gives a string Column; null stays
null. Whole numbers and fractions are told apart by the column's declared type,
so pass ``fraction=True`` for a float, double or decimal column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the powers, smallest first.
COUNTS = ("K", "M", "B")
SIZES = ("KB", "MB", "GB")


def _fixed(value: Column, places: int) -> Column:
    """The value with ``places`` decimals, exact ties to the even digit."""
    return F.bround(value.cast("decimal(38,15)"), places).cast(f"decimal(38,{places})").cast("string")


def _cut(value: Column, places: int = 3) -> Column:
    """The value with ``places`` decimals, the rest cut off."""
    return (F.floor(value.cast("double") * 10**places) / 10**places).cast(f"decimal(38,{places})").cast("string")


def _scaled(value: Column, reach: Column, base: int, names: tuple[str, ...], show) -> Column:
    """``show(number, name)`` at the largest power of ``base`` that ``reach`` comes up to; null below the first."""
    v, out = value.cast("double"), None
    for power in range(len(names), 0, -1):
        case = (reach >= base**power, show(_fixed(v / base**power, 2), names[power - 1]))
        out = F.when(*case) if out is None else out.when(*case)
    return out


def unit(value: Column, per_second: bool = False, fraction: bool = False) -> Column:
    """Base 1000: ``1.50K``, ``2.00M``; below 1000 the number itself. As a rate ``1.50 K/sec`` and ``0`` for none."""
    if per_second:
        big = _scaled(value, value, 1000, COUNTS, lambda n, name: F.concat(n, F.lit(f" {name}/sec")))
        return F.when(value == 0, F.lit("0")).otherwise(F.coalesce(big, F.concat(_fixed(value, 2), F.lit(" /sec"))))
    big = _scaled(value, value, 1000, COUNTS, lambda n, name: F.concat(n, F.lit(name)))
    return F.coalesce(big, _fixed(value, 6) if fraction else value.cast("string"))


def bytes_(value: Column, per_second: bool = False) -> Column:
    """Base 1024, of either sign: ``1.50 KB``; no bytes are ``0``, or ``0.00 /sec`` as a rate."""
    end = "/sec" if per_second else ""
    big = _scaled(value, F.abs(value), 1024, SIZES, lambda n, name: F.concat(n, F.lit(f" {name}{end}")))
    return F.when(value == 0, F.lit("0.00 /sec" if per_second else "0")).otherwise(F.coalesce(big, F.concat(_fixed(value, 2), F.lit(f" B{end}"))))


def milliseconds(value: Column) -> Column:
    """The two largest parts of h, m, s, ms, parts of zero left out but for the ms after seconds; exactly nothing is ``0``."""
    ms = F.floor(value).cast("long")
    hours, minutes, seconds = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    part = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise(F.lit(""))
    return (
        F.when(value == 0, F.lit("0"))
        .when(hours > 0, F.concat(part(hours, "h"), part(minutes, "m")))
        .when(minutes > 0, F.concat(part(minutes, "m"), part(seconds, "s")))
        .when(seconds > 0, F.concat(part(seconds, "s"), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("ms")))
        .otherwise(F.concat(ms.cast("string"), F.lit("ms")))
    )


def nanoseconds(value: Column) -> Column:
    """From a second on as ``milliseconds``; below it ms, us or ns, cut to three decimals. 1000 ns are still ns."""
    return (
        F.when(value >= 10**9, milliseconds(value / 10**6))
        .when(value >= 10**6, F.concat(_cut(value / 10**6), F.lit("ms")))
        .when(value > 1000, F.concat(_cut(value / 1000), F.lit("us")))
        .when(value.isNotNull(), F.concat(_cut(value), F.lit("ns")))
    )


def microseconds(value: Column) -> Column:
    return nanoseconds(value * 1000)


def seconds(value: Column) -> Column:
    return milliseconds(value * 1000)


def ticks(value: Column, per_ms: int) -> Column:
    """Clock ticks of a clock with ``per_ms`` of them in a millisecond: thousands of ticks below one, then time."""
    return F.when(value < per_ms, F.concat(_fixed(value.cast("double") / 1000, 2), F.lit("K clock cycles"))).otherwise(milliseconds(F.floor(value / per_ms)))


def double(value: Column) -> Column:
    """Two decimals and a space, the place of a unit."""
    return F.concat(_fixed(value, 2), F.lit(" "))


def boolean(value: Column) -> Column:
    return value.cast("string")


def listed(values: Column, show=lambda v: v.cast("string")) -> Column:
    """``[a, b]`` with each value as ``show`` gives it."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: show(v)), ", "), F.lit("]"))
