"""Lenient parsers of numbers and truth values: null where the text doesn't parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\x0B\f\r]"
LIMITS = {"int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1), "smallint": (-(2**15), 2**15 - 1), "tinyint": (-(2**7), 2**7 - 1)}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def to_int(text: Column, kind: str = "bigint") -> Column:
    """White space around and a sign are allowed; overflow saturates; a lone sign is 0."""
    low, high = LIMITS[kind]
    t = stripped(text)
    digits = F.regexp_replace(F.regexp_extract(t, r"^[+-]?([0-9]*)$", 1), "^0+", "")
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    # Over 30 digits saturate as well; 30 fit a decimal.
    big = F.when(F.length(digits) > 30, F.lit("9" * 30)).when(digits == "", F.lit("0")).otherwise(digits).cast("decimal(38,0)") * sign
    bound = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    value = F.least(F.greatest(big, bound(low)), bound(high)).cast(kind)
    return F.when(t.rlike(r"^[+-]?[0-9]+$|^[+-]$"), value)


def to_int_base(text: Column, base: int) -> Column:
    """Digits and letters below ``base``; the first other digit or letter ends the number."""
    t = F.lower(stripped(text))
    allowed = "0-9"[: 1 + 2 * (base > 1)] if base >= 10 else f"0-{base - 1}"
    if base > 10:
        allowed += f"a-{chr(ord('a') + base - 11)}"
    digits = F.regexp_extract(t, rf"^[+-]?([{allowed}]*)", 1)
    value = F.conv(F.when(digits == "", F.lit("0")).otherwise(digits), base, 10).cast("bigint")
    return F.when(t.rlike(r"^[+-]?[0-9a-z]+$"), F.when(t.startswith("-"), -value).otherwise(value))


def to_float(text: Column) -> Column:
    """Decimal and scientific notation, inf, infinity and nan in either case; overflow is infinite."""
    t = F.lower(stripped(text))
    number = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$")
    word = F.regexp_replace(t, r"^[+-]", "")
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(number, F.expr("1.0D") * t.try_cast("double")).when(word.isin("inf", "infinity"), sign * inf).when(word == "nan", nan)


def to_bool(text: Column) -> Column:
    """Only true and false, in either case."""
    t = F.lower(stripped(text))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))
