"""Joins that Spark has no operator for, as compositions of operators that it has."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources.sinks import stored_copy


#: An as-of join cuts a key with more rows than this, and than this share of all rows, into SLOTS times.
HOT_ROWS, HOT_SHARE = 1_000_000, 2048
SLOTS, _STEPS = 1000, (100, 10, 1)


def _hot_bounds(rows: DataFrame, by: list[str], hot_rows: int) -> DataFrame | None:
    """(by, __b100, __b10, __b1): rising times of each key with too many rows, every 100th, 10th and each of SLOTS - 1; None without such keys.

    Fewer than HOT_SHARE keys can have that many rows. The bounds are stored,
    since a second evaluation of the approximate percentiles could differ. A
    table of fewer bytes than eight for each of ``hot_rows`` isn't counted.
    """
    if small_enough(rows, 8 * hot_rows):
        return None
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    most, all_ = counts.agg(F.max("__n"), F.sum("__n")).first()
    least = max(hot_rows, (all_ or 0) // HOT_SHARE)
    if (most or 0) <= least:
        return None
    hot = counts.where(F.col("__n") > least).select(*by)
    shares = [i / SLOTS for i in range(1, SLOTS)]
    bounds = rows.join(F.broadcast(hot), by).groupBy(*by).agg(F.percentile_approx("__at", shares).alias("__b1"))
    every = {f"__b{n}": F.expr(f"transform(sequence({n - 1}, {SLOTS - 2}, {n}), i -> __b1[i])") for n in _STEPS if n > 1}
    return stored_copy(bounds.withColumns(every))


def asof(left: DataFrame, right: DataFrame, *, by: list[str], left_at: str, right_at: str, values: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of the same ``by`` at or before it; null if there is none.

    Both sides are one stream per key, sorted once: one shuffle and no pair of
    rows is ever formed. Of right rows at one time the greatest values count.
    Null keys and null times match nothing.

    Keys of large tables are counted first. One with more than ``hot_rows`` rows is cut into
    slots of time by its own percentiles; each slot is a window of its own and
    starts from the last values of the slots before it, one row for each slot.
    Times of other types than numbers, dates and timestamps are not cut.
    """
    packed = F.struct(*values)
    kind = right.select(packed.alias("v")).schema["v"].dataType
    l = left.select(*by, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind).alias("__v"))
    r = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), packed.alias("__v"))
    known = F.col("__at").isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    both = l.unionByName(r.where(known))
    at = both.schema["__at"].dataType
    hot = _hot_bounds(both.where(known).select(*by, "__at"), by, hot_rows) if isinstance(at, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) else None
    # Left rows that match nothing are dealt out to slots of their own, where no right row is.
    apart = -2 - F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)).cast("int")
    if hot is None:
        cut = both.withColumn("__slot", F.when(known, -1).otherwise(apart))
    else:
        # How many bounds are earlier, a digit at a time; each digit is bound once, by a list of one.
        digit = lambda n, slot: f"10 * {slot} + size(filter(slice(__b{n}, 10 * {slot} + 1, 9), b -> b < __at))"
        slot = "array(0)"
        for n in _STEPS:
            slot = f"transform({slot}, s -> {digit(n, 's')})"
        slots = F.when(known, F.coalesce(F.expr(f"if(__b1 is null, null, {slot}[0])"), F.lit(-1))).otherwise(apart)
        cut = both.join(F.broadcast(hot), by, "left").withColumn("__slot", slots).drop(*[f"__b{n}" for n in _STEPS])
    w = Window.partitionBy(*by, "__slot").orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    if hot is not None:
        # A row for each slot of a hot key: what it hands on, then what it starts from.
        ends = cut.where("__slot >= 0 and __side = 0").groupBy(*by, "__slot").agg(F.max(F.struct("__at", "__v")).alias("__end"))
        before = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        every = hot.select(*by, F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("__slot")).join(ends, [*by, "__slot"], "left")
        carried = every.withColumn("__from", F.last("__end.__v", ignorenulls=True).over(before)).drop("__end")
        seen = seen.join(carried, [*by, "__slot"], "left").withColumn("__last", F.coalesce("__last", "__from"))
    return seen.where("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


#: A range is longer than its cells by less than this factor.
_WIDER = 16


def in_range(points: DataFrame, ranges: DataFrame, *, at: str, low: str, high: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Points joined with the ranges that hold them, low <= at < high, as an equi-join on cells.

    Cells are ``width`` long, and 16, 256 ... times that for ranges of 16, 256
    ... times ``width`` or more. So a range is listed for 17 cells at most
    (of whole numbers 65, where it is longer than 2 ** 62), and a point once for each length of cells in use: once
    where no range has 16 times ``width``. There is no nested loop. Null, empty
    and reversed ranges hold nothing; other columns keep their values.
    """
    whole = all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for df, c in ((points, at), (ranges, low), (ranges, high)))
    kind = "long" if whole else "double"
    # Whole numbers are divided as such: a double would lose those above 2 ** 53. Infinite ends count as the last numbers.
    value = (lambda c: F.col(c).cast(kind)) if whole else (lambda c: F.greatest(F.least(F.col(c).cast(kind), F.lit(1.7e308)), F.lit(-1.7e308)))
    wide = lambda level: (F.lit(width) * F.pow(F.lit(float(_WIDER)), level)).cast(kind)
    cell = (lambda v, w: F.call_function("div", v, w) - F.when((v < 0) & (F.pmod(v, w) != 0), 1).otherwise(0)) if whole else (lambda v, w: F.floor(v / w))
    length = value(high).cast("double") - value(low).cast("double")
    most = math.floor(math.log(2**62 / width, _WIDER)) if whole else 255  # longer cells would pass the last number
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.log(float(_WIDER), length / width)))).cast("int")
    held = ranges.where(F.col(low) < F.col(high)).withColumn("__level", level)
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())  # at most 256
    last = value(high) - 1 if whole else value(high)
    listed = held.withColumn("__cell", F.explode(F.sequence(cell(value(low), wide(F.col("__level"))), cell(last, wide(F.col("__level"))))))
    spread = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    spread = spread.withColumn("__cell", cell(value(at), wide(F.col("__level"))))
    found = spread.join(listed, ["__cell", "__level", *(by or [])]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return found.drop("__cell", "__level")


def salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread: left rows take salts in turn by their place, right rows come once for each.

    For joins that adaptive execution can't split (a preceding repartition, a
    cached side); ``right`` has to be the smaller side. Only for inner and left joins.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat the right side")
    # By place and not by content: equal rows get different salts too.
    l = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "__salt"], how).drop("__salt")


def small_enough(df: DataFrame, most_bytes: int = 64 << 20) -> bool:
    """Whether the optimizer's size estimate allows a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes


def broadcast_if_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most_bytes: int = 64 << 20) -> DataFrame:
    """Broadcasts ``right`` behind a check of its size; beyond it, Spark's own choice (a shuffled join)."""
    return left.join(F.broadcast(right) if small_enough(right, most_bytes) else right, on, how)
