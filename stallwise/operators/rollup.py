"""Stored day-grain tables of sales and buyers, and measures answered from them.

Both tables are additive: increments of any batch are added to what is stored, a withdrawn order
comes again with the sign turned. So they are kept as batches of increments (``writers.delta_sink``,
``writers.compact``) and no correction ever reads or rewrites the raw lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import expr as X

COUNTERS = ("cents", "lines", "seen")


def closing_day(ts: X.ColumnLike) -> Column:
    """The first midnight that is not before ``ts``, as a date.

    A trailing window that ends at a midnight, ``as_of - days < ts <= as_of``, holds whole closing days.
    """
    return F.to_date(X.col(ts).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND"))


def sales_increments(lines: DataFrame, valid: Column, withdrawn: Column | None = None) -> DataFrame:
    """One row per (point, day) of a batch: cents and number of its valid lines, and of all its lines.

    Lines that are ``withdrawn`` count negative. Money is whole cents, so that sums are exact and
    what is withdrawn leaves nothing. ``lines`` has point_id, amount and paid_at.
    """
    sign = F.lit(1) if withdrawn is None else F.when(withdrawn, -1).otherwise(1)
    counted = F.coalesce(valid, F.lit(False)).cast("bigint") * sign
    cents = F.coalesce(F.round(F.col("amount") * 100).cast("bigint"), F.lit(0))
    return lines.groupBy("point_id", closing_day("paid_at").alias("day")).agg(
        F.sum(counted * cents).alias("cents"), F.sum(counted).alias("lines"), F.sum(sign.cast("bigint")).alias("seen")
    )


def folded(increments: DataFrame) -> DataFrame:
    """The current table out of all increments: days without any line are gone."""
    summed = increments.groupBy("point_id", "day").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return summed.filter(F.col("seen") != 0)


def as_orders(rollup: DataFrame) -> DataFrame:
    """The rollup as one order per point and day, for any measure that adds up amounts of a window.

    Filters on ``paid_at`` become filters on the day.
    """
    return rollup.filter(F.col("lines") != 0).select(
        "point_id", (F.col("cents") / 100).alias("amount"), F.col("day").cast("timestamp_ntz").alias("paid_at"), "day", "lines"
    )


def trailing_days(table: DataFrame, as_of: X.TimeLike, days: int) -> DataFrame:
    """Closing days of the trailing window that ends at the midnight ``as_of``."""
    end = X.at(as_of).cast("date")
    return table.filter((F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end))


def first_days(rollup: DataFrame) -> DataFrame:
    """When each point was first seen, as far as its lines still stand."""
    seen = rollup.filter(F.col("seen") != 0)
    return seen.groupBy("point_id").agg(F.min("day").cast("timestamp_ntz").alias("first_operated"))


# --- distinct members -----------------------------------------------------------------


def member_bitmaps(facts: DataFrame, keys: Sequence[str], member: str, ts: str = "paid_at") -> DataFrame:
    """The members of each key and day as bitmaps of 64 neighbouring numbers each.

    Members are whole numbers, best dense ones such as a dimension's own keys. Bits are set on the map
    side, so a hot key sends one word a task, day and range of members; members far apart take no more
    than a row each, however many members there are. NULL members have no bit.
    """
    known = facts.filter(F.col(member).isNotNull())
    day, number = closing_day(ts).alias("day"), F.col(member).cast("bigint")
    block = F.shiftright(number, 6).alias("block")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))
    return known.groupBy(*keys, day, block).agg(F.bit_or(bit).alias("members"))


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of several days, batches or keys as one for each of ``keys`` and block."""
    return bitmaps.groupBy(*keys, "block").agg(F.bit_or("members").alias("members"))


def distinct_members(bitmaps: DataFrame, keys: Sequence[str], into: str = "members") -> DataFrame:
    """How many different members each key has, exactly."""
    merged = merged_bitmaps(bitmaps, keys)
    return merged.groupBy(*keys).agg(F.sum(F.bit_count("members")).alias(into))
