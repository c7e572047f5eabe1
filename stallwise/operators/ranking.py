"""Ranks, bands, exact quantiles, gaps and orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.functions import expr as X
from stallwise.functions.ranks import with_rank


def top_n(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, n: int = 3, into: str = "rank"
) -> DataFrame:
    """The n rows of each key with the greatest value, ties by ``tie`` ascending.

    Spark keeps only n rows per key and task before the shuffle (window group limit).
    """
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))
    ranked = df.withColumn(into, F.row_number().over(w)).filter(F.col(into) <= n)
    return ranked.withColumn(into, F.col(into).cast("bigint"))


def bands(
    df: DataFrame, keys: Sequence[str], value: str, name: str, legacy_median: bool = False
) -> DataFrame:
    """Best, top 10 %, median, bottom 10 % and worst members of each group, one row each.

    A tenth is ``n div 10``, one more when the remainder exceeds 4. An even group has two
    medians. With ``legacy_median`` an odd group takes rank ``n div 2``, which is one below
    the middle and none for a group of one. A member appears once per band it is in.
    """
    rn, n = F.col("rn"), F.col("n")
    half = F.floor(n / 2)
    odd_rank = half if legacy_median else half + 1
    tenth = F.floor(n / 10) + F.when(n % 10 > 4, 1).otherwise(0)
    member: dict[str, Column] = {
        "best": rn == n,
        "top": rn > n - tenth,
        "median": F.when(n % 2 == 1, rn == odd_rank).otherwise(rn.between(half, half + 1)),
        "bottom": rn <= tenth,
        "worst": rn == 1,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(b)) for b, c in member.items()]))
    ranked = with_rank(df.select(*keys, name, value), keys, [value, name])
    return ranked.select(*keys, F.explode(found).alias("band"), name, value, "rn", "n")


def five_numbers(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Trimmed five-number summary at exact ranks of the ascending values.

    0-based: second smallest, n div 5, n div 2, 4n div 5, second largest.
    """
    n = F.col("n")
    index = {
        "lower": F.lit(1),
        "q1": F.floor(n / 5),
        "middle": F.floor(n / 2),
        "q3": F.floor(n * 4 / 5),
        "upper": n - 2,
    }
    ranked = with_rank(df.select(*keys, name, value), keys, [value, name])
    i = F.col("rn") - 1
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(i == at, F.col(value))).alias(b) for b, at in index.items()]
    )


def purchase_gaps(orders: DataFrame) -> DataFrame:
    """Days between consecutive purchase days of an account, in order.

    An account has at most one row per calendar day after the distinct, which bounds both
    the window and the list. Accounts with a single day have no gap and are left out.
    """
    days = orders.select("account", X.day_of("paid_at").alias("day")).distinct()
    w = Window.partitionBy("account").orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    lists = gaps.filter(F.col("gap").isNotNull()).groupBy("account").agg(
        F.array_sort(F.collect_list(F.struct("day", "gap"))).alias("_gaps")
    )
    return lists.select(
        "account",
        (F.size("_gaps") + 1).cast("bigint").alias("purchase_days"),
        F.transform("_gaps", lambda g: g["gap"]).alias("gaps"),
    )


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
