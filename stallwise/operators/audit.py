"""Audits: idle and orphan members, reconciliation, cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.skew import salted_join
from stallwise.operators.clean import trailing


def idle_points(points: DataFrame, orders: DataFrame, as_of: X.TimeLike, days: int = 15) -> DataFrame:
    """Points of the dimension without an order in the window."""
    sold = trailing(orders, as_of, days).select("point_id").distinct()
    return points.join(sold, "point_id", "left_anti")


def idle_points_per_site(
    points: DataFrame, orders: DataFrame, as_of: X.TimeLike, days: int = 15
) -> DataFrame:
    idle = idle_points(points, orders, as_of, days)
    return idle.groupBy("site_id").agg(F.count(F.lit(1)).alias("idle_points"))


def idle_sites(
    sites: DataFrame,
    points: DataFrame,
    orders: DataFrame,
    as_of: X.TimeLike,
    days: int = 7,
    operating: DataFrame | None = None,
) -> DataFrame:
    """Sites of the dimension without an order in the window, with 0 sales."""
    sold_points = trailing(orders, as_of, days).select("point_id").distinct()
    sold = points.join(sold_points, "point_id", "left_semi").select("site_id").distinct()
    idle = sites.join(sold, "site_id", "left_anti").withColumn("daily_sales", F.lit(0.0))
    return idle if operating is None else idle.join(operating, "site_id", "left")


def orphan_sites(orders: DataFrame, tree: DataFrame, communities: DataFrame) -> DataFrame:
    """Sites seen in orders whose community is not a live one.

    A site that the tree does not know has a NULL community, which matches nothing, so it
    is an orphan too.
    """
    seen = orders.select("site_id").distinct()
    known = seen.join(tree.select("site_id", "community_id"), "site_id", "left")
    return known.join(communities.select("community_id").distinct(), "community_id", "left_anti")


def orphan_ids(dim: DataFrame, sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Ids that occur in any source but not in the dimension."""
    return union_ids(sources, key).join(dim.select(key), key, "left_anti")


def union_ids(sources: Sequence[DataFrame], key: str) -> DataFrame:
    # Distinct before the union as well: each source then ships its ids only once.
    parts = [s.select(key).distinct() for s in sources]
    return reduce(DataFrame.unionByName, parts).distinct()


def minus_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    # A key may repeat very often on either side; distinct, it crosses the shuffle once per task.
    return left.select(key).distinct().subtract(right.select(key).distinct())


def reconciled_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Distinct names of both lists side by side: ``both``, ``left`` or ``right`` only."""
    a = left.select(F.col(name).alias("left_name"), F.lit(True).alias("_left")).distinct()
    b = right.select(F.col(name).alias("right_name"), F.lit(True).alias("_right")).distinct()
    # By marks, since an unknown (NULL) name is on its side only, whatever the other holds.
    side = F.when(F.col("_right").isNull(), "left").when(F.col("_left").isNull(), "right").otherwise("both")
    joined = a.join(b, F.col("left_name") == F.col("right_name"), "full")
    return joined.withColumn("side", side).drop("_left", "_right")


def cohort_rows(
    rows: DataFrame, cohorts: Mapping[str, DataFrame], key: str = "site_id", spread_by: str | None = None
) -> DataFrame:
    """Rows of each cohort (a list of ids), with the cohort's name; one join for all.

    ``spread_by`` names another stored column where one id may hold a large share of the rows.
    """
    members = reduce(
        DataFrame.unionByName,
        [ids.select(key).distinct().withColumn("cohort", F.lit(name)) for name, ids in cohorts.items()],
    )
    return rows.join(members, key) if spread_by is None else salted_join(rows, members, key, spread_by)


def never_logged(machines: DataFrame, log: DataFrame) -> DataFrame:
    """Machines without any entry in the log."""
    return machines.join(log.select("machine_id").distinct(), "machine_id", "left_anti")
