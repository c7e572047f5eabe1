"""Customer behaviour at points, and the age of machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.skew import salted_join
from stallwise.operators.clean import trailing, with_defaults, with_family


# --- who buys what --------------------------------------------------------------------


def gender_family_orders(
    orders: DataFrame, users: DataFrame, products: DataFrame, families: Sequence[str]
) -> DataFrame:
    """Orders per gender label and product family; accounts without a user do not count.

    Orders shrink to one row per (account, product) before users are looked up, and to one per
    (label, product) before product names are.
    """
    per_account = orders.groupBy("account", "product_id").agg(F.count(F.lit(1)).alias("orders"))
    per_product = (
        per_account.join(users.select("account", "gender_label"), "account", "inner")
        .groupBy("gender_label", "product_id")
        .agg(F.sum("orders").alias("orders"))
    )
    named = with_family(per_product.join(products, "product_id", "inner"), families=families)
    return named.groupBy("gender_label", "family").agg(F.sum("orders").alias("orders"))


def gender_product_buyers(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct buyers per gender label and product."""
    pairs = orders.select("account", "product_id").distinct()
    known = pairs.join(users.select("account", "gender_label"), "account", "inner")
    return known.groupBy("gender_label", "product_id").agg(F.count(F.lit(1)).alias("buyers"))


# --- point profile --------------------------------------------------------------------


def buyers(orders: DataFrame, member_payment: Column) -> DataFrame:
    """One row per (point, account): the grain on which all behaviour is measured."""
    return orders.groupBy("point_id", "account").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("amount").alias("total"),
        F.min("paid_at").alias("first_at"),
        F.max("paid_at").alias("last_at"),
        F.count_if(member_payment).alias("member_payments"),
    )


def point_profile(
    orders: DataFrame,
    users: DataFrame,
    machines: DataFrame,
    as_of: X.TimeLike,
    member_payment: Column,
    levels: Sequence[str],
    days: int = 7,
) -> DataFrame:
    """Behaviour of the buyers of each point in a window.

    Sales per machine and day, buyers, repeat buyers (two orders or more), their mean
    interval in days per order, whole days since the last sale, buyers per user level and
    member payments. ``users`` has account and level, ``machines`` point_id and machines.
    """
    per_buyer = buyers(trailing(orders, as_of, days), member_payment)
    per_buyer = per_buyer.join(users.select("account", "level"), "account", "left")
    repeat = F.col("orders") >= 2
    interval = X.whole_days("first_at", "last_at") / F.col("orders")
    per_point = per_buyer.groupBy("point_id").agg(
        F.sum("total").alias("total"),
        F.count(F.lit(1)).alias("buyers"),
        F.count_if(repeat).alias("repeat_buyers"),
        F.coalesce(F.avg(F.when(repeat, interval)), F.lit(0.0)).alias("repeat_interval"),
        F.max("last_at").alias("last_at"),
        F.count_if(X.is_filled("level")).alias("level_total"),
        *[F.count_if(F.col("level") == level).alias(f"level_{level.lower()}") for level in levels],
        F.sum("member_payments").alias("member_payments"),
    )
    equipped = per_point.join(machines, "point_id", "left")
    volume = X.per_machine_sales("total", F.lit(float(days)), "machines", days)
    return (
        equipped.withColumn("sales_per_machine", volume)
        .withColumn("idle_days", X.whole_days("last_at", X.at(as_of)))
        .drop("last_at", "total")
    )


def full_profile(profile: DataFrame, points: DataFrame, equipment: DataFrame, sites: DataFrame) -> DataFrame:
    """The behaviour of each point with its machines and its site in one row.

    ``points`` has point_id and site_id; ``equipment`` per point tenure_days, faulty_machines,
    products and vacancy_rate; ``sites`` per site households, fee and site_age_days. A point
    without figures has no fault, no product, and is vacant; what its site lacks stays NULL.
    """
    placed = points.select("point_id", "site_id").join(sites, "site_id", "left").join(equipment, "point_id", "left")
    wide = profile.join(placed, "point_id", "left")
    return with_defaults(wide, {"faulty_machines": 0, "products": 0, "vacancy_rate": 1.0, "tenure_days": 30})


# --- new users ------------------------------------------------------------------------


def new_users_weekly(
    orders: DataFrame, as_of: X.TimeLike, opened: DataFrame | None = None, bucket_days: int = 7
) -> DataFrame:
    """Accounts whose first purchase at a point falls into each week since it opened.

    Buckets run from the opening up to ``as_of``; those without a new user are 0, and the
    last one may be short. ``opened`` has point_id and opened_at; without it a point opens
    with its first order. The rows per point are bounded by the calendar.
    """
    # Stated here, the filters are the same for every use of ``first``, so Spark computes
    # it once and reuses the exchange.
    known = orders.filter((F.col("paid_at") < X.at(as_of)) & F.col("point_id").isNotNull())
    first = known.groupBy("point_id", "account").agg(F.min("paid_at").alias("first_at"))
    if opened is None:
        opened = first.groupBy("point_id").agg(F.min("first_at").alias("opened_at"))
    length = bucket_days * X.SECONDS_PER_DAY
    bucket = F.floor(X.elapsed_seconds("opened_at", "first_at") / length)
    found = (
        salted_join(first, opened, "point_id", spread_by="account")
        .filter(F.col("first_at") >= F.col("opened_at"))
        .groupBy("point_id", bucket.alias("week"))
        .agg(F.count(F.lit(1)).alias("new_users"))
    )
    seconds_open = X.elapsed_seconds("opened_at", X.at(as_of))
    weeks = F.sequence(F.lit(0).cast("bigint"), F.ceil(seconds_open / length) - 1)
    grid = opened.filter(F.col("opened_at") < X.at(as_of)).select(
        "point_id", F.explode(weeks).alias("week")
    )
    return grid.join(found, ["point_id", "week"], "left").withColumn(
        "new_users", F.coalesce("new_users", F.lit(0))
    )


# --- machines -------------------------------------------------------------------------


def first_logged(log: DataFrame, as_of: X.TimeLike) -> DataFrame:
    """Earliest log time per machine, before ``as_of``."""
    past = log.filter(F.col("logged_at") < X.at(as_of))
    return past.groupBy("machine_id").agg(F.min("logged_at").alias("first_logged_at"))


def machine_age(machines: DataFrame, log: DataFrame, as_of: X.TimeLike) -> DataFrame:
    """Fractional days since deployment and since the first log entry of each machine."""
    now = X.at(as_of)
    return machines.join(first_logged(log, as_of), "machine_id", "left").withColumns(
        {
            "deployed_days": X.fractional_days("deployed_at", now),
            "operating_days": X.fractional_days("first_logged_at", now),
        }
    )
