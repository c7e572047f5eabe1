"""Sales measures of points, sites, machines and terminals.

Every measure is built from algebraic aggregates in two steps: first per point (or terminal),
which combines on the map side however hot the point is, then per site, city or channel over
one row per point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.skew import salted_join
from stallwise.operators.clean import in_band, tenured, trailing

CENTS = 100


# --- basic aggregates -----------------------------------------------------------------


def totals(df: DataFrame, keys: Sequence[str], amount: str = "amount", into: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(amount).alias(into))


def counts(df: DataFrame, keys: Sequence[str], into: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(into))


def distinct_counts(
    df: DataFrame, keys: Sequence[str], of: str, into: str = "n", approximate: bool = False
) -> DataFrame:
    """Distinct members per key. Spark first groups by (key, member), which splits hot keys."""
    measure = F.approx_count_distinct(of) if approximate else F.count_distinct(F.col(of))
    return df.groupBy(*keys).agg(measure.alias(into))


def distinct_total(df: DataFrame, column: str, into: str = "n") -> DataFrame:
    return df.agg(F.count_distinct(F.col(column)).alias(into))


def promotion_users(orders: DataFrame, promotion: Column) -> DataFrame:
    """Distinct accounts per point that bought on promotion."""
    return distinct_counts(orders.filter(promotion), ["point_id"], "account", "promo_users")


def _per_point(orders: DataFrame, as_of: X.TimeLike, days: int) -> DataFrame:
    return totals(trailing(orders, as_of, days), ["point_id"])


def _per_site(per_point: DataFrame, points: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    located = per_point.join(points.select("point_id", *keys), "point_id", "inner")
    return totals(located, keys, "total")


# --- daily means ----------------------------------------------------------------------


def daily_sales(
    window_totals: DataFrame, tenure: DataFrame, key: str, days: int, min_tenure: int
) -> DataFrame:
    """Mean sales per day of members older than ``min_tenure`` days."""
    aged = tenured(tenure.select(key, "tenure_days"), min_tenure)
    divisor = X.window_days("tenure_days", days)
    return window_totals.join(aged, key, "inner").select(
        key, (F.col("total") / divisor / CENTS).alias("daily_sales")
    )


def site_daily_sales(
    orders: DataFrame,
    points: DataFrame,
    sites: DataFrame,
    as_of: X.TimeLike,
    days: int = 15,
    min_tenure: int = 15,
    at_least: float | None = None,
    at_most: float | None = None,
) -> DataFrame:
    """Mean daily sales per site, optionally only the good or the bad ones.

    ``sites`` carries site_id and tenure_days.
    """
    window = _per_site(_per_point(orders, as_of, days), points)
    means = daily_sales(window, sites, "site_id", days, min_tenure)
    return in_band(means, "daily_sales", at_least, at_most)


def point_daily_sales(
    orders: DataFrame, tenure: DataFrame, as_of: X.TimeLike, days: int = 15, min_tenure: int = 15
) -> DataFrame:
    return daily_sales(_per_point(orders, as_of, days), tenure, "point_id", days, min_tenure)


def point_band_counts(
    orders: DataFrame,
    points: DataFrame,
    tenure: DataFrame,
    as_of: X.TimeLike,
    days: int = 15,
    min_tenure: int = 15,
    good: float = 60,
    bad: float = 5,
) -> DataFrame:
    """Good and bad points per site by their mean daily sales."""
    means = point_daily_sales(orders, tenure, as_of, days, min_tenure)
    located = means.join(points.select("point_id", "site_id"), "point_id", "inner")
    return located.groupBy("site_id").agg(
        F.count_if(F.col("daily_sales") >= good).alias("good_points"),
        F.count_if(F.col("daily_sales") <= bad).alias("bad_points"),
    )


# --- tiers ----------------------------------------------------------------------------


def site_tiers(
    orders: DataFrame,
    points: DataFrame,
    sites: DataFrame,
    as_of: X.TimeLike,
    days: int = 7,
    tiers: Sequence[int] = (30, 60, 100),
    fixed_days: bool = False,
) -> DataFrame:
    """Daily sales of a site and how many of its points reach each daily amount.

    Counts are cumulative and come for all points, above-ground and underground ones
    (point_type '1' is underground). A point without a known type counts in "all" only.
    ``sites`` carries site_id, tenure_days and any attributes to pass through. The divisor
    is the tenure when that is shorter than the window, unless ``fixed_days``.
    """
    per_point = _per_point(orders, as_of, days)
    located = per_point.join(points.select("point_id", "site_id", "point_type"), "point_id", "inner")
    # A site may hold a large share of the points, and the next step groups by site again.
    located = salted_join(located, sites, "site_id", spread_by="point_id")
    divisor = F.lit(float(days)) if fixed_days else X.window_days("tenure_days", days)
    daily = located.withColumn("daily", F.col("total") / divisor / CENTS)
    underground = F.col("point_type") == "1"
    groups = {"all": F.lit(True), "ground": ~underground, "underground": underground}
    measures = [F.sum("daily").alias("daily_sales")]
    for name, member in groups.items():
        measures.append(F.count_if(member).alias(f"{name}_points"))
        measures += [
            F.count_if(member & (F.col("daily") >= t)).alias(f"{name}_{t}") for t in tiers
        ]
    result = daily.groupBy(*sites.columns).agg(*measures)
    for name in groups:
        parts = [f"{name}_{t}" for t in sorted(tiers, reverse=True)] + [f"{name}_points"]
        result = result.withColumn(f"{name}_label", X.ratio_label(*parts))
    return result


# --- point facts ----------------------------------------------------------------------


def point_fact(
    orders: DataFrame,
    points: DataFrame,
    sites: DataFrame,
    as_of: X.TimeLike,
    machines: DataFrame | None = None,
    assortment: DataFrame | None = None,
    days: int = 7,
    poor_at_most: float = 40,
) -> DataFrame:
    """Every point with its window sales (0 without any), its site, and a poor-seller flag.

    ``machines`` and ``assortment`` are per point; figures they lack stay NULL.
    """
    money = _per_point(orders, as_of, days).select("point_id", (F.col("total") / CENTS).alias("sales"))
    in_site = counts(points, ["site_id"], "points_in_site")
    fact = points.join(money, "point_id", "left").withColumn("sales", F.coalesce("sales", F.lit(0.0)))
    for extra in (machines, assortment):
        if extra is not None:
            fact = fact.join(extra, "point_id", "left")
    # Both are one row per site: joined first, so that the points are joined once.
    fact = salted_join(fact, sites.join(in_site, "site_id", "left"), "site_id", "point_id", "left")
    return fact.withColumn("is_poor", F.col("sales") <= poor_at_most)


def coefficient_of_variation(
    orders: DataFrame,
    points: DataFrame,
    sites: DataFrame,
    as_of: X.TimeLike,
    days: int = 20,
    min_tenure: int = 30,
    min_total: float = 15000,
    at_least: float = 0.7,
    include_idle: bool = False,
) -> DataFrame:
    """Spread of sales over the points of a site: population deviation over mean.

    Points without a sale are left out unless ``include_idle``, where they count as 0.
    """
    per_point = _per_point(orders, as_of, days)
    located = points.select("point_id", "site_id").join(
        per_point, "point_id", "left" if include_idle else "inner"
    )
    located = located.withColumn("total", F.coalesce("total", F.lit(0.0)))
    per_site = located.groupBy("site_id").agg(
        F.try_divide(F.stddev_pop("total"), F.avg("total")).alias("cv"),
        F.sum("total").alias("total"),
    )
    kept = in_band(per_site.filter(F.col("total") > min_total), "cv", at_least)
    return kept.join(tenured(sites, min_tenure), "site_id", "inner")


def scaled_to_max(values: DataFrame, key: str, value: str = "total", spread_by: str = "point_id") -> DataFrame:
    """Each value over the greatest one of its group; a missing value counts as 0.

    The maximum is aggregated and joined back, since a window would gather a hot group in
    one task. ``spread_by`` tells the rows of a group apart.
    """
    filled = values.withColumn(value, F.coalesce(value, F.lit(0.0)))
    tops = filled.groupBy(key).agg(F.max(value).alias("_top"))
    scaled = F.try_divide(F.col(value), F.col("_top"))
    return salted_join(filled, tops, key, spread_by).withColumn("scaled", scaled).drop("_top")


def points_of_sites(points: DataFrame) -> DataFrame:
    """The points of each site, one row each, with the size of the list.

    A site may hold a large share of all points, so the list stays in rows.
    """
    pairs = points.select("site_id", "point_id").distinct()
    return salted_join(pairs, counts(pairs, ["site_id"], "points"), "site_id", "point_id")


# --- sales per machine ----------------------------------------------------------------


def machine_sales(
    orders: DataFrame,
    points: DataFrame,
    machines: DataFrame,
    seen: DataFrame,
    as_of: X.TimeLike,
    grains: Sequence[str] = ("city", "site_id", "point_id"),
    windows: Sequence[int] = (7, 30),
) -> DataFrame:
    """Volume per machine and day over each window, at every grain and in total, in one pass.

    ``machines`` has point_id and machines, ``seen`` point_id and first_operated. Tenure of a
    grain starts with its first order. Only the longest window of the orders is read.
    """
    per_point = trailing(orders, as_of, max(windows)).groupBy("point_id").agg(
        *[
            F.sum(F.when(X.in_trailing("paid_at", as_of, d), F.col("quantity"))).alias(f"volume_{d}d")
            for d in windows
        ],
    )
    located = points.select(*dict.fromkeys(["point_id", *grains]))
    first = seen.select("point_id", F.col("first_operated").alias("first"))
    wide = first.join(per_point, "point_id", "left").join(located, "point_id", "inner")
    wide = wide.join(machines, "point_id", "left")
    sets = [[F.col(g)] for g in grains]
    grouped = wide.groupingSets([[], *sets], *grains).agg(
        F.min("first").alias("first"),
        F.sum("machines").alias("machines"),
        *[F.sum(f"volume_{d}d").alias(f"volume_{d}d") for d in windows],
        *[F.grouping(g).alias(f"_no_{g}") for g in grains],
    )
    grain, ident = F.lit("all"), F.lit("all")
    for g in grains:
        grain = F.when(F.col(f"_no_{g}") == 0, F.lit(g)).otherwise(grain)
        ident = F.when(F.col(f"_no_{g}") == 0, F.col(g).cast("string")).otherwise(ident)
    tenure = X.calendar_days("first", X.at(as_of))
    return grouped.select(
        grain.alias("grain"),
        ident.alias("id"),
        *[F.coalesce(f"volume_{d}d", F.lit(0.0)).alias(f"volume_{d}d") for d in windows],
        *[X.per_machine_sales(f"volume_{d}d", tenure, "machines", d).alias(f"sales_{d}d") for d in windows],
    )


def sales_with_operations(volumes: DataFrame, operations: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Sales per machine from two stored statistics feeds joined on ``id``."""
    joined = volumes.join(operations.select("id", "tenure_days", "machines"), "id", "left")
    return joined.select(
        X.strip_marks("id", "(").alias("id"),
        *[
            X.per_machine_sales(
                X.number(f"volume_{d}d"), X.number("tenure_days"), X.number("machines"), d
            ).alias(f"sales_{d}d")
            for d in windows
        ],
    )


# --- terminals ------------------------------------------------------------------------


def _terminal_months(sales: DataFrame) -> DataFrame:
    month = X.month_of("sold_at").alias("month")
    return sales.groupBy("terminal_id", month).agg(F.sum("amount").alias("total"))


def channel_month_means(
    sales: DataFrame,
    terminals: DataFrame,
    blocked: DataFrame,
    keys: Sequence[str] = ("area_id", "channel_id"),
) -> DataFrame:
    """Mean sales per terminal and month of each key, without block-listed terminals.

    One row per (terminal, month) makes the distinct terminals a plain count.
    """
    allowed = terminals.select("terminal_id", *keys).join(blocked, "terminal_id", "left_anti")
    located = _terminal_months(sales).join(allowed, "terminal_id", "inner")
    return located.groupBy(*keys, "month").agg(
        (F.sum("total") / F.count(F.lit(1))).alias("mean_sales")
    )


def month_pivot(
    sales: DataFrame,
    terminals: DataFrame,
    blocked: DataFrame,
    months: Sequence[str],
    key: str = "channel_id",
) -> DataFrame:
    """Monthly means of a channel side by side; a month without a sale is NULL."""
    means = channel_month_means(sales, terminals, blocked, [key])
    wide = means.groupBy(key).pivot("month", list(months)).agg(F.first("mean_sales"))
    return wide.select(key, *[F.col(f"`{m}`").alias(f"m{m[5:]}") for m in months])


def box_year_means(rows: DataFrame, key: str = "channel_id") -> DataFrame:
    """Yearly mean of the five box measures; the divisor is 12 even if a month is missing."""
    box = ("lower", "q1", "middle", "q3", "upper")
    return rows.groupBy(key).agg(*[(F.sum(c) / 12).alias(c) for c in box])


def terminal_year_means(
    sales: DataFrame,
    terminals: DataFrame,
    year: tuple[X.TimeLike, X.TimeLike],
    blocked: DataFrame | None = None,
    min_records: int = 7,
    min_terminals: int = 10,
) -> DataFrame:
    """Monthly mean over one year of terminals with more than ``min_records`` months of sales, in
    channels that have more than ``min_terminals`` such terminals.

    A record is a month with sales; the divisor is 12 whatever their number. Blocked
    terminals and those without an id are left out.
    """
    within = sales.filter(X.in_range("sold_at", *year) & F.col("terminal_id").isNotNull())
    per_terminal = _terminal_months(within).groupBy("terminal_id").agg(
        (F.sum("total") / 12).alias("mean_sales"), F.count(F.lit(1)).alias("records")
    )
    kept = per_terminal.filter(F.col("records") > min_records).drop("records")
    if blocked is not None:
        kept = kept.join(blocked.select("terminal_id"), "terminal_id", "left_anti")
    located = kept.join(terminals.select("terminal_id", "channel_id"), "terminal_id", "inner")
    sizes = counts(located, ["channel_id"], "terminals").filter(F.col("terminals") > min_terminals)
    return salted_join(located, sizes, "channel_id", "terminal_id")


# --- marker product -------------------------------------------------------------------


def marker_sites(
    orders: DataFrame,
    products: DataFrame,
    points: DataFrame,
    sites: DataFrame,
    marker: Column,
    as_of: X.TimeLike | None = None,
    days: int = 20,
    min_tenure: int = 20,
) -> DataFrame:
    """Sites that sold the marker product: how often, and the sales of everything else.

    With ``as_of``, only orders of the window and sites older than ``min_tenure`` count. Orders
    shrink to one row per (point, product) before the products are looked up.
    """
    rows = orders if as_of is None else trailing(orders, as_of, days)
    per_product = rows.groupBy("point_id", "product_id").agg(
        F.count(F.lit(1)).alias("_orders"), F.sum("amount").alias("_amount")
    )
    per_point = per_product.join(products, "product_id").groupBy("point_id").agg(
        F.sum(F.when(marker, F.col("_orders")).otherwise(0)).alias("marker_orders"),
        F.sum(F.when(~marker, F.col("_amount"))).alias("others"),
    )
    located = per_point.join(points.select("point_id", "site_id"), "point_id", "inner")
    per_site = located.groupBy("site_id").agg(
        F.sum("marker_orders").alias("marker_orders"),
        (F.coalesce(F.sum("others"), F.lit(0.0)) / CENTS).alias("other_sales"),
    )
    found = per_site.filter(F.col("marker_orders") > 0)
    aged = sites if as_of is None else tenured(sites, min_tenure)
    return found.join(aged, "site_id", "inner")
