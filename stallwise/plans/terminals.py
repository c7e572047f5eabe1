"""Queries on terminals by channel and area, and on ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.operators import clean, ranking, sales
from stallwise.plans.binding import (
    SQL_TERMINAL_SALES,
    SQL_VALID,
    all_lines,
    blocked_terminals,
    points,
    terminal_sales,
    terminals,
    valid_lines,
)
from stallwise.plans.registry import Tables, query, rounded
from stallwise.sources import writers

YEAR = ("1997-01-01 00:00:00", "1998-01-01 00:00:00")
MONTHS = tuple(f"1997-{m:02d}" for m in range(1, 13))
SQL_YEAR = "sold_at >= TIMESTAMP '1997-01-01' AND sold_at < TIMESTAMP '1998-01-01'"

_SQL_MONTH_MEAN = "sum(amount) / count(DISTINCT terminal_id)"


@query(
    "D15 C6 B7",
    f"""
WITH s AS ({SQL_TERMINAL_SALES}),
m AS (SELECT channel_id, strftime(sold_at, '%Y-%m') AS month, round({_SQL_MONTH_MEAN}, 7) AS mean
  FROM s WHERE NOT blocked AND {SQL_YEAR} GROUP BY 1, 2)
SELECT channel_id, {", ".join(f"max(mean) FILTER (WHERE month = '{m}') AS m{m[5:]}" for m in MONTHS)}
FROM m GROUP BY 1""",
)
def monthly_pivot(t: Tables) -> DataFrame:
    year = clean.between(terminal_sales(t), *YEAR, ts="sold_at")
    wide = sales.month_pivot(year, terminals(t), blocked_terminals(t), MONTHS)
    return rounded(wide, 7, *[c for c in wide.columns if c != "channel_id"])


def _area_channel_months(t: Tables) -> DataFrame:
    kept = clean.short_ids(terminals(t), "channel_id", 20)
    means = sales.channel_month_means(terminal_sales(t), kept, blocked_terminals(t))
    return rounded(means, 7, "mean_sales")


SQL_AREA_CHANNEL_MONTHS = f"""
SELECT area_id, channel_id, strftime(sold_at, '%Y-%m') AS month, round({_SQL_MONTH_MEAN}, 7) AS mean_sales
FROM ({SQL_TERMINAL_SALES}) WHERE NOT blocked AND length(channel_id) < 20 GROUP BY 1, 2, 3"""


@query("D16 B12 F3", SQL_AREA_CHANNEL_MONTHS)
def area_channel_month(t: Tables) -> DataFrame:
    return _area_channel_months(t)


# --- bands ----------------------------------------------------------------------------


def _sql_bands(rows: str, keys: str, name: str) -> str:
    tenth = "(n // 10 + CASE WHEN n % 10 > 4 THEN 1 ELSE 0 END)"
    member = {
        "best": "rn = n",
        "top": f"rn > n - {tenth}",
        "median": "CASE WHEN n % 2 = 1 THEN rn = (n + 1) // 2 ELSE rn IN (n // 2, n // 2 + 1) END",
        "bottom": f"rn <= {tenth}",
        "worst": "rn = 1",
    }
    ranked = (
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY mean_sales, {name}) AS rn, "
        f"count(*) OVER (PARTITION BY {keys}) AS n FROM rows"
    )
    parts = [
        f"SELECT {keys}, '{band}' AS band, {name}, mean_sales, rn, n FROM ranked WHERE {test}"
        for band, test in member.items()
    ]
    return f"WITH rows AS ({rows}), ranked AS ({ranked}) {' UNION ALL '.join(parts)}"


@query("E2 E5", _sql_bands(SQL_AREA_CHANNEL_MONTHS, "area_id, month", "channel_id"))
def channel_bands_small(t: Tables) -> DataFrame:
    return ranking.bands(_area_channel_months(t), ["area_id", "month"], "mean_sales", "channel_id")


@query(
    "E2 E5",
    _sql_bands(
        f"""SELECT n_regionkey AS area_id, strftime(l_shipdate, '%Y') AS year, p_brand AS brand,
    round(sum(l_extendedprice) / count(DISTINCT l_suppkey), 7) AS mean_sales
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey WHERE {SQL_VALID} GROUP BY 1, 2, 3""",
        "area_id, year",
        "brand",
    ),
)
def channel_bands(t: Tables) -> DataFrame:
    brands = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    year = F.date_format("paid_at", "yyyy").alias("year")
    # Sums per product first: what meets the products is no longer every line.
    per_product = valid_lines(t).groupBy("point_id", "product_id", year).agg(F.sum("amount").alias("total"))
    per_point = per_product.join(brands, "product_id").groupBy("point_id", "brand", "year").agg(F.sum("total").alias("total"))
    located = per_point.join(points(t).select("point_id", F.col("city").alias("area_id")), "point_id")
    means = located.groupBy("area_id", "year", "brand").agg(
        (F.sum("total") / F.count(F.lit(1))).alias("mean_sales")
    )
    return ranking.bands(rounded(means, 7, "mean_sales"), ["area_id", "year"], "mean_sales", "brand")


# --- five numbers ---------------------------------------------------------------------

# Here a terminal is a supplier, which sells in most months, and its channel the region; those
# with a negative balance are blocked.
SQL_TERMINAL_MEANS = f"""
SELECT channel_id, terminal_id, round(sum(total) / 12, 4) AS mean_sales FROM (
  SELECT n_regionkey AS channel_id, l_suppkey AS terminal_id, strftime(l_shipdate, '%Y-%m') AS month, sum(l_extendedprice) AS total
  FROM (SELECT *, l_shipdate AS sold_at FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE s_acctbal >= 0 AND {SQL_YEAR} GROUP BY ALL)
GROUP BY 1, 2 HAVING count(*) > 7
QUALIFY count(*) OVER (PARTITION BY channel_id) > 10"""


def _terminal_means(t: Tables) -> DataFrame:
    sold = all_lines(t).select(F.col("point_id").alias("terminal_id"), "amount", F.col("paid_at").alias("sold_at"))
    placed = points(t).select(F.col("point_id").alias("terminal_id"), F.col("city").alias("channel_id"))
    blocked = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("terminal_id"))
    return rounded(sales.terminal_year_means(sold, placed, YEAR, blocked), 4, "mean_sales")


@query("D18", SQL_TERMINAL_MEANS)
def terminal_year_mean(t: Tables) -> DataFrame:
    return _terminal_means(t).select("channel_id", "terminal_id", "mean_sales")


def _sql_five(rows: str, keys: str) -> str:
    index = {"lower": "1", "q1": "n // 5", "middle": "n // 2", "q3": "4 * n // 5", "upper": "n - 2"}
    ranked = (
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY mean_sales, terminal_id) - 1 AS i, "
        f"count(*) OVER (PARTITION BY {keys}) AS n FROM ({rows})"
    )
    picks = ", ".join(f"max(mean_sales) FILTER (WHERE i = {at}) AS {b}" for b, at in index.items())
    return f"SELECT {keys}, max(n) AS n, {picks} FROM ({ranked}) GROUP BY {keys}"


@query("E3 E5", _sql_five(SQL_TERMINAL_MEANS, "channel_id"))
def five_number(t: Tables) -> DataFrame:
    return ranking.five_numbers(_terminal_means(t), ["channel_id"], "mean_sales", "terminal_id")


_SQL_MONTH_BOXES = _sql_five(
    f"""SELECT channel_id, strftime(sold_at, '%Y-%m') AS month, terminal_id,
  round(sum(amount), 2) AS mean_sales FROM ({SQL_TERMINAL_SALES}) WHERE {SQL_YEAR} GROUP BY 1, 2, 3""",
    "channel_id, month",
)


@query(
    "D17",
    "SELECT channel_id, "
    + ", ".join(f"round(sum({b}) / 12, 4) AS {b}" for b in ("lower", "q1", "middle", "q3", "upper"))
    + f" FROM ({_SQL_MONTH_BOXES}) GROUP BY 1",
)
def channel_year_mean(t: Tables) -> DataFrame:
    year = clean.between(terminal_sales(t), *YEAR, ts="sold_at")
    months = year.groupBy("terminal_id", X.month_of("sold_at").alias("month")).agg(
        F.round(F.sum("amount"), 2).alias("mean_sales")
    )
    located = months.join(terminals(t).select("terminal_id", "channel_id"), "terminal_id")
    boxes = ranking.five_numbers(located, ["channel_id", "month"], "mean_sales", "terminal_id")
    means = sales.box_year_means(boxes)
    return rounded(means, 4, "lower", "q1", "middle", "q3", "upper")


# --- order ----------------------------------------------------------------------------


@query(
    "E1",
    """
SELECT p_type, p_partkey, count(*) AS n,
  row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_partkey) AS rank
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
QUALIFY rank <= 3""",
)
def top3_per_type(t: Tables) -> DataFrame:
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    typed = sold.join(t.part.select("p_partkey", "p_type"), "p_partkey")
    return ranking.top_n(typed, ["p_type"], "n", "p_partkey").select("p_type", "p_partkey", "n", "rank")


@query(
    "E4 F7",
    """
WITH days AS (SELECT DISTINCT o_custkey AS account, CAST(o_orderdate AS DATE) AS day FROM orders),
gaps AS (SELECT account, day, date_diff('day', lag(day) OVER (PARTITION BY account ORDER BY day), day) AS gap FROM days)
SELECT account, count(*) + 1 AS purchase_days, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY day) AS gaps
FROM gaps WHERE gap IS NOT NULL GROUP BY 1""",
)
def purchase_gaps(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("paid_at"))
    gaps = ranking.purchase_gaps(orders)
    return gaps.select("account", "purchase_days", F.array_join(F.col("gaps").cast("array<string>"), ",").alias("gaps"))


@query("E6", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def first_n(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.first_n(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query(
    "E9",
    """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ordered, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    last = writers.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered")
    return last.select("o_custkey", "o_orderkey", day, "o_totalprice")
