"""How the notions of the domain map to the test tables, in Spark and in SQL.

Point = supplier, site = nation, city = region, account = customer, product = part; a
promotion order is a returned line, a member payment a line with status F. In the second
family a terminal is a customer, its channel the market segment, its area the region.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.work import input_files, lasting_path
from stallwise.operators import clean, dims
from stallwise.plans.registry import Tables
from stallwise.sources.writers import kept_up

AS_OF = "2001-01-01 00:00:00"
CAP = 95000.0
CLOSED_REGION = "ASIA"

SQL_AS_OF = "TIMESTAMP '2001-01-01 00:00:00'"
SQL_VALID = "l_returnflag <> 'R' AND l_extendedprice < 95000"


def sql_window(days: int, ts: str = "l_shipdate") -> str:
    return f"{ts} > {SQL_AS_OF} - INTERVAL {days} DAY AND {ts} <= {SQL_AS_OF}"


# Tenure by the given grouping column, over all rows.
def sql_tenure(key: str, alias: str) -> str:
    return (
        f"SELECT {key} AS {alias}, date_diff('day', min(l_shipdate), {SQL_AS_OF}) AS tenure "
        f"FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"
    )


def all_lines(t: Tables) -> DataFrame:
    """Every order line under the domain's names."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("point_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("paid_at"),
        (F.col("l_returnflag") == "R").alias("is_promotion"),
        (F.col("l_linestatus") == "F").alias("is_member_payment"),
    )


def valid_lines(t: Tables) -> DataFrame:
    """Lines without promotions and high-value orders."""
    return clean.below_cap(clean.without_promotions(all_lines(t), F.col("is_promotion")), CAP)


def with_account(lines: DataFrame, t: Tables) -> DataFrame:
    owners = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"))
    return lines.join(owners, "order_id", "inner")


def points(t: Tables) -> DataFrame:
    """One row per supplier with its site and city.

    Type '1' is underground; a few points have no known type.
    """
    located = t.supplier.join(t.nation, t.supplier.s_nationkey == t.nation.n_nationkey)
    kind = F.when(F.col("s_acctbal") < 0, "1").when(F.col("s_acctbal") <= 9000, "0")
    return located.select(
        F.col("s_suppkey").alias("point_id"),
        F.col("s_name").alias("point_name"),
        F.col("n_nationkey").alias("site_id"),
        F.col("n_regionkey").alias("city"),
        kind.alias("point_type"),
    )


def sites(t: Tables) -> DataFrame:
    located = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey)
    return located.select(
        F.col("n_nationkey").alias("site_id"),
        F.col("n_name").alias("site_name"),
        F.col("r_name").alias("city_name"),
    )


def first_seen_points(t: Tables) -> DataFrame:
    """The first-seen table of all points, kept in the shared folder for every application.

    Files of lines that it has not seen yet are read and merged, once; the queries read the table and scan
    only their own window.
    """
    path = lasting_path(t.spark, f"first-seen-{sha256(t.folder.encode()).hexdigest()[:16]}")

    def fresh(files: list[str]) -> DataFrame:
        part = Tables(t.spark, t.folder, {"lineitem": t.spark.read.schema(t.lineitem.schema).parquet(*files)})
        return dims.first_seen(all_lines(part).select("point_id", "paid_at"), "point_id")

    def merged(known: DataFrame, more: DataFrame) -> DataFrame:
        return known.unionByName(more).groupBy("point_id").agg(F.min("first_operated").alias("first_operated"))

    return kept_up(t.spark, path, input_files(t.spark, t.path("lineitem")), fresh, merged)


def point_tenure(t: Tables) -> DataFrame:
    return dims.with_tenure(first_seen_points(t), AS_OF)


def site_tenure(t: Tables) -> DataFrame:
    return dims.rolled_up_stats(point_tenure(t), points(t), "site_id", AS_OF)


def aged_sites(t: Tables) -> DataFrame:
    """Sites with their names and tenure."""
    return sites(t).join(site_tenure(t).select("site_id", "tenure_days"), "site_id", "inner")


def machines_at_points(t: Tables, days: int = 30) -> DataFrame:
    """Machines of a point: the distinct products it sold lately, one per machine."""
    lately = clean.trailing(all_lines(t), AS_OF, days)
    return lately.groupBy("point_id").agg(F.count_distinct("product_id").alias("machines"))


def equipment(t: Tables) -> DataFrame:
    """Tenure, faults, products and vacancy of each point: one pass over its last month."""
    last_week = X.in_trailing("paid_at", AS_OF, 7)
    month = clean.trailing(all_lines(t), AS_OF, 30).groupBy("point_id").agg(
        F.count_distinct("product_id").alias("_slots"),
        F.count_if(last_week & F.col("is_promotion")).alias("faulty_machines"),
        F.count_distinct(F.when(last_week, F.col("product_id"))).alias("products"),
    )
    vacancy = (1 - F.col("products") / F.col("_slots")).alias("vacancy_rate")
    rates = month.select("point_id", "faulty_machines", "products", vacancy)
    return point_tenure(t).select("point_id", "first_operated", "tenure_days").join(rates, "point_id", "left")


def households(t: Tables) -> DataFrame:
    """Households and fee of a site: its customers and their mean balance."""
    return t.customer.groupBy(F.col("c_nationkey").alias("site_id")).agg(
        F.count(F.lit(1)).alias("households"), F.round(F.avg("c_acctbal"), 4).alias("fee")
    )


SQL_EQUIPMENT = f"""
SELECT o.point_id, o.first, date_diff('day', o.first, {SQL_AS_OF}) AS tenure_days, coalesce(faulty_machines, 0) AS faulty_machines,
  coalesce(products, 0) AS products, coalesce(1 - products / slots, 1.0) AS vacancy_rate
FROM (SELECT l_suppkey AS point_id, min(l_shipdate) AS first FROM lineitem GROUP BY 1) o LEFT JOIN (
  SELECT l_suppkey AS point_id, count(DISTINCT l_partkey) AS slots,
    count(*) FILTER (WHERE l_returnflag = 'R' AND {sql_window(7)}) AS faulty_machines,
    count(DISTINCT l_partkey) FILTER (WHERE {sql_window(7)}) AS products
  FROM lineitem WHERE {sql_window(30)} GROUP BY 1) m ON o.point_id = m.point_id"""
SQL_HOUSEHOLDS = "SELECT c_nationkey AS site_id, count(*) AS households, round(avg(c_acctbal), 4) AS fee FROM customer GROUP BY 1"

SQL_MACHINES = (
    "SELECT l_suppkey AS point_id, count(DISTINCT l_partkey) AS machines FROM lineitem "
    f"WHERE {sql_window(30)} GROUP BY 1"
)


# --- terminals ------------------------------------------------------------------------


def terminal_sales(t: Tables) -> DataFrame:
    kept = t.orders.filter(F.col("o_orderstatus") != "P")
    return kept.select(
        F.col("o_custkey").alias("terminal_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("sold_at"),
    )


def terminals(t: Tables) -> DataFrame:
    located = t.customer.join(t.nation, t.customer.c_nationkey == t.nation.n_nationkey)
    return located.select(
        F.col("c_custkey").alias("terminal_id"),
        F.col("c_mktsegment").alias("channel_id"),
        F.col("n_regionkey").alias("area_id"),
    )


def blocked_terminals(t: Tables) -> DataFrame:
    """The block list: terminals with a negative balance."""
    return t.customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("terminal_id"))


SQL_TERMINAL_SALES = (
    "SELECT o_custkey AS terminal_id, o_totalprice AS amount, o_orderdate AS sold_at, "
    "c_mktsegment AS channel_id, n_regionkey AS area_id, c_acctbal < 0 AS blocked "
    "FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P'"
)


# --- machines and logs ----------------------------------------------------------------


def device_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("machine_id"), F.col("ts").alias("logged_at"), "event_type"
    )


def click_lines(t: Tables) -> DataFrame:
    """Tab-separated click log rebuilt from the events.

    Clicks and purchases are requests for a course; purchases carry no referer.
    """
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    course = F.regexp_extract("props", r'"k": (\d+)', 1)
    folder = F.when(kind.isin("click", "purchase"), "/class/").otherwise("/other/")
    host = F.concat(F.lit("https://s"), F.substring(user, 1, 1), F.lit(".example.com"))
    referer = F.concat(host, F.lit("//search?q="), course)
    line = F.concat_ws(
        "\t",
        F.concat(F.lit("10.0.0."), user),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.lit("GET "), folder, course, F.lit(".html HTTP/1.1")),
        F.lit("200"),
        F.when(kind == "purchase", "-").otherwise(referer),
    )
    return t.events.select(line.alias("value"))


SQL_CLICKS = (
    "SELECT strftime(ts, '%Y%m%d') AS day, "
    "CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) AS course_id, "
    "CASE WHEN event_type = 'click' "
    "THEN 's' || substr(CAST(user_id AS VARCHAR), 1, 1) || '.example.com' END AS host "
    "FROM events WHERE event_type IN ('click', 'purchase')"
)
