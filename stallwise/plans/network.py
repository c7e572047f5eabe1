"""Queries on the network of points, sites and cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.operators import audit, clean, dims, sales
from stallwise.plans.binding import (
    AS_OF,
    CLOSED_REGION,
    SQL_AS_OF,
    SQL_EQUIPMENT,
    SQL_HOUSEHOLDS,
    SQL_MACHINES,
    SQL_VALID,
    aged_sites,
    all_lines,
    equipment,
    first_seen_points,
    households,
    machines_at_points,
    point_tenure,
    points,
    site_tenure,
    sites,
    sql_tenure,
    sql_window,
    valid_lines,
    with_account,
)
from stallwise.plans.registry import Tables, query, rounded, shown

# --- daily means ----------------------------------------------------------------------


def _sql_site_means(having: str) -> str:
    return f"""
WITH tenure AS ({sql_tenure("s_nationkey", "site_id")}),
sold AS (
  SELECT s_nationkey AS site_id, sum(l_extendedprice) AS total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE {SQL_VALID} AND {sql_window(15)} GROUP BY 1),
means AS (
  SELECT site_id, total / least(tenure, 15) / 100 AS daily_sales
  FROM sold JOIN tenure USING (site_id) WHERE tenure > 15)
SELECT site_id, round(daily_sales, 4) AS daily_sales FROM means WHERE {having}"""


def site_means(t: Tables, at_least: float | None = None, at_most: float | None = None) -> DataFrame:
    return sales.site_daily_sales(
        valid_lines(t), points(t), site_tenure(t), AS_OF, at_least=at_least, at_most=at_most
    )


@query("D1 D6 B4 B5 B6 B8 B22", _sql_site_means("daily_sales >= 250"))
def site_daily_sales(t: Tables) -> DataFrame:
    return rounded(site_means(t, at_least=250), 4, "daily_sales")


@query("D6 B22", _sql_site_means("daily_sales <= 150"))
def site_daily_sales_low(t: Tables) -> DataFrame:
    return rounded(site_means(t, at_most=150), 4, "daily_sales")


@query(
    "D7",
    f"""
WITH tenure AS ({sql_tenure("l_suppkey", "point_id")}),
sold AS (
  SELECT l_suppkey AS point_id, sum(l_extendedprice) AS total FROM lineitem
  WHERE {SQL_VALID} AND {sql_window(7)} GROUP BY 1),
means AS (
  SELECT point_id, total / least(tenure, 7) / 100 AS daily
  FROM sold JOIN tenure USING (point_id) WHERE tenure > 15)
SELECT s_nationkey AS site_id, count(*) FILTER (WHERE daily >= 60) AS good_points,
  count(*) FILTER (WHERE daily <= 5) AS bad_points
FROM means JOIN supplier ON point_id = s_suppkey GROUP BY 1""",
)
def point_band_counts(t: Tables) -> DataFrame:
    return sales.point_band_counts(valid_lines(t), points(t), point_tenure(t), AS_OF, days=7)


# --- tiers ----------------------------------------------------------------------------


def _sql_tier_columns(name: str, member: str) -> str:
    columns = [f"count(*) FILTER (WHERE {member}) AS {name}_points"]
    columns += [f"count(*) FILTER (WHERE {member} AND daily >= {x}) AS {name}_{x}" for x in (30, 60, 100)]
    return ", ".join(columns)


def _sql_tiers(divisor: str) -> str:
    labels = ", ".join(
        f"{g}_100 || '/' || {g}_60 || '/' || {g}_30 || '/' || {g}_points AS {g}_label"
        for g in ("all", "ground", "underground")
    )
    return f"""
WITH tenure AS ({sql_tenure("s_nationkey", "site_id")}),
sold AS (
  SELECT l_suppkey AS point_id, sum(l_extendedprice) AS total FROM lineitem
  WHERE {SQL_VALID} AND {sql_window(7)} GROUP BY 1),
daily AS (
  SELECT s_nationkey AS site_id, total / {divisor} / 100 AS daily,
    CASE WHEN s_acctbal < 0 THEN '1' WHEN s_acctbal <= 9000 THEN '0' END AS kind
  FROM sold JOIN supplier ON point_id = s_suppkey JOIN tenure ON site_id = s_nationkey),
tiers AS (
  SELECT site_id, round(sum(daily), 6) AS daily_sales, {_sql_tier_columns("all", "true")},
    {_sql_tier_columns("ground", "kind <> '1'")}, {_sql_tier_columns("underground", "kind = '1'")}
  FROM daily GROUP BY 1)
SELECT tiers.*, {labels}, n_name AS site_name, r_name AS city_name, tenure AS tenure_days
FROM tiers JOIN tenure USING (site_id) JOIN nation ON site_id = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


@query("D8 F10 F14", _sql_tiers("least(tenure, 7)"))
def site_tiers(t: Tables) -> DataFrame:
    tiers = sales.site_tiers(valid_lines(t), points(t), aged_sites(t), AS_OF)
    return rounded(tiers, 6, "daily_sales")


@query("D9", f"SELECT site_id, site_name, all_label FROM ({_sql_tiers('7')})")
def site_tiers_short(t: Tables) -> DataFrame:
    tiers = sales.site_tiers(valid_lines(t), points(t), aged_sites(t), AS_OF, fixed_days=True)
    return tiers.select("site_id", "site_name", "all_label")


# --- facts per point ------------------------------------------------------------------


@query(
    "D10 C16 B19 F9",
    f"""
WITH sold AS (
  SELECT l_suppkey AS point_id, sum(l_extendedprice) / 100 AS sales FROM lineitem
  WHERE {SQL_VALID} AND {sql_window(7)} GROUP BY 1),
opened AS (SELECT l_suppkey AS point_id, min(l_shipdate) AS first FROM lineitem GROUP BY 1),
machines AS ({SQL_MACHINES}),
sizes AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
SELECT s_suppkey AS point_id, s_name AS point_name, supplier.s_nationkey AS site_id,
  n_name AS site_name, r_name AS city_name, round(coalesce(sales, 0), 4) AS sales,
  n AS points_in_site, coalesce(machines, 0) AS products,
  CAST(date_diff('day', first, {SQL_AS_OF}) AS DOUBLE) AS operating_days,
  coalesce(sales, 0) <= 40 AS is_poor
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN sold ON s_suppkey = sold.point_id LEFT JOIN opened ON s_suppkey = opened.point_id
LEFT JOIN machines ON s_suppkey = machines.point_id
JOIN sizes ON supplier.s_nationkey = sizes.s_nationkey""",
)
def point_fact(t: Tables) -> DataFrame:
    operating = point_tenure(t).select(
        "point_id", X.fractional_days("first_operated", X.at(AS_OF)).alias("operating_days")
    )
    assortment = machines_at_points(t).withColumnRenamed("machines", "products")
    every = dims.complete_fact(points(t), assortment, "point_id", {"products": 0})
    fact = sales.point_fact(valid_lines(t), every, sites(t), AS_OF, machines=operating)
    fact = rounded(fact, 4, "sales", "operating_days")
    return fact.drop("city", "point_type")


@query(
    "D10",
    f"""
WITH sold AS (
  SELECT l_suppkey AS point_id, sum(l_extendedprice) / 100 AS sales FROM lineitem WHERE {SQL_VALID} AND {sql_window(7)} GROUP BY 1),
sizes AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
SELECT s_suppkey AS point_id, s_name AS point_name, supplier.s_nationkey AS site_id, n_name AS site_name, r_name AS city_name,
  n_regionkey AS area_id, households AS coverage, round(coalesce(sales, 0), 4) AS sales, n AS points_in_site,
  round(1 - vacancy_rate, 9) AS stocked_rate, round(vacancy_rate, 9) AS vacancy_rate, products,
  strftime(first, '%Y-%m-%d') AS first_online, tenure_days AS deployed_days, coalesce(sales, 0) <= 40 AS is_poor
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN sizes ON supplier.s_nationkey = sizes.s_nationkey LEFT JOIN sold ON s_suppkey = sold.point_id
LEFT JOIN ({SQL_EQUIPMENT}) e ON e.point_id = s_suppkey LEFT JOIN ({SQL_HOUSEHOLDS}) h ON h.site_id = supplier.s_nationkey""",
)
def full_point_fact(t: Tables) -> DataFrame:
    """Every point with coverage, assortment, area, deployment and sales."""
    attributes = equipment(t).select(
        "point_id", "products", "vacancy_rate", (1 - F.col("vacancy_rate")).alias("stocked_rate"),
        F.date_format("first_operated", "yyyy-MM-dd").alias("first_online"), F.col("tenure_days").alias("deployed_days"),
    )
    attributes = clean.with_defaults(attributes, {"products": 0, "vacancy_rate": 1.0, "stocked_rate": 0.0})
    of_site = sites(t).join(households(t).select("site_id", F.col("households").alias("coverage")), "site_id", "left")
    every = points(t).withColumnRenamed("city", "area_id").drop("point_type")
    fact = sales.point_fact(valid_lines(t), every, of_site, AS_OF, machines=attributes)
    return rounded(rounded(fact, 4, "sales"), 9, "vacancy_rate", "stocked_rate")


@query(
    "D11 F11",
    f"""
WITH tenure AS ({sql_tenure("s_nationkey", "site_id")}),
sold AS (
  SELECT s_nationkey AS site_id, l_suppkey, sum(l_extendedprice) AS total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE {SQL_VALID} AND {sql_window(20)} GROUP BY 1, 2),
spread AS (
  SELECT site_id, stddev_pop(total) / avg(total) AS cv, sum(total) AS total FROM sold GROUP BY 1)
SELECT site_id, n_name AS site_name, r_name AS city_name, round(cv, 6) AS cv,
  round(total, 2) AS total, tenure AS tenure_days
FROM spread JOIN tenure USING (site_id) JOIN nation ON site_id = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE total > 15000 AND cv >= 0.7 AND tenure > 30""",
)
def site_cv(t: Tables) -> DataFrame:
    cv = sales.coefficient_of_variation(valid_lines(t), points(t), aged_sites(t), AS_OF)
    return rounded(rounded(cv, 6, "cv"), 2, "total")


@query(
    "D12",
    f"""
WITH sold AS (
  SELECT s_nationkey AS site_id, l_suppkey AS point_id, sum(l_extendedprice) AS total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE {SQL_VALID} AND {sql_window(20)} GROUP BY 1, 2)
SELECT site_id, point_id, round(total, 2) AS total,
  round(total / max(total) OVER (PARTITION BY site_id), 6) AS scaled FROM sold""",
)
def scaled_to_max(t: Tables) -> DataFrame:
    sold = sales.totals(clean.trailing(valid_lines(t), AS_OF, 20), ["point_id"])
    located = sold.join(points(t).select("point_id", "site_id"), "point_id")
    scaled = sales.scaled_to_max(located, "site_id")
    return rounded(rounded(scaled, 2, "total"), 6, "scaled")


@query(
    "D13",
    """
SELECT s_nationkey AS site_id, s_suppkey AS point_id,
  count(*) OVER (PARTITION BY s_nationkey) AS points FROM supplier""",
)
def points_of_site(t: Tables) -> DataFrame:
    return sales.points_of_sites(points(t))


# --- per machine ----------------------------------------------------------------------


def _sql_machine_sales() -> str:
    grains = {"all": "'all'", "city": "n_regionkey", "site_id": "n_nationkey", "point_id": "s_suppkey"}

    def measure(d: int) -> str:
        tenure = f"date_diff('day', min(first), {SQL_AS_OF})"
        days = f"CASE WHEN {tenure} <= {d} THEN {tenure} ELSE {d} END"
        return (
            f"coalesce(sum(volume_{d}d), 0) AS volume_{d}d, round(coalesce(sum(volume_{d}d), 0) / "
            f"({days}) / coalesce(sum(machines), 3), 9) AS sales_{d}d"
        )

    parts = [
        f"SELECT '{g}' AS grain, CAST({c} AS VARCHAR) AS id, {measure(7)}, {measure(30)} FROM wide GROUP BY 1, 2"
        for g, c in grains.items()
    ]
    return f"""
WITH machines AS ({SQL_MACHINES}),
volumes AS (
  SELECT l_suppkey AS point_id, min(l_shipdate) AS first,
    sum(l_quantity) FILTER (WHERE {SQL_VALID} AND {sql_window(7)}) AS volume_7d,
    sum(l_quantity) FILTER (WHERE {SQL_VALID} AND {sql_window(30)}) AS volume_30d
  FROM lineitem GROUP BY 1),
wide AS (
  SELECT * FROM volumes JOIN supplier ON point_id = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey LEFT JOIN machines USING (point_id))
{" UNION ALL ".join(parts)}"""


@query("D14 U1 F12", _sql_machine_sales())
def per_machine_sales(t: Tables) -> DataFrame:
    measured = sales.machine_sales(valid_lines(t), points(t), machines_at_points(t), first_seen_points(t), AS_OF)
    return rounded(measured, 9, "sales_7d", "sales_30d")


@query(
    "C14 U1 U2 F12 F13 B1",
    f"""
WITH volumes AS (
  SELECT l_suppkey AS point_id, sum(l_quantity) FILTER (WHERE {sql_window(7)}) AS v7,
    sum(l_quantity) FILTER (WHERE {sql_window(30)}) AS v30 FROM lineitem GROUP BY 1),
machines AS ({SQL_MACHINES})
SELECT CAST(point_id AS VARCHAR) AS id,
  round(coalesce(v7, 0) / 7 / coalesce(machines, 3), 9) AS sales_7d,
  round(coalesce(v30, 0) / 30 / coalesce(machines, 3), 9) AS sales_30d
FROM volumes LEFT JOIN machines USING (point_id)""",
)
def stats_feeds_joined(t: Tables) -> DataFrame:
    """The two statistics feeds as text, with the tuple mark and blanks they come with."""
    marked = F.concat(F.lit("("), F.col("point_id").cast("string")).alias("id")
    lately = clean.trailing(all_lines(t), AS_OF, 30).groupBy("point_id").agg(
        *[
            F.sum(F.when(X.in_trailing("paid_at", AS_OF, d), F.col("quantity"))).alias(f"v{d}")
            for d in (7, 30)
        ]
    )
    volumes = first_seen_points(t).select("point_id").join(lately, "point_id", "left")
    as_text = [F.coalesce(F.col(f"v{d}").cast("string"), F.lit("")).alias(f"volume_{d}d") for d in (7, 30)]
    operations = point_tenure(t).join(machines_at_points(t), "point_id", "left")
    feed = operations.select(
        marked,
        F.col("tenure_days").cast("string").alias("tenure_days"),
        F.coalesce(F.col("machines").cast("string"), F.lit("")).alias("machines"),
    )
    joined = sales.sales_with_operations(volumes.select(marked, *as_text), feed)
    return rounded(joined, 9, "sales_7d", "sales_30d")


# --- marker product -------------------------------------------------------------------

MARKER = "Brand#5"


def _brands(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))


@query(
    "D19",
    f"""
WITH tenure AS ({sql_tenure("s_nationkey", "site_id")}),
sold AS (
  SELECT s_nationkey AS site_id, count(*) FILTER (WHERE p_brand = '{MARKER}') AS marker_orders,
    sum(l_extendedprice) FILTER (WHERE p_brand <> '{MARKER}') AS others
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  WHERE {SQL_VALID} AND {sql_window(20)} GROUP BY 1)
SELECT site_id, n_name AS site_name, r_name AS city_name, marker_orders,
  round(coalesce(others, 0) / 100, 4) AS other_sales, tenure AS tenure_days
FROM sold JOIN tenure USING (site_id) JOIN nation ON site_id = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE marker_orders > 0 AND tenure > 20""",
)
def marker_sites(t: Tables) -> DataFrame:
    marker = F.col("brand") == MARKER
    found = sales.marker_sites(valid_lines(t), _brands(t), points(t), aged_sites(t), marker, AS_OF)
    return rounded(found, 4, "other_sales")


@query(
    "D20",
    f"""
SELECT s_nationkey AS site_id, n_name AS site_name, count(*) AS marker_orders
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE p_brand = '{MARKER}' GROUP BY 1, 2""",
)
def marker_sites_ever(t: Tables) -> DataFrame:
    found = sales.marker_sites(all_lines(t), _brands(t), points(t), sites(t), F.col("brand") == MARKER)
    return found.select("site_id", "site_name", "marker_orders")


# --- counts ---------------------------------------------------------------------------


@query(
    "D3",
    """
SELECT s_nationkey AS site_id, count(DISTINCT l_partkey) AS machines
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
)
def machines_per_site(t: Tables) -> DataFrame:
    # One row per (point, product) first: the join then carries no repeated line.
    pairs = all_lines(t).select("point_id", "product_id").distinct()
    located = pairs.join(points(t).select("point_id", "site_id"), "point_id")
    return sales.distinct_counts(located, ["site_id"], "product_id", "machines")


@query(
    "D3",
    "SELECT c_mktsegment AS channel_id, count(DISTINCT o_custkey) AS machines "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def machines_per_channel(t: Tables) -> DataFrame:
    active = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    located = active.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("channel_id")), "c_custkey")
    return sales.distinct_counts(located, ["channel_id"], "c_custkey", "machines")


@query(
    "D4",
    "SELECT l_suppkey AS point_id, count(DISTINCT o_custkey) AS promo_users "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1",
)
def promo_users(t: Tables) -> DataFrame:
    promoted = all_lines(t).filter("is_promotion")
    return sales.promotion_users(with_account(promoted, t), F.col("is_promotion"))


@query(
    "D5 E8",
    "SELECT 'terminals' AS what, count(DISTINCT o_custkey) AS n FROM orders "
    "UNION ALL SELECT 'points', count(DISTINCT l_suppkey) FROM lineitem",
)
def global_distinct(t: Tables) -> DataFrame:
    parts = {"terminals": (t.orders, "o_custkey"), "points": (t.lineitem, "l_suppkey")}
    counted = [
        sales.distinct_total(df, c).select(F.lit(what).alias("what"), "n") for what, (df, c) in parts.items()
    ]
    return counted[0].unionByName(counted[1])


@query("D2", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def count_by_key(t: Tables) -> DataFrame:
    return sales.counts(t.orders, ["o_custkey"])


# --- dimensions -----------------------------------------------------------------------

CLOSED_SITE_NAMES = ("NATION_3", "NATION_11")


def _tree(t: Tables) -> DataFrame:
    """The site tree: sites, and the points below them."""
    nodes = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_regionkey").cast("string").alias("parent_id"),
        F.lit("net").alias("kind"),
        F.col("n_name").alias("community_id"),
    )
    leaves = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"),
        F.col("n_name").alias("parent_id"),
        F.lit("point").alias("kind"),
        F.col("s_name").alias("community_id"),
    )
    return nodes.unionByName(leaves)


@query(
    "C1 B2 B3 B13 B15 B16",
    f"""
SELECT s_suppkey AS id, n_name AS parent_id, 'point' AS kind, s_name AS pid, s_acctbal AS balance,
  '0' AS is_deleted
FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal >= 0 AND n_name NOT IN {CLOSED_SITE_NAMES}""",
)
def point_dim(t: Tables) -> DataFrame:
    attributes = t.supplier.select("s_name", "s_acctbal", (F.col("s_acctbal") < 0).cast("int").cast("string").alias("d"))
    renamed = clean.named_columns(attributes, {"s_name": "id", "s_acctbal": "balance", "d": "is_deleted"})
    return dims.point_dim(_tree(t), renamed, CLOSED_SITE_NAMES)


@query(
    "C2 B2 B3 B13",
    """
SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS VARCHAR) AS parent_id,
  'net' AS kind, n_name AS nid, points, '0' AS is_deleted
FROM nation JOIN (SELECT s_nationkey, count(*) AS points FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
WHERE n_nationkey NOT IN (7, 12)""",
)
def site_dim(t: Tables) -> DataFrame:
    sizes = points(t).groupBy("site_id").agg(F.count(F.lit(1)).alias("points"))
    attributes = t.nation.join(sizes, F.col("n_nationkey") == F.col("site_id")).select(
        F.col("n_name").alias("id"), "points", F.lit("0").alias("is_deleted")
    )
    return dims.site_dim(_tree(t), attributes, (7, 12))


@query(
    "C3 C19 C20 B19",
    """
SELECT o_orderkey, o_custkey, coalesce(c_mktsegment, 'UNKNOWN') AS channel,
  coalesce(c_acctbal, 0) AS balance
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""",
)
def lookup_left(t: Tables) -> DataFrame:
    return dims.lookup(_order_ids(t), _live_customers(t), "o_custkey", {"channel": "UNKNOWN", "balance": 0.0})


@query(
    "C4",
    """
SELECT o_orderkey, o_custkey, c_mktsegment AS channel, c_acctbal AS balance
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0""",
)
def lookup_inner(t: Tables) -> DataFrame:
    return dims.lookup(_order_ids(t), _live_customers(t), "o_custkey", required=True)


def _order_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey")


def _live_customers(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_mktsegment").alias("channel"),
        F.col("c_acctbal").alias("balance"),
    )


@query(
    "C19 E9",
    """
SELECT c_nationkey, c_mktsegment, c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_acctbal DESC) = 1""",
)
def lookup_dim(t: Tables) -> DataFrame:
    return dims.lookup_dim(t.customer, "c_nationkey", ["c_mktsegment", "c_acctbal"])


@query(
    "C5 B8",
    f"""
WITH tenure AS ({sql_tenure("l_suppkey", "point_id")})
SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS point_id, l_extendedprice AS amount
FROM lineitem WHERE {sql_window(20)}
  AND l_suppkey IN (SELECT point_id FROM tenure WHERE tenure > 2188)""",
)
def semi_tenured(t: Tables) -> DataFrame:
    lately = clean.trailing(all_lines(t), AS_OF, 20).select("order_id", "line", "point_id", "amount")
    return dims.in_set(lately, clean.tenured(point_tenure(t), 2188), "point_id", spread_by="order_id")


@query(
    "C6",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def anti_blocked(t: Tables) -> DataFrame:
    blocked = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dims.not_in_set(_order_ids(t), blocked, "o_custkey")


@query(
    "C11",
    f"""
WITH ids AS (SELECT DISTINCT c_nationkey AS site_id FROM customer)
SELECT site_id, n_name AS name, r_name AS province FROM ids
LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> '{CLOSED_REGION}')
ON site_id = n_nationkey""",
)
def enrich_ids(t: Tables) -> DataFrame:
    ids = t.customer.select(F.col("c_nationkey").alias("site_id")).distinct()
    return dims.enriched_ids(ids, _open_sites(t))


def _open_sites(t: Tables) -> DataFrame:
    return sites(t).filter(F.col("city_name") != CLOSED_REGION).select(
        "site_id", F.col("site_name").alias("name"), F.col("city_name").alias("province")
    )


@query(
    "C17",
    f"""
WITH counted AS (
  SELECT s_nationkey AS site_id, count(*) AS points FROM supplier GROUP BY 1),
machines AS (
  SELECT s_nationkey AS site_id, sum(machines) AS machines
  FROM ({SQL_MACHINES}) JOIN supplier ON point_id = s_suppkey GROUP BY 1)
SELECT site_id, coalesce(points, 0) AS points, CAST(coalesce(machines, 0) AS BIGINT) AS machines
FROM machines LEFT JOIN counted USING (site_id)""",
)
def points_times_machines(t: Tables) -> DataFrame:
    located = machines_at_points(t).join(points(t).select("point_id", "site_id"), "point_id")
    per_site = sales.totals(located, ["site_id"], "machines", "machines")
    return dims.points_and_machines(points(t).select("site_id"), per_site)


@query(
    "C15 B19",
    f"""
WITH machines AS ({SQL_MACHINES})
SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS point_id, o_custkey AS account,
  n_nationkey AS site_id, n_name AS site_name, coalesce(date_diff('day', first, {SQL_AS_OF}), 30) AS tenure_days,
  coalesce(machines, 3) AS machines, coalesce(faulty, 0) AS faulty_machines, coalesce(products, 0) AS products, c_mktsegment AS level
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN (SELECT l_suppkey AS p, min(l_shipdate) AS first FROM lineitem GROUP BY 1) ON p = l_suppkey
LEFT JOIN machines ON machines.point_id = l_suppkey
LEFT JOIN (SELECT l_suppkey AS q, count(*) AS faulty FROM lineitem
  WHERE l_returnflag = 'R' AND {sql_window(7)} GROUP BY 1) ON q = l_suppkey
LEFT JOIN (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS products FROM lineitem
  WHERE {sql_window(7)} GROUP BY 1) ON s = l_suppkey
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey
WHERE {sql_window(20)}""",
)
def star_lookup(t: Tables) -> DataFrame:
    lately = with_account(clean.trailing(all_lines(t), AS_OF, 20), t)
    # Machines, faults and products of a point in one pass over its last month.
    last_week = X.in_trailing("paid_at", AS_OF, 7)
    per_point = clean.trailing(all_lines(t), AS_OF, 30).groupBy("point_id").agg(
        F.count_distinct("product_id").alias("machines"),
        F.count_if(last_week & F.col("is_promotion")).alias("faulty_machines"),
        F.count_distinct(F.when(last_week, F.col("product_id"))).alias("products"),
    )
    machines = point_tenure(t).select("point_id", "tenure_days").join(per_point, "point_id", "left")
    users = _live_customers(t).select(F.col("o_custkey").alias("account"), F.col("channel").alias("level"))
    wide = dims.star_lookup(
        lately.select("order_id", "line", "point_id", "account"),
        points(t).select("point_id", "site_id"),
        sites(t).select("site_id", "site_name"),
        machines,
        users,
    )
    return clean.with_defaults(wide, {"products": 0})


# --- audits ---------------------------------------------------------------------------


@query(
    "C7",
    f"""
WITH tenure AS ({sql_tenure("s_nationkey", "site_id")})
SELECT n_nationkey AS site_id, n_name AS site_name, r_name AS city_name, 0.0::DOUBLE AS daily_sales,
  tenure AS tenure_days
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN tenure ON site_id = n_nationkey
WHERE n_nationkey NOT IN (
  SELECT s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE {SQL_VALID} AND {sql_window(7)})""",
)
def idle_sites(t: Tables) -> DataFrame:
    operating = site_tenure(t).select("site_id", "tenure_days")
    return audit.idle_sites(sites(t), points(t), valid_lines(t), AS_OF, operating=operating)


@query(
    "C8",
    f"""
SELECT s_nationkey AS site_id, count(*) AS idle_points FROM supplier
WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE {SQL_VALID} AND {sql_window(15)}) GROUP BY 1""",
)
def idle_points(t: Tables) -> DataFrame:
    return audit.idle_points_per_site(points(t), valid_lines(t), AS_OF)


@query(
    "C9",
    f"""
SELECT DISTINCT s_nationkey AS site_id,
  CASE WHEN n_name IN {CLOSED_SITE_NAMES} THEN NULL ELSE r_name END AS community_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE n_name IN {CLOSED_SITE_NAMES} OR r_name = '{CLOSED_REGION}'""",
)
def orphan_sites(t: Tables) -> DataFrame:
    sold = all_lines(t).select("point_id").distinct()
    seen = sold.join(points(t).select("point_id", "site_id"), "point_id")
    known = clean.without_values(sites(t), "site_name", CLOSED_SITE_NAMES)
    tree = known.select("site_id", F.col("city_name").alias("community_id"))
    communities = t.region.filter(F.col("r_name") != CLOSED_REGION).select(F.col("r_name").alias("community_id"))
    return audit.orphan_sites(seen, tree, communities)


@query(
    "C10 E10",
    f"""
SELECT id FROM (SELECT s_nationkey AS id FROM supplier UNION SELECT c_nationkey FROM customer)
WHERE id NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> '{CLOSED_REGION}')""",
)
def orphan_ids(t: Tables) -> DataFrame:
    dim = _open_sites(t).select(F.col("site_id").alias("id"))
    return audit.orphan_ids(dim, _id_sources(t), "id")


def _id_sources(t: Tables) -> list[DataFrame]:
    return [
        t.supplier.select(F.col("s_nationkey").alias("id")),
        t.customer.select(F.col("c_nationkey").alias("id")),
    ]


@query("E10", "SELECT s_nationkey AS id FROM supplier UNION SELECT c_nationkey FROM customer")
def union_ids(t: Tables) -> DataFrame:
    return audit.union_ids(_id_sources(t), "id")


@query(
    "E11",
    "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def minus_ids(t: Tables) -> DataFrame:
    buyers = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return audit.minus_ids(t.customer.select(F.col("c_custkey").alias("id")), buyers, "id")


@query(
    "C12 E8",
    """
SELECT a.p_name AS left_name, b.p_name AS right_name,
  CASE WHEN b.p_name IS NULL THEN 'left' WHEN a.p_name IS NULL THEN 'right' ELSE 'both' END AS side
FROM (SELECT DISTINCT p_name FROM part WHERE p_size < 25) a FULL JOIN (SELECT DISTINCT p_name FROM part WHERE p_size >= 25) b
ON a.p_name = b.p_name
UNION ALL SELECT a.word, b.word,
  CASE WHEN b.word IS NULL THEN 'left' WHEN a.word IS NULL THEN 'right' ELSE 'both' END
FROM (SELECT DISTINCT 'c ' || c_name AS word FROM customer) a
FULL JOIN (SELECT DISTINCT 'c Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS word FROM orders) b ON a.word = b.word""",
)
def reconcile_names(t: Tables) -> DataFrame:
    """Names of small and large parts side by side; names of customers against those that orders imply."""
    names = t.part.select("p_name", "p_size")
    parts = audit.reconciled_names(names.filter("p_size < 25"), names.filter("p_size >= 25"), "p_name")
    held = t.customer.select(F.concat(F.lit("c "), "c_name").alias("word"))
    key = X.zero_padded("o_custkey", 9)
    implied = t.orders.select(F.concat(F.lit("c Customer#"), key).alias("word"))
    return parts.unionByName(audit.reconciled_names(held, implied, "word"))


@query(
    "C13",
    f"""
WITH means AS ({_sql_site_means("true")}),
spread AS (
  SELECT site_id FROM (SELECT s_nationkey AS site_id, l_suppkey, sum(l_extendedprice) AS total
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE {SQL_VALID} AND {sql_window(20)} GROUP BY 1, 2)
  GROUP BY 1 HAVING sum(total) > 15000 AND stddev_pop(total) / avg(total) >= 0.7),
cohorts AS (
  SELECT site_id, 'good' AS cohort FROM means WHERE daily_sales >= 250
  UNION ALL SELECT site_id, 'bad' FROM means WHERE daily_sales <= 150
  UNION ALL SELECT site_id, 'uneven' FROM spread)
SELECT cohort, site_id, daily_sales FROM means JOIN cohorts USING (site_id)""",
)
def cohort_rows(t: Tables) -> DataFrame:
    means = rounded(site_means(t), 4, "daily_sales")
    uneven = sales.coefficient_of_variation(valid_lines(t), points(t), site_tenure(t), AS_OF)
    cohorts = {
        "good": clean.in_band(means, "daily_sales", at_least=250),
        "bad": clean.in_band(means, "daily_sales", at_most=150),
        "uneven": uneven,
    }
    return audit.cohort_rows(means, cohorts).select("cohort", "site_id", "daily_sales")


# --- the flagship ---------------------------------------------------------------------


def flagship(t: Tables) -> DataFrame:
    """Daily sales of every site, before any threshold."""
    return shown(
        rounded(site_means(t), 4, "daily_sales").join(
            site_tenure(t).select("site_id", "first_operated"), "site_id"
        ),
        "first_operated",
    )
