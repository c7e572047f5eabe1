"""Queries on customers, their baskets, and devices."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowthModel
from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.skew import salted_join
from stallwise.functions.work import cut
from stallwise.operators import audit, baskets, clean, customers, dims, sales
from stallwise.plans.binding import (
    AS_OF,
    CAP,
    SQL_AS_OF,
    SQL_EQUIPMENT,
    SQL_HOUSEHOLDS,
    SQL_MACHINES,
    SQL_VALID,
    all_lines,
    device_log,
    equipment,
    households,
    machines_at_points,
    point_tenure,
    points,
    site_tenure,
    sites,
    sql_window,
    valid_lines,
    with_account,
)
from stallwise.plans.registry import Tables, query, rounded, shown

# The nouns of the test products, standing in for the product families.
FAMILIES = ("widget", "plate", "gear", "bolt", "ring", "rod", "gizmo")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EXCLUDED = (5, 17, 42)


def _users(t: Tables) -> DataFrame:
    coded = t.customer.select(
        F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("level"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "1").otherwise("2").alias("gender"),
    )
    return clean.with_gender(coded)


_SQL_LABEL = "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'MAN' ELSE 'WOMAN' END AS gender_label"
_SQL_FAMILY = "CASE " + " ".join(f"WHEN contains(p_name, '{f}') THEN '{f}'" for f in FAMILIES) + " ELSE 'OTHER' END AS family"
_SQL_BOUGHT = (
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    f"JOIN part ON l_partkey = p_partkey WHERE l_partkey NOT IN {EXCLUDED}"
)


def _bought(t: Tables) -> DataFrame:
    lines = clean.without_values(all_lines(t), "product_id", EXCLUDED)
    return with_account(lines.select("order_id", "product_id"), t)


@query("D21 B13 B17 B18 F4", f"SELECT {_SQL_LABEL}, {_SQL_FAMILY}, count(*) AS orders {_SQL_BOUGHT} GROUP BY 1, 2")
def gender_category(t: Tables) -> DataFrame:
    products = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    return customers.gender_family_orders(_bought(t), _users(t), products, FAMILIES)


@query(
    "D22",
    f"SELECT {_SQL_LABEL}, l_partkey AS product_id, count(DISTINCT o_custkey) AS buyers {_SQL_BOUGHT} GROUP BY 1, 2",
)
def gender_product_people(t: Tables) -> DataFrame:
    return customers.gender_product_buyers(_bought(t), _users(t))


SQL_PROFILE = f"""
WITH machines AS ({SQL_MACHINES}),
buyers AS (
  SELECT l_suppkey AS point_id, o_custkey AS account, count(*) AS orders, sum(l_extendedprice) AS total,
    min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) FILTER (WHERE l_linestatus = 'F') AS member
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {SQL_VALID} AND {sql_window(90)} GROUP BY 1, 2),
per AS (
  SELECT point_id, sum(total) AS total, count(*) AS buyers, count(*) FILTER (WHERE orders >= 2) AS repeat_buyers,
    coalesce(avg(date_diff('day', first, last) / orders) FILTER (WHERE orders >= 2), 0) AS repeat_interval,
    max(last) AS last, count(c_mktsegment) AS level_total,
    {", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS level_{s.lower()}" for s in SEGMENTS)},
    CAST(sum(member) AS BIGINT) AS member_payments
  FROM buyers LEFT JOIN customer ON account = c_custkey GROUP BY 1)
SELECT per.* EXCLUDE (total, last, repeat_interval), round(repeat_interval, 6) AS repeat_interval, coalesce(machines, 0) AS machines,
  round(total / 90 / coalesce(machines, 3), 9) AS sales_per_machine, date_diff('day', last, {SQL_AS_OF}) AS idle_days
FROM per LEFT JOIN machines USING (point_id)"""


@query("D23 D24 D25 D26 C15", SQL_PROFILE)
def point_profile(t: Tables) -> DataFrame:
    orders = with_account(clean.trailing(valid_lines(t), AS_OF, 90), t)
    profile = customers.point_profile(
        orders, _users(t), machines_at_points(t), AS_OF, F.col("is_member_payment"), SEGMENTS, days=90
    )
    profile = clean.with_defaults(profile, {"machines": 0})
    return rounded(rounded(profile, 6, "repeat_interval"), 9, "sales_per_machine")


@query(
    "D23",
    f"""
SELECT p.*, s_nationkey AS site_id, tenure_days, faulty_machines, products, round(vacancy_rate, 9) AS vacancy_rate,
  households, fee, site_age_days
FROM ({SQL_PROFILE}) p JOIN supplier ON point_id = s_suppkey JOIN ({SQL_EQUIPMENT}) e ON e.point_id = p.point_id
LEFT JOIN ({SQL_HOUSEHOLDS}) h ON h.site_id = s_nationkey
LEFT JOIN (SELECT s_nationkey AS n, date_diff('day', min(l_shipdate), {SQL_AS_OF}) AS site_age_days
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON n = s_nationkey""",
)
def full_profile(t: Tables) -> DataFrame:
    """The profile of each point with its machines, its assortment and its site."""
    of_site = households(t).join(site_tenure(t).select("site_id", F.col("tenure_days").alias("site_age_days")), "site_id", "full")
    wide = customers.full_profile(point_profile(t), points(t), equipment(t).drop("first_operated"), of_site)
    return rounded(wide, 9, "vacancy_rate")


@query(
    "C16 C17 B19 D4 F8",
    f"""
WITH machines AS ({SQL_MACHINES}),
sold AS (
  SELECT l_suppkey AS point_id, count(DISTINCT o_custkey) AS buyers, sum(l_extendedprice) AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {SQL_VALID} AND {sql_window(7)} GROUP BY 1),
promoted AS (
  SELECT l_suppkey AS point_id, count(DISTINCT o_custkey) AS promo_users
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND {sql_window(7)} GROUP BY 1),
opened AS (SELECT l_suppkey AS point_id, date_diff('day', min(l_shipdate), {SQL_AS_OF}) AS days FROM lineitem GROUP BY 1),
per_site AS (
  SELECT s_nationkey, count(*) AS points, CAST(coalesce(sum(machines), 0) AS BIGINT) AS machines
  FROM supplier LEFT JOIN machines ON point_id = s_suppkey GROUP BY 1)
SELECT s_suppkey AS point_id, supplier.s_nationkey AS site_id, n_name AS site_name,
  coalesce(buyers, 0) AS buyers, round(coalesce(total / 7 / coalesce(machines.machines, 3), 0), 9) AS sales_per_machine,
  coalesce(promo_users, 0) AS promo_users, coalesce(days, 30) AS tenure_days, coalesce(days, 30) // 365 AS years_open,
  per_site.points AS site_points, per_site.machines AS site_machines
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN per_site ON per_site.s_nationkey = supplier.s_nationkey
LEFT JOIN sold ON sold.point_id = s_suppkey LEFT JOIN promoted ON promoted.point_id = s_suppkey
LEFT JOIN opened ON opened.point_id = s_suppkey LEFT JOIN machines ON machines.point_id = s_suppkey""",
)
def complete_profile(t: Tables) -> DataFrame:
    """Every point with its profile if it sold, defaults if not, and the size of its site."""
    lines = with_account(clean.trailing(all_lines(t), AS_OF, 7), t)
    valid = clean.below_cap(clean.without_promotions(lines, F.col("is_promotion")), CAP)
    machines = machines_at_points(t)
    profile = customers.point_profile(valid, _users(t), machines, AS_OF, F.col("is_member_payment"), SEGMENTS)
    promoted = sales.promotion_users(lines, F.col("is_promotion"))
    tenure = point_tenure(t).select("point_id", "tenure_days")
    metrics = profile.select("point_id", "buyers", "sales_per_machine")
    metrics = metrics.join(promoted, "point_id", "full").join(tenure, "point_id", "full")
    defaults = {"buyers": 0, "sales_per_machine": 0.0, "promo_users": 0, "tenure_days": 30}
    every = dims.complete_fact(points(t).select("point_id", "site_id"), metrics, "point_id", defaults)
    located = points(t).select("point_id", "site_id").join(machines, "point_id", "left")
    per_site = dims.points_and_machines(points(t), sales.totals(located, ["site_id"], "machines", "machines"))
    sized = sites(t).select("site_id", "site_name").join(
        per_site.select("site_id", F.col("points").alias("site_points"), F.col("machines").alias("site_machines")), "site_id"
    )
    wide = salted_join(every, sized, "site_id", "point_id")
    return rounded(wide.withColumn("years_open", X.whole_years("tenure_days")), 9, "sales_per_machine")


@query(
    "D27",
    f"""
WITH first AS (
  SELECT l_suppkey AS point_id, o_custkey AS account, min(l_shipdate) AS first
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {SQL_VALID} AND l_shipdate < {SQL_AS_OF} GROUP BY 1, 2),
opened AS (SELECT point_id, min(first) AS opened FROM first GROUP BY 1),
grid AS (
  SELECT point_id, unnest(range(0, CAST(ceil(date_diff('day', opened, {SQL_AS_OF}) / 7) AS BIGINT))) AS week FROM opened),
found AS (
  SELECT point_id, date_diff('day', opened, first) // 7 AS week, count(*) AS n
  FROM first JOIN opened USING (point_id) GROUP BY 1, 2)
SELECT point_id, week, coalesce(n, 0) AS new_users FROM grid LEFT JOIN found USING (point_id, week)""",
)
def new_users_weekly(t: Tables) -> DataFrame:
    return customers.new_users_weekly(with_account(valid_lines(t), t), AS_OF)


# --- baskets --------------------------------------------------------------------------


def _basket_orders(t: Tables) -> DataFrame:
    owners = t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("paid_at")
    )
    items = valid_lines(t).select("order_id", "product_id")
    return items.join(owners, "order_id", "inner")


@query(
    "D28",
    f"""
WITH items AS (
  SELECT DISTINCT o_custkey AS account, l_partkey AS product_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE {SQL_VALID} AND {sql_window(50, "o_orderdate")})
SELECT account, product_id, count(*) OVER (PARTITION BY account) AS products FROM items
QUALIFY products > 1""",
)
def user_baskets(t: Tables) -> DataFrame:
    return baskets.user_baskets(clean.trailing(_basket_orders(t), AS_OF, 50))


@query(
    "D29",
    f"""
WITH items AS (
  SELECT DISTINCT o_custkey AS account, CAST(o_orderdate AS DATE) AS day, l_partkey AS product_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {SQL_VALID}),
lists AS (
  SELECT account, day, list(product_id ORDER BY product_id) AS basket FROM items GROUP BY 1, 2 HAVING count(*) > 1),
kept AS (SELECT account, basket, min(day) AS day FROM lists GROUP BY 1, 2)
SELECT account, strftime(day, '%Y-%m-%d') AS day, unnest(basket) AS product_id, len(basket) AS products FROM kept""",
)
def day_baskets(t: Tables) -> DataFrame:
    return shown(baskets.day_baskets(_basket_orders(t)), "day", pattern="yyyy-MM-dd")


HELD_TWICE = 2  # baskets that hold a frequent set, at least: pairs and sets of three among thousands of products


def _model(t: Tables) -> FPGrowthModel:
    """Item sets of the products in the day baskets."""
    product = F.col("product_id").cast("string").alias("product_id")
    items = cut(baskets.day_baskets(_basket_orders(t)).select("account", "day", product), "day-items")
    n = items.select("account", "day").distinct().count()
    support = (HELD_TWICE - 0.5) / max(n, 1)
    return baskets.mine(baskets.transactions(items, ["account", "day"], "product_id", support), support)


# Every subset of a basket, by a mask of its places; those that occur twice are frequent.
_SQL_SETS = f"""
WITH bought AS (
  SELECT DISTINCT o_custkey AS account, CAST(o_orderdate AS DATE) AS day, CAST(l_partkey AS VARCHAR) AS product_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {SQL_VALID}),
lists AS (
  SELECT account, day, list(product_id ORDER BY product_id) AS basket FROM bought GROUP BY 1, 2 HAVING count(*) > 1),
kept AS (SELECT DISTINCT account, basket FROM lists),
n AS (SELECT count(*) AS n FROM kept),
masks AS (SELECT basket, unnest(range(1, CAST(1 << len(basket) AS BIGINT))) AS mask FROM kept),
parts AS (SELECT [x FOR x, i IN basket IF mask & CAST(1 << (i - 1) AS BIGINT) <> 0] AS part FROM masks),
sets AS (SELECT part, count(*) AS freq, len(part) AS size FROM parts GROUP BY 1 HAVING count(*) >= {HELD_TWICE})"""


@query("M1", f"{_SQL_SETS} SELECT array_to_string(part, ',') AS items, size, freq FROM sets")
def fp_items(t: Tables) -> DataFrame:
    return baskets.frequent_item_sets(_model(t))


@query(
    "M2",
    f"""{_SQL_SETS},
wholes AS (SELECT part, freq, unnest(part) AS consequent FROM sets WHERE size > 1)
SELECT array_to_string(a.part, ',') AS antecedent, consequent, round(w.freq / a.freq, 6) AS confidence,
  round(w.freq / a.freq / (c.freq / n), 6) AS lift, round(w.freq / n, 6) AS support
FROM wholes w JOIN sets a ON a.part = list_filter(w.part, lambda x: x <> w.consequent) JOIN sets c ON c.part = [w.consequent], n""",
)
def fp_rules(t: Tables) -> DataFrame:
    return rounded(baskets.rules(_model(t)), 6, "confidence", "lift", "support")


# --- devices --------------------------------------------------------------------------

DEVICES_AS_OF = "2024-01-31 00:00:00"


@query(
    "D30",
    f"""
SELECT user_id AS machine_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_logged_at FROM events
WHERE ts < TIMESTAMP '{DEVICES_AS_OF}' GROUP BY 1""",
)
def device_first_seen(t: Tables) -> DataFrame:
    return shown(customers.first_logged(device_log(t), DEVICES_AS_OF), "first_logged_at")


@query(
    "D31 F9 C3",
    f"""
WITH seen AS (SELECT user_id, min(ts) AS first, min(ts) FILTER (WHERE event_type = 'signup') AS deployed FROM events GROUP BY 1),
logged AS (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '{DEVICES_AS_OF}' GROUP BY 1)
SELECT seen.user_id AS machine_id,
  round(date_diff('microsecond', deployed, TIMESTAMP '{DEVICES_AS_OF}') / 86400e6, 6) AS deployed_days,
  round(date_diff('microsecond', logged.first, TIMESTAMP '{DEVICES_AS_OF}') / 86400e6, 6) AS operating_days
FROM seen LEFT JOIN logged USING (user_id) WHERE deployed IS NOT NULL""",
)
def device_age(t: Tables) -> DataFrame:
    """A device is deployed by its first signup; its log holds the errors."""
    log = device_log(t)
    deployed = log.filter("event_type = 'signup'").groupBy("machine_id").agg(F.min("logged_at").alias("deployed_at"))
    aged = customers.machine_age(deployed, log.filter("event_type = 'error'"), DEVICES_AS_OF)
    return rounded(aged.drop("deployed_at", "first_logged_at"), 6, "deployed_days", "operating_days")


@query(
    "D31 C6",
    """
SELECT c_custkey AS machine_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""",
)
def devices_without_error(t: Tables) -> DataFrame:
    """All customers own a device; those that never logged an error."""
    owned = t.customer.select(F.col("c_custkey").alias("machine_id"))
    return audit.never_logged(owned, device_log(t).filter("event_type = 'error'"))
