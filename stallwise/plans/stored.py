"""Queries on tables that are kept beside the facts: rollups, changes, layouts, histories."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from stallwise.functions import expr as X
from stallwise.functions.work import fresh_path
from stallwise.operators import clean, dims, history, keyed, rollup, sales
from stallwise.plans.binding import AS_OF, CAP, SQL_AS_OF, SQL_VALID, all_lines, points, sql_window, with_account
from stallwise.plans.registry import Tables, query, rounded
from stallwise.sources import layouts, writers

# --- rollup of sales with corrections -------------------------------------------------

WINDOWS = (7, 15, 20, 50)


def corrected_rollup(t: Tables) -> DataFrame:
    """The day table after a load, late orders and corrections, the last batch of them delivered twice.

    Every tenth order comes late. Every thirteenth is withdrawn, and every seventeenth was loaded with double
    amounts: the same lines come again, withdrawn, together with the right ones.
    """
    path = fresh_path(t.spark, "rollup")
    number = F.col("order_id")
    lines = all_lines(t).select("order_id", "point_id", "amount", "paid_at", "is_promotion")
    doubled = F.when(number % 17 == 0, F.col("amount") * 2).otherwise(F.col("amount"))
    loaded = lines.withColumn("amount", doubled)
    valid = ~F.col("is_promotion") & (F.col("amount") < CAP)
    wrong = loaded.filter((number % 13 == 0) | (number % 17 == 0)).withColumn("withdrawn", F.lit(True))
    right = lines.filter((number % 17 == 0) & (number % 13 != 0)).withColumn("withdrawn", F.lit(False))
    batches = [
        rollup.sales_increments(loaded.filter(number % 10 != 0), valid),
        rollup.sales_increments(loaded.filter(number % 10 == 0), valid),
        rollup.sales_increments(wrong.unionByName(right), valid, F.col("withdrawn")),
    ]
    write, schema = writers.delta_sink(path), batches[0].schema
    for i in (0, 1, 2, 2):
        write(batches[i], i)
        if i == 1:
            writers.compact(t.spark, path, schema, rollup.folded, "day")
    return rollup.folded(writers.read_deltas(t.spark, path, schema))


@query(
    "D1 D6 B6 B8 A17",
    f"""
WITH kept AS (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 13 <> 0),
tenure AS (SELECT s_nationkey AS site_id, date_diff('day', min(l_shipdate), {SQL_AS_OF}) AS tenure FROM kept GROUP BY 1),
sold AS (
  SELECT window_days, s_nationkey AS site_id, sum(l_extendedprice) AS total
  FROM kept, (SELECT unnest([{", ".join(map(str, WINDOWS))}]) AS window_days)
  WHERE {SQL_VALID} AND l_shipdate > {SQL_AS_OF} - window_days * INTERVAL 1 DAY AND l_shipdate <= {SQL_AS_OF} GROUP BY ALL)
SELECT window_days, site_id, round(total / least(tenure, window_days) / 100, 4) AS daily_sales
FROM sold JOIN tenure USING (site_id) WHERE tenure > 15""",
)
def rollup_site_daily_sales(t: Tables) -> DataFrame:
    """Site means of four windows and the tenure they need, all out of the corrected day table."""
    table = corrected_rollup(t)
    tenure = dims.rolled_up_stats(dims.with_tenure(rollup.first_days(table), AS_OF), points(t), "site_id", AS_OF)

    def means(days: int) -> DataFrame:
        orders = rollup.as_orders(rollup.trailing_days(table, AS_OF, days))
        return sales.site_daily_sales(orders, points(t), tenure, AS_OF, days).withColumn("window_days", F.lit(days))

    return rounded(reduce(DataFrame.unionByName, map(means, WINDOWS)), 4, "daily_sales")


@query(
    "D7 D9 B22",
    f"""
WITH kept AS (SELECT * FROM lineitem WHERE l_orderkey % 13 <> 0),
tenure AS (SELECT l_suppkey AS point_id, date_diff('day', min(l_shipdate), {SQL_AS_OF}) AS tenure FROM kept GROUP BY 1),
sold AS (SELECT l_suppkey AS point_id, sum(l_extendedprice) AS total FROM kept WHERE {SQL_VALID} AND {sql_window(15)} GROUP BY 1),
means AS (SELECT point_id, total / least(tenure, 15) / 100 AS daily FROM sold JOIN tenure USING (point_id) WHERE tenure > 15)
SELECT s_nationkey AS site_id, count(*) FILTER (WHERE daily >= 60) AS good_points,
  count(*) FILTER (WHERE daily <= 5) AS bad_points FROM means JOIN supplier ON point_id = s_suppkey GROUP BY 1""",
)
def rollup_point_bands(t: Tables) -> DataFrame:
    table = corrected_rollup(t)
    tenure = dims.with_tenure(rollup.first_days(table), AS_OF)
    orders = rollup.as_orders(rollup.trailing_days(table, AS_OF, 15))
    return sales.point_band_counts(orders, points(t), tenure, AS_OF, days=15)


# --- distinct members -----------------------------------------------------------------


@query(
    "D3 D4 D5 D24",
    f"""
WITH bought AS (
  SELECT s_nationkey AS site_id, o_custkey AS account, l_shipdate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey WHERE {sql_window(30)}),
spans AS (SELECT unnest([7, 15, 30]) AS window_days)
SELECT window_days, site_id, count(DISTINCT account) AS buyers FROM bought, spans
WHERE l_shipdate > {SQL_AS_OF} - window_days * INTERVAL 1 DAY GROUP BY ALL
UNION ALL SELECT window_days, -1, count(DISTINCT account) FROM bought, spans
WHERE l_shipdate > {SQL_AS_OF} - window_days * INTERVAL 1 DAY GROUP BY ALL""",
)
def distinct_buyers(t: Tables) -> DataFrame:
    """Buyers per site and of all sites (-1) in three windows, merged from one table of bitmaps by site and day."""
    path = fresh_path(t.spark, "buyers")
    bought = with_account(all_lines(t), t).join(points(t).select("point_id", "site_id"), "point_id")
    rollup.member_bitmaps(bought, ["site_id"], "account").write.parquet(path)
    stored = t.spark.read.parquet(path)

    def buyers(days: int) -> DataFrame:
        window = rollup.trailing_days(stored, AS_OF, days)
        own = rollup.distinct_members(window, ["site_id"], "buyers").select("site_id", "buyers")
        every = rollup.distinct_members(window.withColumn("site_id", F.lit(-1)), ["site_id"], "buyers").filter("buyers > 0")
        return own.union(every.select("site_id", "buyers")).withColumn("window_days", F.lit(days))

    return reduce(DataFrame.unionByName, map(buyers, (7, 15, 30)))


# --- deletes in the keyed table -------------------------------------------------------


@query(
    "K6 A14 A15 E9",
    """
WITH rich AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000)
SELECT c_custkey, c_name, coalesce(CASE WHEN c_custkey % 5 = 0 OR c_acctbal >= 0 THEN c_mktsegment END, 'none') AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS version
FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM rich))""",
)
def stored_deletes(t: Tables) -> DataFrame:
    """Puts, row deletes and cell deletes in batches, one delivered twice, with a compaction between them."""
    path, keys = fresh_path(t.spark, "changed"), ["c_custkey"]
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.lit(0).alias("version"))
    schema, number = rows.schema, F.col("c_custkey")
    rich = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    again = rows.filter(number % 5 == 0).withColumn("version", F.lit(1))
    batches = [
        writers.changes(schema, keys, puts=rows),
        writers.changes(schema, keys, deleted=rich),
        writers.changes(schema, keys, cleared=[(t.customer.filter("c_acctbal < 0"), ["c_mktsegment"])]),
        writers.changes(schema, keys, puts=again, deleted=rows.filter(number % 10 == 0)),
        writers.changes(schema, keys, deleted=rows.filter(number % 7 == 0)),
    ]
    write = writers.delta_sink(path)
    for i in (0, 1, 2, 2, 3, 4):
        write(batches[i], i)
        if i == 1:
            writers.compact(t.spark, path, writers.with_marks(schema), writers.current_of(keys), "c_custkey")
    held = writers.current_rows(t.spark, path, schema, keys)
    return held.select("c_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), "version")


# --- co-located tables ----------------------------------------------------------------

BUCKETS = 16


def bucketed_purchases(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines joined to orders, and purchases and accounts to join: both joins find their rows in the same buckets."""
    name = lambda table: f"stallwise_{table}_{uuid.uuid4().hex}"
    kept = lambda df, table, by: layouts.write_bucketed(df, name(table), fresh_path(t.spark, table), by, BUCKETS)
    lines = kept(all_lines(t).select("order_id", "point_id", "product_id", "amount", "paid_at"), "lines", "order_id")
    orders = kept(t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"), "o_orderstatus"), "orders", "order_id")
    owned = lines.join(orders, "order_id")
    accounts = kept(t.customer.select(F.col("c_custkey").alias("account"), "c_mktsegment"), "accounts", "account")
    return owned, kept(owned, "purchases", "account"), accounts


@query(
    "C4 C15 D21 D22 D23 D24",
    """
SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS lines, count(DISTINCT o_custkey) AS buyers,
  round(sum(l_extendedprice), 1) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def colocated_accounts(t: Tables) -> DataFrame:
    """Lines with the attributes of their orders and accounts, without an exchange below either join."""
    _, purchases, accounts = bucketed_purchases(t)
    per_account = purchases.join(accounts, "account").groupBy("account", "c_mktsegment", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("total")
    )
    told = per_account.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg(
        F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("buyers"), F.sum("total").alias("total")
    )
    return rounded(told, 1, "total")


# --- rejects --------------------------------------------------------------------------


@query(
    "B10 B11 B14 A2",
    """
WITH l AS (SELECT o_orderkey % 17 = 0 AS short, o_orderkey % 19 = 0 AS blank, o_orderkey % 23 = 0 AS odd, o_orderkey % 29 = 0 AS untimed FROM orders)
SELECT unnest(['read', 'accepted', 'rejected', 'width', 'header', 'status', 'amount', 'time']) AS reason, unnest([
  count(*) + 3, count(*) FILTER (WHERE NOT (short OR blank OR odd OR untimed)), count(*) FILTER (WHERE short OR blank OR odd OR untimed) + 3,
  count(*) FILTER (WHERE short), 3, count(*) FILTER (WHERE short OR blank), count(*) FILTER (WHERE short OR odd) + 3,
  count(*) FILTER (WHERE untimed) + 3]) AS n FROM l""",
)
def rejected_lines(t: Tables) -> DataFrame:
    """A feed with faults, written in one pass as accepted rows and rejects with their reasons, and counted on the way."""
    number, path = F.col("o_orderkey"), fresh_path(t.spark, "judged")
    when = F.when(number % 29 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    amount = F.when(number % 23 == 0, F.lit("1,2x")).otherwise(F.col("o_totalprice").cast("string"))
    status = F.when(number % 19 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus"))
    whole = F.concat_ws(";", number.cast("string"), when, amount, status, "o_orderpriority")
    line = F.when(number % 17 == 0, F.concat_ws(";", number.cast("string"), when)).otherwise(whole).alias("value")
    header = t.spark.range(3).select(F.lit("id;created_at;amount;status;priority").alias("value"))
    part = lambda i: X.field("value", i, ";")
    rules = {
        "width": X.width("value", ";") > 4,
        "header": part(0) != "id",
        "status": X.is_filled(part(3)),
        "amount": X.number(part(2)).isNotNull(),
        "time": X.parse_time(part(1)).isNotNull(),
    }
    seen = Observation("feed")
    told = clean.judged(t.orders.select(line).unionByName(header), rules, seen)
    told.withColumn("accepted", F.size("reasons") == 0).write.partitionBy("accepted").parquet(path)
    counts = seen.get
    stored = t.spark.read.schema(told.schema.add("accepted", "boolean")).parquet(path)
    reasons = stored.filter("not accepted").select(F.explode("reasons").alias("reason")).groupBy("reason").count()
    both = stored.groupBy(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("reason")).count()
    read = t.spark.createDataFrame([("read", counts["read"])], "reason string, count bigint")
    return reasons.union(both).union(read).withColumnRenamed("count", "n")


# --- layouts --------------------------------------------------------------------------


def z_index(t: Tables, n_files: int | None = None) -> DataFrame:
    """An index of the lines that user, point and time search alike."""
    path = fresh_path(t.spark, "z-index")
    key = F.concat_ws("-", "order_id", "line").alias("row_key")
    # zone-free times are not compared with the statistics of row groups, dates are
    rows = with_account(all_lines(t), t).select(key, "account", "point_id", "paid_at", X.day_of("paid_at").alias("paid_on"))
    # some five hundred row groups, until they have the size that suits a large table
    group = min(max(t.lineitem.count() // 12, 4 << 10), 32 << 20)
    layouts.write_z_ordered(rows, path, ["account", "point_id", "paid_on"], "row_key", group, n_files)
    return t.spark.read.schema(rows.schema).parquet(path)


def z_searches() -> dict[str, Column]:
    days = (F.col("paid_on") >= F.lit(date(1997, 3, 1))) & (F.col("paid_on") <= F.lit(date(1997, 3, 14)))
    time = days & X.in_range("paid_at", "1997-03-01 00:00:00", "1997-03-15 00:00:00")
    return {"account": F.col("account") == 42, "point": F.col("point_id") == 7, "time": time, "key": F.col("row_key") == "1-3"}


@query(
    "E12 K1 K4 K7",
    """
WITH i AS (
  SELECT l_orderkey || '-' || l_linenumber AS row_key, o_custkey AS account, l_suppkey AS point_id, l_shipdate AS paid_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'account' AS search, row_key, account, point_id FROM i WHERE account = 42
UNION ALL SELECT 'point', row_key, account, point_id FROM i WHERE point_id = 7
UNION ALL SELECT 'time', row_key, account, point_id FROM i WHERE paid_at >= TIMESTAMP '1997-03-01' AND paid_at < TIMESTAMP '1997-03-15'
UNION ALL SELECT 'key', row_key, account, point_id FROM i WHERE row_key = '1-3'""",
)
def z_search(t: Tables) -> DataFrame:
    """Searches by user, point, time and key, each of which skips most of one index."""
    index = z_index(t)
    found = [index.filter(met).select(F.lit(name).alias("search"), "row_key", "account", "point_id") for name, met in z_searches().items()]
    return reduce(DataFrame.unionByName, found)


@query(
    "K5",
    """
SELECT c_name, c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000001000'
  AND (regexp_matches(c_name, '7[0-4]5$') OR contains(c_name, '33') OR starts_with(c_name, 'Customer#00000050'))""",
)
def keyed_scan_grams(t: Tables) -> DataFrame:
    """The scan for a pattern, a text or a prefix, over candidates out of a table of grams instead of all keys."""
    path = fresh_path(t.spark, "grams")
    table = t.customer.select("c_name", "c_custkey", "c_acctbal", "c_mktsegment")
    writers.write_sorted_by_key(layouts.key_grams(table, "c_name"), path, "gram")
    texts = [f"7{d}5\x03" for d in range(5)] + ["33", "\x02Customer#00000050"]
    near = layouts.keys_that_may_hold(t.spark.read.parquet(path), "c_name", texts)
    return keyed.scan_any(
        keyed.get_rows(table, near, "c_name"), "c_name", "Customer#000000100", "Customer#000001000",
        pattern="7[0-4]5$", part="33", prefix="Customer#00000050",
    )


# --- trees and histories --------------------------------------------------------------


def site_tree(t: Tables) -> DataFrame:
    """Points under sites under cities under one root, by text ids."""
    ids = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    under = lambda df, node, parent: df.select(node.alias("id"), parent.alias("parent_id"))
    return (
        under(t.supplier, ids("point-", "s_suppkey"), ids("site-", "s_nationkey"))
        .unionByName(under(t.nation, ids("site-", "n_nationkey"), ids("city-", "n_regionkey")))
        .unionByName(under(t.region, ids("city-", "r_regionkey"), F.lit("country")))
    )


@query(
    "C1 C2 C11 C19",
    f"""
WITH RECURSIVE tree AS (
  SELECT 'point-' || s_suppkey AS id, 'site-' || s_nationkey AS parent_id FROM supplier
  UNION ALL SELECT 'site-' || n_nationkey, 'city-' || n_regionkey FROM nation
  UNION ALL SELECT 'city-' || r_regionkey, 'country' FROM region),
up(id, above) AS (SELECT id, id FROM tree UNION ALL SELECT up.id, parent_id FROM up JOIN tree ON up.above = tree.id),
sold AS (SELECT 'point-' || l_suppkey AS id, sum(l_extendedprice) AS total FROM lineitem WHERE {SQL_VALID} GROUP BY 1)
SELECT above AS id, round(sum(total), 0) AS total, count(*) AS points FROM sold JOIN up USING (id) GROUP BY 1""",
)
def tree_sales(t: Tables) -> DataFrame:
    """Sales at every level of the site tree, whatever its depth."""
    above = history.ancestors(site_tree(t))
    sold = clean.below_cap(clean.without_promotions(all_lines(t), F.col("is_promotion")), CAP)
    per_point = sales.totals(sold, ["point_id"]).select(F.concat(F.lit("point-"), F.col("point_id").cast("string")).alias("id"), "total")
    sums = history.summed_upwards(per_point, above, "id", "total")
    known = history.summed_upwards(per_point.withColumn("total", F.lit(1)), above, "id", "total", "points")
    return rounded(sums.join(known, "id"), 0, "total")


def point_grades(t: Tables) -> DataFrame:
    """A grade for each point from one month of each year on."""
    years = t.supplier.select(F.col("s_suppkey").alias("point_id"), F.explode(F.sequence(F.lit(1996), F.lit(2001))).alias("year"))
    since = F.make_date("year", (F.col("point_id") % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    return years.select("point_id", since.alias("since"), ((F.col("point_id") * 7 + F.col("year")) % 5).alias("grade"))


@query(
    "C15 C20 E9",
    """
WITH grades AS (
  SELECT s_suppkey AS point_id, make_timestamp(year, 1 + s_suppkey % 12, 1, 0, 0, 0.0) AS since, (s_suppkey * 7 + year) % 5 AS grade
  FROM supplier, (SELECT unnest(range(1996, 2002)) AS year))
SELECT l_suppkey AS point_id, coalesce(grade, -1) AS grade, count(*) AS lines
FROM lineitem ASOF LEFT JOIN grades ON l_suppkey = point_id AND l_shipdate >= since GROUP BY ALL""",
)
def grades_as_of(t: Tables) -> DataFrame:
    """Lines with the grade that their point had on the day."""
    lines = all_lines(t).select("order_id", "line", "point_id", "paid_at")
    told = history.as_of_join(lines, point_grades(t), "point_id", "paid_at", "since", ["grade"], "order_id")
    return told.groupBy("point_id", F.coalesce("grade", F.lit(-1)).alias("grade")).agg(F.count(F.lit(1)).alias("lines"))
