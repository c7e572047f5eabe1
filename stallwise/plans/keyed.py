"""Queries on the keyed order table, its index, and stored counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.work import fresh_path
from stallwise.operators import clean, keyed
from stallwise.plans.registry import Tables, query
from stallwise.sources import readers, writers

# Customers are the keyed table here: c_name is its row key, stored as text.
_COLUMNS = ("c_name", "c_custkey", "c_acctbal", "c_mktsegment")
_SQL_COLUMNS = ", ".join(_COLUMNS)


def _table(t: Tables) -> DataFrame:
    return t.customer.select(*_COLUMNS)


@query("K1", "SELECT c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'")
def key_get(t: Tables) -> DataFrame:
    return keyed.get_row(_table(t), "c_name", "Customer#000000042", ["c_name", "c_acctbal"])


@query("K2", f"SELECT {_SQL_COLUMNS} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def multi_get(t: Tables) -> DataFrame:
    keys = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return keyed.get_rows(_table(t), keys, "c_custkey")


@query(
    "K3",
    """
SELECT DISTINCT o_custkey AS c_custkey,
  o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS found FROM orders""",
)
def key_exists(t: Tables) -> DataFrame:
    wanted = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return keyed.keys_exist(t.customer.filter("c_acctbal >= 0"), wanted, "c_custkey")


@query(
    "K4",
    f"SELECT {_SQL_COLUMNS} FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'",
)
def keyed_scan(t: Tables) -> DataFrame:
    return keyed.scan(_table(t), "c_name", "Customer#000000100", "Customer#000000200")


@query(
    "K5",
    f"""
SELECT {_SQL_COLUMNS} FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000001000'
  AND (regexp_matches(c_name, '7[0-4]5$') OR contains(c_name, '33') OR starts_with(c_name, 'Customer#00000050'))""",
)
def keyed_scan_or(t: Tables) -> DataFrame:
    return keyed.scan_any(
        _table(t), "c_name", "Customer#000000100", "Customer#000001000",
        pattern="7[0-4]5$", part="33", prefix="Customer#00000050",
    )


@query(
    "E7",
    f"SELECT {_SQL_COLUMNS} FROM customer WHERE c_name >= 'Customer#000000100' "
    "AND c_name < 'Customer#000001000' ORDER BY c_name LIMIT 20",
)
def range_first_n(t: Tables) -> DataFrame:
    return keyed.scan_top(_table(t), "c_name", "Customer#000000100", "Customer#000001000", 20)


@query("K6", f"SELECT {_SQL_COLUMNS} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def keyed_delete(t: Tables) -> DataFrame:
    doomed = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return keyed.delete_rows(_table(t), doomed, "c_custkey")


@query(
    "K6",
    """
SELECT c_name, c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
  THEN 'none' ELSE c_mktsegment END AS segment FROM customer""",
)
def keyed_delete_cells(t: Tables) -> DataFrame:
    doomed = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    kept = keyed.delete_cells(_table(t), doomed, "c_custkey", ["c_mktsegment"])
    return kept.select("c_name", "c_custkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


# --- search ---------------------------------------------------------------------------


def _index(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("row_key"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("paid_at"),
    )


def _hits(t: Tables) -> DataFrame:
    wanted = {"status": "F", "user_id": None}
    return keyed.matches(_index(t), wanted, "paid_at", "1997-01-01 00:00:00", "1997-12-31 00:00:00")


_SQL_HITS = (
    "FROM orders WHERE o_orderstatus = 'F' "
    "AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'"
)


@query(
    "E12",
    f"""
SELECT o_orderkey AS row_key, o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS paid
{_SQL_HITS} ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 10""",
)
def search_page(t: Tables) -> DataFrame:
    found = keyed.page(_hits(t), "paid_at", "row_key", number=1, size=10)
    return found.select("row_key", "user_id", F.date_format("paid_at", "yyyy-MM-dd").alias("paid"))


@query(
    "E12",
    f"""
SELECT row_key, user_id, paid, page FROM (
  SELECT o_orderkey AS row_key, o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS paid,
    (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) // 10 AS page {_SQL_HITS}) WHERE page < 4""",
)
def search_pages(t: Tables) -> DataFrame:
    """The first four pages, each found from the last row of the one before."""
    pages, last = [], None
    for number in range(4):
        found = keyed.page_after(_hits(t), "paid_at", "row_key", 10, last)
        rows = found.select("row_key", "user_id", "paid_at").collect()
        if not rows:
            break
        last = (rows[-1]["paid_at"], rows[-1]["row_key"])
        pages.append(found.withColumn("page", F.lit(number).cast("bigint")))
    shown = F.date_format("paid_at", "yyyy-MM-dd").alias("paid")
    return reduce(DataFrame.unionByName, pages).select("row_key", "user_id", shown, "page") if pages else _no_page(t)


def _no_page(t: Tables) -> DataFrame:
    return _hits(t).limit(0).select("row_key", "user_id", F.lit("").alias("paid"), F.lit(0).cast("bigint").alias("page"))


@query("E12", f"SELECT count(*) AS hits {_SQL_HITS}")
def search_total(t: Tables) -> DataFrame:
    return keyed.total(_hits(t))


@query("K7 E12", f"SELECT o_orderkey AS row_key, o_totalprice, o_orderpriority {_SQL_HITS}")
def two_step_lookup(t: Tables) -> DataFrame:
    table = t.orders.select(F.col("o_orderkey").alias("row_key"), "o_totalprice", "o_orderpriority")
    return keyed.full_rows(table, _hits(t), "row_key")


# --- keys, upserts, counters ----------------------------------------------------------


@query(
    "K8 F18",
    """
SELECT o_orderkey,
  substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3) || lpad(CAST(9999999999999 - epoch_ms(o_orderdate) AS VARCHAR), 13, '0')
    || '_' || o_orderkey AS time_key,
  md5(o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S')) AS digest_key,
  substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) || md5(o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S')) AS letter_key
FROM orders""",
)
def row_keys(t: Tables) -> DataFrame:
    keys = keyed.with_row_keys(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate")
    return keys.drop("o_orderdate")


@query(
    "K9",
    """
SELECT c_custkey, coalesce(n, 0) AS n FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey""",
)
def counter_read(t: Tables) -> DataFrame:
    counters = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return keyed.read_counters(t.customer.select("c_custkey"), counters, ["c_custkey"], "n")


_SQL_VERSIONS = """
SELECT o_orderkey, o_totalprice AS amount, 1 AS version, strftime(o_orderdate, '%Y') AS year FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, o_totalprice + 1, 2, strftime(o_orderdate, '%Y') FROM orders WHERE o_orderstatus <> 'O'"""


@query(
    "A14 A15 A16",
    f"""
SELECT o_orderkey, round(amount, 2) AS amount, version, year FROM ({_SQL_VERSIONS})
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) = 1""",
)
def upsert_latest(t: Tables) -> DataFrame:
    """Two overlapping batches into one keyed table, the second one applied twice."""
    year = F.date_format("o_orderdate", "yyyy").alias("year")

    def batch(status: str, version: int) -> DataFrame:
        rows = t.orders.filter(F.col("o_orderstatus") != status)
        amount = F.round(F.col("o_totalprice") + (version - 1), 2).alias("amount")
        return rows.select("o_orderkey", amount, F.lit(version).alias("version"), year)

    path = fresh_path(t.spark, "orders")
    first, second = batch("F", 1), batch("O", 2)
    for rows in (first, second, second):
        writers.upsert(rows, path, "o_orderkey", ["version"], "year")
    return t.spark.read.schema(first.schema).parquet(path)


@query(
    "A16 F19",
    """
SELECT CAST(c_custkey AS VARCHAR) AS id,
  '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS document FROM customer""",
)
def json_documents(t: Tables) -> DataFrame:
    return keyed.documents(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")


@query(
    "A17 K9",
    "SELECT c_mktsegment, 2 * count(*) AS n FROM customer GROUP BY 1",
)
def counter_sink(t: Tables) -> DataFrame:
    """Increments of three batches, the last one a replay of the second."""
    path = fresh_path(t.spark, "counters")
    counted = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    write = writers.delta_sink(path)
    for batch_id in (0, 1, 1):
        write(counted, batch_id)
    return writers.summed_deltas(t.spark, path, counted.schema, ["c_mktsegment"], "n")


@query(
    "A14 A17 ST3 ST9",
    "SELECT o_custkey, max(o_orderkey) AS last_order, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1",
)
def compacted_deltas(t: Tables) -> DataFrame:
    """A table of batches, compacted twice, read as its base and the batches since.

    Rows keep each account's last order, increments its number of orders; the third batch is
    written twice and counts once.
    """
    keys = ["o_custkey"]
    rows, sums = fresh_path(t.spark, "rows"), fresh_path(t.spark, "sums")
    counted = t.orders.groupBy(*keys, F.pmod("o_orderkey", F.lit(4)).alias("batch")).agg(
        F.max("o_orderkey").alias("last_order"), F.count(F.lit(1)).alias("orders")
    )
    last, number = counted.select(*keys, "last_order"), counted.select(*keys, "orders")
    latest, total = writers.latest_of(keys), writers.sum_of(keys, "orders")
    newest = lambda table: table.groupBy(*keys).agg(F.max("last_order").alias("last_order"))
    for batch in (0, 1, 2, 2, 3):
        part = counted.filter(F.col("batch") == batch)
        known = writers.read_deltas(t.spark, rows, last.schema).select(*keys, "last_order")
        state = newest(known.unionByName(part.select(*keys, "last_order")))
        writers.delta_sink(rows)(state, batch)
        writers.delta_sink(sums)(part.select(*keys, "orders"), batch)
        if batch in (0, 1):
            writers.compact(t.spark, rows, last.schema, latest, "o_custkey")
            writers.compact(t.spark, sums, number.schema, total, "o_custkey")
    stored = writers.latest_deltas(t.spark, rows, last.schema, keys)
    return stored.join(writers.summed_deltas(t.spark, sums, number.schema, keys, "orders"), keys)


@query(
    "A14 K1 K4",
    f"SELECT {_SQL_COLUMNS} FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'",
)
def compacted_scan(t: Tables) -> DataFrame:
    """A range scan of a table that was compacted by key: other files are skipped."""
    path = fresh_path(t.spark, "compacted")
    writers.write_sorted_by_key(_table(t), path, "c_name")
    return keyed.scan(t.spark.read.parquet(path), "c_name", "Customer#000000100", "Customer#000000200")


# --- files ----------------------------------------------------------------------------


@query(
    "A2 A3 A8 B15 U3",
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS balance FROM supplier",
)
def csv_roundtrip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    marked = F.concat(F.lit("("), F.col("s_suppkey").cast("string")).alias("s_suppkey")
    writers.write_csv(t.supplier.select(marked, "s_name", "s_acctbal"), path, header=False)
    read = clean.named_columns(readers.numbered_columns(t.spark, path, 3), {"c0": "id", "c1": "name", "c2": "balance"})
    return read.withColumns({"id": X.strip_marks("id", "()"), "balance": X.number("balance")})


@query("A1 A9 A10", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def text_roundtrip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "lines")
    writers.write_lines(t.orders, path, ["o_orderkey", "o_custkey", "o_orderstatus"], overwrite=False)
    fields = {"o_orderkey": 0, "o_custkey": 1, "o_orderstatus": 2}
    parsed = clean.parsed_lines(readers.text_lines(t.spark, path), fields, min_width=2)
    return parsed.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


@query(
    "A11",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
)
def partitioned_write(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "months")
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    counted = t.orders.groupBy(month, "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    writers.write_partitioned(counted, path, ["month"])
    return t.spark.read.schema(counted.schema).parquet(path)
