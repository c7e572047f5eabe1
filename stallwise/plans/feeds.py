"""Queries on raw feeds: cleaning, scalars, words, clicks and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.operators import clean
from stallwise.plans.binding import SQL_CLICKS, click_lines
from stallwise.plans.registry import Tables, query
from stallwise.streaming import counts


@query(
    "B1 B4 B5 B7 B10 B11 B14 F1 F2 F4 F5 F13",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS ordered,
  o_totalprice AS amount, replace(o_orderpriority, '#', '') AS priority
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1998-05-01'
  AND o_orderstatus <> 'P' AND o_totalprice < 400000""",
)
def clean_orders(t: Tables) -> DataFrame:
    """Orders written as raw lines, with marks, blanks and a repeated header, and parsed back."""
    blank_if_open = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    lines = t.orders.select(
        F.concat_ws(
            ",",
            F.concat(F.lit("("), F.col("o_orderkey").cast("string")),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
            F.col("o_totalprice").cast("string"),
            blank_if_open,
            F.concat(F.col("o_orderpriority"), F.lit("#)")),
        ).alias("value")
    )
    header = t.spark.range(1).select(F.lit("id,created_at,amount,status,priority").alias("value"))
    fields = {"id": 0, "created_at": 1, "amount": 2, "status": 3, "priority": 4}
    parsed = clean.parsed_lines(lines.unionByName(header), fields, min_width=4)
    parsed = clean.non_blank(clean.without_header_rows(parsed), ["id", "created_at", "status"])
    typed = clean.without_promotions(clean.below_cap(clean.typed_orders(parsed), 400000))
    year = clean.between(typed, "1997-05-01 00:00:00", "1998-05-01 00:00:00", "created_at")
    return year.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("ordered"), "amount", "priority")


@query(
    "B9 B13",
    """
SELECT p_partkey AS machine_id, p_brand AS site_id, p_type AS point_id FROM part
WHERE p_size >= 10 AND p_retailprice >= 950 AND p_name NOT LIKE 'hot%' AND p_brand NOT IN ('Brand#1', 'Brand#6')""",
)
def eligible_devices(t: Tables) -> DataFrame:
    machines = t.part.select(
        F.col("p_partkey").alias("machine_id"),
        F.col("p_brand").alias("site_id"),
        F.col("p_type").alias("point_id"),
        F.when(F.col("p_size") >= 10, "2").otherwise("1").alias("kind"),
        F.when(F.col("p_retailprice") >= 950, "1").otherwise("0").alias("enabled"),
        F.when(F.col("p_name").startswith("hot"), "1").otherwise("0").alias("fault"),
    )
    kept = clean.eligible_machines(machines, ("Brand#1", "Brand#6"))
    return kept.select("machine_id", "site_id", "point_id")


@query(
    "F3 F6 F7 F8 F15",
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day,
  strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y%m%d%H%M%S') AS compact_time,
  date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS days,
  date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') // 365 AS years,
  strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS previous_month,
  week(CAST(o_orderdate AS DATE) - INTERVAL 7 DAY) AS previous_week
FROM orders""",
)
def scalar_dates(t: Tables) -> DataFrame:
    now = X.at("2002-01-01 00:00:00")
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    ts = X.parse_time(text)
    return t.orders.select(
        "o_orderkey",
        X.month_of(ts).alias("month"),
        X.day_of(ts).cast("string").alias("day"),
        X.compact_day(ts).alias("compact"),
        X.compact_time(ts).alias("compact_time"),
        X.whole_days(ts, now).alias("days"),
        X.whole_years(X.whole_days(ts, now)).alias("years"),
        X.previous_month(ts).alias("previous_month"),
        X.previous_iso_week(ts).cast("bigint").alias("previous_week"),
    )


@query(
    "F10 F16 F18 F19",
    """
SELECT o_orderkey, round(o_totalprice / 7, 2) AS two_decimals, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS padded,
  lpad(CAST(o_orderkey + 1 AS VARCHAR), 12, '0') AS next_padded, md5(o_orderpriority) AS digest,
  '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS document
FROM orders""",
)
def scalar_misc(t: Tables) -> DataFrame:
    padded = X.zero_padded("o_orderkey", 12)
    return t.orders.select(
        "o_orderkey",
        X.two_decimals(F.col("o_totalprice") / 7).alias("two_decimals"),
        padded.alias("padded"),
        X.next_number(padded, 12).alias("next_padded"),
        X.digest_key("o_orderpriority").alias("digest"),
        X.json_document("o_orderkey", "o_orderstatus").alias("document"),
    )


@query(
    "F17 B21",
    r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*?)(\.[^./]*)?$', 1) AS stem,
  regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '\.([^./]*)$', 1) AS extension
FROM pages""",
)
def url_parts(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    name = F.regexp_extract(path, "[^/]*$", 0)
    return t.pages.select(
        "page_id",
        X.url_host("url").alias("host"),
        X.file_stem(path).alias("stem"),
        X.file_extension(name).alias("extension"),
    )


SQL_WORDS = """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
WHERE word <> '' GROUP BY 1"""


@query("D32 ST1", SQL_WORDS)
def sql_word_count(t: Tables) -> DataFrame:
    tokens = counts.words(t.documents.select("text"), "text")
    return t.spark.sql("SELECT word, count(*) AS n FROM {tokens} GROUP BY word", tokens=tokens)


SQL_CLICKS_PER_COURSE = f"SELECT day, course_id, count(*) AS n FROM ({SQL_CLICKS}) WHERE course_id <> 0 GROUP BY 1, 2"
SQL_CLICKS_PER_HOST = (
    f"SELECT day, host, course_id, count(*) AS n FROM ({SQL_CLICKS}) "
    "WHERE course_id <> 0 AND host IS NOT NULL GROUP BY 1, 2, 3"
)


@query("D33 B20 F6", SQL_CLICKS_PER_COURSE)
def clicks_per_day_page(t: Tables) -> DataFrame:
    return counts.clicks_per_course(counts.course_clicks(click_lines(t)))


@query("D33 B20 B21", SQL_CLICKS_PER_HOST)
def clicks_per_host(t: Tables) -> DataFrame:
    return counts.clicks_per_host(counts.course_clicks(click_lines(t)))


@query("B23 A18", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000.0")
def predicate_sql(t: Tables) -> DataFrame:
    return clean.above_by_sql(t.orders, "o_totalprice", 300000.0).select("o_orderkey", "o_totalprice")
