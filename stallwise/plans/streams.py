"""Streaming queries, replayed over the test tables as file streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.work import cut, fresh_path
from stallwise.operators import clean
from stallwise.plans.binding import click_lines
from stallwise.plans.feeds import SQL_CLICKS_PER_COURSE, SQL_CLICKS_PER_HOST, SQL_WORDS
from stallwise.plans.registry import Tables, query, shown
from stallwise.sources import readers, writers
from stallwise.sources.writers import delta_sink, latest_deltas, read_deltas
from stallwise.streaming import counts, orders, run


def _stream(t: Tables, name: str) -> DataFrame:
    return readers.stream_table(t.spark, t.path(name), getattr(t, name).schema)


BATCHES = 4
LATE_BY = "8 days"  # a batch holds no row from before the end of the last one, so however long it is none is too late


def _events(t: Tables) -> tuple[DataFrame, Iterator[int]]:
    """The events as a stream, and the steps that write them: in order of time, each step one micro-batch."""
    path = fresh_path(t.spark, "events")
    t.events.limit(0).write.parquet(path)

    def written() -> Iterator[int]:
        first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
        for i in range(BATCHES if first is not None else 0):
            begin, end = (first + (last - first) * n / BATCHES for n in (i, i + 1))
            upto = F.col("ts") < X.at(end) if i < BATCHES - 1 else F.lit(True)
            t.events.filter((F.col("ts") >= X.at(begin)) & upto).write.mode("append").parquet(path)
            yield i

    return readers.stream_table(t.spark, path, t.events.schema, max_files=2**31 - 1), written()


def _windows(t: Tables, length: str, *keys: str, slide: str | None = None) -> tuple[DataFrame, Iterator[int]]:
    events, feed = _events(t)
    return counts.windowed_counts(events, "ts", length, *keys, slide=slide, late_by=LATE_BY), feed


def _sql_windows(seconds: int, slide: int, keys: str = "event_type, ") -> str:
    steps = seconds // slide
    return f"""
SELECT strftime(to_timestamp(start) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(to_timestamp(start + {seconds}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_end, {keys}count(*) AS n
FROM (SELECT *, (CAST(floor(epoch(ts)) AS BIGINT) // {slide} - step) * {slide} AS start
  FROM events, range({steps}) r(step)) GROUP BY ALL"""


@query("ST2 A6 ST12", _sql_windows(5, 5))
def st_tumbling(t: Tables) -> DataFrame:
    windows, feed = _windows(t, "5 seconds", "event_type")
    totals = run.replay(windows, ["window_start", "window_end", "event_type"], feed)
    return shown(totals, "window_start", "window_end")


@query("ST4", _sql_windows(60, 10))
def st_sliding(t: Tables) -> DataFrame:
    windows, feed = _windows(t, "60 seconds", "event_type", slide="10 seconds")
    return shown(run.replay(windows, ["window_start", "window_end", "event_type"], feed), "window_start", "window_end")


@query("ST8", _sql_windows(3600, 3600, ""))
def st_count(t: Tables) -> DataFrame:
    windows, feed = _windows(t, "1 hour")
    return shown(run.replay(windows, ["window_start", "window_end"], feed), "window_start", "window_end")


@query("ST3 ST1 ST12", SQL_WORDS)
def st_running_total(t: Tables) -> DataFrame:
    """Totals that a table keeps: the stream has no state, its batches are increments."""
    lines = _stream(t, "documents").select("text")
    return run.replay_increments(counts.words(lines, "text"), ["word"])


@query(
    "ST5",
    f"""
WITH w AS ({_sql_windows(86400, 43200, "event_type, user_id, ")})
SELECT window_start, window_end, category, product, n, rank FROM (
  SELECT *, event_type AS category, CAST(user_id AS VARCHAR) AS product,
    row_number() OVER (PARTITION BY window_start, event_type ORDER BY n DESC, CAST(user_id AS VARCHAR)) AS rank FROM w)
WHERE rank <= 3""",
)
def st_top3(t: Tables) -> DataFrame:
    windows, feed = _product_windows(t)
    totals = run.replay(windows, ["window_start", "window_end", "category", "product"], feed)
    return shown(run.top_per_window(totals, "category", "product"), "window_start", "window_end")


def _product_windows(t: Tables) -> tuple[DataFrame, Iterator[int]]:
    events, feed = _events(t)
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type"))
    clicks = counts.product_clicks(events.select("ts", line.alias("value")))
    return counts.windowed_counts(clicks, "ts", "1 day", "category", "product", slide="12 hours", late_by=LATE_BY), feed


@query(
    "ST5",
    f"""
WITH w AS ({_sql_windows(86400, 43200, "event_type, user_id, ")}),
closed AS (SELECT * FROM w WHERE window_end <= (SELECT strftime(max(ts) - INTERVAL {LATE_BY}, '%Y-%m-%d %H:%M:%S') FROM events))
SELECT window_start, window_end, category, product, n, rank FROM (
  SELECT *, event_type AS category, CAST(user_id AS VARCHAR) AS product,
    row_number() OVER (PARTITION BY window_start, event_type ORDER BY n DESC, CAST(user_id AS VARCHAR)) AS rank FROM closed)
WHERE rank <= 3""",
)
def st_top3_closing(t: Tables) -> DataFrame:
    """The top three of each window, ranked as the window closes."""
    windows, feed = _product_windows(t)
    ranked = run.replay_closing(windows, "category", "product", feed=feed)
    return shown(ranked, "window_start", "window_end")


@query("ST7 D32", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def st_sql(t: Tables) -> DataFrame:
    statement = "SELECT event_type, count(*) AS n, sum(value) AS total FROM event_stream GROUP BY event_type"
    totals = run.replay(counts.sql_on_stream(_stream(t, "events"), "event_stream", statement), ["event_type"])
    return totals.withColumn("total", F.round("total", 2))


_SQL_BLOCKED = "SELECT user_id FROM events GROUP BY 1 HAVING sum(value) > (SELECT 1.1 * sum(value) / count(DISTINCT user_id) FROM events)"


@query("ST6 C18", f"SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN ({_SQL_BLOCKED})")
def st_blocklist(t: Tables) -> DataFrame:
    per_user = t.events.groupBy("user_id").agg(F.sum("value").alias("total"))
    mean = per_user.agg(F.sum("total") * 1.1 / F.count(F.lit(1))).scalar()
    # Stored outside the query: a micro-batch reads the list, it does not compute it again.
    blocked = cut(per_user.filter(F.col("total") > mean).select("user_id"), "blocked")
    stream = _stream(t, "events").select("event_id", "user_id", "event_type")
    kept = counts.without_blocked(stream, blocked, "user_id", "event_id")
    return run.replay(kept).select("event_id", "user_id", "event_type")


def _clicks(t: Tables) -> tuple[DataFrame, Iterator[int]]:
    """Clicks in order of time: a day is closed, and leaves the state, LATE_BY after its end."""
    events, feed = _events(t)
    return counts.timed_clicks(click_lines(Tables(t.spark, t.folder, {"events": events})), LATE_BY), feed


@query("ST11 D33 A17", SQL_CLICKS_PER_COURSE)
def st_clicks(t: Tables) -> DataFrame:
    clicks, feed = _clicks(t)
    return run.replay(counts.clicks_of_day(clicks, "course_id"), ["day", "course_id"], feed)


@query("ST11 B21 A17", SQL_CLICKS_PER_HOST)
def st_clicks_per_host(t: Tables) -> DataFrame:
    clicks, feed = _clicks(t)
    return run.replay(counts.clicks_of_day(clean.with_referer_host(clicks), "host", "course_id"), ["day", "host", "course_id"], feed)


# --- order messages -------------------------------------------------------------------


def _messages(t: Tables) -> DataFrame:
    """The stream of orders as CSV messages: order id, then the fields of the order feed."""
    return _as_messages(_stream(t, "orders"))


def _as_messages(o: DataFrame) -> DataFrame:
    empty = F.lit("")
    fields = [
        F.col("o_orderkey").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.lit("m"), F.col("o_custkey").cast("string")),
        F.col("o_orderstatus"),
        F.lit("102"),
        F.col("o_totalprice").cast("string"),
        F.col("o_custkey").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        *[empty] * 4,
        F.col("o_orderpriority"),
        F.concat(F.lit("product "), F.col("o_orderstatus")),
        F.lit("1.5"),
        F.lit("2"),
        *[empty] * 4,
    ]
    return o.select(F.concat_ws(",", *fields).alias("value"))


@query(
    "ST9 A14 K8",
    """
SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3) || lpad(CAST(9999999999999 - epoch_ms(o_orderdate) AS VARCHAR), 13, '0')
    || '_' || o_orderkey AS row_key, CAST(o_orderkey AS VARCHAR) AS order_id, o_totalprice AS amount,
  CAST(o_custkey AS VARCHAR) AS account, o_orderpriority AS product_id, 3.0::DOUBLE AS charged
FROM orders""",
)
def st_upsert(t: Tables) -> DataFrame:
    path, checkpoint = fresh_path(t.spark, "keyed"), fresh_path(t.spark, "offsets")
    parsed = orders.parsed_orders(_messages(t))
    run.start(parsed, orders.order_sink(path), checkpoint, mode="append").awaitTermination()
    table = latest_deltas(t.spark, path, parsed.schema, ["row_key"])
    charged = (F.col("unit_price") * F.col("quantity")).alias("charged")
    return table.select("row_key", "order_id", "amount", "account", "product_id", charged)


@query(
    "ST9 A14 E9",
    """
SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3) || lpad(CAST(9999999999999 - epoch_ms(o_orderdate) AS VARCHAR), 13, '0')
    || '_' || o_orderkey AS row_key, o_totalprice AS amount, CAST(1 AS BIGINT) AS batches, n_read, n_kept, n_read - n_kept AS n_stopped
FROM orders, (SELECT 2 * count(*) AS n_read, count(*) AS n_kept FROM orders)""",
)
def st_once(t: Tables) -> DataFrame:
    """A topic folder that is played a second time: no key reaches the sink twice, and the counts add up."""
    first, last = t.orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    folder, path, checkpoint = (fresh_path(t.spark, n) for n in ("topic", "keyed", "offsets"))
    t.orders.limit(0).write.parquet(folder)
    middle = X.at(first + (last - first) / 2) if first is not None else F.lit(None)
    early = F.coalesce(F.col("o_orderdate") < middle, F.lit(False))

    def feed() -> Iterator[int]:
        for i, step in enumerate((early, F.lit(True), ~early)):  # the early half, all of it, the late half again
            t.orders.filter(step).write.mode("append").parquet(folder)
            yield i

    messages = _as_messages(readers.stream_table(t.spark, folder, t.orders.schema, max_files=2**31 - 1))
    span = f"{(last - first).days + 1} days" if first is not None else "1 day"
    parsed = orders.once(orders.parsed_orders(messages), span)
    read, kept, stopped = orders.stopped(run.drain(parsed, delta_sink(path), checkpoint, feed=feed()))
    written = read_deltas(t.spark, path, parsed.schema)
    per_key = written.groupBy("row_key").agg(F.max("amount").alias("amount"), F.count(F.lit(1)).alias("batches"))
    counts_ = {"n_read": read, "n_kept": kept, "n_stopped": stopped}
    return per_key.withColumns({c: F.lit(n).cast("bigint") for c, n in counts_.items()})


STEPS = 3


@query(
    "A6 ST1 ST12 A3",
    f"""
SELECT doc_id % {STEPS} AS step, count(*) AS lines, sum(len(regexp_extract_all(text, '[^\\s]+'))) AS words,
  CAST(1 AS BIGINT) AS times_read FROM documents GROUP BY 1""",
)
def st_text_folder(t: Tables) -> DataFrame:
    """Documents dropped into a folder as text files in three steps, each by its own start of the query."""
    folder, archive, path, checkpoint = (fresh_path(t.spark, n) for n in ("inbox", "archive", "lines", "offsets"))
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace("text", r"\s+", " ")).alias("value")

    def feed() -> Iterator[int]:
        for i in range(STEPS):
            part = t.documents.filter(F.pmod("doc_id", F.lit(STEPS)) == i).select(line)
            writers.write_lines(part, f"{folder}/step-{i}", ["value"])
            yield i

    t.spark.createDataFrame([], "value string").write.text(f"{folder}/step-none")
    stream = readers.new_text_files(t.spark, f"{folder}/step-*", archive=archive)
    run.drain(stream, delta_sink(path), checkpoint, feed=feed())
    read = read_deltas(t.spark, path, stream.schema).filter(F.col("value") != "")
    step = F.regexp_extract("file", r"step-(\d+)/", 1).cast("bigint").alias("step")
    words = F.size(F.filter(X.fields("value", " "), lambda w: w != "")).cast("bigint") - 1  # the id leads the line
    per_file = read.groupBy(step, "file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(words).alias("words"), F.count_distinct("run", "batch_id").alias("times")
    )
    return per_file.groupBy("step").agg(
        F.sum("lines").alias("lines"), F.sum("words").alias("words"), F.max("times").alias("times_read")
    )


@query(
    "ST10 A13",
    "SELECT CAST(o_orderkey AS VARCHAR) AS key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ',m' || o_custkey AS value FROM orders",
)
def st_publish(t: Tables) -> DataFrame:
    """What is published per message, stored by file instead of a broker."""
    return run.replay(orders.publishable(_messages(t)))
