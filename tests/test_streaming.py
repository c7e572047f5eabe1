"""Streams over files, in one and in several micro-batches, against batch answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from frames import rows_of, timed
from stallwise.functions.work import fresh_path
from stallwise.plans import streams
from stallwise.plans.registry import Tables
from stallwise.sources import readers, writers
from stallwise.streaming import counts, orders, run


def _append(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def events(spark):
    """Five files of events, so that one file per batch gives five batches."""
    path = fresh_path(spark, "events")
    table = Tables(spark, f"{DATA}/sf0.001").events
    for part in table.randomSplit([1.0] * 5, seed=3):
        _append(part, path)
    return table, readers.stream_table(spark, path, table.schema, max_files=1)


def test_running_totals_over_many_batches(events):
    table, stream = events
    found = run.replay(counts.running_totals(stream, "event_type"), ["event_type"])
    expected = table.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    assert rows_of(found, "event_type", "n") == rows_of(expected, "event_type", "n")


def test_sliding_windows_over_many_batches(events):
    table, stream = events
    keys = ["window_start", "window_end", "event_type"]
    windows = dict(slide="12 hours", late_by=None)
    found = run.replay(counts.windowed_counts(stream, "ts", "1 day", "event_type", **windows), keys)
    expected = counts.windowed_counts(table, "ts", "1 day", "event_type", **windows)
    assert rows_of(found, *keys, "n") == rows_of(expected, *keys, "n")


def test_top_three_per_window(events):
    table, stream = events
    named = [s.select("ts", F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("product")) for s in (stream, table)]
    keys = ["window_start", "window_end", "category", "product"]
    streamed, batch = (counts.windowed_counts(s, "ts", "7 days", "category", "product", late_by=None) for s in named)
    found = run.top_per_window(run.replay(streamed, keys), "category", "product")
    expected = run.top_per_window(batch, "category", "product")
    assert rows_of(found, *keys, "n", "rank") == rows_of(expected, *keys, "n", "rank")
    assert found.agg(F.max("rank")).first()[0] == 3


def test_late_rows_are_dropped_after_the_watermark(spark):
    path = fresh_path(spark, "late")
    # Lateness is judged by the watermark of the batch before, so the third batch is dropped.
    batches = [("00:00:01", "01:00:00"), ("02:00:00",), ("00:00:02",)]
    for times in batches:
        rows = [("a", f"2024-01-01 {x}") for x in times]
        _append(timed(spark, rows, "k string, ts string", "ts"), path)
    schema = spark.read.parquet(path).schema
    stream = readers.stream_table(spark, path, schema, max_files=1)
    windows = counts.windowed_counts(stream, "ts", "1 minute", "k", late_by="10 minutes")
    found = run.replay(windows, ["window_start", "k"], may_drop=True)
    first = found.filter(F.hour("window_start") == 0).collect()
    assert [r["n"] for r in first] == [1]
    assert found.agg(F.sum("n")).first()[0] == 3


def test_windows_of_a_long_table_lose_no_rows(spark, tmp_path, monkeypatch):
    """400 days, far more than the watermark allows, in files of uneven numbers a quarter."""
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 8640).cast("timestamp_ntz")
    schema = Tables(spark, f"{DATA}/sf0.001").events.schema
    made = {"ts": ts, "event_id": F.col("id"), "event_type": F.lit("a")}
    rows = spark.range(4000).select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    rows.repartitionByRange(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    table = Tables(spark, str(tmp_path))
    monkeypatch.setitem(vars(table), "events", spark.read.parquet(f"{tmp_path}/events.parquet"))
    batches = []
    stream, feed = streams._events(table)
    note = lambda batch, _: batches.append(tuple(batch.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()))
    checkpoint = fresh_path(spark, "offsets")
    for _ in feed:
        run.start(stream, note, checkpoint, "append").awaitTermination()
    assert [b[2] for b in batches] == [1000] * 4 and all(x[1] < y[0] for x, y in zip(batches, batches[1:]))
    assert streams.st_count(table).agg(F.sum("n")).first()[0] == 4000


def test_a_row_that_a_feed_brings_too_late_is_an_error(spark):
    path = fresh_path(spark, "late")
    make = lambda x: timed(spark, [("a", f"2024-01-01 {x}")], "k string, ts string", "ts")
    _append(make("00:00:01").limit(0), path)
    stream = readers.stream_table(spark, path, make("00:00:01").schema)
    windows = counts.windowed_counts(stream, "ts", "1 minute", "k", late_by="10 minutes")
    feed = (_append(make(x), path) for x in ("02:00:00", "02:05:00", "00:00:02"))
    with pytest.raises(ValueError, match="1 rows"):
        run.replay(windows, ["window_start", "k"], feed)


def test_block_list_on_a_stream(spark, events):
    table, stream = events
    blocked = table.filter("event_type = 'error'").select("user_id").distinct()
    found = run.replay(counts.without_blocked(stream, blocked, "user_id"))
    expected = table.join(blocked, "user_id", "left_anti")
    assert rows_of(found, "event_id") == rows_of(expected, "event_id")


def test_words_from_new_text_files(spark):
    path = fresh_path(spark, "text")
    for lines in (["to be  or", "not"], ["to be"]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    totals = counts.word_counts(counts.words(readers.new_text_files(spark, path, max_files=1)))
    assert rows_of(run.replay(totals, ["word"]), "word", "n") == [("be", 2), ("not", 1), ("or", 1), ("to", 2)]


def test_sql_on_a_stream(events):
    table, stream = events
    query = "SELECT event_type, max(value) AS top FROM ev GROUP BY event_type"
    found = run.replay(counts.sql_on_stream(stream, "ev", query), ["event_type"])
    expected = table.groupBy("event_type").agg(F.max("value").alias("top"))
    assert rows_of(found, "event_type", "top") == rows_of(expected, "event_type", "top")


MESSAGE = "{id},2024-01-0{d} 10:00:00,m1,1,102,{amount},u{id},2024-01-01 10:00:01,9,s1,p1,city,77,tea,1.5,{n},1,0,m1,d"


def test_order_messages_are_stored_once(spark):
    path, table, checkpoint = (fresh_path(spark, n) for n in ("messages", "table", "offsets"))
    batches = [
        [MESSAGE.format(id=1, d=1, amount="250.5", n=2), MESSAGE.format(id=2, d=2, amount="x", n=""), "garbage", ""],
        [MESSAGE.format(id=1, d=1, amount="251", n=3), MESSAGE.format(id=1, d=1, amount="251", n=3)],
    ]
    schema = None
    for _ in range(2):  # the second run finds nothing new
        for lines in batches:
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
        batches = []
        parsed = orders.parsed_orders(readers.new_text_files(spark, path, max_files=1))
        schema = parsed.schema
        run.start(parsed, orders.order_sink(table), checkpoint, mode="append").awaitTermination()
    stored = writers.latest_deltas(spark, table, schema, ["row_key"])
    assert rows_of(stored, "order_id", "amount", "quantity", "account") == [("1", 251.0, 3, "u1"), ("2", None, None, "u2")]


def test_publishable_fields(spark):
    df = spark.createDataFrame([("a,b,c,d",), ("k,v",)], "value string")
    assert rows_of(orders.publishable(df), "key", "value") == [("a", "b,c"), ("k", "v")]


def test_click_log(spark):
    lines = [
        "10.0.0.1\t2024-01-05 10:00:00\tGET /class/112.html HTTP/1.1\t200\thttps://www.search.com//s?q=x",
        "10.0.0.1\t2024-01-05 10:00:00\tGET /class/112.html HTTP/1.1\t200\t-",
        "10.0.0.1\t2024-01-05 10:00:00\tGET /learn/9.html HTTP/1.1\t200\t-",
        "10.0.0.1\t2024-01-06 10:00:00\tGET /class/0.html HTTP/1.1\t404\t-",
        "broken",
    ]
    clicks = counts.course_clicks(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows_of(counts.clicks_per_course(clicks), "day", "course_id", "n") == [("20240105", 112, 2)]
    assert rows_of(counts.clicks_per_host(clicks), "host", "n") == [("www.search.com", 1)]


def test_block_list_lines(spark):
    df = spark.createDataFrame([("20240101 tom",), ("20240101 ann",)], "value string")
    names = counts.named_days(df)
    blocked = spark.createDataFrame([("tom",)], "name string")
    assert rows_of(counts.without_blocked(names, blocked, "name"), "day", "name") == [("20240101", "ann")]


def test_words_per_window(spark):
    """Lines with an arrival time, as a socket or broker gives them."""
    path = fresh_path(spark, "timed_lines")
    rows = [("a b a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:04"), ("a", "2024-01-01 00:00:06")]
    _append(timed(spark, rows, "value string, timestamp string", "timestamp"), path)
    stream = readers.stream_table(spark, path, spark.read.parquet(path).schema)
    windows = counts.windowed_counts(counts.words(stream), "timestamp", "5 seconds", "word", late_by=None)
    found = run.replay(windows, ["window_start", "word"]).withColumn("second", F.second("window_start"))
    assert rows_of(found, "second", "word", "n") == [(0, "a", 2), (0, "b", 2), (5, "a", 1)]
