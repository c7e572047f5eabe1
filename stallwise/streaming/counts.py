"""Streaming transformations: words, windows, running totals, block lists, clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.skew import salted_join
from stallwise.operators import clean


def words(lines: DataFrame, line: str = "value", separator: str = " ") -> DataFrame:
    """One row per non-empty word."""
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, F.explode(X.fields(line, separator)).alias("word")).filter(F.col("word") != "")


def word_counts(tokens: DataFrame) -> DataFrame:
    """Running total per word on a stream, plain count on a table."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def running_totals(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _window(ts: str, length: str, slide: str | None) -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def windowed_counts(
    stream: DataFrame,
    ts: str,
    length: str,
    *keys: str,
    slide: str | None = None,
    late_by: str | None = "10 minutes",
) -> DataFrame:
    """Rows per event-time window and key: tumbling, or sliding with ``slide``.

    ``late_by`` bounds the state: later rows are dropped. Use None only to replay a bounded
    table, where nothing may be dropped and the state ends with the table.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if late_by is not None:
        timed = timed.withWatermark(ts, late_by)
    grouped = timed.groupBy(_window(ts, length, slide).alias("window"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n"
    )


def without_blocked(
    stream: DataFrame, blocked: DataFrame, key: str, spread_by: str | None = None
) -> DataFrame:
    """Rows whose key is not on a static block list. The query keeps no state.

    The list may repeat keys, and a key may hold a large share of the stream.
    """
    listed = blocked.select(key).distinct()
    if spread_by is None:
        return stream.join(listed, key, "left_anti")
    return salted_join(stream, listed, key, spread_by, "left_anti")


def product_clicks(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines "user product category" as columns."""
    names = ("user", "product", "category")
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, *[X.field(line, i, " ").alias(n) for i, n in enumerate(names)])


def named_days(lines: DataFrame, separator: str = " ", line: str = "value") -> DataFrame:
    """Lines "day name" as columns, the input of the block-list job."""
    rest = [c for c in lines.columns if c != line]
    return lines.select(
        *rest, X.field(line, 0, separator).alias("day"), X.field(line, 1, separator).alias("name")
    )


def course_clicks(lines: DataFrame) -> DataFrame:
    """Clean click-log lines to (day, course_id, referer)."""
    return clean.parsed_clicks(lines).select(
        X.compact_day("clicked_at").alias("day"), "course_id", "referer"
    )


def timed_clicks(lines: DataFrame, late_by: str) -> DataFrame:
    """Clean click-log lines of a stream to (clicked_at, course_id, referer), each day open for ``late_by``."""
    clicks = clean.parsed_clicks(lines).select(F.col("clicked_at").cast("timestamp"), "course_id", "referer")
    return clicks.withWatermark("clicked_at", late_by)


def clicks_of_day(clicks: DataFrame, *keys: str) -> DataFrame:
    """Clicks per day and ``keys`` out of ``timed_clicks``; a day leaves the state when the watermark closes it."""
    day = F.window("clicked_at", "1 day").alias("_day")
    counted = clicks.groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(X.compact_day("_day.start").alias("day"), *keys, "n")


def clicks_per_course(clicks: DataFrame) -> DataFrame:
    return running_totals(clicks, "day", "course_id")


def clicks_per_host(clicks: DataFrame) -> DataFrame:
    return running_totals(clean.with_referer_host(clicks), "day", "host", "course_id")


def sql_on_stream(stream: DataFrame, view: str, query: str) -> DataFrame:
    """A SQL statement over a stream registered as a view."""
    stream.createOrReplaceTempView(view)
    return stream.sparkSession.sql(query)
