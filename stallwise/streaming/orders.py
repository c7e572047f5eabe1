"""Order messages: parsing, row keys, idempotent ingest, publishing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwise.functions import expr as X
from stallwise.sources.schemas import ORDER_MESSAGE
from stallwise.sources.writers import BatchWriter, delta_sink


def parsed_orders(messages: DataFrame, value: str = "value") -> DataFrame:
    """CSV order messages to typed orders with their row key.

    The key depends on the message alone, so a replay meets its own row.
    """
    text = messages.select(F.inline(F.array(F.from_csv(value, ORDER_MESSAGE.toDDL()))))
    as_text = ("machine_id", "status", "pay_method", "account", "site_id", "point_id", "city")
    columns = {
        "order_id": F.col("order_id"),
        "created_at": X.parse_time("created_at"),
        **{c: F.col(c) for c in (*as_text, "product_id", "product_name")},
        "amount": X.number("amount"),
        "unit_price": X.number("unit_price"),
        "quantity": X.whole_number("quantity"),
    }
    typed = X.computed_once(text, columns)
    keyed = typed.withColumn("row_key", X.reversed_time_key("order_id", "created_at"))
    return keyed.filter(F.col("row_key").isNotNull())


def once(parsed: DataFrame, again_within: str) -> DataFrame:
    """Parsed orders without those whose row key has come before, in a stream that keeps its keys for a time.

    A message may come again while its event time is within ``again_within`` of the newest one; its key then
    leaves the state. ``observe`` counts what is read and what is kept: see ``stopped``.
    """
    timed = parsed.withColumn("_event_time", F.col("created_at").cast("timestamp")).withWatermark("_event_time", again_within)
    read = timed.observe("read", F.count(F.lit(1)).alias("n"))
    kept = read.dropDuplicatesWithinWatermark(["row_key"]).drop("_event_time")
    return kept.observe("kept", F.count(F.lit(1)).alias("n"))


def stopped(queries: Iterable[StreamingQuery]) -> tuple[int, int, int]:
    """Messages read, kept, and stopped as repeated, over the recent progress of some queries of ``once``."""
    read, kept = 0, 0
    for query in queries:
        for progress in query.recentProgress:
            seen = progress.observedMetrics
            read += seen["read"]["n"] if "read" in seen else 0
            kept += seen["kept"]["n"] if "kept" in seen else 0
    return read, kept, read - kept


def rejected_orders(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages that ``parsed_orders`` has no row or no key for: no id, or no time from 1970 to 2286."""
    text = messages.select(value, F.inline(F.array(F.from_csv(value, ORDER_MESSAGE.toDDL()))))
    key = X.reversed_time_key("order_id", X.parse_time("created_at"))
    return text.filter(key.isNull()).select(value)


def order_sink(path: str) -> BatchWriter:
    """Per-batch sink of the keyed order table; empty batches leave nothing behind.

    The table is what ``latest_deltas`` reads by row key: a message that comes again, in
    this batch or a later one, replaces its own row.
    """
    write = delta_sink(path)

    def write_filled(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch, batch_id)

    return write_filled


def publishable(lines: DataFrame, line: str = "value", delimiter: str = ",") -> DataFrame:
    """Field 0 as message key, fields 1 and 2 as value."""
    parts = [X.field(line, i, delimiter) for i in range(3)]
    return lines.select(parts[0].alias("key"), F.concat_ws(delimiter, *parts[1:]).alias("value"))
