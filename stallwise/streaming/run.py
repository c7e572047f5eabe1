"""Starting queries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwise.functions.work import fresh_path
from stallwise.operators.ranking import top_n
from stallwise.sources.writers import BatchWriter, delta_sink, latest_deltas, read_deltas, summed_deltas


def start(
    stream: DataFrame,
    writer: BatchWriter,
    checkpoint: str,
    mode: str = "update",
    every: str | None = None,
) -> StreamingQuery:
    """Run a query: on a fixed trigger, or once over all that is available."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(writer)
    )
    query = query.trigger(processingTime=every) if every else query.trigger(availableNow=True)
    return query.start()


def drain(
    stream: DataFrame, writer: BatchWriter, checkpoint: str, mode: str = "append",
    feed: Iterable[object] | None = None, may_drop: bool = False,
) -> list[StreamingQuery]:
    """Run a query over all that is available, once, or once after each step of ``feed``; the queries that ran.

    Rows that come later than the watermark allows are an error, unless they ``may_drop``.
    """
    queries = []
    for _ in [None] if feed is None else feed:
        query = start(stream, writer, checkpoint, mode)
        query.awaitTermination()
        lost = 0 if may_drop else dropped_rows(query)
        if lost:
            raise ValueError(f"{lost} rows came later than the watermark allows")
        queries.append(query)
    return queries


def replay_increments(
    stream: DataFrame, keys: Sequence[str], feed: Iterable[object] | None = None, counter: str = "n"
) -> DataFrame:
    """Running totals of a stream that keeps no state: each batch is counted and the sink adds up its increments.

    The table of increments is compacted like any other (``writers.compact`` with ``sum_of``), so it follows the number of
    keys, and a replayed batch counts once.
    """
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, "increments"), fresh_path(spark, "offsets")
    write = delta_sink(path)

    def counted(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias(counter))

    schema = counted(spark.createDataFrame([], stream.schema)).schema
    drain(stream, lambda batch, number: write(counted(batch), number), checkpoint, feed=feed)
    return summed_deltas(spark, path, schema, keys, counter)


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The state that a stopped query keeps, read back: one row per key."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def replay(
    stream: DataFrame, keys: Sequence[str] | None = None, feed: Iterable[object] | None = None, may_drop: bool = False
) -> DataFrame:
    """Run a stream over everything available and return what its sink then holds.

    ``feed`` adds to the stream's source step by step. All that a step adds is read before the next.
    Rows that come too late are an error, unless they ``may_drop``.

    With ``keys`` the stream emits running totals and the latest per key is returned,
    otherwise it appends rows.
    """
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, "deltas"), fresh_path(spark, "offsets")
    mode = "append" if keys is None else "update"
    drain(stream, delta_sink(path), checkpoint, mode, feed, may_drop)
    if keys is None:
        return read_deltas(spark, path, stream.schema).drop("run", "batch_id")
    return latest_deltas(spark, path, stream.schema, keys)


def replay_closing(
    counted: DataFrame, category: str, product: str, n: int = 3, feed: Iterable[object] | None = None
) -> DataFrame:
    """Top products of each window, ranked inside the stream when the watermark closes the window.

    In append mode a window leaves the state once, complete, so its ranks are final. Windows
    that are still open when the stream ends stay in its checkpoint. ``feed`` is as in ``replay``.
    """
    spark = counted.sparkSession
    path, checkpoint = fresh_path(spark, "deltas"), fresh_path(spark, "offsets")
    write = delta_sink(path)
    schema = top_per_window(spark.createDataFrame([], counted.schema), category, product, n).schema

    def ranked(batch: DataFrame, batch_id: int) -> None:
        write(top_per_window(batch, category, product, n), batch_id)

    drain(counted, ranked, checkpoint, "append", feed)
    return read_deltas(spark, path, schema).drop("run", "batch_id")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came later than the watermark allows, over the query's recent progress."""
    states = (s for p in query.recentProgress for s in p["stateOperators"])
    return sum(s["numRowsDroppedByWatermark"] for s in states)


def top_per_window(counted: DataFrame, category: str, product: str, n: int = 3) -> DataFrame:
    """Top products per window and category, out of the table that a count stream keeps.

    A stream cannot be ranked itself, because a rank may change with every later row.
    """
    return top_n(counted, ["window_start", "window_end", category], "n", product, n)
