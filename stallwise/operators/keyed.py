"""Reads and deletes on a keyed order table, search on its index, and stored counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import expr as X


def get_row(table: DataFrame, key: str, value, columns: Sequence[str] | None = None) -> DataFrame:
    found = table.filter(F.col(key) == value)
    return found.select(*columns) if columns else found


def get_rows(
    table: DataFrame, keys: DataFrame, key: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of a list of keys. A key listed twice gives its row once."""
    found = table.join(keys.select(key).distinct(), key, "left_semi")
    return found.select(*columns) if columns else found


def key_exists(table: DataFrame, key: str, value) -> bool:
    return not table.filter(F.col(key) == value).limit(1).isEmpty()


def keys_exist(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each wanted key with whether the table has it."""
    wanted = keys.select(key).distinct()
    stored = table.select(key).distinct().withColumn("_found", F.lit(True))
    return wanted.join(stored, key, "left").select(key, F.col("_found").isNotNull().alias("found"))


def _key_range(key: str, start, stop) -> Column:
    return (F.col(key) >= start) & (F.col(key) < stop)


def scan(table: DataFrame, key: str, start, stop) -> DataFrame:
    """Rows with ``start <= key < stop``."""
    return table.filter(_key_range(key, start, stop))


def scan_any(
    table: DataFrame,
    key: str,
    start: str,
    stop: str,
    pattern: str | None = None,
    part: str | None = None,
    prefix: str | None = None,
) -> DataFrame:
    """A range scan that keeps keys matching a pattern, holding a text, or with a prefix."""
    tests = []
    if pattern is not None:
        tests.append(F.col(key).rlike(pattern))
    if part is not None:
        tests.append(F.col(key).contains(part))
    if prefix is not None:
        tests.append(F.col(key).startswith(prefix))
    rows = scan(table, key, start, stop)
    if not tests:
        return rows
    either = tests[0]
    for test in tests[1:]:
        either = either | test
    return rows.filter(either)


def scan_top(table: DataFrame, key: str, start, stop, n: int) -> DataFrame:
    """The first n rows of a key range, over the whole table."""
    return scan(table, key, start, stop).orderBy(key).limit(n)


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def delete_cells(table: DataFrame, keys: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Set columns to NULL in the rows of the listed keys."""
    marks = keys.select(key).distinct().withColumn("_delete", F.lit(True))
    joined = table.join(marks, key, "left")
    kept = {c: F.when(F.col("_delete").isNull(), F.col(c)) for c in columns}
    return joined.withColumns(kept).select(*table.columns)


# --- search ---------------------------------------------------------------------------


def matches(
    index: DataFrame,
    equals: Mapping[str, object],
    ts: str,
    start: X.TimeLike | None = None,
    end: X.TimeLike | None = None,
) -> DataFrame:
    """Index rows that meet all given predicates; None leaves a field open."""
    for name, value in equals.items():
        if value is not None:
            index = index.filter(F.col(name) == value)
    if start is not None:
        index = index.filter(F.col(ts) >= X.at(start))
    if end is not None:
        index = index.filter(F.col(ts) <= X.at(end))
    return index


def page(hits: DataFrame, ts: str, key: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (0-based), newest first, ties by key.

    All rows of the earlier pages are gathered on the way: for deep pages use ``page_after``.
    """
    ordered = hits.orderBy(F.col(ts).desc(), F.col(key))
    return ordered.offset(number * size).limit(size)


def page_after(hits: DataFrame, ts: str, key: str, size: int, last: tuple[X.TimeLike, object] | None = None) -> DataFrame:
    """The page behind the row ``last`` (its time and key), newest first; the first page without one.

    However deep the page, a task keeps no more than ``size`` rows.
    """
    if last is not None:
        moment = X.at(last[0])
        hits = hits.filter((F.col(ts) < moment) | ((F.col(ts) == moment) & (F.col(key) > F.lit(last[1]))))
    return hits.orderBy(F.col(ts).desc(), F.col(key)).limit(size)


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("hits"))


def full_rows(table: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Second step of a lookup: the complete rows behind the hits of the index."""
    return get_rows(table, hits, key)


# --- keys and counters ----------------------------------------------------------------


def with_row_keys(df: DataFrame, record_id: str, ts: str) -> DataFrame:
    return df.withColumns(
        {
            "time_key": X.reversed_time_key(record_id, ts),
            "digest_key": X.digest_key(record_id, X.compact_time(ts)),
            "letter_key": X.lettered_digest_key(record_id, ts),
        }
    )


def read_counters(wanted: DataFrame, counters: DataFrame, keys: Sequence[str], counter: str) -> DataFrame:
    """Stored count of each wanted key, 0 where none is stored."""
    joined = wanted.join(counters, list(keys), "left")
    return joined.withColumn(counter, F.coalesce(counter, F.lit(0)))


def documents(df: DataFrame, key: str) -> DataFrame:
    """Rows as (id, JSON document)."""
    return df.select(
        F.col(key).cast("string").alias("id"), X.json_document(*df.columns).alias("document")
    )
