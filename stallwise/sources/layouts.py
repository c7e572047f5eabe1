"""Table layouts that save a shuffle or a scan: buckets, Z order, and grams of keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.work import cut, parts_for

Z_BITS = 8  # of each column in a Z order
GRAM = 3


def write_bucketed(df: DataFrame, table: str, path: str, by: str, buckets: int) -> DataFrame:
    """``df`` as a table in ``buckets`` files' worth of hash buckets of ``by``, sorted in each.

    Tables with the same buckets join on ``by`` without an exchange, and their hot keys without one too;
    choose the number so that a bucket fits a task. Rows are dealt once, here, so that each bucket is one file.
    """
    dealt = df.repartition(buckets, by)
    dealt.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


# --- Z order --------------------------------------------------------------------------


def quantile_bounds(df: DataFrame, columns: Sequence[str], bits: int = Z_BITS) -> dict[str, list]:
    """For each column the values that part its rows evenly, 2**bits - 1 at most."""
    parts = 1 << bits
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(*[F.percentile_approx(c, shares, 10 * parts).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def _spread(part: int, place: int, columns: int, bits: int) -> int:
    return sum((part >> i & 1) << (i * columns + place) for i in range(bits))


def z_value(bounds: Mapping[str, Sequence], bits: int = Z_BITS) -> Column:
    """The bits of each column's part, interleaved: near values of all columns get near numbers. NULL comes first."""
    terms = []
    for j, (column, limits) in enumerate(bounds.items()):
        if not limits:
            continue
        # how many limits a value has reached, found by halving
        n, sorted_limits = len(limits), F.sort_array(F.array(*[F.lit(x) for x in limits]))
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
        reached = lambda at, step: F.get(sorted_limits, at + step - 1) <= F.col(column)  # noqa: B023, E731
        part = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(reached(at, step), step).otherwise(0))  # noqa: B023
        # a column of few values spreads over all bits too, so that each column decides as often
        parts = [i * ((1 << bits) - 1) // n for i in range(n + 1)]
        terms.append(F.get(F.array(*[F.lit(_spread(p, j, len(bounds), bits)).cast("bigint") for p in parts]), part))
    return reduce(lambda a, b: a.bitwiseOR(b), terms, F.lit(0).cast("bigint"))


def write_z_ordered(
    df: DataFrame, path: str, columns: Sequence[str], key: str | None = None, row_group_bytes: int = 32 << 20, n_files: int | None = None
) -> None:
    """A table whose row groups are narrow in each of ``columns``, so that a search on any of them skips most.

    A Bloom filter on ``key`` lets a lookup of one row skip nearly all the others.
    """
    # quantiles, the sample of the ranges and the ranges themselves each read all rows: ``df`` is computed once
    stored = cut(df, "to-order")
    placed = stored.withColumn("_z", z_value(quantile_bounds(stored, columns)))
    n_files = n_files or parts_for(df.sparkSession, stored.count())
    dealt = placed.repartitionByRange(n_files, "_z") if n_files else placed.repartitionByRange("_z")
    writer = dealt.sortWithinPartitions("_z").drop("_z").write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    if key is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        # a file holds the filters of all its row groups until it is closed
        writer = writer.option("parquet.bloom.filter.max.bytes", max(1024, row_group_bytes // 16))
    writer.parquet(path)


# --- grams of keys --------------------------------------------------------------------


def _grams(text: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substr(text, i, F.lit(n))))


def key_grams(table: DataFrame, key: str) -> DataFrame:
    """``gram``, ``key``: the runs of two and three characters of each key, its begin and end marked by \\x02 and \\x03.

    Written sorted by ``gram`` (``writers.write_sorted_by_key``) it answers which keys may hold a text.
    """
    marked = F.concat(F.lit("\x02"), F.col(key), F.lit("\x03"))
    both = F.array_distinct(F.concat(_grams(marked, GRAM), _grams(marked, GRAM - 1)))
    return table.select(F.explode(both).alias("gram"), key)


def wanted_grams(text: str) -> list[str]:
    """The grams that a key must hold to hold ``text``."""
    n = min(GRAM, len(text))
    if n < GRAM - 1:
        raise ValueError(f"a text of at least {GRAM - 1} characters is needed: {text!r}")
    return sorted({text[i : i + n] for i in range(len(text) - n + 1)})


def keys_that_may_hold(grams: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """Keys that hold all grams of any of the texts; ``prefix`` texts begin with \\x02, endings end with \\x03.

    A superset of the keys that hold one: the caller applies its predicate to their rows.
    """
    asked = [(i, g) for i, text in enumerate(texts) for g in wanted_grams(text)]
    wanted = grams.sparkSession.createDataFrame(asked, "text int, gram string")
    needed = wanted.groupBy("text").agg(F.count(F.lit(1)).alias("needed"))
    # the literal list reaches the scan of the sorted table
    near = grams.filter(F.col("gram").isin(sorted({g for _, g in asked}))).join(wanted, "gram")
    held = near.groupBy(key, "text").agg(F.count_distinct("gram").alias("held")).join(needed, "text")
    return held.filter("held = needed").select(key).distinct()
