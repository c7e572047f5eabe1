"""Exact ranks inside groups of any size.

``row_number() OVER (PARTITION BY key)`` sorts a whole group in one task. Here the rows are
range-partitioned by key *and* order, so a hot group spreads over many tasks; the position
of a row inside its partition plus the sizes of the earlier partitions gives its rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stallwise.functions.work import cut

# monotonically_increasing_id() puts the partition number above bit 33.
PARTITION_SHIFT = 33


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``rn`` (1-based, ascending by ``order``) and ``n`` (group size) to every row.

    ``order`` must be unique inside a group, else ties are ranked arbitrarily.
    """
    keys = list(keys)
    sorted_rows = df.orderBy(*keys, *order).withColumn("_pos", F.monotonically_increasing_id())
    placed = cut(sorted_rows, "ranks")
    placed = placed.withColumn("_part", F.shiftright("_pos", PARTITION_SHIFT))
    # One row per (key, partition): at most #keys + #partitions rows in all.
    runs = placed.groupBy(*keys, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_len")
    )
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_part").alias("_run_part"),
        "_first",
        F.coalesce(F.sum("_len").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_len").over(by_key).alias("n"),
    )
    same = [placed[k].eqNullSafe(offsets[f"_key_{k}"]) for k in keys]
    joined = placed.join(offsets, [placed["_part"] == offsets["_run_part"], *same], "inner")
    return joined.select(
        *df.columns,
        (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias("rn"),
        "n",
    )
