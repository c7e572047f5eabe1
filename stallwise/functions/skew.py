"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16  # a power of two, so that the salt is a mask of the hash and never NULL
HOT_SHARE = 1 / 1024  # of the sampled rows; so there are at most 1024 hot keys
SAMPLED = 64  # one in so many values of the spreading column


def hot_keys(facts: DataFrame, on: str, spread_by: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of the rows, by a sample that a hash of ``spread_by`` picks, and their ``_salts``.

    At most 1 / share keys. A key's salts follow its sampled share of the shuffle partitions, two to a
    partition, so a key with half of the rows goes to half of the tasks, however many there are, and all
    keys together take no more than twice the partitions and two each. Whether a key is found, and with
    how many salts, changes how rows are dealt, never the result.
    """
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = facts.filter(F.pmod(F.xxhash64(F.col(spread_by), F.lit(64)), F.lit(SAMPLED)) == 0)
    counted = picked.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n")).scalar()
    salts = F.greatest(F.lit(2), F.ceil(F.col("_n") / total * 2 * tasks)).cast("int").alias("_salts")
    found = counted.filter((F.col("_n") >= total * share) & (F.col("_n") > 1))
    return found.select(on, salts).limit(round(1 / share))


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    spread_by: str,
    how: str = "inner",
    salts: int = SALTS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join facts to a dimension (one row per key) with each key split over ``salts`` tasks.

    With ``hot`` (see ``hot_keys``; at most 1024 keys, so it is broadcast) only those keys are split, each
    over its own ``_salts``, and only their rows of ``dim`` are copied: use it where ``dim`` is large, such
    as all accounts.

    Adaptive execution splits the hot keys of a join by itself, but only when both sides
    come straight from a shuffle for this join and nothing downstream needs its
    partitioning. Use this where ``dim`` is an aggregate or join on the same key, or where
    an aggregation on that key follows: there a hot key would stay in one task.

    The salt is a hash of ``spread_by``, which must come out the same in a retried task: a key
    or another stored value, never a floating sum, whose last bit may change and move the row.
    Only joins that keep no unmatched row of ``dim`` are possible, as ``dim`` is copied.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}: each row of the right side has {salts} copies")
    salt = F.xxhash64(F.col(spread_by)).bitwiseAND(F.lit(salts - 1)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    left, right = facts, dim
    if hot is not None:
        marked = F.broadcast(hot.select(on, "_salts"))
        left, right = facts.join(marked, on, "left"), dim.join(marked, on, "left")
        parts = F.coalesce("_salts", F.lit(1))
        salt = F.pmod(F.xxhash64(F.col(spread_by)), parts).cast("int")
        copies = F.sequence(F.lit(0), parts - 1)
    left = left.withColumn("_salt", salt).drop("_salts")
    right = right.withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [on, "_salt"], how).drop("_salt")
