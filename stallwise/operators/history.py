"""Attributes as of a time, and trees of any depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stallwise.functions.work import cut, parts_for


def as_of_join(
    facts: DataFrame, versions: DataFrame, key: str, ts: str, since: str, columns: Sequence[str], ident: str
) -> DataFrame:
    """``facts`` with the ``columns`` of the version of their key that was valid at ``ts``; NULL before the first.

    ``versions`` has the key, ``since`` and the columns, one row per key and time. ``ident`` tells facts of
    equal times apart, so that they are dealt evenly. Facts and versions are merged in one range-partitioned sort
    by key and time, so a key with any share of the facts spans as many tasks as it needs. Each
    range takes over the last version before it: one row for each range is on the driver. There are as many ranges
    as the rows need, and each is one task's, so what a task sorts does not grow. A NULL key or time finds no version.
    """
    version = F.struct(F.col(key).alias("key"), F.col(since).alias("since"), *columns)
    kept = facts.columns
    none = F.lit(None).cast(versions.select(version.alias("v")).schema["v"].dataType)
    rows = facts.select(
        F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(ident).alias("_tie"),
        F.struct(*kept).alias("_fact"), none.alias("_version"),
    )
    known = versions.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.col(key).alias("_key"), F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"),
        F.lit(None).cast(rows.schema["_fact"].dataType).alias("_fact"), version.alias("_version"),
    )
    order = ["_key", "_at", "_kind", "_tie"]
    both = known.union(rows)
    n = parts_for(facts.sparkSession, both.count())
    ranged = both.repartitionByRange(n, *order) if n else both.repartitionByRange(*order)
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()), "as-of")
    lasts = ranged.filter("_kind = 0").groupBy("_part").agg(F.max_by("_version", F.struct("_key", "_at")).alias("_before"))
    parts = [r["_part"] for r in ranged.select("_part").distinct().collect()]
    found = {r["_part"]: r["_before"] for r in lasts.collect()}
    carried, last = [], None
    for part in sorted(parts):
        carried.append((part, last))
        last = found.get(part, last)
    schema = ranged.select("_part", F.col("_version").alias("_before")).schema
    before = ranged.sparkSession.createDataFrame(carried, schema)
    in_part = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.coalesce(F.last("_version", ignorenulls=True).over(in_part), F.col("_before"))
    # each range goes to a task of its own: by hash several could meet in one
    dealt = ranged.repartitionById(max(parts, default=0) + 1, "_part")
    told = dealt.join(F.broadcast(before), "_part").withColumn("_valid", latest).filter("_kind = 1")  # a row for each range
    same = F.col("_valid.key") == F.col("_key")
    timed = same & F.col("_at").isNotNull()
    return told.select("_fact.*", *[F.when(timed, F.col("_valid")[c]).alias(c) for c in columns])


def ancestors(tree: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """``node``, ``ancestor``, ``depth``: each node with all that are above it, in a tree of any depth.

    By pointer doubling: round k joins what is known to distance 2**k with itself, so a tree of depth d takes log d
    rounds, each one join. A node with two parents, or above itself, is an error. Its own row (depth 0)
    comes first; a NULL parent ends the path.
    """
    links = tree.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).distinct()
    known = cut(links.withColumn("depth", F.lit(1)), "ancestors")
    if not known.groupBy("node").count().filter("count > 1").isEmpty():
        raise ValueError("a node has two parents")
    far = 1
    while True:
        if not known.filter("node = ancestor").isEmpty():
            raise ValueError("a node stands above itself")
        tips = known.filter(F.col("depth") == far)
        on = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        longer = tips.join(on, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        longer = cut(longer, "ancestors")
        if longer.isEmpty():
            break
        known = known.union(longer)
        far *= 2
    own = tree.select(F.col(node).alias("node")).union(links.select("ancestor")).distinct()
    return own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).union(known)


def summed_upwards(measure: DataFrame, above: DataFrame, node: str, amount: str, into: str = "total") -> DataFrame:
    """The sum of ``amount`` over all nodes at or below each node that has any."""
    per_node = measure.groupBy(F.col(node).alias("node")).agg(F.sum(amount).alias("_sum"))
    return per_node.join(above, "node").groupBy(F.col("ancestor").alias(node)).agg(F.sum("_sum").alias(into))
