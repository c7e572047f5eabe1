"""Baskets, and item sets mined from them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.skew import hot_keys, salted_join
from stallwise.functions.work import cut


def user_baskets(orders: DataFrame, min_products: int = 2) -> DataFrame:
    """Distinct products per account, for accounts with at least ``min_products``.

    One row per (account, product), numbered by nothing but the product itself: a shared
    or anonymous account can hold a large part of all rows and would not fit into one list.
    """
    items = orders.select("account", "product_id").distinct()
    sizes = items.groupBy("account").agg(F.count(F.lit(1)).alias("products"))
    kept = sizes.filter(F.col("products") >= min_products)
    return salted_join(items, kept, "account", "product_id", hot=hot_keys(items, "account", "product_id"))


def day_baskets(orders: DataFrame, min_products: int = 2) -> DataFrame:
    """Distinct baskets of each account, a basket being what it bought on one day.

    Equal baskets of one account count once, under the first day they occur; equal baskets
    of different accounts stay apart. One row per (account, day, product).

    Baskets are compared by size and two independent 64-bit sums over their products, so no
    basket is gathered in one place: 128 bits, by chance equal for one in 10^38 pairs.
    """
    items = orders.select("account", X.day_of("paid_at").alias("day"), "product_id")
    # An unknown account or day is no basket. Filtered here, both uses of the items below
    # have the same plan, and Spark computes them once.
    items = items.filter(F.col("account").isNotNull() & F.col("day").isNotNull()).distinct()
    seeds = [F.xxhash64("product_id", F.lit(seed)) for seed in (1, 2)]
    # Halves are summed apart, so the sums cannot overflow and stay exact.
    halves = [h for s in seeds for h in (F.shiftrightunsigned(s, 32), s.bitwiseAND(F.lit(0xFFFFFFFF)))]
    marks = [F.sum(h).alias(f"_h{i}") for i, h in enumerate(halves)]
    baskets = items.groupBy("account", "day").agg(F.count(F.lit(1)).alias("products"), *marks)
    first = (
        baskets.filter(F.col("products") >= min_products)
        .groupBy("account", "products", *[f"_h{i}" for i in range(len(halves))])
        .agg(F.min("day").alias("day"))
    )
    return items.join(first.select("account", "day", "products"), ["account", "day"], "inner")


def transactions(
    items: DataFrame, basket: list[str], item: str, min_support: float
) -> DataFrame:
    """Baskets as arrays of their frequent items, the input of item-set mining.

    An item below the support cannot be in a frequent set, so it is dropped before lists
    are built; what remains per basket is bounded by (mean basket size / support). Baskets
    that lose all items stay, as empty arrays, because they count in the support.
    """
    known = items.select(*basket, item).filter(F.col(item).isNotNull())
    rows = known.distinct()
    n = known.select(*basket).distinct().count()
    frequent = (
        rows.groupBy(item)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= F.lit(min_support) * F.lit(n))
        .select(item, F.lit(True).alias("_frequent"))
    )
    marked = salted_join(rows, frequent, item, basket[0], "left")
    # collect_list skips NULL, so an infrequent item adds nothing to its basket.
    return marked.groupBy(*basket).agg(
        F.collect_list(F.when(F.col("_frequent"), F.col(item))).alias("items")
    )


@dataclass(frozen=True)
class ItemSets:
    """Frequent item sets: ``items`` sorted, ``freq`` baskets that hold them, out of ``baskets``."""

    freqItemsets: DataFrame
    baskets: int
    min_confidence: float

    @property
    def associationRules(self) -> DataFrame:
        """Each item of a set as the consequent of the others."""
        sets = self.freqItemsets
        rest = F.filter("items", lambda x: ~x.eqNullSafe(F.col("one")))
        parts = sets.filter(F.size("items") > 1).withColumn("one", F.explode("items"))
        parts = parts.select(rest.alias("antecedent"), F.array("one").alias("consequent"), F.col("freq").alias("both"))
        known = parts.join(sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("before")), "antecedent")
        ones = sets.filter(F.size("items") == 1).select(F.col("items").alias("consequent"), F.col("freq").alias("alone"))
        told = known.withColumn("confidence", F.col("both") / F.col("before")).filter(F.col("confidence") >= self.min_confidence)
        lift = F.col("confidence") / (F.col("alone") / F.lit(self.baskets))
        support = F.col("both") / F.lit(self.baskets)
        return told.join(ones, "consequent").select("antecedent", "consequent", "confidence", lift.alias("lift"), support.alias("support"))


def mine(
    baskets: DataFrame, min_support: float = 0.02, min_confidence: float = 0.0, partitions: int | None = None
) -> ItemSets:
    """Frequent item sets and rules over the ``items`` arrays, by joins from each size of set to the next.

    A basket's sets of one size that differ in their last item alone are one row. Two of them together
    are a candidate of the next size; candidates are counted, and the frequent ones numbered, stored
    and joined back to the baskets. So neither the items nor a tree of the baskets is ever in one
    task or on the driver: a task holds its share of candidates and spills it. An item twice in a basket is an error.
    """
    held = baskets.filter(F.col("items").isNotNull())
    if partitions:
        held = held.repartition(partitions)
    twice = F.raise_error(F.lit("items in a basket must be unique"))
    items = F.when(F.size(F.array_distinct("items")) == F.size("items"), F.col("items")).otherwise(twice)
    held = cut(held.select(F.monotonically_increasing_id().alias("basket"), items.alias("items")), "baskets")
    n = held.count()
    counted, least = F.count(F.lit(1)).alias("freq"), math.ceil(min_support * n)
    number = F.monotonically_increasing_id().alias("set")  # fixed once it is stored

    bought = held.select("basket", F.explode("items").alias("item"))
    ones = bought.groupBy("item").agg(counted).filter(F.col("freq") >= least)
    ones = cut(ones.select(number, "item", F.array("item").alias("items"), "freq"), "item-sets")
    levels = [ones]
    names = ones.select(F.col("set").alias("last"), "item")
    same = bought["item"].eqNullSafe(ones["item"])
    found = bought.join(ones, same).select("basket", F.lit(-1).cast("bigint").alias("prefix"), F.col("set").alias("last"), "set")
    while True:
        # one row for the sets of a basket with the same prefix, ``set`` being prefix and last item
        ends = F.sort_array(F.collect_list(F.struct("last", "set"))).alias("ends")
        alike = cut(found.groupBy("basket", "prefix").agg(ends).filter(F.size("ends") > 1), "alike")
        if alike.isEmpty():
            break
        one = alike.select("basket", "ends", F.posexplode("ends").alias("at", "end"))
        later = F.explode(F.slice("ends", F.col("at") + 2, F.size("ends"))).alias("more")
        pairs = one.select("basket", F.col("end.set").alias("prefix"), later)
        pairs = pairs.select("basket", "prefix", F.col("more.last").alias("last"))
        frequent = pairs.groupBy("prefix", "last").agg(counted).filter(F.col("freq") >= least)
        named = frequent.join(names, "last").join(levels[-1].select(F.col("set").alias("prefix"), "items"), "prefix")
        whole = F.array_sort(F.concat("items", F.array("item"))).alias("items")
        longer = cut(named.select(number, "prefix", "last", whole, "freq"), "item-sets")
        if longer.isEmpty():
            break
        levels.append(longer)
        found = pairs.join(longer.select("prefix", "last", "set"), ["prefix", "last"])
    sets = reduce(DataFrame.union, [level.select("items", "freq") for level in levels])
    return ItemSets(sets, n, min_confidence)


def frequent_item_sets(model: ItemSets) -> DataFrame:
    """Item sets as sorted text with their size and frequency."""
    return model.freqItemsets.select(
        F.array_join(F.array_sort("items"), ",").alias("items"),
        F.size("items").cast("bigint").alias("size"),
        "freq",
    )


def rules(model: ItemSets) -> DataFrame:
    return model.associationRules.select(
        F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"),
        F.array_join(F.array_sort("consequent"), ",").alias("consequent"),
        "confidence",
        "lift",
        "support",
    )
