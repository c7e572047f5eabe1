"""Dimensions and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from stallwise.functions import expr as X
from stallwise.functions.skew import hot_keys, salted_join
from stallwise.operators import clean
from stallwise.sources.writers import latest_per_key


def point_dim(
    tree: DataFrame, attributes: DataFrame, closed_sites: Sequence[str] = clean.CLOSED_SITES
) -> DataFrame:
    """Live point attributes joined to their node of the site tree.

    A point without a node has no kind and would be filtered out, so the join is inner.
    """
    nodes = clean.without_values(clean.matching(tree, kind="point"), "parent_id", closed_sites)
    return _joined_to_tree(nodes, clean.live(attributes), "pid")


def site_dim(
    tree: DataFrame, attributes: DataFrame, closed_sites: Sequence[str] = clean.CLOSED_SITES
) -> DataFrame:
    """Live site attributes joined to their node of the site tree."""
    nodes = clean.without_values(clean.matching(tree, kind="net"), "id", closed_sites)
    return _joined_to_tree(nodes, clean.live(attributes), "nid")


def _joined_to_tree(nodes: DataFrame, attributes: DataFrame, attribute_id: str) -> DataFrame:
    own = attributes.withColumnRenamed("id", attribute_id)
    shared = [c for c in own.columns if c in nodes.columns]
    own = own.drop(*shared)
    return nodes.join(own, nodes["community_id"] == own[attribute_id], "inner").drop("community_id")


def lookup_dim(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key out of a wide table that repeats it; the greatest row wins."""
    return latest_per_key(wide.select(key, *columns), [key], [])


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    defaults: Mapping[str, object] | None = None,
    required: bool = False,
    spread_by: str | None = None,
) -> DataFrame:
    """Attach dimension attributes; a miss is a default (or NULL), or drops the row.

    ``spread_by`` is for a dimension that is itself an aggregate or join on the key: see
    ``salted_join``.
    """
    how = "inner" if required else "left"
    if spread_by is None:
        joined = facts.join(dim, on, how)
    else:
        joined = salted_join(facts, dim, on, spread_by, how)
    return clean.with_defaults(joined, defaults) if defaults else joined


def in_set(facts: DataFrame, keys: DataFrame, on: str, spread_by: str | None = None) -> DataFrame:
    """Facts whose key is listed, once per key.

    ``spread_by`` is for a list that is itself an aggregate on the key: see ``salted_join``.
    """
    return _against(facts, keys, on, "left_semi", spread_by)


def not_in_set(facts: DataFrame, keys: DataFrame, on: str, spread_by: str | None = None) -> DataFrame:
    """Facts whose key is not listed; an unknown (NULL) key is not."""
    return _against(facts, keys, on, "left_anti", spread_by)


def _against(facts: DataFrame, keys: DataFrame, on: str, how: str, spread_by: str | None) -> DataFrame:
    listed = keys.select(on)
    if spread_by is None:
        return facts.join(listed, on, how)
    return salted_join(facts, listed, on, spread_by, how, hot=hot_keys(facts, on, spread_by))


def first_seen(facts: DataFrame, key: str, stored: DataFrame | None = None, ts: str = "paid_at") -> DataFrame:
    """When each key was first seen: by the stored table merged with newer facts alone.

    Kept as a table and merged with each day's facts, it spares every later question about
    age a scan of the whole history.
    """
    fresh = facts.groupBy(key).agg(F.min(ts).alias("first_operated"))
    if stored is None:
        return fresh
    return stored.select(key, "first_operated").unionByName(fresh).groupBy(key).agg(F.min("first_operated").alias("first_operated"))


def with_tenure(seen: DataFrame, as_of: X.TimeLike) -> DataFrame:
    """Operating statistics out of a first-seen table."""
    return seen.withColumn("tenure_days", X.calendar_days("first_operated", X.at(as_of)))


def operating_stats(facts: DataFrame, key: str, as_of: X.TimeLike, ts: str = "paid_at") -> DataFrame:
    """First operated and tenure per key, from every fact of it."""
    return with_tenure(first_seen(facts, key, ts=ts), as_of)


def rolled_up_stats(
    stats: DataFrame, points: DataFrame, key: str, as_of: X.TimeLike
) -> DataFrame:
    """Operating statistics of a coarser grain out of those per point."""
    located = stats.join(points.select("point_id", key), "point_id", "inner")
    first = located.groupBy(key).agg(F.min("first_operated").alias("first_operated"))
    return first.withColumn("tenure_days", X.calendar_days("first_operated", X.at(as_of)))


def star_lookup(
    orders: DataFrame,
    points: DataFrame,
    sites: DataFrame,
    machines: DataFrame,
    users: DataFrame,
) -> DataFrame:
    """Orders with the attributes of point, site, machines (with their assortment) and user.

    Machine figures that are missing take the house defaults; other misses stay NULL. The
    dimensions of a point are joined to each other first, so the orders are shuffled by
    point and by account only, a hot point over several tasks.
    """
    located = points.join(sites, "site_id", "left").join(machines, "point_id", "full")
    wide = salted_join(orders, located, "point_id", "order_id", "left").join(users, "account", "left")
    return clean.with_defaults(wide, {"tenure_days": 30, "machines": 3, "faulty_machines": 0})


def complete_fact(
    dim: DataFrame, metrics: DataFrame, on: str, defaults: Mapping[str, object]
) -> DataFrame:
    """Every member of the dimension with its metrics, defaults where it has none."""
    return clean.with_defaults(dim.join(metrics, on, "left"), defaults)


def points_and_machines(points: DataFrame, machines: DataFrame) -> DataFrame:
    """Points and machines per site; a site with machines but no point counts 0 points.

    ``machines`` has one row per (site_id, machines).
    """
    counts = points.groupBy("site_id").agg(F.count(F.lit(1)).alias("points"))
    return counts.join(machines, "site_id", "right").select(
        "site_id",
        F.coalesce("points", F.lit(0)).alias("points"),
        F.coalesce("machines", F.lit(0)).alias("machines"),
    )


def enriched_ids(ids: DataFrame, sites: DataFrame) -> DataFrame:
    """A list of site ids with name, position and administrative units."""
    wanted = [c for c in ("name", "lat", "lng", "province", "city", "county") if c in sites.columns]
    return ids.join(sites.select("site_id", *wanted), "site_id", "left")
