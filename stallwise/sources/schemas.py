"""Schemas of the positional feeds. Columns that no job reads keep the name ``c<position>``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql.types import StringType, StructField, StructType


def positional(width: int, names: Mapping[int, str]) -> StructType:
    """An all-text schema of ``width`` columns with names at the given positions."""
    return StructType(
        [StructField(names.get(i, f"c{i}"), StringType(), True) for i in range(width)]
    )


def named(*names: str) -> StructType:
    return positional(len(names), dict(enumerate(names)))


# The column order of each feed.
ORDER_FIELDS = (
    "created_at", "machine_id", "status", "pay_method", "amount", "account", "paid_at",
    "pay_platform", "site_id", "point_id", "city", "product_id", "product_name",
    "unit_price", "quantity", "dispensed", "refunded", "machine_no", "day",
)
ORDERS = named(*ORDER_FIELDS)
ORDER_MESSAGE = named("order_id", *ORDER_FIELDS)

SITE_TREE = positional(
    25,
    {
        0: "id", 1: "name", 2: "parent_id", 4: "created_at", 7: "is_deleted", 8: "kind", 11: "province", 12: "city",
        13: "county", 16: "address", 17: "operators", 20: "community_id", 21: "lat", 22: "lng",
    },
)
POINT_ATTRIBUTES = positional(
    17, {0: "id", 3: "sort", 4: "point_type", 5: "covered_households", 6: "occupied_households", 16: "is_deleted"}
)
SITE_ATTRIBUTES = positional(
    25,
    {
        0: "id", 2: "site_kind_id", 8: "households", 9: "checked_in_households", 10: "buildings", 14: "completed_at",
        15: "property_fee", 16: "estate_price", 24: "is_deleted",
    },
)
OPERATING_STATS = positional(
    14,
    {
        0: "id", 1: "first_operated", 2: "tenure_days", 3: "hosts", 4: "machines",
        10: "points", 11: "faulty_machines", 13: "deployed_days",
    },
)
SALES_STATS = positional(35, {0: "id", 1: "volume_7d", 12: "volume_30d"})
ASSORTMENT = positional(
    9, {2: "point_id", 3: "products", 7: "shortage_rate", 8: "vacancy_rate"}
)
USERS = positional(21, {0: "account", 17: "gender", 20: "level"})
MACHINES = positional(
    22,
    {
        0: "machine_id", 4: "enabled", 5: "fault", 15: "deployed_at", 17: "area_id",
        18: "site_id", 19: "point_id", 21: "kind",
    },
)
MACHINE_LOG = positional(4, {1: "machine_id", 3: "logged_at"})
SLAVE_MACHINES = positional(9, {1: "host_id", 8: "is_deleted"})
TERMINALS = positional(
    63,
    {
        1: "terminal_id", 4: "status", 28: "channel_id", 30: "channel_name",
        34: "site_id", 35: "site_name", 51: "area_id", 52: "area_name",
    },
)
TERMINAL_SALES_BY_SITE = positional(
    6, {1: "terminal_id", 2: "site_id", 4: "sold_at", 5: "amount"}
)
TERMINAL_SALES_BY_CHANNEL = named(
    "org_id", "terminal_id", "site_id", "channel_id", "area_id", "sold_at", "amount"
)
BLOCKED_TERMINALS = named("terminal_id")
AREA_CHANNEL_MONTHS = named("area_id", "channel_id", "month", "mean_sales")
BOX_ROWS = named("channel_id", "month", "upper", "q3", "middle", "q1", "lower")
COHORT_FILE = named("site_id")
CLICK_LOG = named("ip", "time", "request", "status", "referer")
