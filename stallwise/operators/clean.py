"""Filters, projections and parsing of raw feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from stallwise.functions import expr as X

# Product families in order of precedence, and the products (cases of
# water and a water heater) that the gender reports leave out.
PRODUCT_FAMILIES = (
    "NFC", "东方树叶", "水溶C100", "清嘴", "尖叫", "茶π", "维他命", "牛肉棒",
)
EXCLUDED_PRODUCTS = ("123", "228", "121", "114", "151", "129", "219", "108", "157", "122")
# Closed sites, the amount (cents) that marks a promotion order, the amount
# from which an order counts as high-value.
CLOSED_SITES = ("101", "620", "7667")
PROMOTION_AMOUNT = 100.0
HIGH_VALUE = 15000.0


# --- row filters ----------------------------------------------------------------------


def live(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return df.filter(F.col(flag) == "0")


def matching(df: DataFrame, **equals) -> DataFrame:
    """Rows where every named column has the given value."""
    for name, value in equals.items():
        df = df.filter(F.col(name) == value)
    return df


def without_promotions(df: DataFrame, promotion: Column | None = None) -> DataFrame:
    """Drop promotion orders: by a predicate, or by the marker amount.

    An unknown amount is no promotion; callers drop unparsed rows themselves.
    """
    is_promotion = F.col("amount") == PROMOTION_AMOUNT if promotion is None else promotion
    return df.filter(~F.coalesce(is_promotion, F.lit(False)))


def below_cap(df: DataFrame, cap: float = HIGH_VALUE, amount: str = "amount") -> DataFrame:
    return df.filter(F.col(amount) < cap)


def trailing(df: DataFrame, as_of: X.TimeLike, days: int, ts: str = "paid_at") -> DataFrame:
    return df.filter(X.in_trailing(ts, as_of, days))


def between(df: DataFrame, start: X.TimeLike, stop: X.TimeLike, ts: str = "paid_at") -> DataFrame:
    return df.filter(X.in_range(ts, start, stop))


def tenured(df: DataFrame, min_days: int, tenure: str = "tenure_days") -> DataFrame:
    """Operated for longer than ``min_days``."""
    return df.filter(F.col(tenure) > min_days)


def eligible_machines(df: DataFrame, closed_sites: Sequence[str] = CLOSED_SITES) -> DataFrame:
    """Vending machines (kind 2) that are placed, enabled, without fault and not closed."""
    return (
        non_blank(df, ["site_id", "point_id"])
        .filter((F.col("kind") == "2") & (F.col("enabled") == "1") & (F.col("fault") == "0"))
        .filter(~F.col("site_id").isin(*closed_sites))
    )


def judged(lines: DataFrame, rules: Mapping[str, Column], counted: Observation | str = "feed") -> DataFrame:
    """``lines`` with ``reasons``, the names of the rules that a line breaks, in the rules' order.

    A rule is a condition that an accepted row meets; one that is unknown counts as broken. ``observe``
    counts rows read, accepted, and broken by rule, in the pass that writes them.
    """
    broken = {rule: ~F.coalesce(met, F.lit(False)) for rule, met in rules.items()}
    mask = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in broken.items()]), lambda r: r.isNotNull())
    told = lines.withColumn("reasons", mask)
    counts = [F.count_if(F.array_contains("reasons", rule)).alias(rule) for rule in broken]
    return told.observe(counted, F.count(F.lit(1)).alias("read"), F.count_if(F.size("reasons") == 0).alias("accepted"), *counts)


def wide_enough(lines: DataFrame, min_width: int, line: str = "value") -> DataFrame:
    """Raw lines with more than ``min_width`` fields."""
    return lines.filter(X.width(line) > min_width)


def non_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for name in columns:
        df = df.filter(X.is_filled(name))
    return df


def short_ids(df: DataFrame, column: str, max_length: int = 20) -> DataFrame:
    return df.filter(F.length(column) < max_length)


def without_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop the listed values; an unknown value is not listed and stays."""
    return df.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def without_header_rows(df: DataFrame, column: str = "id", header: str = "id") -> DataFrame:
    """Drop header rows that a headerless read took for data."""
    return df.filter(F.col(column) != header)


def in_band(
    df: DataFrame, column: str, at_least: float | None = None, at_most: float | None = None
) -> DataFrame:
    if at_least is not None:
        df = df.filter(F.col(column) >= at_least)
    if at_most is not None:
        df = df.filter(F.col(column) <= at_most)
    return df


# --- projections ----------------------------------------------------------------------


def named_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep and rename: ``{"c0": "id", "c4": "machines"}``."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill missing attributes with their named defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_family(
    df: DataFrame,
    name: str = "product_name",
    families: Sequence[str] = PRODUCT_FAMILIES,
    into: str = "family",
) -> DataFrame:
    return df.withColumn(into, X.first_keyword(name, families))


def with_gender(df: DataFrame, code: str = "gender", male: str = "1", into: str = "gender_label") -> DataFrame:
    return df.withColumn(into, X.two_way_label(code, male, "MAN", "WOMAN"))


def parsed_lines(
    lines: DataFrame,
    fields: Mapping[str, int],
    min_width: int = 0,
    delimiter: str = ",",
    line: str = "value",
) -> DataFrame:
    """Text columns picked by position from raw lines, tuple punctuation removed."""
    split = lines.select(X.fields(line, delimiter).alias("_parts"))
    picked = {name: X.strip_marks(F.get("_parts", F.lit(i))) for name, i in fields.items()}
    parsed = X.computed_once(split, {**picked, "_width": F.size("_parts")})
    return parsed.filter(F.col("_width") > min_width).drop("_width")


def typed_orders(df: DataFrame) -> DataFrame:
    """Give a text order feed its types; values that do not parse become NULL."""
    types = {
        "created_at": X.parse_time("created_at"),
        "paid_at": X.parse_time("paid_at"),
        "amount": X.number("amount"),
        "unit_price": X.number("unit_price"),
        "quantity": X.whole_number("quantity"),
    }
    return X.computed_once(df, {c: types.get(c, F.col(c)) for c in df.columns})


# --- click log ------------------------------------------------------------------------


def parsed_clicks(lines: DataFrame, line: str = "value") -> DataFrame:
    """Tab-separated click log to typed clicks on a course; other requests are dropped."""
    split = lines.select(X.fields(line, "\t").alias("_parts"))
    ip, time, request, status, referer = (F.get("_parts", F.lit(i)) for i in range(5))
    url = F.get(X.fields(request, " "), F.lit(1))
    columns = {
        "ip": ip,
        "clicked_at": X.parse_time(time),
        "course_id": X.course_id(url),
        "status": X.whole_number(status),
        "referer": referer,
    }
    return X.computed_once(split, columns).filter(~F.col("course_id").eqNullSafe(0))


def with_referer_host(clicks: DataFrame, referer: str = "referer") -> DataFrame:
    """Search host of each click; clicks without one are dropped."""
    found = X.computed_once(clicks, {"host": X.url_host(referer)}, keep=clicks.columns)
    return found.filter(F.col("host").isNotNull())


# --- SQL on a table -------------------------------------------------------------------


def above_by_sql(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """A parameterised SQL predicate; it is pushed into the scan like a filter."""
    return df.sparkSession.sql(
        "SELECT * FROM {rows} WHERE {c} > :threshold",
        args={"threshold": threshold},
        rows=df,
        c=F.col(column),
    )
