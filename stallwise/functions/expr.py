"""Scalar expressions. All are built-in Spark functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

SECONDS_PER_DAY = 86400
MAX_EPOCH_MS = 9_999_999_999_999

TimeLike = str | datetime
ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -----------------------------------------------------------------------------


def at(moment: TimeLike) -> Column:
    """A zone-free timestamp literal.

    Facts carry wall-clock times without a zone. A zoned literal would put a cast on the
    column side of a comparison, and the filter would no longer reach the parquet scan.
    """
    return F.lit(str(moment)).cast("timestamp_ntz")


def as_datetime(moment: TimeLike) -> datetime:
    return moment if isinstance(moment, datetime) else datetime.fromisoformat(moment)


def in_trailing(ts: ColumnLike, as_of: TimeLike, days: int) -> Column:
    """``as_of - days < ts <= as_of``."""
    end = as_datetime(as_of)
    return (col(ts) > at(end - timedelta(days=days))) & (col(ts) <= at(end))


def in_range(ts: ColumnLike, start: TimeLike, stop: TimeLike) -> Column:
    """``start <= ts < stop``."""
    return (col(ts) >= at(start)) & (col(ts) < at(stop))


def elapsed_seconds(start: ColumnLike, end: ColumnLike) -> Column:
    micros = [F.unix_micros(col(c).cast("timestamp")) for c in (start, end)]
    return (micros[1] - micros[0]) / F.lit(1_000_000.0)


def whole_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Complete 24-hour days between two times."""
    return F.floor(elapsed_seconds(start, end) / SECONDS_PER_DAY)


def fractional_days(start: ColumnLike, end: ColumnLike) -> Column:
    return elapsed_seconds(start, end) / F.lit(float(SECONDS_PER_DAY))


def calendar_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Difference of the two calendar dates, whatever the time of day."""
    return F.datediff(col(end), col(start)).cast("bigint")


def whole_years(days: ColumnLike) -> Column:
    return F.floor(col(days) / 365)


def month_of(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def day_of(ts: ColumnLike) -> Column:
    return F.to_date(col(ts))


def compact_day(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "yyyyMMdd")


def compact_time(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "yyyyMMddHHmmss")


def previous_month(ts: ColumnLike) -> Column:
    return F.date_format(F.add_months(col(ts).cast("date"), -1), "yyyy-MM")


def previous_iso_week(ts: ColumnLike) -> Column:
    return F.weekofyear(F.date_sub(col(ts).cast("date"), 7))


def parse_time(text: ColumnLike, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Wall-clock time of a string; NULL when it does not parse."""
    return F.try_to_timestamp(col(text), F.lit(pattern)).cast("timestamp_ntz")


# --- text and numbers -----------------------------------------------------------------


def strip_marks(text: ColumnLike, marks: str = "()#") -> Column:
    """Remove the tuple punctuation that some feeds leave around a field."""
    escaped = "".join(f"\\{m}" for m in marks)
    return F.regexp_replace(col(text), f"[{escaped}]", "")


def fields(line: ColumnLike, delimiter: str = ",") -> Column:
    """All fields of a delimited line; trailing blanks count.

    A one-character pattern (escaped or not) spares Java a regex compilation per row.
    """
    if len(delimiter) > 1:
        pattern = f"\\Q{delimiter}\\E"
    elif delimiter.isalnum() or delimiter.isspace():
        pattern = delimiter
    else:
        pattern = f"\\{delimiter}"
    return F.split(col(line), pattern, -1)


def field(line: ColumnLike, position: int, delimiter: str = ",") -> Column:
    """The i-th field of a delimited line, NULL past its end."""
    return F.get(fields(line, delimiter), F.lit(position))


def width(line: ColumnLike, delimiter: str = ",") -> Column:
    return F.size(fields(line, delimiter))


def is_filled(text: ColumnLike) -> Column:
    return F.length(F.trim(col(text))) > 0


def filled_or(text: ColumnLike, default) -> Column:
    """NULL or blank text to a default."""
    return F.coalesce(F.nullif(F.trim(col(text)), F.lit("")), F.lit(default))


def number(text: ColumnLike) -> Column:
    """Text to double; NULL instead of an error when it is not a number."""
    return _parsed(text, "double")


def whole_number(text: ColumnLike) -> Column:
    """Text to a 64-bit whole number; NULL when it is none."""
    return _parsed(text, "bigint")


def _parsed(text: ColumnLike, kind: str) -> Column:
    # A failed try_cast costs an exception, so blanks are taken out before.
    return F.nullif(F.trim(col(text)), F.lit("")).try_cast(kind)


def two_decimals(x: ColumnLike) -> Column:
    return F.round(col(x), 2)


def ratio_label(*counts: ColumnLike) -> Column:
    return F.concat_ws("/", *[col(c).cast("string") for c in counts])


def zero_padded(n: ColumnLike, digits: int) -> Column:
    """At least ``digits`` digits; a longer number keeps all of its own."""
    text = col(n).cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def next_number(text: ColumnLike, digits: int) -> Column:
    return zero_padded(col(text).cast("bigint") + 1, digits)


def file_stem(path: ColumnLike) -> Column:
    return F.regexp_extract(col(path), r"([^/]*?)(\.[^./]*)?$", 1)


def file_extension(path: ColumnLike) -> Column:
    return F.regexp_extract(col(path), r"\.([^./]*)$", 1)


def json_document(*columns: ColumnLike) -> Column:
    return F.to_json(F.struct(*[col(c) for c in columns]))


# --- labels ---------------------------------------------------------------------------


def first_keyword(text: ColumnLike, keywords: Sequence[str], other: str = "OTHER") -> Column:
    """The first keyword, in the given order, that the text contains."""
    label = F.lit(other)
    for word in reversed(keywords):
        label = F.when(col(text).contains(word), F.lit(word)).otherwise(label)
    return label


def two_way_label(code: ColumnLike, when_equal: str, yes: str, no: str) -> Column:
    return F.when(col(code) == when_equal, F.lit(yes)).otherwise(F.lit(no))


def course_id(request: ColumnLike, prefix: str = "/class/") -> Column:
    """Numeric id of ``<prefix><id>.<ext>`` where a request path begins so, else 0.

    An id beyond 64 bits is NULL, not 0: it is a course, only not one with a number here.
    """
    found = F.regexp_extract(F.coalesce(col(request), F.lit("")), f"^\\Q{prefix}\\E(\\d+)\\.", 1)
    return F.when(found == "", F.lit(0).cast("bigint")).otherwise(found.try_cast("bigint"))


def url_host(url: ColumnLike) -> Column:
    """Host part of a URL, NULL when the text holds none."""
    found = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*:/+([^/?#]+)", 1)
    return F.nullif(found, F.lit(""))


# --- measures -------------------------------------------------------------------------


def per_machine_sales(
    volume: ColumnLike,
    tenure: ColumnLike,
    machines: ColumnLike,
    days: int,
    default_machines: int = 3,
) -> Column:
    """Volume per day and machine over a window of ``days``.

    A missing volume is 0, a missing machine count is ``default_machines``; a site younger
    than the window is divided by its own age. A zero divisor gives NULL.
    """
    age = col(tenure).cast("double")
    divisor = F.when(age <= days, age).otherwise(F.lit(float(days)))
    units = F.coalesce(col(machines).cast("double"), F.lit(float(default_machines)))
    amount = F.coalesce(col(volume).cast("double"), F.lit(0.0))
    return F.try_divide(F.try_divide(amount, divisor), units)


def window_days(tenure: ColumnLike, days: int) -> Column:
    """Days to divide a window total by: the window, or the tenure when it is shorter."""
    return F.coalesce(F.least(col(tenure).cast("double"), F.lit(float(days))), F.lit(float(days)))


# --- keys -----------------------------------------------------------------------------


def reversed_time_key(record_id: ColumnLike, ts: ColumnLike) -> Column:
    """Row key that spreads writes and lists the newest row of a salt first.

    Salt from a hash of the id, then the time counted down, then the id. It depends on the
    row only, so a replayed message lands on the same key. The 13 digits of the countdown hold
    the times from 1970 to 2286; any other time has no key (NULL), see ``rejected_orders``.
    """
    ident = col(record_id).cast("string")
    left = F.lit(MAX_EPOCH_MS) - F.unix_millis(col(ts).cast("timestamp"))
    held = F.when(left.between(0, MAX_EPOCH_MS), left)
    return F.concat(F.substring(F.md5(ident), 1, 3), zero_padded(held, 13), F.lit("_"), ident)


def digest_key(*parts: ColumnLike) -> Column:
    return F.md5(F.concat_ws("_", *[col(p).cast("string") for p in parts]))


def lettered_digest_key(name: ColumnLike, ts: ColumnLike) -> Column:
    """One hash letter followed by the digest of name and time."""
    letter = F.substring(F.md5(col(name).cast("string")), 1, 1)
    return F.concat(letter, digest_key(name, compact_time(ts)))


# --- projections ----------------------------------------------------------------------


def computed_once(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Project expensive columns so that later filters reuse them.

    Through a plain projection a filter is pushed down together with the expressions it
    refers to, and a parse is then done once per use. A generator stops that.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))
