"""Time, array and numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours that a new tag may get (fixed values).
PALETTE = ("#FF5555", "#50FA7B", "#F1FA8C", "#BD93F9", "#FF79C6", "#8BE9FD", "#FFB86C", "#A6E22E", "#66D9EF")
#: Dates, with a time and a zone or without.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
DEFAULT_COLOUR, DEFAULT_PRIORITY = "#66d9ef", 0


def millis(value: Column) -> Column:
    """Epoch milliseconds of a number: null and 0 give 0, values above 1e12 are milliseconds
    already, others seconds. Fractions are cut off."""
    v = value.cast("double")
    return F.when(v.isNull() | (v == 0), F.lit(0).cast("long")).when(v > 1e12, v.cast("long")).otherwise((v * 1000).cast("long"))


def millis_text(value: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 string with a whole date ("Z" allowed); anything else,
    such as a year alone, gives 0."""
    whole = F.rlike(value, F.lit(ISO))
    return F.coalesce(F.unix_millis(F.when(whole, F.try_to_timestamp(value))), F.lit(0).cast("long"))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def new_id() -> Column:
    """A random identifier for each row."""
    return F.uuid()


def shown_time(ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch milliseconds for display, in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), pattern)


def shortened(text: Column, width: int = 30) -> Column:
    """The first `width` characters for display."""
    return F.substring(text, 1, width)


def tf_map(features: Column) -> Column:
    """A map from a list of (hash, tf) with distinct hashes."""
    return F.map_from_entries(F.transform(features, lambda x: F.struct(x["hash"].alias("key"), x["tf"].alias("value"))))


def lookup(map_: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(map_, key), default)


def ratio(part: Column, whole: Column) -> Column:
    """Percent, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def append_once(tags: Column, tag: Column) -> Column:
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, tag))


def colour(tag: Column) -> Column:
    """A palette colour that follows from the tag alone, by its md5."""
    number = F.conv(F.substring(F.md5(tag.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*(F.lit(c) for c in PALETTE)), (F.pmod(number, F.lit(len(PALETTE))) + 1).cast("int"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def common_keys(a: Column, b: Column) -> Column:
    return F.array_intersect(F.map_keys(a), F.map_keys(b))


def map_dot(a: Column, b: Column) -> Column:
    """The dot product of two sparse vectors held as maps."""
    return F.aggregate(common_keys(a, b), F.lit(0).cast("long"), lambda acc, k: acc + F.element_at(a, k) * F.element_at(b, k))


def map_min_sum(a: Column, b: Column) -> Column:
    return F.aggregate(common_keys(a, b), F.lit(0).cast("long"), lambda acc, k: acc + F.least(F.element_at(a, k), F.element_at(b, k)))


def as_array(value: Column, item: str = "int") -> Column:
    """A list or a scalar, given as JSON text, as an array."""
    return F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, f"array<{item}>")).when(value.isNotNull(), F.array(value.try_cast(item)))


def line_text(tokens: Column, line: Column) -> Column:
    """The text of one line: its tokens (structs with line and t) of a source's list, in order."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: t["line"] == line), lambda t: t["t"]), "")
