"""Text, date, map and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonemill.functions.numbers import finite_or_null

# Accented letters and their base letters.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuucnyy"


def slug(c: Column) -> Column:
    """Lower-case ASCII slug; every other character run becomes one dash."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def folded_slug(c: Column) -> Column:
    """Slug after replacing accented letters by their base letters."""
    return slug(F.translate(F.lower(c), ACCENTED, UNACCENTED))


def class_code(c: Column, width: int = 5) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def year_in(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")


def date_in(c: Column) -> Column:
    return F.to_date(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1))


def property_value(properties: Column, name: str) -> Column:
    """Value of a map entry whose key matches regardless of case."""
    return F.try_element_at(F.map_values(F.map_filter(properties, lambda k, _: F.lower(k) == name.lower())), F.lit(1))


def doubled_midpoint(first: Column, last: Column) -> Column:
    """Twice the midpoint of a period, in days since 1970, so that half days stay whole numbers."""
    return F.unix_date(first) + F.unix_date(last)


def midpoint_distance(day: Column, first: Column, last: Column) -> Column:
    """Distance of a day to the middle of a period, in half days."""
    return F.abs(2 * F.unix_date(day) - doubled_midpoint(first, last))


def days_to_target(day: Column, month: int, day_of_month: int) -> Column:
    return F.abs(F.date_diff(day, F.make_date(F.year(day), F.lit(month), F.lit(day_of_month))))


def brussels_time(instant: Column) -> Column:
    """UTC instant as local text with its zone name."""
    local = F.from_utc_timestamp(instant, "Europe/Brussels")
    offset = F.timestamp_diff("HOUR", instant, local)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm"), F.when(offset == 2, " CEST").otherwise(" CET"))


def localised(values: Column, default: str | Column) -> Column:
    """English, else Dutch, else the default text."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(values["en"], values["nl"], fallback)


def strict_json(columns: dict[str, Column], numeric: set[str]) -> Column:
    """JSON text without NaN or infinities, which the format does not know."""
    return F.to_json(F.struct(*[
        (finite_or_null(c) if name in numeric else c).alias(name) for name, c in columns.items()]))


def schema_version(c: Column) -> Column:
    return F.coalesce(c, F.lit(1))


def request_hash(parts: Column) -> Column:
    """Digest of a request; the keys are sorted first, so their order does not matter."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parts)))), 256)


def safe_asset(path: Column, extension: str) -> Column:
    """Relative path without ``..`` and with the allowed extension."""
    return F.coalesce(~path.contains("..") & ~path.rlike(r"^([/\\]|[A-Za-z]:)")
                      & F.lower(path).endswith(extension), F.lit(False))


def https_link(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https://[^/\s]+"), F.lit(False))
