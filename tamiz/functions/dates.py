"""Dates of feeds and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Year, hyphen, month, day, hour, colon, minute, second, fraction, offset.
_ISO = r"^(?!0000)(\d{4})(-?)(\d\d)\2(\d\d)(?:[Tt ](\d\d)(?:(:?)(\d\d)(?:\6(\d\d)(?:[.,](\d+))?)?)? ?([Zz]|[+-]\d\d(?::?\d\d)?)?)?\z"


def parse_iso(text: Column) -> Column:
    """ISO 8601 calendar dates and times, extended or basic, with or without a zone; NULL where invalid.

    Times without a zone are the session's; digits of a fraction after the sixth are cut off.
    """
    part = lambda n: F.regexp_extract(text, _ISO, n)
    or_zero = lambda n: F.coalesce(F.nullif(part(n), F.lit("")), F.lit("00"))
    zone = F.regexp_replace(F.upper(part(10)), r"^([+-]\d\d):?(\d\d)?$", "$1:$2")
    zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    whole = F.concat(part(1), F.lit("-"), part(3), F.lit("-"), part(4), F.lit(" "), or_zero(5), F.lit(":"), or_zero(7), F.lit(":"), or_zero(8), F.lit("."), F.substring(F.concat(part(9), F.lit("000000")), 1, 6), zone)
    return F.when(text.rlike(_ISO), F.try_to_timestamp(whole))


def parse_feed_date(text: Column, as_of: Column | None = None) -> Column:
    """RFC 2822, else ISO 8601, else ``as_of`` (NULL if none is given)."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""))
    bare = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    parsed = F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")), parse_iso(F.trim(text))
    )
    return parsed if as_of is None else F.coalesce(parsed, as_of)


def format_iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")
