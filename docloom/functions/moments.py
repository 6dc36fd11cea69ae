"""Moments written in many formats, and roots of paths written in many ways: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by number, in English, French, Spanish, Portuguese and German.
MONTHS = {
    1: "january jan janvier janv enero ene janeiro januar jänner",
    2: "february feb février fevrier févr fevr febrero fevereiro fev februar",
    3: "march mar mars marzo março marco märz maerz mrz",
    4: "april apr avril avr abril abr",
    5: "may mai mayo maio",
    6: "june jun juin junio junho juni",
    7: "july jul juillet juil julio julho juli",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre set setembro",
    10: "october oct octobre octubre outubro out oktober okt",
    11: "november nov novembre noviembre novembro",
    12: "december dec décembre decembre déc diciembre dic dezembro dez dezember",
}
_TIME = r"(?:[T\s+,]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_YEAR_FIRST = r"(?i)^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + "$"
_DAY_FIRST = r"(?i)^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME + "$"
_DAY_NAME = r"(?i)^(\d{1,2})(?:\.|er|st|nd|rd|th|º)?[\s-]+(?:de\s+)?(\p{L}+)\.?[\s-]+(?:de\s+)?(\d{4})" + _TIME + "$"
_NAME_DAY = r"(?i)^(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TIME + "$"


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for number, names in MONTHS.items() for name in names.split() for x in (name, number)])
    return F.try_element_at(table, F.lower(name))


def moment(text: Column) -> Column:
    """The moment a text denotes, as a timestamp; null if none.

    ISO dates and times (also with ``/``, or ``+`` for the space), day-first numbers, dates with the
    month's name in five languages, and all-digit values: a day (8 digits), seconds (10) or
    milliseconds (13) since 1970.  Without time it is midnight, without zone UTC.
    """
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    digits = F.when(t.rlike(r"^\d+$"), t)

    def built(pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
        part = lambda k: F.regexp_extract(t, pattern, k)
        month = _month(part(m)) if named else part(m).try_cast("int")
        clock = F.when(part(4) == "", "00:00:00").when(F.length(F.substring_index(part(4), ":", 2)) == F.length(part(4)), F.concat(part(4), F.lit(":00"))).otherwise(part(4))
        clock = F.regexp_replace(clock, r"^(\d):", "0$1:")
        zone = F.when(F.upper(part(5)).isin("", "Z", "UTC", "GMT"), "Z").otherwise(F.regexp_replace(F.regexp_replace(part(5), ":", ""), r"^([+-]\d{2})(\d{2})?$", "$1:$2"))
        zone = F.regexp_replace(zone, ":$", ":00")
        whole = F.format_string("%s-%02d-%02dT%s%s", part(y), month, part(d).try_cast("int"), clock, zone)
        return F.when(t.rlike(pattern) & month.isNotNull(), whole.try_cast("timestamp"))

    day = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return (
        F.when(F.length(digits) == 8, F.concat(day, F.lit("T00:00:00Z")).try_cast("timestamp"))
        .when(F.length(digits) == 10, F.timestamp_seconds(digits.try_cast("long")))
        .when(F.length(digits) == 13, F.timestamp_millis(digits.try_cast("long")))
        .when(digits.isNotNull(), None)
        .otherwise(F.coalesce(built(_YEAR_FIRST, 1, 2, 3), built(_DAY_FIRST, 3, 2, 1), built(_DAY_NAME, 3, 2, 1, True), built(_NAME_DAY, 3, 1, 2, True)))
    )


def utc(column: Column, kind: str) -> Column:
    """A timestamp column as a moment: without zone (``timestamp_ntz``) it is UTC, whatever the session's zone."""
    if kind == "timestamp_ntz":
        return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).try_cast("timestamp")
    return column.try_cast("timestamp")


def path_root(path: Column) -> Column:
    """The first part of a path, small, however it is written: percent codes, back slashes, ``./``, doubled slashes, blanks."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    slashes = F.replace(decoded, F.lit("\\"), F.lit("/"))
    return F.lower(F.trim(F.regexp_extract(slashes, r"^(?:\s|/|\.+/)*([^/]*)", 1)))
