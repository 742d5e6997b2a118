"""Dates brought to YYYY-MM-DD, as column expressions.

The reading order matters: strict ISO first, then day-first free forms. No time
zone is ever applied, so a date never moves. Partial dates stay NULL, because a
job has to give the same result on any day it runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let

_CLOCK = (
    r"(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"
)
_ISO = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_CLOCK})?$"
_ISO_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ]{_CLOCK})?$"
_ISO_WEEK = rf"^(\d{{4}})-?W(\d{{2}})(?:-?([1-7]))?(?:[T ]{_CLOCK})?$"

_TIME = r"(?:(?:,| at|T)? ?\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?)?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? )?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_MONTH_TAIL = (
    r"(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust"
    r"|(?<=sep)t(?:ember)?|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?"
)
_DAY_FIRST = rf"^{_WEEKDAY}(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}}){_TIME}$"
_YEAR_FIRST = rf"^{_WEEKDAY}(\d{{4}})[./-](\d{{1,2}})[./-](\d{{1,2}}){_TIME}$"
_DAY_MONTH = rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH}{_MONTH_TAIL}\.?,?[ -](\d{{4}}|\d{{2}}){_TIME}$"
_MONTH_DAY = rf"^{_WEEKDAY}{_MONTH}{_MONTH_TAIL}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TIME}$"

# English month names in order, and where two-digit years turn.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_YEAR_TURN = 76


def _iso(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws(
        "-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")
    )
    return let(text, lambda t: F.when(F.try_to_date(t, "yyyy-MM-dd").isNotNull(), t))


def _parts(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(text, pattern, i) for i in (1, 2, 3))


def _week_date(text: Column) -> Column:
    year, week, day = _parts(text, _ISO_WEEK)
    fourth = F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd")
    offset = (week.try_cast("int") - 1) * 7 + F.coalesce(day.try_cast("int"), F.lit(1)) - 1
    start = F.date_trunc("week", fourth).cast("date")
    date = F.date_add(start, offset)
    last_week = F.weekofyear(F.try_to_date(F.concat(year, F.lit("-12-28")), "yyyy-MM-dd"))
    legal = week.try_cast("int").between(1, last_week)
    return F.when(legal, F.date_format(date, "yyyy-MM-dd"))


def _full_year(year: Column) -> Column:
    short = year.try_cast("int")
    return F.when(F.length(year) == 4, year).otherwise(
        F.when(short < _YEAR_TURN, short + 2000).otherwise(short + 1900).cast("string")
    )


def _day_first(text: Column) -> Column:
    a, b, year = _parts(text, _DAY_FIRST)
    century = _full_year(year)
    swapped = (b.try_cast("int") > 12) & (a.try_cast("int") <= 12)
    return F.when(swapped, _iso(century, a, b)).otherwise(_iso(century, b, a))


def _year_first(text: Column) -> Column:
    year, a, b = _parts(text, _YEAR_FIRST)
    day_in_middle = b.try_cast("int") <= 12
    return F.when(day_in_middle, _iso(year, b, a)).otherwise(_iso(year, a, b))


def _named(text: Column, pattern: str, day_group: int, month_group: int) -> Column:
    parts = _parts(text, pattern)
    month = F.lit(None).cast("string")
    for number, name in enumerate(_MONTHS.split(), start=1):
        month = F.when(parts[month_group - 1] == name, F.lit(str(number))).otherwise(month)
    return _iso(_full_year(parts[2]), month, parts[day_group - 1])


def read_date(text: Column) -> Column:
    """ISO date of an already cleaned text."""
    low = F.lower(text)
    return (
        F.when(text.rlike(_ISO), _iso(*_parts(text, _ISO)))
        .when(text.rlike(_ISO_COMPACT), _iso(*_parts(text, _ISO_COMPACT)))
        .when(text.rlike(_ISO_WEEK), _week_date(text))
        .when(low.rlike(_DAY_FIRST), _day_first(low))
        .when(low.rlike(_YEAR_FIRST), _year_first(low))
        .when(low.rlike(_DAY_MONTH), _named(low, _DAY_MONTH, 1, 2))
        .when(low.rlike(_MONTH_DAY), _named(low, _MONTH_DAY, 2, 1))
    )


def to_iso_date(value: Column) -> Column:
    """ISO date of any text, NULL where none can be read."""
    return let(clean_text(value), read_date)


def day_of(value: Column) -> Column:
    """The day part of an ISO text."""
    return F.substring(value, 1, 10)
