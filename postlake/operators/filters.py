"""The filters every search and report understands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EQUAL = ("source", "region", "country", "contract_type", "remote_policy", "lang")
CONTAINS = ("city", "company")
OTHER = ("workload_min", "salary_min", "posted_since", "skills")


def _ascii_lower(value: Column) -> Column:
    """Letters A-Z only; accented letters keep their case."""
    return F.translate(value, _UPPER, _UPPER.lower())


def seen_day() -> Column:
    """Publication date, else the first sight."""
    return F.coalesce(F.col("posted_at"), F.col("first_seen_at"))


def condition(**wanted) -> Column:
    """One predicate from the given filters; empty ones do not filter.

    `source region country contract_type remote_policy lang`: equality.
    `city company`: part of the text; `%` and `_` act as wildcards.
    `workload_min salary_min`: against the upper bound, 0 counts as a filter.
    `posted_since`: text comparison of ISO dates. `skills`: all must be present.
    """
    unknown = set(wanted) - {*EQUAL, *CONTAINS, *OTHER}
    if unknown:
        raise TypeError(f"unknown filter: {', '.join(sorted(unknown))}")
    parts: list[Column] = [F.col(c) == wanted[c] for c in EQUAL if wanted.get(c)]
    for name in CONTAINS:
        if wanted.get(name):
            # A backslash escapes in LIKE here; it must stand for itself.
            pattern = "%" + wanted[name].replace("\\", "\\\\") + "%"
            parts.append(_ascii_lower(F.col(name)).like(pattern.translate(
                str.maketrans(_UPPER, _UPPER.lower()))))
    for bound, low, high in (
        ("workload_min", "workload_min", "workload_max"),
        ("salary_min", "salary_min", "salary_max"),
    ):
        if wanted.get(bound) is not None:
            parts.append(F.coalesce(high, low) >= wanted[bound])
    if wanted.get("posted_since"):
        parts.append(seen_day() >= wanted["posted_since"])
    parts += [F.array_contains("skills", s) for s in wanted.get("skills") or ()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))
