"""Facets, term counts, timeline and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LIST_FIELDS
from ..session import materialise
from .filters import condition, seen_day

FACETS = (
    "source", "region", "city", "company", "country", "contract_type",
    "remote_policy", "lang", "seniority",
)


def _ranked(counted: DataFrame, limit: int) -> DataFrame:
    return counted.orderBy(F.desc("count"), F.asc("value")).limit(limit)


def facets(state: DataFrame, field: str, limit: int = 30, **filters) -> DataFrame:
    """Values of one column and how many postings have each, most frequent first."""
    if field not in FACETS:
        raise ValueError(f"unknown facet {field!r}; one of {', '.join(sorted(FACETS))}")
    kept = state.filter(condition(**filters)).filter(F.col(field) != "")
    return _ranked(kept.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count")), limit)


def _by_each(rows: DataFrame, fields: tuple[str, ...], *also: str, **figures) -> DataFrame:
    """field, value and `figures` for each value of each of the columns, and of the whole
    table under the field NULL: one pass, in which each row stands once for each column
    and is combined before the shuffle. `also` are columns that the figures read."""
    columns = [F.col(f).cast("string").alias(f) for f in fields]
    sets = rows.select(*columns, *also).groupingSets([[F.col(f)] for f in fields] + [[]], *[F.col(f) for f in fields])
    counted = sets.agg(*[made.alias(name) for name, made in figures.items()], *[F.grouping(f).alias(f"_{f}") for f in fields])
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        field = F.when(F.col(f"_{f}") == 0, F.lit(f)).otherwise(field)
        value = F.when(F.col(f"_{f}") == 0, F.col(f)).otherwise(value)
    return counted.select(field.alias("field"), value.alias("value"), *figures)


def _leading(counted: DataFrame, limit: int) -> DataFrame:
    """The most frequent values of each field; a task passes on no more than `limit` of one."""
    order = Window.partitionBy("field").orderBy(F.desc("count"), F.asc("value"))
    kept = counted.filter((F.col("value") != "") & F.col("field").isNotNull()).select("field", "value", "count")
    return kept.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit).drop("_place")


def all_facets(state: DataFrame, limit: int = 30, fields: tuple[str, ...] = FACETS, **filters) -> DataFrame:
    """`facets` of several columns (field, value, count) from one scan."""
    if unknown := set(fields) - set(FACETS):
        raise ValueError(f"unknown facet {min(unknown)!r}; one of {', '.join(sorted(FACETS))}")
    kept = state.filter(condition(**filters))
    return _leading(_by_each(kept, fields, count=F.count("*")), limit)


def top_terms(state: DataFrame, field: str = "skills", limit: int = 30, **filters) -> DataFrame:
    """Entries of a list column and how often they occur, repeats included."""
    if field not in LIST_FIELDS:
        raise ValueError(f"{field!r} is not a list of terms; one of {', '.join(LIST_FIELDS)}")
    # The outer form keeps Spark from deriving a size check below the generator,
    # which would work out a computed list twice; its empty rows have no position.
    entries = state.filter(condition(**filters)).select(
        F.posexplode_outer(field).alias("pos", "value")
    ).filter("pos is not null")
    return _ranked(entries.groupBy("value").agg(F.count("*").alias("count")), limit)


def timeline(state: DataFrame, days: int = 30, **filters) -> DataFrame:
    """Postings per day: the last `days` days that have any, in ascending order."""
    dated = state.filter(condition(**filters)).filter(seen_day().isNotNull())
    per_day = dated.groupBy(F.substring(seen_day(), 1, 10).alias("day")).agg(
        F.count("*").alias("count")
    )
    return per_day.orderBy(F.desc("day")).limit(days).orderBy("day")


def totals(state: DataFrame) -> DataFrame:
    """One row: volume, coverage and freshness of the whole state."""
    return state.agg(
        F.count("*").alias("total"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct("company").alias("companies"),
        F.min(seen_day()).alias("oldest"),
        F.max(seen_day()).alias("newest"),
        F.sum(F.when(F.col("lat").isNotNull(), 1).otherwise(0)).alias("geolocated"),
    )


def summary(state: DataFrame) -> dict[str, DataFrame]:
    """The totals with the leading sources and countries, from one scan: counts by
    value are written once, a row for each value."""
    rows = state.withColumn("_day", seen_day()).withColumn("_placed", F.when(F.col("lat").isNotNull(), 1).otherwise(0))
    figures = {"count": F.count("*"), "oldest": F.min("_day"), "newest": F.max("_day"), "geolocated": F.sum("_placed")}
    counted = materialise(
        _by_each(rows, ("source", "company", "country"), "_day", "_placed", **figures), "summary")
    whole = F.col("field").isNull()

    def values(field: str):
        return F.count_if(F.coalesce(F.col("field") == field, F.lit(False)) & F.col("value").isNotNull())

    return {
        "totals": counted.agg(
            F.coalesce(F.sum(F.when(whole, F.col("count"))), F.lit(0)).alias("total"),
            values("source").alias("sources"), values("company").alias("companies"),
            *[F.max(F.when(whole, F.col(c))).alias(c) for c in ("oldest", "newest", "geolocated")]),
        "by_source": _ranked(_leading(counted.filter("field = 'source'"), 50).select("value", "count"), 50),
        "by_country": _ranked(_leading(counted.filter("field = 'country'"), 20).select("value", "count"), 20),
    }


def counts_by_source(state: DataFrame) -> DataFrame:
    """Postings per source, largest first; equal counts by name."""
    return (
        state.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("source"))
    )


def total(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("n"))


def quantiles(rows: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """Exact quantiles of a column in each group, between two values in proportion:
    group, how many rows have a value, and an array in the order of `shares`. NULL and
    NaN are left out; NULL is a group of its own.

    Equal values are counted before the shuffle and dealt to ranges, so a group may hold
    all rows: no task gets more of it than a range. Counts per range tell in which ranges
    the wanted places lie, and only the values of these are ranked."""
    if not shares or not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares are between 0 and 1")
    number = F.col(value).cast("double")
    counted = (
        rows.select(F.col(group).alias("_group"), number.alias("_value"))
        .filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
        .groupBy("_group", "_value").agg(F.count("*").alias("_n"))
    )
    dealt = materialise(
        counted.repartitionByRange("_group", "_value").withColumn("_range", F.spark_partition_id()), "quantiles")
    whole, so_far = Window.partitionBy("_group"), Window.partitionBy("_group").orderBy("_range")
    ranges = dealt.groupBy("_group", "_range").agg(F.sum("_n").alias("_in")).select(
        F.col("_group").alias("_g"), F.col("_range").alias("_r"), F.sum("_in").over(whole).alias("_all"),
        (F.sum("_in").over(so_far) - F.col("_in")).alias("_before"), "_in")
    # Two neighbouring places for each share, from 0 on.
    at = [(F.col("_all") - 1) * F.lit(float(s)) for s in shares]
    places = F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)])
    held = F.filter(places, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_in")))
    needed = ranges.withColumn("_places", F.array_distinct(held)).filter(F.size("_places") > 0)
    near = dealt.join(needed, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    end = F.sum("_n").over(Window.partitionBy("_group", "_range").orderBy("_value")) + F.col("_before")
    ranked = near.withColumn("_end", end)
    mine = F.filter("_places", lambda p: (p >= F.col("_end") - F.col("_n")) & (p < F.col("_end")))
    found = ranked.select("_group", "_all", "_value", F.explode(mine).alias("_place")).groupBy("_group", "_all").agg(
        F.map_from_entries(F.collect_list(F.struct("_place", "_value"))).alias("_at"))

    def between(position):
        low, part = F.floor(position).cast("bigint"), position - F.floor(position)
        below, above = F.col("_at")[low], F.col("_at")[F.ceil(position).cast("bigint")]
        return F.when(below == above, below).otherwise(below * (1 - part) + above * part)

    return found.select(F.col("_group").alias(group), F.col("_all").alias("n"), F.array(*[between(a) for a in at]).alias("quantiles"))
