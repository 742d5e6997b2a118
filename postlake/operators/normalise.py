"""One projection that brings every posting to the common form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import read_date
from ..functions.numbers import clamp_percent, plain_text, salary_range, to_float, workload_range
from ..functions.places import read_country
from ..functions.text import clean_text, strip, strip_lines, with_each
from ..schema import CLEAN_TEXT_FIELDS, LIST_FIELDS, POSTING_FIELDS, RUN_COLUMNS, conform


def fingerprint(source: Column, external_id: Column, url: Column) -> Column:
    """Stable key of a posting: its source and identifier, else its address."""
    identifier = F.coalesce(F.nullif(strip(external_id), F.lit("")), strip(url), F.lit(""))
    origin = F.lower(strip(F.coalesce(source, F.lit(""))))
    return F.sha1(F.concat(origin, F.lit("|"), identifier).cast("binary"))


def clean_list(values: Column) -> Column:
    """Entries cleaned, empty ones dropped, first of equal ones kept."""
    cleaned = F.array_distinct(F.transform(values, clean_text))
    return F.coalesce(
        F.filter(cleaned, lambda x: x.isNotNull()), F.array().cast("array<string>")
    )


def normalise(df: DataFrame, run_time: str | Column) -> DataFrame:
    """Any loose postings to clean ones. `run_time` fills a missing `scraped_at`;
    pass the same value for the whole run."""
    extra = [c for c in RUN_COLUMNS if c in df.columns]
    numbers = ("lat", "lon", "salary_min", "salary_max", "workload_min", "workload_max")
    dates = ("posted_at", "expires_at")

    staged = conform(df)
    cleaned = (*CLEAN_TEXT_FIELDS, *dates, "country")
    staged = with_each(staged, "_text", {c: F.col(c) for c in cleaned}, clean_text)
    staged = with_each(staged, "_number", {c: F.col(c) for c in numbers}, to_float)
    staged = with_each(staged, "_list", {c: F.col(c) for c in LIST_FIELDS}, clean_list)
    staged = with_each(staged, "_date", {c: F.col(f"_text.{c}") for c in dates}, read_date)
    low, high = (clamp_percent(F.col(f"_number.{c}")) for c in ("workload_min", "workload_max"))
    staged = staged.withColumns({"_low": low, "_high": high})
    both = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    given_time = F.nullif("scraped_at", F.lit(""))

    made = {
        **{c: F.col(f"_text.{c}") for c in CLEAN_TEXT_FIELDS},
        **{c: F.col(f"_date.{c}") for c in dates},
        **{c: F.col(f"_number.{c}") for c in numbers},
        **{c: F.col(f"_list.{c}") for c in LIST_FIELDS},
        "description": strip_lines(F.col("description")),
        "country": read_country(F.col("_text.country")),
        "scraped_at": F.coalesce(
            given_time, F.lit(run_time) if isinstance(run_time, str) else run_time
        ),
        "salary_currency": F.nullif(F.upper("salary_currency"), F.lit("")),
        "workload_min": F.when(both, F.least("_low", "_high")).otherwise(F.col("_low")),
        "workload_max": F.when(both, F.greatest("_low", "_high")).otherwise(F.col("_high")),
        "fingerprint": F.coalesce(
            F.nullif("fingerprint", F.lit("")),
            fingerprint(*[F.col(f"_text.{c}") for c in ("source", "external_id", "url")]),
        ),
    }
    return staged.select(*[made[c].alias(c) for c in POSTING_FIELDS], *extra)


def with_workload(df: DataFrame, column: str) -> DataFrame:
    """`workload_min` and `workload_max` read from a column of text or numbers."""
    return df.withColumn("_r", workload_range(F.col(column), df.schema[column].dataType)).withColumns(
        {"workload_min": F.col("_r.min"), "workload_max": F.col("_r.max")}
    ).drop("_r")


def with_salary(df: DataFrame, column: str, currency_hint: str | None = None) -> DataFrame:
    """`salary_min`, `salary_max` and `salary_currency` from a column of text or numbers."""
    hint = F.col(currency_hint) if currency_hint else None
    kind = df.schema[column].dataType
    # Amounts have two decimals; more of them would read as groups of thousands.
    amount = F.round(F.col(column), 2) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(column)
    text = plain_text(amount, kind)
    return df.withColumn("_r", salary_range(text, hint)).withColumns(
        {
            "salary_min": F.col("_r.min"),
            "salary_max": F.col("_r.max"),
            "salary_currency": F.col("_r.currency"),
        }
    ).drop("_r")


def coverage(df: DataFrame, low: str, high: str) -> DataFrame:
    """Per source: how many rows have a range, and the extent of its bounds."""
    return df.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count(low).alias("parsed"),
        F.min(low).alias("lowest"),
        F.max(high).alias("highest"),
        F.percentile(low, 0.5).alias("median_low"),
    )
