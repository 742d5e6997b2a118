"""Landed API page dumps to rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """One output row per element of a page that is a JSON list; any other JSON
    gives none, text that is not JSON is left to `unreadable_pages`.

    Adds `row_pos` (place in the page) and `row` (VARIANT).
    """
    rows = F.try_variant_get(F.try_parse_json(F.col(body)), "$", "array<variant>")
    others = [c for c in pages.columns if c != body]
    exploded = pages.select(*others, F.posexplode(rows).alias("row_pos", "row"))
    return exploded.filter(F.col("row").isNotNull() & ~F.is_variant_null(F.col("row")))


def unreadable_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Pages that are not JSON: skipped by `page_rows`, reported here."""
    bad = F.col(body).isNotNull() & F.try_parse_json(F.col(body)).isNull()
    return pages.filter(bad).drop(body)


def map_rows(rows: DataFrame, mapping: Mapping[str, str | Column], keep=()) -> DataFrame:
    """Posting columns from the row variants.

    A mapping value is a JSON path (`$.job.title`, read as text) or a column
    expression over `row`. A path that does not fit gives NULL, so one odd row
    never stops the job; rows where nothing could be read are left out.
    """
    made = {
        name: F.try_variant_get(F.col("row"), how, "string") if isinstance(how, str) else how
        for name, how in mapping.items()
    }
    mapped = rows.select(*keep, *[c.alias(name) for name, c in made.items()])
    return mapped.filter(F.coalesce(*[F.col(n).cast("string") for n in made]).isNotNull())


def page_report(
    pages: DataFrame, page_size: int, max_pages: int | None = None, start_page: int = 0,
    body: str = "body",
) -> DataFrame:
    """Per landed page: its row count, whether it is the last one (shorter than
    `page_size`, or the `max_pages`-th) and whether it lies past the end."""
    rows = F.try_variant_get(F.try_parse_json(F.col(body)), "$", "array<variant>")
    counted = pages.select(
        "source", "page", F.coalesce(F.size(rows), F.lit(0)).alias("n_rows")
    ).withColumn("n_rows", F.greatest("n_rows", F.lit(0)))
    per_page = counted.groupBy("source", "page").agg(F.sum("n_rows").alias("n_rows"))
    is_last = F.col("n_rows") < page_size
    if max_pages is not None:
        is_last = is_last | (F.col("page") - start_page + 1 >= max_pages)
    flagged = per_page.withColumn("is_last", is_last)
    ends = flagged.groupBy("source").agg(
        F.min(F.when(F.col("is_last"), F.col("page"))).alias("end_page")
    )
    return flagged.join(ends, "source").select(
        "source", "page", "n_rows", "is_last",
        F.coalesce(F.col("page") > F.col("end_page"), F.lit(False)).alias("past_end"),
    )
