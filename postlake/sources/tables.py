"""Parquet tables and run-wide reading helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A quota is counted per slice of 2**16 places in the landing order.
_SLICE_BITS = 16


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def stamp(df: DataFrame, source: str, scraped_at: str | Column) -> DataFrame:
    """Source name and scrape time where a record does not carry them."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), default) if name in df.columns else default
            for name, default in (
                ("source", F.lit(source)),
                ("scraped_at", F.lit(scraped_at)),
            )
        }
    )


def with_ingest_seq(df: DataFrame, *order: str) -> DataFrame:
    """A landing order, assigned once; persist the result before relying on it.

    Rows are sorted by `order` across the cluster, so the number grows with it.
    """
    ordered = df.orderBy(*order) if order else df
    return ordered.withColumn("ingest_seq", F.monotonically_increasing_id())


def quota_per_source(df: DataFrame, limit: int | str | None) -> DataFrame:
    """The first `limit` rows of each source in landing order; None, "" and "0"
    mean no limit. Needs a unique `ingest_seq`.

    A source may hold a third of all rows, so no source is ever sorted in one
    task: rows are counted per slice of the landing order, the running total
    over those counts finds the slices the limit reaches into, and only their rows
    are ranked, slice by slice.
    """
    if limit in (None, "", "0"):
        return df
    limit = int(limit)
    sliced = df.withColumn("_slice", F.shiftright("ingest_seq", _SLICE_BITS))
    counted = sliced.groupBy("source", "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = (
        counted.select(
            F.col("source").alias("_src"), F.col("_slice").alias("_sl"),
            F.coalesce(before, F.lit(0)).alias("_before"),
        )
        .filter(F.col("_before") < limit)
    )
    rows = sliced.join(
        needed, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_slice") == F.col("_sl"))
    )
    place = F.row_number().over(Window.partitionBy("source", "_slice").orderBy("ingest_seq"))
    return (
        rows.withColumn("_place", place)
        .filter(F.col("_place") + F.col("_before") <= limit)
        .select(*df.columns)
    )


def union_sources(frames: dict[str, DataFrame], limit: int | str | None = None) -> DataFrame:
    """All configured sources as one frame, each stamped with its name where it
    has none and held to the same quota."""
    named = [
        df.withColumn("source", F.coalesce(F.col("source"), F.lit(name)))
        if "source" in df.columns
        else df.withColumn("source", F.lit(name))
        for name, df in sorted(frames.items())
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return quota_per_source(both, limit)
