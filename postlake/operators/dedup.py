"""Duplicates inside a run: the first record of a fingerprint wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_KEY = ("run_id", "source", "fingerprint")


def _losers(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key and `ingest_seq` of the rows that come after the first of their key. Only
    these narrow columns are shuffled, combined before it; a key of very many rows
    sends one row per task and is joined back by its own numbers."""
    narrow = df.select(*key, "ingest_seq").filter(F.coalesce("fingerprint", F.lit("")) != "")
    first = narrow.groupBy(*key).agg(F.min("ingest_seq").alias("_first"), F.count("*").alias("_n"))
    repeated = first.filter("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in key], "_first")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return narrow.join(repeated, same).filter("ingest_seq > _first").select(*key, "ingest_seq")


def _placed(df: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    losers = _losers(df, key)
    names = (*key, "ingest_seq")
    losers = losers.select(*[F.col(c).alias(f"_{c}") for c in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    return df.join(losers, same, how)


def first_per_fingerprint(df: DataFrame, key: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """The earliest row (`ingest_seq`, unique within a key) per key; rows without a
    fingerprint pass. The rows themselves are in no window and no aggregate."""
    return _placed(df, key, "left_anti")


def duplicates(df: DataFrame, key: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """The rows `first_per_fingerprint` leaves out."""
    return _placed(df, key, "left_semi")


def duplicate_counts(df: DataFrame, key: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Dropped duplicates per run and source."""
    per_key = (
        df.filter(F.coalesce("fingerprint", F.lit("")) != "")
        .groupBy(*key).agg(F.count("*").alias("_n"))
    )
    return per_key.groupBy("run_id", "source").agg(F.sum(F.col("_n") - 1).alias("duplicates"))
