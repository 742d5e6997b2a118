"""The current state: one row per fingerprint with first and last sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STATE_COLUMNS

CONTENT = tuple(c for c in STATE_COLUMNS if c not in ("fingerprint", "first_seen_at", "last_seen_at"))


def fold(history: DataFrame, order: tuple[str, ...] = ("run_seq", "ingest_seq"),
         content: tuple[str, ...] = CONTENT) -> DataFrame:
    """State from a whole history of sightings (`fingerprint`, content, `seen_at`
    and the order columns): content of the last write, NULLs included; `seen_at`
    of the first and the last write.

    Every aggregate is combined before the shuffle, so a fingerprint seen a
    billion times sends one row per task.
    """
    present = [c for c in content if c in history.columns]
    position = F.struct(*order)
    # A struct is never NULL itself, so NULL content survives as the last write.
    last = F.max_by(F.struct(*[F.col(c) for c in present], F.col("seen_at")), position)
    folded = history.groupBy("fingerprint").agg(
        last.alias("_last"), F.min_by("seen_at", position).alias("first_seen_at")
    )
    return folded.select(
        "fingerprint",
        *[F.col("_last")[c].alias(c) for c in present],
        "first_seen_at",
        F.col("_last.seen_at").alias("last_seen_at"),
    )


def fold_wide(history: DataFrame, order: tuple[str, ...] = ("run_seq", "ingest_seq"),
              content: tuple[str, ...] = CONTENT) -> DataFrame:
    """`fold` of a history written by `write_history`: the winners are found on key and
    order alone, and their content is fetched once, bucket by bucket, so no content is
    in an exchange or an aggregate. The order columns tell all writes of a key apart;
    rows without a key are left out."""
    present = [c for c in content if c in history.columns]
    position = F.struct(*order)
    winners = history.groupBy("fingerprint").agg(
        F.max(position).alias("_last"), F.min_by("seen_at", position).alias("first_seen_at"))
    rows = history.select("fingerprint", *present, F.col("seen_at").alias("last_seen_at"), position.alias("_at"))
    # No write is later than the last one. An equality would be a key of the join, and
    # the buckets are by fingerprint alone.
    same = (rows["fingerprint"] == winners["fingerprint"]) & (rows["_at"] >= winners["_last"])
    return rows.join(winners.hint("merge"), same).select(
        rows["fingerprint"], *[rows[c] for c in present], winners["first_seen_at"], rows["last_seen_at"])


def write_history(history: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write sightings as a table in buckets by key, to which later runs append."""
    writer = history.write.mode("append").format("parquet").option("path", path)
    writer.bucketBy(buckets, "fingerprint").sortBy("fingerprint").saveAsTable(table)
    return history.sparkSession.table(table)


def upsert(state: DataFrame, batch: DataFrame, content: tuple[str, ...] = CONTENT) -> DataFrame:
    """New state after a batch, with `is_new` (inserted now), NULL for rows the
    batch does not touch. Both sides hold a fingerprint at most once: fold the
    batch first. Every content column is overwritten, by NULL as well; only
    `first_seen_at` keeps the older value."""
    present = [c for c in content if c in batch.columns]
    s, b = state.alias("s"), batch.alias("b")
    touched = F.col("b.fingerprint").isNotNull()
    known = F.col("s.fingerprint").isNotNull()

    def newer(name: str) -> Column:
        return F.when(touched, F.col(f"b.{name}")).otherwise(F.col(f"s.{name}")).alias(name)

    return s.join(b, F.col("s.fingerprint") == F.col("b.fingerprint"), "full_outer").select(
        F.coalesce("b.fingerprint", "s.fingerprint").alias("fingerprint"),
        *[newer(c) for c in present],
        F.coalesce("s.first_seen_at", "b.first_seen_at").alias("first_seen_at"),
        newer("last_seen_at"),
        F.when(touched, ~known).alias("is_new"),
    )


def overlay_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The state `upsert` would give, without moving the base: its untouched rows
    pass an anti join, and only the first sight of touched ones is looked up.
    While the changes are small enough to be sent to every task, the base is
    neither shuffled nor sorted. Both sides hold a fingerprint at most once."""
    columns = base.columns
    untouched = base.join(changes.select("fingerprint"), "fingerprint", "left_anti")
    first = base.select("fingerprint", F.col("first_seen_at").alias("_first"))
    keys = changes.select("fingerprint")
    known = first.join(keys, "fingerprint", "left_semi")
    renewed = changes.join(known, "fingerprint", "left").withColumn(
        "first_seen_at", F.coalesce("_first", "first_seen_at")
    )
    return untouched.select(*columns).unionByName(renewed.select(*columns))


def as_batch(postings: DataFrame, seen_at: str) -> DataFrame:
    """Postings of one run as an upsert batch: one row per key, one `seen_at` for all.
    Only keys that several rows have are folded; the others pass as they are."""
    ordered = postings
    for name in ("run_seq", "ingest_seq"):
        if name not in ordered.columns:
            ordered = ordered.withColumn(name, F.lit(0).cast("bigint"))
    several = ordered.groupBy("fingerprint").agg(F.count("*").alias("_n")).filter("_n > 1").select("fingerprint")
    stamped = ordered.withColumn("seen_at", F.lit(seen_at))
    folded = fold(stamped.join(several, "fingerprint", "left_semi"))
    alone = stamped.join(several, "fingerprint", "left_anti").withColumns(
        {"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")})
    return alone.select(*folded.columns).unionByName(folded)


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """One row: how many postings were new, how many updated."""
    return upserted.agg(
        F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("updated")
    )


def publication_duration(state: DataFrame, group: str = "source") -> DataFrame:
    """Days between first and last sight per group."""
    def day(name: str) -> Column:
        return F.to_date(F.substring(name, 1, 10))

    days = F.datediff(day("last_seen_at"), day("first_seen_at"))
    return state.groupBy(group).agg(
        F.count("*").alias("postings"),
        F.min(days).alias("shortest"),
        F.max(days).alias("longest"),
        F.sum(days).cast("bigint").alias("total_days"),
        F.percentile(days, 0.5).alias("median_days"),
    )


def remove(state: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """State (or index rows) without the given fingerprints."""
    return state.join(fingerprints.select("fingerprint"), "fingerprint", "left_anti")
