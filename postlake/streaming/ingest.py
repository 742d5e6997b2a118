"""Postings that keep arriving: landing folder to state, micro-batch by micro-batch.

Of a posting that occurs several times, in one micro-batch or in several, the first
record wins and the others are duplicates, as long as the stream remembers it: the keys
of valid postings pass a state store under a watermark on `scraped_at` (the time of
reading where a row has none), which forgets a key once the watermark is `delay` past
its first record. So the state is bounded by the postings of that time, whatever the
age of the stream. A row that is older than the watermark is late and dropped with the
duplicates. Only keys are in the state and its shuffle; the rows of a micro-batch meet
the keys that are new in it.

The store counts the micro-batches of a stream, so one that is repeated after a failure
changes nothing, and several streams, or a stream and batch runs, write the same store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import Step
from ..operators.normalise import normalise
from ..operators.validate import accepted, judge
from ..plans.ingest import Run, ingest
from ..plans.store import Store
from ..schema import RAW_SCHEMA, RUN_COLUMNS
from ..session import remove_folder, scratch_path


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def read_landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed raw postings as a stream. The landing job may have fixed their
    order in `ingest_seq`."""
    schema = T.StructType(
        [*RAW_SCHEMA.fields, T.StructField("ingest_seq", RUN_COLUMNS["ingest_seq"])]
    )
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a fingerprint within `delay` of each other across
    micro-batches, with bounded state. Which of the repeats stays is not fixed;
    the first-wins rule inside a micro-batch is that of the batch job."""
    return (
        stream.withColumn("_at", F.coalesce(F.try_to_timestamp("scraped_at"), F.current_timestamp()))
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(["source", "fingerprint"])
        .drop("_at")
    )


def _valid_keys(stream: DataFrame) -> DataFrame:
    """(source, fingerprint, scraped_at) of the valid postings of a landing stream."""
    stamped = stream.withColumns({"run_id": F.lit(""), "run_seq": F.lit(0).cast("bigint")})
    read_at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return accepted(judge(normalise(stamped, read_at))).select("source", "fingerprint", "scraped_at")


def new_keys(stream: DataFrame, delay: str) -> DataFrame:
    """(source, fingerprint) of valid postings of a landing stream that it has not seen
    within `delay`: once for each, whichever record of a micro-batch they come from."""
    return deduplicated(_valid_keys(stream), delay).select("source", "fingerprint")


def closed(stream: DataFrame, unseen: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Postings of a landing stream that were not seen for `unseen`: one row each time
    one closes, with its first and last sight since it was opened and how many there
    were. A posting that comes back later is opened anew.

    Sightings may come out of order by `delay`: a posting closes once the watermark,
    `delay` behind the latest sighting of all, is `unseen` past its last one. A sighting
    that comes later is dropped if the watermark is `unseen` past it already, and else
    opens a closed posting anew. The state store holds the open postings alone: three
    values each."""
    seen = _valid_keys(stream).withColumn(
        "_at", F.coalesce(F.try_to_timestamp("scraped_at"), F.current_timestamp()))
    spans = seen.withWatermark("_at", delay).groupBy("source", "fingerprint", F.session_window("_at", unseen)).agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("sightings"))

    def written(name: str):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    return spans.select("source", "fingerprint", written("_first").alias("first_seen_at"),
                        written("_last").alias("last_seen_at"), "sightings")


def start(
    stream: DataFrame,
    store: Store,
    checkpoint: str,
    steps: Iterable[tuple[str, Step]] = (),
    clock: Callable[[int], str] | None = None,
    available_now: bool = True,
    delay: str = "30 days",
) -> StreamingQuery:
    """Feed a landing stream into the store. `clock` gives a micro-batch its
    `seen_at`; `delay` is how long a posting is remembered."""
    steps = list(steps)
    keys = new_keys(stream, delay)
    both = stream.withColumn("new_key", F.lit(False)).unionByName(
        keys.withColumn("new_key", F.lit(True)), allowMissingColumns=True)

    def run_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Written once: each action on the batch itself would work through the state again.
        path = scratch_path(spark, "micro-batch")
        batch.write.partitionBy("new_key").parquet(path)
        written = spark.read.schema(batch.schema).parquet(path)
        rows = written.filter(~F.col("new_key")).drop("new_key")
        if rows.isEmpty():
            remove_folder(spark, path)
            return
        # A new checkpoint is a new stream, whose batches are numbered from 0 again.
        identity = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        name = hashlib.sha1(identity.encode()).hexdigest()[:12]
        seen_at = clock(number) if clock else utc_now()
        raw = rows.withColumn("ingest_seq", F.coalesce("ingest_seq", F.monotonically_increasing_id()))
        run = Run(f"{name}-{number:09d}", number, seen_at, steps=steps)
        ingest(raw, store, run, written.filter("new_key").select("source", "fingerprint"), (name, number),
               lambda: remove_folder(spark, path))

    writer = both.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
