"""From raw postings to archive, state and counters: one run.

Stages: normalise, validate, drop duplicates, enrich, archive, upsert. Raw rows
are read and normalised once; the judged rows are written to a staging folder and
everything after works from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.dedup import duplicates, first_per_fingerprint
from ..operators.enrich import ERRORS, Step, enrich
from ..operators.normalise import normalise
from ..operators.state import as_batch
from ..operators.validate import BAD_URL, DUPLICATE, INCOMPLETE, accepted, judge, rejects
from ..schema import POSTING_FIELDS, RUN_COLUMNS
from ..session import materialise, prepare, remove_folder, scratch_path, tidy
from ..sources.archive import append_archive
from .store import Store


@dataclass
class Run:
    """One collection run. `seen_at` is the single time of all its sightings."""

    run_id: str
    run_seq: int
    seen_at: str
    archive: bool = True
    steps: Iterable[tuple[str, Step]] = field(default_factory=tuple)


def stage(raw: DataFrame, run: Run, path: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Normalised and judged rows of a run, written once, and their counters."""
    stamped = raw.withColumns(
        {"run_id": F.lit(run.run_id), "run_seq": F.lit(run.run_seq).cast("bigint")}
    )
    if "ingest_seq" not in raw.columns:
        stamped = stamped.withColumn("ingest_seq", F.monotonically_increasing_id())
    judged = judge(normalise(stamped, run.seen_at))
    seen = Observation()
    reason = F.col("reject_reason")
    watched = judged.observe(
        seen,
        F.count_if(reason.isNull()).alias("valid"),
        F.count_if(reason == INCOMPLETE).alias(f"dropped/{INCOMPLETE}"),
        F.count_if(reason == BAD_URL).alias(f"dropped/{BAD_URL}"),
    )
    staged = materialise(watched, f"stage-{run.run_id}", path)
    return staged, dict(seen.get)


def ingest(
    raw: DataFrame, store: Store, run: Run, unseen: DataFrame | None = None,
    mark: tuple[str, int] | None = None, spent: Callable[[], None] = lambda: None,
) -> dict[str, int]:
    """Process one run into the store and return its counters. The same run again
    right after itself replaces what it wrote. `unseen` holds (source, fingerprint) of
    the postings that no earlier part of the run had: all others are duplicates here.
    `mark` names a stream and its batch; `spent` is called when `raw` and `unseen` are
    not read any more. What a run only writes for itself goes as soon as it is read."""
    spark, own = prepare(store.spark), raw.sparkSession
    stage_path, kept_path = (scratch_path(own, f"{label}-{run.run_id}") for label in ("stage", "kept"))
    with tidy(own):
        staged, counters = stage(raw, run, stage_path)
    valid = accepted(staged)
    kept_rows, dropped = first_per_fingerprint(valid), duplicates(valid)
    if unseen is not None:
        known = unseen.select(F.col("source").alias("_s"), F.col("fingerprint").alias("_f"))
        same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("fingerprint") == F.col("_f"))
        dropped = dropped.unionByName(kept_rows.join(known, same, "left_anti"))
        kept_rows = kept_rows.join(known, same, "left_semi")

    dropped = dropped.withColumns(
        {"reject_reason": F.lit(DUPLICATE), "missing_fields": F.array().cast("array<string>")}
    )
    out = rejects(staged).unionByName(dropped.select(*staged.columns))
    with tidy(own):
        (
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id").parquet(store.folder("rejects"))
        )

    kept = Observation()
    steps = list(run.steps)
    enriched = enrich(kept_rows, steps)
    failed = [
        F.count_if(F.array_contains(ERRORS, name)).alias(f"enrich_failed/{name}")
        for name, _ in steps
    ]
    with tidy(own):
        written = materialise(
            enriched.observe(kept, F.count("*").alias("kept"), *failed), f"kept-{run.run_id}", kept_path
        )
    remove_folder(spark, stage_path)
    spent()
    figures = dict(kept.get)
    counters[f"dropped/{DUPLICATE}"] = counters["valid"] - figures.pop("kept")
    counters |= figures
    postings = written.select(*POSTING_FIELDS, *RUN_COLUMNS)
    if run.archive:
        append_archive(postings, store.folder("archive"))

    counters |= store.upsert(as_batch(postings, run.seen_at), f"{run.run_id}/{run.run_seq}", mark,
                             lambda: remove_folder(spark, kept_path))
    store.add_metrics(run.run_id, counters)
    return counters


def replay(store: Store, target: Store, runs: Iterable[Run]) -> None:
    """Process landed raw rows again, run by run, into another store: after a
    parser was corrected, without asking any site again."""
    for run in sorted(runs, key=lambda r: r.run_seq):
        ingest(store.raw([run.run_id]).drop("run_id", "run_seq"), target, run)
