"""Where a corpus lives: raw landing, archive, rejects, run metrics and the current
state.

The state is a plain table in `buckets` folders by key. A run rewrites the buckets it
touches into a new folder, which no reader has open, and then publishes a short list
that names the folder of every bucket. Runs are applied in the order in which they are
published, whatever they are numbered: the last write of a posting wins and none is
lost. A reader opens the newest list and scans the folders it names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.index import Index, read_index, refresh_index, write_index
from ..operators.search import Corpus, token_count
from ..operators.state import overlay_changes
from ..schema import POSTING_FIELDS, RAW_SCHEMA, RUN_COLUMNS, STATE_COLUMNS, conform
from ..session import keyed, materialise, remove_folder, scratch_path, tidy

#: Columns the store keeps beside a posting: when it was written, how long it is.
_KEPT = {"version": T.LongType(), "doc_tokens": T.IntegerType()}
_STATE_SCHEMA = T.StructType([T.StructField(c, POSTING_FIELDS.get(c, T.StringType())) for c in STATE_COLUMNS])
_STORED_SCHEMA = T.StructType([*_STATE_SCHEMA.fields, *[T.StructField(n, k) for n, k in _KEPT.items()]])
_GONE = "fingerprint string, version bigint"
#: Bytes of the state that a run rewrites at one time.
_AT_ONCE = 256 << 20
METRICS = "run_id string, counter string, n bigint"


@dataclass(frozen=True)
class Published:
    """One state of the store: the folder of each bucket, and what led to it. `marks`
    holds for each stream its last batch and that batch's counters."""

    version: int
    run: str
    before: int | None
    folders: dict[str, str] = field(default_factory=dict)
    marks: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    buckets: int = 64

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _file(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(name))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _read(self, name: str) -> str | None:
        system, place = self._file(name)
        if not system.exists(place):
            return None
        stream = system.open(place)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> bool:
        """Whether the file could be written; without `overwrite` the first one stays."""
        system, place = self._file(name)
        if not overwrite and system.exists(place):
            return False
        try:
            stream = system.create(place, overwrite)
        except Exception as failure:
            if not overwrite and system.exists(place):
                return False
            raise failure
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    # -- raw landing -------------------------------------------------------

    def land(self, raw: DataFrame, run_id: str, run_seq: int) -> None:
        """Keep what a source answered, before any processing, and fix its order."""
        ordered = raw
        if "ingest_seq" not in raw.columns:
            ordered = raw.withColumn("ingest_seq", F.monotonically_increasing_id())
        stamped = conform(ordered, keep=("ingest_seq",)).withColumns(
            {"run_id": F.lit(run_id), "run_seq": F.lit(run_seq).cast("bigint")}
        )
        stamped.write.mode("append").partitionBy("run_id").parquet(self.folder("raw"))

    def raw(self, run_ids: list[str] | None = None) -> DataFrame:
        df = self.spark.read.schema(
            T.StructType([*RAW_SCHEMA.fields,
                          *[T.StructField(n, t) for n, t in RUN_COLUMNS.items()]])
        ).parquet(self.folder("raw"))
        return df.filter(F.col("run_id").isin(run_ids)) if run_ids else df

    # -- state -------------------------------------------------------------

    def published(self, version: int) -> Published | None:
        text = self._read(f"published/{version}.json")
        return Published(**json.loads(text)) if text else None

    def newest(self) -> Published | None:
        """The newest state: from the one last noted on, as far as there are any."""
        noted = self._read("published/noted")
        found, at = None, int(noted) if noted else 0
        while (later := self.published(at)) is not None:
            found, at = later, at + 1
        return found

    def latest_version(self) -> int | None:
        head = self.newest()
        return head.version if head else None

    def empty_state(self) -> DataFrame:
        return self.spark.createDataFrame([], _STATE_SCHEMA)

    def rows(self, state: Published | None, touched: list[int] | None = None) -> DataFrame:
        """Rows of a published state with what the store keeps; only some buckets."""
        folders = state.folders if state else {}
        paths = [f"{self.folder(place)}/bucket={bucket}" for bucket, place in sorted(folders.items())
                 if touched is None or int(bucket) in touched]
        if not paths:
            return self.spark.createDataFrame([], _STORED_SCHEMA)
        return self.spark.read.schema(_STORED_SCHEMA).parquet(*paths)

    def state(self, version: int | None = None) -> DataFrame:
        """The state as of a version, the newest one by default."""
        chosen = self.newest() if version is None else self.published(version)
        return self.rows(chosen).select(*STATE_COLUMNS)

    def bucket_of(self) -> F.Column:
        return F.pmod(F.xxhash64("fingerprint"), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys: at most as many numbers as there are buckets."""
        return sorted(r.b for r in keys.select(self.bucket_of().alias("b")).distinct().collect())

    def _groups(self, state: Published | None, touched: list[int]) -> list[list[int]]:
        """Some buckets in groups of some `_AT_ONCE` bytes of a published state."""
        groups, held = [[]], 0
        for bucket in touched:
            place = state.folders.get(str(bucket)) if state else None
            if place:
                system, written = self._file(f"{place}/bucket={bucket}")
                held += system.getContentSummary(written).getLength()
            groups[-1].append(bucket)
            if held >= _AT_ONCE:
                groups.append([])
                held = 0
        return [g for g in groups if g]

    def _commit(
        self, run: str, touched: list[int], change: Callable[[DataFrame, int], DataFrame],
        mark: tuple[str, int] | None, counters: Callable[[DataFrame], dict[str, int]],
    ) -> dict[str, int]:
        """Rewrite the touched buckets and publish. When another run publishes first,
        this one starts again from what that one published. The same run once more in
        a row replaces itself; a batch that a stream has published is left alone."""
        while True:
            head = self.newest()
            done = head.marks.get(mark[0]) if head and mark else None
            if done and done["batch"] >= mark[1]:
                return done["counters"]
            base = head
            if head and head.run == run:
                base = None if head.before is None else self.published(head.before)
            version = head.version + 1 if head else 0
            old = self.rows(base, touched)
            counted = counters(old)
            place = f"state/{uuid.uuid4().hex}"
            # What is shuffled for some buckets goes before that of the next.
            for group in self._groups(base, touched):
                changed = change(self.rows(base, group), version).withColumn("bucket", self.bucket_of())
                # A file for each bucket: as many as the tasks that read it would make more of them each run.
                ordered = changed.filter(F.col("bucket").isin(group)).repartition("bucket").sortWithinPartitions(
                    "bucket", "fingerprint")
                with tidy(ordered.sparkSession):
                    keyed(ordered.write).option("compression", "zstd").mode("append").partitionBy("bucket").parquet(
                        self.folder(place))
            folders = dict(base.folders) if base else {}
            for bucket in touched:
                system, written = self._file(f"{place}/bucket={bucket}")
                if system.exists(written):
                    folders[str(bucket)] = place
                else:  # nothing is left in it
                    folders.pop(str(bucket), None)
            marks = dict(head.marks) if head else {}
            if mark:
                marks[mark[0]] = {"batch": mark[1], "counters": counted}
            entry = Published(version, run, base.version if base else None, folders, marks)
            if self._write(f"published/{version}.json", json.dumps(asdict(entry)), overwrite=False):
                self._write("published/noted", str(version), overwrite=True)
                return counted

    def upsert(
        self, batch: DataFrame, run: str, mark: tuple[str, int] | None = None, spent: Callable[[], None] = lambda: None
    ) -> dict[str, int]:
        """Write a folded batch over the state. The rows of the touched buckets are dealt
        by bucket, one file for each. `mark` names a stream and its batch; `spent` is called
        when `batch` is not read any more. Returns how many postings were new and updated."""
        sized = batch.select(*STATE_COLUMNS).withColumn("doc_tokens", token_count(batch))
        path = scratch_path(sized.sparkSession, "batch")
        with tidy(sized.sparkSession):
            written = materialise(sized, "batch", path)
        spent()

        def change(old: DataFrame, version: int) -> DataFrame:
            changes = written.withColumn("version", F.lit(version).cast("bigint")).select(*_STORED_SCHEMA.names)
            return overlay_changes(old, changes)

        def counters(old: DataFrame) -> dict[str, int]:
            total = written.count()
            updated = written.select("fingerprint").join(old.select("fingerprint"), "fingerprint", "left_semi").count()
            return {"new": total - updated, "updated": updated}

        told = self._commit(run, self._touched(written), change, mark, counters)
        remove_folder(self.spark, path)
        return told

    def remove(self, fingerprints: DataFrame, run: str) -> None:
        """Take postings out of the state, and so out of every index brought up to it."""
        gone = materialise(fingerprints.select("fingerprint").distinct(), "gone")
        at: list[int] = []

        def change(old: DataFrame, version: int) -> DataFrame:
            at.append(version)
            return old.join(gone, "fingerprint", "left_anti")

        self._commit(run, self._touched(gone), change, None, lambda old: {})
        stamped = gone.withColumn("version", F.lit(at[-1]).cast("bigint"))
        stamped.write.mode("append").parquet(self.folder("removed"))

    # -- index -------------------------------------------------------------

    def write_index(self, version: int | None = None) -> int:
        """Index a published state in full; `index` keeps it current."""
        chosen = self.latest_version() if version is None else version
        write_index(self.state(chosen), self.folder(f"index/version={chosen}"))
        return chosen

    def index(self, built: int, version: int | None = None) -> Index:
        """The index built for version `built`, brought to `version` (the newest by
        default): only the texts of postings written since are read, and the figures
        of the corpus come from the lengths that the state keeps."""
        index = read_index(self.spark, self.folder(f"index/version={built}"))
        chosen = self.published(self.latest_version() if version is None else version)
        rows = self.rows(chosen)
        changed = rows.filter(F.col("version") > built)
        figures = rows.agg(F.count("*").alias("n"), F.sum("doc_tokens").alias("tokens")).first()
        system, place = self._file("removed")
        gone = None
        if system.exists(place):
            gone = self.spark.read.schema(_GONE).parquet(self.folder("removed")).filter(
                F.col("version").between(built + 1, chosen.version)).select("fingerprint").distinct()
        return refresh_index(index, changed.select(*STATE_COLUMNS), Corpus(figures.n, figures.tokens or 0), gone)

    # -- metrics -----------------------------------------------------------

    def add_metrics(self, run_id: str, counters: dict[str, int]) -> None:
        """Counters of a run; those of a run that is repeated are replaced."""
        rows = [(run_id, name, int(n)) for name, n in sorted(counters.items())]
        df = self.spark.createDataFrame(rows, METRICS).coalesce(1)
        (
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id").json(self.folder("run_metrics"))
        )

    def metrics(self) -> DataFrame:
        return self.spark.read.schema(METRICS).json(self.folder("run_metrics"))

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(self.folder("rejects"))
