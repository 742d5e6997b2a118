"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    # Dates must not move with the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the expressions rely on; changes nothing else of the session."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds while eager work runs."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """Shuffle files go as soon as the eager work that wrote them is done."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors share: the one the cluster names, or for a local
    session a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="postlake-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for an intermediate table; all of a session's lie together."""
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/postlake/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this session's intermediate tables, once no result needs them."""
    remove_folder(spark, _session_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no result needs any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Bits of a Bloom filter for each value, and sizes tried, each half of the one before.
_BLOOM_BITS, _BLOOM_SIZES = 10, 14


def keyed(writer, column: str = "fingerprint", values: int = 1_000_000):
    """A Parquet writer that adds a Bloom filter of `column` to each row group, of up to
    `values` values: a look-up by key skips the groups that do not have it. A filter is
    as large as the values of its row group ask for, so small files stay small."""
    return (
        writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option(f"parquet.bloom.filter.candidates.number#{column}", str(_BLOOM_SIZES))
        .option("parquet.bloom.filter.max.bytes", str(values * _BLOOM_BITS // 8))
    )


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table:
    used where several results need the same expensive rows. `path` names its folder
    for who removes it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
