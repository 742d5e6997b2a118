"""Helpers shared by the operators: Arrow batches in tasks, slices, hashes of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Batches = Iterable[pa.RecordBatch]

#: Rows of a batch that are held as Python objects at one time.
SLICE = 128
#: Characters of them, so that very long texts are taken a few at a time.
SLICE_CHARS = 1 << 21


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_arrow(df: DataFrame, work: Callable[[Batches], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """Run `work` over the Arrow batches of each partition; it yields columns by name."""
    spec = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(spec)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([_typed(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spec)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def slices(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of few rows and few characters of column `text`."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
        start = held = 0
        for at, size in enumerate(sizes):
            if at > start and (at - start >= SLICE or held + size > SLICE_CHARS):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


_KEPT: dict = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What `make` gives, made once by each Python worker and used by its next tasks too.
    A worker keeps one thing of a kind: the first part of `key` names the kind."""
    kind, which = key
    if kind not in _KEPT or _KEPT[kind][0] != which:
        _KEPT.pop(kind, None)
        _KEPT[kind] = which, make()
    return _KEPT[kind][1]


def whole_rows(df: DataFrame, name: str):
    """All columns, whatever their names, as one struct `name`."""
    quoted = (f"`{c.replace('`', '``')}`" for c in df.columns)
    return F.struct(*map(F.col, quoted)).alias(name)


class WordHashes(dict):
    """64-bit hash of a word, kept per worker; emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self._most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
