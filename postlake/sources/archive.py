"""Posting archives as JSON lines: read back and append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import POSTING_FIELDS, POSTING_SCHEMA

BAD_LINE = "_bad_line"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every archived posting, with `source` and `run_id` of its folder; lines
    that are not JSON keep their text in `_bad_line` and are otherwise NULL."""
    fields = [f for f in POSTING_SCHEMA.fields if f.name != "source"]
    schema = T.StructType(
        [*fields, T.StructField(BAD_LINE, T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("run_id", T.StringType())]
    )
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", BAD_LINE).json(path)
    return df.select(*POSTING_FIELDS, "run_id", BAD_LINE)


def append_archive(postings: DataFrame, path: str) -> None:
    """One set of JSON lines per source and run; a run that is repeated replaces its
    own set, no other is touched. NULLs are kept as keys."""
    (
        postings.select(*POSTING_FIELDS, "run_id")
        .withColumn("source", F.coalesce("source", F.lit("")))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "run_id")
        .option("ignoreNullFields", "false")
        .option("compression", "gzip")
        .json(path)
    )
