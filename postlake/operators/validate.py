"""Keep usable postings; give every other one a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REQUIRED_FIELDS

INCOMPLETE, BAD_URL, DUPLICATE = "incomplete", "bad_url", "duplicate"


def judge(df: DataFrame) -> DataFrame:
    """Add `reject_reason` (NULL for a valid posting) and `missing_fields`."""
    missing = F.array_compact(
        F.array(
            *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED_FIELDS]
        )
    )
    return df.withColumn("missing_fields", missing).withColumn(
        "reject_reason",
        F.when(F.size("missing_fields") > 0, F.lit(INCOMPLETE)).when(
            ~F.col("url").rlike("^https?://"), F.lit(BAD_URL)
        ),
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reject_reason").isNull()).drop("reject_reason", "missing_fields")


def rejects(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reject_reason").isNotNull())


def reject_counts(judged: DataFrame) -> DataFrame:
    """Counter per outcome: `valid` or the reason."""
    outcome = F.coalesce("reject_reason", F.lit("valid"))
    return judged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
