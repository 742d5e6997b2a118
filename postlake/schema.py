"""The posting record: one fixed schema shared by every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.numbers import plain_text

_TEXT, _REAL, _WHOLE = T.StringType(), T.DoubleType(), T.IntegerType()
_WORDS = T.ArrayType(T.StringType())

# Field names, order and types of a posting.
POSTING_FIELDS = {
    "source": _TEXT, "external_id": _TEXT, "url": _TEXT, "fingerprint": _TEXT,
    "title": _TEXT, "company": _TEXT, "description": _TEXT,
    "location_raw": _TEXT, "city": _TEXT, "postal_code": _TEXT,
    "region": _TEXT, "country": _TEXT,
    "lat": _REAL, "lon": _REAL,
    "contract_type": _TEXT, "workload_min": _WHOLE, "workload_max": _WHOLE,
    "salary_min": _REAL, "salary_max": _REAL, "salary_currency": _TEXT,
    "posted_at": _TEXT, "expires_at": _TEXT, "scraped_at": _TEXT,
    "lang": _TEXT, "keywords": _WORDS, "skills": _WORDS,
    "seniority": _TEXT, "remote_policy": _TEXT,
    "languages": _WORDS, "occupations": _WORDS, "apply_url": _TEXT,
}
LIST_FIELDS = ("keywords", "skills", "languages", "occupations")
REQUIRED_FIELDS = ("source", "url", "title")
CLEAN_TEXT_FIELDS = (
    "source", "external_id", "url", "title", "company", "location_raw", "city",
    "postal_code", "region", "contract_type", "seniority", "remote_policy",
    "apply_url", "lang",
)

POSTING_SCHEMA = T.StructType(
    [T.StructField(name, dtype) for name, dtype in POSTING_FIELDS.items()]
)
# Before normalisation every non-list value is still text.
RAW_SCHEMA = T.StructType(
    [
        T.StructField(name, dtype if name in LIST_FIELDS else _TEXT)
        for name, dtype in POSTING_FIELDS.items()
    ]
)

STATE_COLUMNS = tuple(n for n in POSTING_FIELDS if n != "scraped_at") + (
    "first_seen_at",
    "last_seen_at",
)

# Stage bookkeeping that travels beside a posting: which run it belongs to, the
# order of runs, and its place in the landing order of that run.
RUN_COLUMNS = {"run_id": _TEXT, "run_seq": T.LongType(), "ingest_seq": T.LongType()}


def conform(df: DataFrame, keep: tuple[str, ...] = tuple(RUN_COLUMNS)) -> DataFrame:
    """Bring any input to the posting columns: missing ones become typed NULL,
    unknown ones are dropped, a lone string becomes a one-element list.

    `keep` names bookkeeping columns that are passed through when present.
    """
    present = {f.name: f.dataType for f in df.schema.fields}

    def column(name: str, dtype: T.DataType) -> Column:
        if name not in present:
            return F.lit(None).cast(dtype).alias(name)
        if name in LIST_FIELDS:
            value = F.col(name)
            if not isinstance(present[name], T.ArrayType):
                value = F.when(value.isNotNull(), F.array(value.cast("string")))
            return value.cast(_WORDS).alias(name)
        return plain_text(F.col(name), present[name]).alias(name)

    columns = [column(f.name, f.dataType) for f in RAW_SCHEMA.fields]
    return df.select(*columns, *[F.col(c) for c in keep if c in present])
