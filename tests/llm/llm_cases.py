"""Tables of awkward rows that every operator has to take."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names that operators use inside, as extra columns of their input.
CLASHING = ("key", "sig", "size", "spans", "row", "marks", "rule", "n_words", "component_id", "bad", "tokens", "my col", "x-y")
LONG = "lorem ipsum dolor " * 3_000


def docs(spark, rows, extra=CLASHING):
    """Rows (doc_id, text) with extra columns."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                         *(StructField(c, StringType()) for c in extra)])
    return spark.createDataFrame([(d, t, *("x",) * len(extra)) for d, t in rows], schema)


def awkward(spark):
    return docs(spark, [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "same text here now"), (7, "same text here now"),
        (7, "same text here now"), (8, "Ünïcödé — 東京 \U0001f600 ▁x  y\x00z"), (None, "no id here at all"), (9, "a\u2028b\xa0c"),
    ])


def empty(spark):
    return docs(spark, [])


def prose(seed, words, vocabulary=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(words)]
