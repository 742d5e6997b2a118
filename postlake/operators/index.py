"""A stored full-text index, for searching the same state many times.

One row per token: (term, fingerprint, field, pos), with the posting's length
riding along so that scoring needs no second table. The index is written in
segments: each task sorts the tokens of its own postings by term and writes them,
so a term found in a third of all postings is spread like the postings are. A segment
is of bounded texts, since a token as a row is many times as large as in its text: where
the state's own parts are larger, its texts are dealt out first. A reader of a few terms skips all other
pages of every segment by the sorted term's statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import condition
from .query import Box, Phrase
from .search import (
    FIELD_WEIGHTS, Corpus, browse, field_text, field_weights, hit_names, matches, measured, page_of, scored, with_tokens,
)

# Small row groups: a look-up reads one or two of them per segment.
_ROW_GROUP = 16 << 20
# Text of a segment, whose tokens (some hundred bytes each) are sorted in memory.
_SEGMENT = 8 << 20

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("doc_tokens", T.IntegerType()),
        T.StructField("field", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Index:
    """Index rows and the corpus they describe."""

    rows: DataFrame
    corpus: Corpus


def index_rows(state: DataFrame) -> DataFrame:
    """One row per token of every posting, without a shuffle."""
    placed = F.transform(
        "t",
        lambda words, field: F.transform(
            words,
            lambda word, pos: F.struct(word.alias("term"), field.alias("field"), pos.alias("pos")),
        ),
    )
    one_per_token = with_tokens(state).select(
        "fingerprint", "doc_tokens", F.inline(F.flatten(placed))
    )
    return one_per_token.select(*INDEX_SCHEMA.names)


def in_parts(state: DataFrame, size: int) -> DataFrame:
    """A state in parts of some `size` bytes of indexed text: as it is, if they are that
    small, else dealt by key."""
    texts = F.concat_ws(" ", *[field_text(state, f) for f in FIELD_WEIGHTS])
    each = state.select(F.octet_length(texts).alias("n")).groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum("n").alias("n"))
    figures = each.agg(F.max("n").alias("most"), F.sum("n").alias("whole")).first()
    if (figures.most or 0) <= 2 * size:
        return state
    used = [c for c in ("fingerprint", *FIELD_WEIGHTS) if c in state.columns]
    return state.select(*used).repartition(-(-figures.whole // size), "fingerprint")


def write_index(state: DataFrame, path: str, segment: int = _SEGMENT) -> None:
    """Write the index of a state and its corpus figures below `path`, in segments of
    some `segment` bytes of text."""
    (
        index_rows(in_parts(state, segment)).sortWithinPartitions("term", "fingerprint", "field", "pos")
        .write.mode("overwrite").option("parquet.block.size", _ROW_GROUP).parquet(f"{path}/terms")
    )
    # The texts are not read again: every token is a row.
    tokens = state.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{path}/terms").count()
    figures = state.agg(
        F.count("*").alias("documents"), F.lit(tokens).cast("bigint").alias("tokens")
    )
    figures.write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> Index:
    figures = spark.read.parquet(f"{path}/corpus").first()
    rows = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/terms")
    return Index(rows, Corpus(figures["documents"], figures["tokens"]))


def corpus_of(state: DataFrame) -> Corpus:
    """Postings and tokens of a state, from its texts."""
    figures = with_tokens(state).agg(
        F.count("*").alias("documents"), F.sum("doc_tokens").alias("tokens")
    ).first()
    return Corpus(figures["documents"], figures["tokens"] or 0)


def refresh_index(
    index: Index, changed: DataFrame, now: Corpus, removed: DataFrame | None = None
) -> Index:
    """The index after postings changed or went away: their rows are replaced.
    `now` is the corpus afterwards. Old segments stay as they are; the rows of
    changed postings are left out of the few rows a search reads from them."""
    gone = changed.select("fingerprint")
    if removed is not None:
        gone = gone.unionByName(removed.select("fingerprint"))
    kept = index.rows.join(gone, "fingerprint", "left_anti").select(*INDEX_SCHEMA.names)
    return Index(kept.unionByName(index_rows(changed)), now)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _phrase_hits(entries: Column, phrase: Phrase) -> Column:
    """Weighted starts of a several-term phrase among the entries of one posting."""

    def starts(field: Column) -> Column:
        def places(k: int) -> Column:
            mine = F.filter(
                entries, lambda e: (e["field"] == field) & matches(e["term"], phrase, k)
            )
            return F.transform(mine, lambda e: e["pos"] - k)

        return F.size(reduce(F.array_intersect, [places(k) for k in range(len(phrase.terms))]))

    weighted = F.transform(field_weights(), lambda w, field: starts(field) * w)
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def index_hits(index: Index, box: Box) -> DataFrame:
    """Per posting with any query term: length and weighted hits of each phrase."""
    term = F.col("term")
    every = [(p, k) for p in box.phrases for k in range(len(p.terms))]
    wanted = index.rows.filter(_any([matches(term, p, k) for p, k in every]))
    weight = F.get(field_weights(), F.col("field"))
    sums, made = [], []
    for phrase, name in zip(box.phrases, hit_names(box), strict=True):
        if len(phrase.terms) == 1:
            mine = F.when(matches(term, phrase, 0), weight).otherwise(0.0)
            sums.append(F.sum(mine).alias(name))
            made.append(F.col(name))
        else:
            made.append(_phrase_hits(F.col("_entries"), phrase).alias(name))
    long = [(p, k) for p, k in every if len(p.terms) > 1]
    if long:
        # One posting's tokens among the query's terms: bounded by its own text.
        needed = _any([matches(term, p, k) for p, k in long])
        entry = F.when(needed, F.struct("field", "term", "pos"))
        sums.append(F.collect_list(entry).alias("_entries"))
    grouped = wanted.groupBy("fingerprint").agg(F.max("doc_tokens").alias("doc_tokens"), *sums)
    return grouped.select("fingerprint", "doc_tokens", *made)


def search_index(
    index: Index, state: DataFrame, query: str | None = None, *,
    limit: int | None = 20, offset: int = 0, **filters,
) -> DataFrame:
    """`search` answered from a stored index of `state`."""
    box = Box.read(query)
    if box is None:
        return browse(state, limit, offset, **filters)
    if not box.can_match:
        return state.limit(0).withColumn("rank", F.lit(None).cast("double"))
    written, figures = measured(index_hits(index, box), box, F.lit(True), "index-hits")
    ranked = scored(written, box, index.corpus, [figures[n] for n in hit_names(box)])
    if any(v not in (None, "", []) for v in filters.values()):
        kept = state.filter(condition(**filters)).select("fingerprint")
        ranked = ranked.join(kept, "fingerprint", "left_semi")
    return page_of(state, ranked, limit, offset)
