"""Ranked full-text search over postings.

Two ways lead to the same result. `search` reads the texts of a state table
once and needs no index. `search_index` reads only the index rows of the query's
terms (see `index.py`). Both first write the narrow hits (key, length, hit
weights) and take the corpus-wide figures from that same pass; a handful of
numbers reach the driver, never documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import once, tokens
from ..session import materialise, scratch_path
from .filters import condition, seen_day
from .query import Box, Phrase

# Indexed columns in order and the weight of a hit in each.
FIELD_WEIGHTS = {
    "title": 10.0, "company": 3.0, "city": 4.0, "description": 1.0, "keywords": 6.0, "skills": 8.0,
}
# Fixed values of the BM25 ranking function.
_K1, _B = 1.2, 0.75
_LEAST_IDF = 1e-6


@dataclass(frozen=True)
class Corpus:
    """Size of the whole searched table, filters or not."""

    documents: int
    tokens: int


def field_text(df: DataFrame, name: str) -> Column:
    """Text of an indexed column; a list is its entries in order, a missing
    column is empty."""
    if name not in df.columns:
        return F.lit("")
    if df.schema[name].dataType.typeName() == "array":
        return F.array_join(F.col(name), " ")
    return F.col(name)


def with_tokens(df: DataFrame, *keep: str) -> DataFrame:
    """`fingerprint`, kept columns, `t`: one token array per indexed field in the
    order of `FIELD_WEIGHTS`, and their total length `doc_tokens`."""
    texts = F.array(*[field_text(df, f) for f in FIELD_WEIGHTS])
    read = once(df, "t", F.transform(texts, tokens)).select("fingerprint", *keep, "t")
    return read.withColumn("doc_tokens", F.size(F.flatten("t")))


def token_count(df: DataFrame) -> Column:
    """Tokens of all indexed fields of a posting."""
    texts = F.array(*[field_text(df, f) for f in FIELD_WEIGHTS])
    return F.size(F.flatten(F.transform(texts, tokens)))


def matches(term: Column, phrase: Phrase, place: int) -> Column:
    """Whether a term fits the phrase's term at `place`."""
    wanted = phrase.terms[place]
    if phrase.prefix and place == len(phrase.terms) - 1:
        return term.startswith(wanted)
    return term == wanted


def field_weights() -> Column:
    return F.array(*[F.lit(w) for w in FIELD_WEIGHTS.values()])


def _occurrences(field: Column, phrase: Phrase) -> Column:
    """How often a phrase starts in a token array."""

    def starts(term: Column, i: Column) -> Column:
        tests = [matches(term, phrase, 0)] + [
            F.coalesce(matches(F.get(field, i + k), phrase, k), F.lit(False))
            for k in range(1, len(phrase.terms))
        ]
        return reduce(lambda a, b: a & b, tests)

    return F.size(F.filter(field, starts))


def weighted_hits(fields: Column, phrase: Phrase) -> Column:
    """Hits of a phrase in all fields, each times the weight of its field."""
    per_field = F.zip_with(fields, field_weights(), lambda f, w: _occurrences(f, phrase) * w)
    return F.aggregate(per_field, F.lit(0.0), lambda a, x: a + x)


def hit_names(box: Box) -> list[str]:
    return [f"hit_{i}" for i in range(len(box.phrases))]


def idf_of(corpus: Corpus, n: int) -> float:
    """Worth of a phrase that `n` documents have."""
    return max(math.log((corpus.documents - n + 0.5) / (n + 0.5)), _LEAST_IDF)


def scored(hits: DataFrame, box: Box, corpus: Corpus, found: list[int], key: str = "fingerprint") -> DataFrame:
    """`key` and `rank` (lower is better) of matching documents."""
    names = hit_names(box)
    _, counting = box.evaluate([F.col(n) for n in names])
    average = corpus.tokens / corpus.documents if corpus.documents else 1.0
    norm = F.lit(_K1) * (F.lit(1 - _B) + F.lit(_B) * F.col("doc_tokens") / F.lit(average))
    score = F.lit(0.0)
    for name, counts, n in zip(names, counting, found, strict=True):
        part = F.lit(idf_of(corpus, n)) * (F.col(name) * F.lit(_K1 + 1)) / (F.col(name) + norm)
        score = score + F.when(counts, part).otherwise(0.0)
    return hits.select(key, (-score).alias("rank"))


def measured(hits: DataFrame, box: Box, keep: Column, label: str, *extra: Column, key: str = "fingerprint"):
    """Write the matching hits once; count per phrase over all of them on the way.

    The counters ride on the writing stage itself, which is a result stage, so a
    retried task is counted once.
    """
    names = hit_names(box)
    observation = Observation()
    watched = hits.observe(
        observation, *[F.count_if(F.col(n) > 0).alias(n) for n in names], *extra
    )
    matched, _ = box.evaluate([F.col(n) for n in names])
    spark = hits.sparkSession
    path = scratch_path(spark, label)
    kept = watched.filter(matched & keep).select(key, "doc_tokens", *names)
    kept.write.parquet(path)
    figures = observation.get
    return spark.read.schema(kept.schema).parquet(path), figures


def rank_texts(state: DataFrame, box: Box, **filters) -> DataFrame:
    """`fingerprint` and `rank` of matching postings, straight from their texts."""
    names = hit_names(box)
    if not box.can_match:
        return state.limit(0).select("fingerprint", F.lit(None).cast("double").alias("rank"))
    # The filter is decided beside the texts; corpus figures see every row.
    judged = state.withColumn("_kept", F.coalesce(condition(**filters), F.lit(False)))
    tokenised = with_tokens(judged, "_kept")
    hits = tokenised.select(
        "fingerprint", "_kept", "doc_tokens",
        *[weighted_hits(F.col("t"), p).alias(n) for p, n in zip(box.phrases, names, strict=True)],
    )
    written, figures = measured(
        hits, box, F.col("_kept"), "hits",
        F.count("*").alias("documents"), F.sum("doc_tokens").alias("tokens"),
    )
    corpus = Corpus(figures["documents"], figures["tokens"] or 0)
    return scored(written, box, corpus, [figures[n] for n in names])


def page_of(state: DataFrame, ranked: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """The wanted results with all columns of the state, best first. The keys of a page
    come to the driver, at most `limit` of them, and are asked of the state by value,
    so that files and row groups without them are skipped; `limit=None` joins all."""
    if limit is None:
        wanted = skip(ranked, offset, "rank", "fingerprint") if offset else ranked
        rows = state
    else:
        page = ranked.orderBy("rank", "fingerprint").offset(offset).limit(limit).collect()
        wanted = F.broadcast(state.sparkSession.createDataFrame(page, ranked.schema))
        rows = state.filter(F.col("fingerprint").isin([r.fingerprint for r in page]))
    return rows.join(wanted, "fingerprint").select(*state.columns, "rank").orderBy("rank", "fingerprint")


def skip(keys: DataFrame, offset: int, *order: Column | str) -> DataFrame:
    """Narrow rows without the first `offset` in an order. They are sorted over all
    tasks and written; the sizes of the sorted parts tell where to begin."""
    placed = keys.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    written = materialise(placed, "sorted")
    part = F.shiftright("_place", 33).alias("part")
    sizes = sorted((r.part, r.n) for r in written.groupBy(part).agg(F.count("*").alias("n")).collect())
    begin = None
    for number, size in sizes:
        if offset < size:
            begin = (number << 33) + offset
            break
        offset -= size
    left = written.filter(F.lit(False)) if begin is None else written.filter(F.col("_place") >= begin)
    return left.drop("_place")


def browse(state: DataFrame, limit: int | None, offset: int, **filters) -> DataFrame:
    """Without a query: newest first, `rank` NULL."""
    newest = (seen_day().desc_nulls_last(), F.col("fingerprint"))
    rows = state.filter(condition(**filters))
    if offset and limit is None:
        keys = rows.select("fingerprint", seen_day().alias("_day"))
        later = skip(keys, offset, F.col("_day").desc_nulls_last(), "fingerprint")
        rows = rows.join(later.select("fingerprint"), "fingerprint", "left_semi").select(*state.columns)
    rows = rows.withColumn("rank", F.lit(None).cast("double")).orderBy(*newest)
    return rows if limit is None else rows.offset(offset).limit(limit)


def search(
    state: DataFrame, query: str | None = None, *, limit: int | None = 20, offset: int = 0, **filters
) -> DataFrame:
    """Postings matching the query and the filters, best first, with `rank`."""
    box = Box.read(query)
    if box is None:
        return browse(state, limit, offset, **filters)
    return page_of(state, rank_texts(state, box, **filters), limit, offset)


def count(state: DataFrame, query: str | None = None, **filters) -> DataFrame:
    """One row: how many postings `search` would find."""
    kept = state.filter(condition(**filters))
    box = Box.read(query)
    if box is not None:
        tokenised = with_tokens(kept)
        hits = [weighted_hits(F.col("t"), p) for p in box.phrases]
        kept = tokenised.filter(box.evaluate(hits)[0])
    return kept.agg(F.count("*").alias("n"))


def get(state: DataFrame, fingerprint: str) -> DataFrame:
    """One posting by its key."""
    return state.filter(F.col("fingerprint") == fingerprint)


#: Keys that are asked of a table by value, so that row groups without them are skipped.
_BY_VALUE = 500


def get_many(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The postings of some keys (fingerprint): a few are asked by value, more are joined."""
    wanted = keys.select("fingerprint").filter("fingerprint is not null").distinct()
    few = wanted.limit(_BY_VALUE + 1).collect()
    if len(few) <= _BY_VALUE:
        return state.filter(F.col("fingerprint").isin([r.fingerprint for r in few]))
    return state.join(wanted, "fingerprint", "left_semi").select(*state.columns)
