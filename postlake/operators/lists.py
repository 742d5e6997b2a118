"""A full-text index of posting lists.

Three tables below one path:

* `forward`: a row for each posting with its long number, key, length and terms, each
  with the places it stands at (field and position in one long number). Written as the
  texts are read, without a shuffle. Tokens are grouped over Arrow batches, some half a
  million at a time, since functions of arrays take several times as long.
* `lists`: a row for each term and block of posting numbers, with the entries of that
  block; beside them the most weighted hits and the least length of an entry, by which a
  block can be passed over without opening its entries. In folders by hash of the term; a
  task that read a part of `forward` writes a file of its own to each, sorted by term, and
  goes on in a further file after some `split` entries. The postings of a block lie in one
  part, so entries are not shuffled; one that is cut by the row groups of a large file of
  `forward` has a row for each of its parts. `pairs` holds lists of the same kind for two
  words that follow each other and are both in a share `common` of all postings, so that a
  phrase of frequent words reads the postings of the pair and not those of both words.
  There are at most (distinct terms of a posting) / `common` such words.
* `dictionary`: the terms with the number of postings that have them.

A look-up names the folders of its terms, so no other is listed or opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import keyed, materialise, setting
from .filters import condition
from .query import Box, Phrase
from .search import (
    _B, _K1, FIELD_WEIGHTS, Corpus, browse, field_weights, hit_names, idf_of, measured, scored, with_tokens,
)

Batches = Iterable[pa.RecordBatch]

_FORWARD = "number bigint, fingerprint string, doc_tokens int, entries array<struct<term:string,places:array<bigint>>>"
_MADE = (
    "term string, block bigint, n bigint, most double, shortest int,"
    " entries array<struct<number:bigint,doc_tokens:int,places:array<bigint>>>"
)
_LISTED = f"folder int, {_MADE}"
#: Tokens or entries that a task works on at one time.
_HELD = 500_000
#: Postings of an Arrow batch, which lies in memory on both sides.
_ROWS = 1_000
#: Bits of a place that hold the position in its field.
_POSITION = 32


@dataclass(frozen=True)
class Lists:
    """A stored index and the corpus it describes."""

    spark: SparkSession
    path: str
    corpus: Corpus
    folders: int

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def forward(self) -> DataFrame:
        return self._read("forward")

    @property
    def dictionary(self) -> DataFrame:
        return self._read("dictionary")

    def listed(self, table: str = "lists") -> DataFrame:
        return self.spark.read.schema(_LISTED).parquet(f"{self.path}/{table}")

    def rows(self, terms: list[str], table: str = "lists") -> DataFrame:
        """Rows of some terms; only their folders are opened."""
        folders = [_folder(F.lit(t), self.folders) for t in terms]
        return self.listed(table).filter(F.col("folder").isin(*folders) & F.col("term").isin(terms))

    def starting(self, prefix: str) -> DataFrame:
        """Rows of all terms that begin with `prefix`, which the dictionary names."""
        named = self.dictionary.filter(F.col("term").startswith(prefix)).select("folder", "term")
        return self.listed().join(named, ["folder", "term"], "left_semi")


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def _by_arrow(df: DataFrame, work: Callable[[Batches], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """Run `work` over the Arrow batches of each task; it yields columns in the order of `schema`."""
    spec = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(spec)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, spec)


def _few_rows(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(key))
    return setting(spark, key, str(min(given, _ROWS) if given > 0 else _ROWS))


def _cut(sizes: np.ndarray, most: int) -> list[int]:
    """Bounds of runs of neighbours of some `most` in all."""
    steps = np.cumsum(sizes) // most
    return [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(sizes)] if len(sizes) else [0]


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each thing in lists of some sizes its list and its place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _coded(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of some terms in the order of terms, and the terms by number."""
    told = terms.dictionary_encode()
    order = pc.sort_indices(told.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[told.indices.to_numpy()], told.dictionary.take(pa.array(order))


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _lists(begins: np.ndarray, values: pa.Array) -> pa.Array:
    """The values as lists that begin at some places."""
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype(np.int32)), values)


def _forward(batches: Batches) -> Iterator[list[pa.Array]]:
    """Rows of `forward`: the distinct terms of a posting's token arrays with their places."""
    for batch in batches:
        bounds = _cut(batch.column("doc_tokens").to_numpy(zero_copy_only=False), _HELD)
        for start, end in pairwise(bounds):
            part = batch.slice(start, end - start)
            fields = part.column("t").flatten()
            posting, field = _spread(part.column("t").value_lengths().to_numpy(zero_copy_only=False))
            owner, pos = _spread(fields.value_lengths().to_numpy(zero_copy_only=False))
            code, terms = _coded(fields.flatten())
            posting, place = posting[owner], (field[owner] << _POSITION) + pos
            # Tokens come by posting, field and position, which a stable sort keeps.
            order = np.argsort(posting * max(len(terms), 1) + code, kind="stable")
            begins = _begins(posting[order], code[order])
            first = order[begins]
            entries = pa.StructArray.from_arrays(
                [terms.take(pa.array(code[first])), _lists(begins, pa.array(place[order]))], ["term", "places"])
            of = np.searchsorted(posting[first], np.arange(len(part)))
            yield [part.column("number"), part.column("fingerprint"), part.column("doc_tokens"), _lists(of, entries)]


def _by_block(batches: Batches, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Whole blocks of postings, some `_HELD` entries at a time: their numbers and lengths,
    and of each entry its posting, term and places."""
    held: list[pa.RecordBatch] = []

    def told(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        entries = table.column("entries").combine_chunks()
        posting, _ = _spread(entries.value_lengths().to_numpy(zero_copy_only=False))
        term, places = entries.flatten().flatten()
        return table.column("number").to_numpy(), table.column("doc_tokens").to_numpy(), posting, term, places

    waiting = 0
    for batch in batches:
        block = batch.column("number").to_numpy() >> bits
        sizes = pc.list_value_length(batch.column("entries")).to_numpy(zero_copy_only=False)
        starts = _begins(block) if len(block) else []
        for start, end in pairwise([*starts, len(block)]):
            part = batch.slice(start, end - start)
            same = held and held[-1].column("number")[len(held[-1]) - 1].as_py() >> bits == block[start]
            if held and not same and waiting >= _HELD:
                yield told(held)
                held, waiting = [], 0
            held.append(part)
            waiting += int(sizes[start:end].sum())
    if held:
        yield told(held)


def _listed(bits: int, number: np.ndarray, length: np.ndarray, posting: np.ndarray, term: pa.Array, places: pa.Array):
    """Rows of a table of lists from entries that come by block and posting."""
    code, terms = _coded(term)
    order = np.argsort(code, kind="stable")
    posting = posting[order]
    begins = _begins(code[order], number[posting] >> bits)
    places = places.take(pa.array(order))
    weights = np.array(list(FIELD_WEIGHTS.values()))[places.flatten().to_numpy() >> _POSITION]
    sizes = places.value_lengths().to_numpy(zero_copy_only=False)
    weight = np.add.reduceat(weights, np.cumsum(sizes) - sizes)
    entries = pa.StructArray.from_arrays(
        [pa.array(number[posting]), pa.array(length[posting]), places], ["number", "doc_tokens", "places"])
    return [terms.take(pa.array(code[order][begins])), pa.array(number[posting[begins]] >> bits),
            pa.array(np.diff(np.append(begins, len(posting)))), pa.array(np.maximum.reduceat(weight, begins)),
            pa.array(np.minimum.reduceat(length[posting], begins)), _lists(begins, entries)]


def _term_rows(bits: int) -> Callable[[Batches], Iterator[list[pa.Array]]]:
    def work(batches: Batches) -> Iterator[list[pa.Array]]:
        for number, length, posting, term, places in _by_block(batches, bits):
            if len(posting):
                yield _listed(bits, number, length, posting, term, places)

    return work


def _pair_rows(bits: int, words: list[str]) -> Callable[[Batches], Iterator[list[pa.Array]]]:
    """As `_term_rows`, of two of some words that follow each other, with the places of the first."""

    def work(batches: Batches) -> Iterator[list[pa.Array]]:
        known = pa.array(words, pa.string())
        for number, length, posting, term, places in _by_block(batches, bits):
            word = pc.index_in(term.cast(pa.string()), known)
            mine = pc.is_valid(word)
            word, posting, places = word.filter(mine).to_numpy(), posting[mine.to_numpy(zero_copy_only=False)], places.filter(mine)
            entry, _ = _spread(places.value_lengths().to_numpy(zero_copy_only=False))
            word, posting, place = word[entry], posting[entry], places.flatten().to_numpy()
            order = np.lexsort((place, posting))
            word, posting, place = word[order], posting[order], place[order]
            first = np.flatnonzero((posting[1:] == posting[:-1]) & (place[1:] == place[:-1] + 1))
            pair, posting, place = word[first].astype(np.int64) * len(words) + word[first + 1], posting[first], place[first]
            if not len(pair):
                continue
            order = np.lexsort((place, pair, posting))
            begins = _begins(posting[order], pair[order])
            entries = order[begins]
            kinds, code = np.unique(pair[entries], return_inverse=True)
            names = pa.array([f"{words[p // len(words)]} {words[p % len(words)]}" for p in kinds.tolist()], pa.string())
            yield _listed(bits, number, length, posting[entries], names.take(pa.array(code)),
                          _lists(begins, pa.array(place[order])))

    return work


def _weight(places: Column) -> Column:
    """Hits at some places, each times the weight of its field."""
    return F.aggregate(
        places, F.lit(0.0), lambda a, p: a + F.get(field_weights(), F.shiftright(p, _POSITION).cast("int")))


def _write(forward: DataFrame, work: Callable[[Batches], Iterator[list[pa.Array]]], folders: int, rows: int, path: str) -> None:
    """Rows that `work` makes of postings, in folders by term and files of some `rows` rows. A
    block lies in one file of `forward`, so no entry is shuffled."""
    made = _by_arrow(forward.select("number", "doc_tokens", "entries"), work, _MADE)
    ordered = made.withColumn("folder", _folder(F.col("term"), folders)).sortWithinPartitions("folder", "term", "block")
    with _few_rows(forward.sparkSession):
        _packed(ordered.write).option("maxRecordsPerFile", rows).mode("overwrite").partitionBy("folder").parquet(path)


def _packed(writer):
    """A Parquet writer whose dictionaries hold the terms and places of a row group."""
    return writer.option("compression", "zstd").option("parquet.dictionary.page.size", 8 << 20)


def write_lists(
    state: DataFrame, path: str, *, folders: int = 64, bits: int = 8, split: int = 1_000_000, common: float = 0.1
) -> Lists:
    """Index a state below `path`. Blocks are of 2 ** `bits` postings at most."""
    spark = state.sparkSession
    numbered = with_tokens(state).select(F.monotonically_increasing_id().alias("number"), "fingerprint", "doc_tokens", "t")
    with _few_rows(spark):
        _packed(keyed(_by_arrow(numbered, _forward, _FORWARD).write)).mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.schema(_FORWARD).parquet(f"{path}/forward")
    figures = forward.agg(F.count("*").alias("n"), F.sum("doc_tokens").alias("tokens")).first()

    counted = forward.select(F.explode("entries.term").alias("term")).groupBy("term").agg(F.count("*").alias("postings"))
    (
        counted.withColumn("folder", _folder(F.col("term"), folders))
        .withColumn("common", F.col("postings") >= F.lit(max(2.0, common * figures.n)))
        .sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
    )
    dictionary = spark.read.parquet(f"{path}/dictionary")

    # Rows that hold `split` entries, if postings with a term lay as by chance.
    size, n = 1 << bits, max(figures.n, 1)
    met = F.lit(max(1.0, n / size)) * (1 - F.pow(1 - F.col("postings") / n, F.lit(size)))
    told = dictionary.agg(F.sum("postings").alias("entries"), F.sum(met).alias("rows")).first()
    rows = max(1, int(split * told.rows / told.entries)) if told.entries else split
    _write(forward, _term_rows(bits), folders, rows, f"{path}/lists")

    # At most (distinct terms of a posting) / `common` words; a posting's pairs come from its own entries.
    words = [r.term for r in dictionary.filter("common").select("term").collect()]
    _write(forward, _pair_rows(bits, words), folders, rows, f"{path}/pairs")
    spark.createDataFrame([(figures.n, figures.tokens or 0, folders)], "n bigint, tokens bigint, folders int").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/corpus")
    return read_lists(spark, path)


def read_lists(spark: SparkSession, path: str) -> Lists:
    figures = spark.read.parquet(f"{path}/corpus").first()
    return Lists(spark, path, Corpus(figures.n, figures.tokens), figures.folders)


@dataclass(frozen=True)
class Unit:
    """Part of a phrase that one look-up answers: a word, two common words that follow
    each other, or a beginning of words; `at` is its first word's place in the phrase."""

    phrase: int
    at: int
    term: str
    kind: str


def units(index: Lists, box: Box) -> list[Unit]:
    """What a search looks up. The driver asks the dictionary for words of phrases."""
    asked = sorted({t for p in box.phrases if len(p.terms) > 1 for t in p.terms})
    named = index.dictionary.filter(F.col("term").isin(asked) & F.col("common")).select("term") if asked else None
    common = {r.term for r in named.collect()} if asked else set()
    found = []
    for i, phrase in enumerate(box.phrases):
        exact = len(phrase.terms) - phrase.prefix
        covered = 0
        for at in range(exact):
            pair = at + 1 < exact and {phrase.terms[at], phrase.terms[at + 1]} <= common
            if pair and (covered <= at or covered == at + 1 and _last_chance(phrase, at, exact, common)):
                found.append(Unit(i, at, f"{phrase.terms[at]} {phrase.terms[at + 1]}", "pairs"))
                covered = at + 2
            elif covered <= at:
                found.append(Unit(i, at, phrase.terms[at], "lists"))
                covered = at + 1
        if phrase.prefix:
            found.append(Unit(i, exact, phrase.terms[-1], "starting"))
    return found


def _last_chance(phrase: Phrase, at: int, exact: int, common: set[str]) -> bool:
    """Whether the word after `at` is in no pair that begins with it."""
    return not (at + 2 < exact and phrase.terms[at + 2] in common)


def looked_up(index: Lists, wanted: list[Unit]) -> DataFrame:
    """unit, block, n, most, shortest, entries of every unit of a search."""
    parts = []
    for kind in ("lists", "pairs"):
        own = [(n, u) for n, u in enumerate(wanted) if u.kind == kind]
        if own:
            numbers = F.array_compact(F.array(*[F.when(F.col("term") == u.term, n) for n, u in own]))
            rows = index.rows(sorted({u.term for _, u in own}), kind)
            parts.append(rows.withColumn("unit", F.explode(numbers)))
    parts += [index.starting(u.term).withColumn("unit", F.lit(n)) for n, u in enumerate(wanted) if u.kind == "starting"]
    columns = ("unit", "block", "n", "most", "shortest", "entries")
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def list_hits(rows: DataFrame, box: Box, wanted: list[Unit]) -> DataFrame:
    """Per posting with any unit: its number, length and weighted hits of each phrase."""
    each = rows.select("unit", F.inline("entries"))
    # One posting's places of the search's units: bounded by its own text.
    found = each.groupBy("number").agg(
        F.max("doc_tokens").alias("doc_tokens"), F.collect_list(F.struct("unit", "places")).alias("found"))

    def places(number: int, unit: Unit) -> Column:
        mine = F.filter("found", lambda f: f["unit"] == number)
        return F.transform(F.flatten(F.transform(mine, lambda f: f["places"])), lambda p: p - unit.at)

    hits = []
    for i, name in enumerate(hit_names(box)):
        own = [places(n, u) for n, u in enumerate(wanted) if u.phrase == i]
        hits.append(_weight(own[0] if len(own) == 1 else reduce(F.array_intersect, own)).alias(name))
    return found.select("number", "doc_tokens", *hits)


def _named(index: Lists, state: DataFrame, ranked: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """The wanted postings with all columns of the state, best first."""
    if limit is not None:
        # The last rank that is wanted; ties of it are told apart by key.
        edge = ranked.orderBy("rank").offset(offset + limit - 1).limit(1).collect()
        ranked = ranked.filter(F.col("rank") <= edge[0]["rank"]) if edge else ranked
    keyed = ranked.join(index.forward.select("number", "fingerprint"), "number").select("fingerprint", "rank")
    ordered = keyed.orderBy("rank", "fingerprint")
    if limit is not None:
        keyed = ordered.offset(offset).limit(limit)
    elif offset:
        raise ValueError("an offset needs a limit")
    return state.join(keyed, "fingerprint").select(*state.columns, "rank").orderBy("rank", "fingerprint")


def _kept(index: Lists, state: DataFrame, ranked: DataFrame, filters: dict) -> DataFrame:
    if not any(v not in (None, "", []) for v in filters.values()):
        return ranked
    kept = state.filter(condition(**filters)).select("fingerprint")
    numbers = index.forward.select("number", "fingerprint").join(kept, "fingerprint", "left_semi")
    return ranked.join(numbers.select("number"), "number", "left_semi")


def search_lists(
    index: Lists, state: DataFrame, query: str | None = None, *, limit: int | None = 20, offset: int = 0, **filters
) -> DataFrame:
    """`search` answered from the lists of `state`."""
    box = Box.read(query)
    if box is None:
        return browse(state, limit, offset, **filters)
    if not box.can_match:
        return state.limit(0).withColumn("rank", F.lit(None).cast("double"))
    wanted = units(index, box)
    hits = list_hits(looked_up(index, wanted), box, wanted)
    written, figures = measured(hits, box, F.lit(True), "list-hits", key="number")
    ranked = scored(written, box, index.corpus, [figures[n] for n in hit_names(box)], key="number")
    return _named(index, state, _kept(index, state, ranked, filters), limit, offset)


def bounded(box: Box) -> bool:
    """Whether a block's bounds tell the best score in it: every phrase is one word."""
    return all(len(p.terms) == 1 and not p.prefix for p in box.phrases)


def block_bounds(index: Lists, box: Box, rows: DataFrame, found: list[int]) -> DataFrame:
    """block, n, bound: no posting of a block scores more than its bound, whatever words
    of the search it has."""
    average = index.corpus.tokens / index.corpus.documents if index.corpus.documents else 1.0
    norm = F.lit(_K1) * (F.lit(1 - _B) + F.lit(_B) * F.col("shortest") / F.lit(average))
    idf = F.get(F.array(*[F.lit(idf_of(index.corpus, n)) for n in found]), F.col("unit"))
    part = idf * F.col("most") * F.lit(_K1 + 1) / (F.col("most") + norm)
    return rows.withColumn("part", part).groupBy("block").agg(F.sum("part").alias("bound"), F.sum("n").alias("n"))


def top_k(index: Lists, state: DataFrame, query: str, k: int) -> tuple[DataFrame, dict[str, int]]:
    """The first `k` of `search_lists`, and how many entries were read of how many. The
    blocks of the `k` largest bounds are ranked first; then those whose bound reaches
    the score of the k-th posting found in them. Other blocks cannot hold a better one."""
    box = Box.read(query)
    if box is None or not box.can_match or not bounded(box):
        raise ValueError("bounds are kept for searches of whole words")
    wanted = units(index, box)
    asked = {u.term for u in wanted}
    postings = {r.term: r.postings for r in index.dictionary.filter(F.col("term").isin(sorted(asked))).collect()}
    found = [postings.get(u.term, 0) for u in wanted]
    rows = looked_up(index, wanted)
    bounds = materialise(block_bounds(index, box, rows, found), "bounds")

    def ranked(blocks: DataFrame) -> DataFrame:
        hits = list_hits(rows.join(blocks.select("block"), "block", "left_semi"), box, wanted)
        matched, _ = box.evaluate([F.col(n) for n in hit_names(box)])
        return scored(hits.filter(matched), box, index.corpus, found, key="number")

    first = bounds.orderBy(F.desc("bound"), "block").limit(k)
    best = ranked(first).orderBy("rank").offset(k - 1).limit(1).collect()
    # Sums in another order may differ in their last digits.
    able = bounds.filter(F.col("bound") >= -best[0]["rank"] * (1 - 1e-9)) if best else bounds
    read = able.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    every = bounds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return _named(index, state, ranked(able), k, 0), {"read": read, "all": every}
