"""The index of posting lists: size, folders that a look-up opens, blocks passed over."""

import pathlib

import pytest

from postlake.operators import index, lists, search
from postlake.operators.query import Box
from postlake.plans import corpus
from postlake.plans.queries import TOP
from postlake.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def state(spark):
    return corpus.postings(spark, FOLDER)


@pytest.fixture(scope="module")
def stored(spark, state):
    return lists.write_lists(state, scratch_path(spark, "lists"), folders=16, bits=4, split=40)


def ranks(df):
    return [(r.external_id, round(r["rank"], 6)) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("typed", ["the", '"of the"', '"in of the that"', "erk* und", "the NOT of OR thatin", '"of the" que', '"the o*"', "zzzz"])
def test_finds_what_a_scan_finds(state, stored, typed):
    assert ranks(lists.search_lists(stored, state, typed, limit=None)) == ranks(search.search(state, typed, limit=None))
    page = lists.search_lists(stored, state, typed, limit=7, offset=3)
    assert ranks(page) == ranks(search.search(state, typed, limit=7, offset=3))


def test_filters(state, stored):
    wanted = {"lang": "en", "workload_min": 60}
    assert ranks(lists.search_lists(stored, state, "the", limit=None, **wanted)) == ranks(
        search.search(state, "the", limit=None, **wanted))


def test_rows_are_a_third_of_the_tokens(spark, state, stored):
    big = lists.write_lists(state, scratch_path(spark, "lists"), folders=4)
    assert 3 * big.listed().count() <= index.index_rows(state).count()
    entries = stored.listed().selectExpr("term", "block", "inline(entries)")
    assert entries.groupBy("term", "number").count().where("count > 1").isEmpty()


def test_a_look_up_opens_its_folders_only(stored):
    rows = stored.rows(["the", "der"])
    opened = {f.split("folder=")[1].split("/")[0] for f in rows.inputFiles()}
    assert len(opened) == 16  # what is listed before the plan prunes
    text = plan(rows)
    assert "PartitionFilters: [isnotnull(folder" in text or "PartitionFilters: [folder" in text
    assert "PushedFilters: [In(term" in text
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() <= 2
    bounds = plan(lists.block_bounds(stored, Box.read("the"), lists.looked_up(stored, lists.units(stored, Box.read("the"))), [9]))
    assert "entries" not in bounds.split("ReadSchema")[1]


def test_frequent_terms_lie_in_several_files(spark, state):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = lists.write_lists(state, scratch_path(spark, "lists"), folders=4, bits=2, split=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = stored.listed().where("term = 'the'").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1


def test_phrases_of_common_words_read_pairs(stored):
    kinds = [(u.term, u.kind, u.at) for u in lists.units(stored, Box.read('"of the and"'))]
    assert kinds == [("of the", "pairs", 0), ("the and", "pairs", 1)]
    box = Box.read('"of the"')
    pair = lists.looked_up(stored, lists.units(stored, box)).agg({"n": "sum"}).first()[0]
    both = stored.dictionary.where("term in ('of', 'the')").agg({"postings": "sum"}).first()[0]
    assert 0 < pair < both / 2


def test_best_postings_without_most_blocks(spark, state):
    small = lists.write_lists(state, scratch_path(spark, "lists"), folders=4, bits=0)
    found, read = lists.top_k(small, state, TOP, 5)
    assert ranks(found) == ranks(search.search(state, TOP, limit=5))
    assert read["read"] < read["all"] / 2
    for typed in ("the of", "der NOT the", "zzzz OR the"):
        found, _ = lists.top_k(small, state, typed, 8)
        assert ranks(found) == ranks(search.search(state, typed, limit=8))
    with pytest.raises(ValueError):
        lists.top_k(small, state, '"of the"', 5)


def test_an_empty_state(spark, state):
    none = lists.write_lists(state.limit(0), scratch_path(spark, "lists"), folders=2)
    assert lists.search_lists(none, state.limit(0), "the").collect() == []


def test_files_hold_a_bounded_number_of_entries(spark, state):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = lists.write_lists(state, scratch_path(spark, "lists"), folders=2, split=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = stored.listed().groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()
    whole = sum(r.n for r in held)
    assert whole == stored.dictionary.agg({"postings": "sum"}).first()[0] > 20000
    assert stored.dictionary.where("postings > 2000").isEmpty() and max(r.n for r in held) < whole / 4


def test_entries_are_not_shuffled(spark, state):
    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    begun = shuffled()
    stored = lists.write_lists(state, scratch_path(spark, "lists"), folders=4)
    written = shuffled() - begun
    files = [f for f in pathlib.Path(stored.path.removeprefix("file:")).rglob("*.parquet") if "/lists/" in str(f)]
    assert 0 < written < sum(f.stat().st_size for f in files)


def test_rows_of_blocks_that_come_in_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = ["b a a", "a b c", "", "c b", "a b a b", None, "a"]
        rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "fingerprint string, title string").coalesce(1)
        stored = lists.write_lists(rows, scratch_path(spark, "lists"), folders=2, bits=2, common=0.2)
        told = {(r.term, r.block): [(e.number, e.doc_tokens, e.places) for e in r.entries] for r in stored.listed().collect()}
        pairs = {(r.term, r.block): [(e.number, e.places) for e in r.entries] for r in stored.listed("pairs").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert told == {
        ("a", 0): [(0, 3, [1, 2]), (1, 3, [0])], ("b", 0): [(0, 3, [0]), (1, 3, [1]), (3, 2, [1])],
        ("c", 0): [(1, 3, [2]), (3, 2, [0])], ("a", 1): [(4, 4, [0, 2]), (6, 1, [0])], ("b", 1): [(4, 4, [1, 3])]}
    assert pairs == {
        ("b a", 0): [(0, [0])], ("a a", 0): [(0, [1])], ("a b", 0): [(1, [0])], ("b c", 0): [(1, [1])],
        ("c b", 0): [(3, [0])], ("a b", 1): [(4, [0, 2])], ("b a", 1): [(4, [1])]}
    assert {(r.n, r.most, r.shortest) for r in stored.listed().where("term = 'a' and block = 1").collect()} == {(2, 20.0, 1)}
