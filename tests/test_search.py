"""Search, index, filters and reports over a small corpus, and ranking
against an independent full-text engine from the standard library."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from postlake.operators import index, reports, search
from postlake.operators.query import Box
from postlake.session import scratch_path

SCHEMA = """fingerprint string, source string, title string, company string, city string,
region string, country string, description string, keywords array<string>, skills array<string>,
contract_type string, remote_policy string, lang string, seniority string, lat double,
workload_min int, workload_max int, salary_min double, salary_max double, posted_at string,
first_seen_at string, last_seen_at string, languages array<string>, occupations array<string>"""


def posting(fingerprint, **fields):
    base = dict(
        source="testsource", title="T", country="CH", keywords=["backend"], skills=[], lang="fr",
        posted_at="2026-08-20", first_seen_at="2026-08-21", last_seen_at="2026-08-21",
        languages=[], occupations=[],
    )
    names = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(",")]
    return tuple({**base, **fields, "fingerprint": fingerprint}.get(n) for n in names)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        posting("baker", title="Bäckermeisterin", company="Korn & Söhne", city="Thun", region="BE",
                description="Sauerteig, Brezel, Nachtschicht; Ofen.", skills=["oven", "dough"],
                workload_min=40, workload_max=60),
        posting("clerk", title="Night Ledger Clerk", company="Hafenkontor", city="Göteborg", region="VG", country="SE",
                description="Ledger, oven invoices and harbour fees by night.", skills=["dough", "ledger"],
                workload_min=60, salary_min=52000.0),
        posting("pilot", title="Lotse", source="harbour", company="É100%_b\\c", city="Kiel", region="SH",
                country="DE", description="Harbour pilot, schwere See.", skills=["ships"], posted_at=None),
        posting("smith", title="Hufschmied", source="harbour", company="Hafenkontor", city="kiel", region="SH",
                country="DE", description="Ofen und Amboss.", skills=[], lang="de", posted_at="2026-08-25"),
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()


@pytest.fixture(scope="module")
def stored(spark, corpus):
    path = scratch_path(spark, "index")
    index.write_index(corpus, path)
    return index.read_index(spark, path)


def keys(df):
    return [r.fingerprint for r in df.collect()]


def words_of(row):
    import re

    from postlake.operators.query import fold_term

    fields = [row[f] for f in search.FIELD_WEIGHTS]
    return [re.findall(r"[^\W_]+", fold_term(" ".join(f) if isinstance(f, list) else f or "")) for f in fields]


def holds(row, phrase):
    """Whether a posting has a phrase (a list of words, the last maybe `word*`), by hand."""
    def fits(word, wanted):
        return word.startswith(wanted[:-1]) if wanted.endswith("*") else word == wanted

    return any(all(fits(w, p) for w, p in zip(field[i:], phrase, strict=False)) and len(field) - i >= len(phrase)
               for field in words_of(row) for i in range(len(field)))


#: What is typed, and the same as any-of all-of (phrase, wanted or not).
TYPED = {
    "backermeisterin": [[("backermeisterin", True)]], "GÖTEBORG": [[("goteborg", True)]], "ofen": [[("ofen", True)]],
    "ove*": [[("ove*", True)]], '"ledger clerk" oven': [[("ledger clerk", True), ("oven", True)]],
    "oven AND ledger": [[("oven", True), ("ledger", True)]], "oven not ledger": [[("oven", True), ("ledger", False)]],
    "thun or lotse": [[("thun", True)], [("lotse", True)]], "night-ledger": [[("night ledger", True)]],
    '"clerk ledger"': [[("clerk ledger", True)]], "harbour pil*": [[("harbour", True), ("pil*", True)]],
    "hafenkontor NOT kiel OR brezel": [[("hafenkontor", True), ("kiel", False)], [("brezel", True)]],
}


@pytest.mark.parametrize("typed", TYPED)
def test_both_ways_find_what_is_there(corpus, stored, typed):
    want = sorted(r.fingerprint for r in corpus.collect() if any(
        all(holds(r, phrase.split()) == asked for phrase, asked in branch) for branch in TYPED[typed]))
    assert sorted(keys(search.search(corpus, typed))) == want
    assert sorted(keys(index.search_index(stored, corpus, typed))) == want
    assert search.count(corpus, typed).first().n == len(want)


def test_signs_without_words(corpus, stored):
    for typed, want in {"!! oven": ["baker", "clerk"], "!! AND oven": [], "!! OR lotse": ["pilot"]}.items():
        assert sorted(keys(search.search(corpus, typed))) == want
        assert sorted(keys(index.search_index(stored, corpus, typed))) == want


def test_any_box_can_be_typed(corpus):
    rng = random.Random(11)
    for _ in range(25):
        typed = "".join(rng.choice('ab "*:^(){}[]\'-+\\\t|&#') for _ in range(rng.randrange(12)))
        box = Box.read(typed)
        assert box is None or search.rank_texts(corpus.limit(0), box) is not None


@pytest.mark.parametrize("typed", ["or", "oven AND", "not oven", "oven OR NOT thun", "a AND AND b"])
def test_an_operator_needs_two_sides(typed):
    with pytest.raises(ValueError, match="AND|OR|NOT"):
        Box.read(typed)


def test_without_query_newest_first(corpus):
    order = ["smith", "pilot", "baker", "clerk"]
    found = search.search(corpus, None).collect()
    assert [r.fingerprint for r in found] == order and all(r["rank"] is None for r in found)
    for offset in range(6):
        assert keys(search.search(corpus, None, limit=2, offset=offset)) == order[offset : offset + 2]
        assert keys(search.search(corpus, None, limit=None, offset=offset)) == order[offset:]


def test_pages_of_hits(corpus):
    everything = keys(search.search(corpus, "ofen OR oven OR harbour", limit=None))
    assert len(everything) == 4
    for offset in (0, 1, 3, 9):
        assert keys(search.search(corpus, "ofen OR oven OR harbour", limit=2, offset=offset)) == everything[offset : offset + 2]
        assert keys(search.search(corpus, "ofen OR oven OR harbour", limit=None, offset=offset)) == everything[offset:]


def test_a_page_asks_for_its_keys(spark, corpus):
    path = scratch_path(spark, "state")
    corpus.sortWithinPartitions("fingerprint").write.parquet(path)
    page = search.search(spark.read.parquet(path), "oven", limit=1)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(fingerprint,baker)" in plan or "In(fingerprint, [baker])" in plan
    rest = search.search(spark.read.parquet(path), None, limit=None, offset=1)
    assert "CollectLimit" not in rest._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("filters,want", [
    ({"skills": ["dough"]}, "baker clerk"), ({"skills": ["oven", "dough"]}, "baker"), ({"skills": ["dough", "sail"]}, ""),
    ({"workload_min": 55}, "baker clerk"), ({"workload_min": 0}, "baker clerk"), ({"salary_min": 50000}, "clerk"),
    ({"posted_since": "2026-08-21"}, "pilot smith"), ({"source": ""}, "baker clerk pilot smith"),
    ({"city": "kie"}, "pilot smith"), ({"city": "GöTE"}, "clerk"), ({"city": "GÖTE"}, ""), ({"company": "o%e"}, "baker"),
    ({"company": "b\\c"}, "pilot"), ({"company": "é100"}, ""), ({"country": "DE", "region": "SH"}, "pilot smith"),
    ({"lang": "de", "city": "kiel"}, "smith"),
])
def test_filters(corpus, filters, want):
    assert sorted(keys(search.search(corpus, None, **filters))) == want.split()
    assert search.count(corpus, None, **filters).first().n == len(want.split())


def test_query_with_filters(corpus, stored):
    free = {r.fingerprint: r["rank"] for r in search.search(corpus, "oven").collect()}
    for country, want in (("SE", ["clerk"]), ("CH", ["baker"]), ("DE", [])):
        held = search.search(corpus, "oven", country=country).collect()
        assert [r.fingerprint for r in held] == want == keys(index.search_index(stored, corpus, "oven", country=country))
        # Figures of the whole corpus decide the rank, whatever the filter.
        assert [r["rank"] for r in held] == [free[k] for k in want]
    with pytest.raises(TypeError):
        search.search(corpus, None, colour="red")


def test_get(corpus):
    assert search.get(corpus, "pilot").first().title == "Lotse"
    assert search.get(corpus, "x").first() is None


def test_reports(corpus):
    assert {r.value: r["count"] for r in reports.facets(corpus, "region").collect()} == {"BE": 1, "VG": 1, "SH": 2}
    with pytest.raises(ValueError):
        reports.facets(corpus, "title")
    with pytest.raises(ValueError):
        reports.top_terms(corpus, "title")
    assert tuple(reports.top_terms(corpus, "skills", limit=3).first()) == ("dough", 2)
    days = [("2026-08-20", 2), ("2026-08-21", 1), ("2026-08-25", 1)]
    assert [tuple(r) for r in reports.timeline(corpus).collect()] == days
    assert [r.day for r in reports.timeline(corpus, days=1).collect()] == ["2026-08-25"]
    whole = reports.summary(corpus)
    assert whole["totals"].first()[:3] == (4, 2, 3)
    both = [("harbour", 2), ("testsource", 2)]
    assert sorted(tuple(r) for r in whole["by_source"].collect()) == both
    assert sorted(tuple(r) for r in reports.counts_by_source(corpus).collect()) == both
    assert reports.total(corpus).first().n == 4


def test_index_follows_changes(corpus, stored):
    now = corpus.filter("fingerprint <> 'baker'").withColumn(
        "title", F.when(F.col("fingerprint") == "pilot", "Oven pilot").otherwise(F.col("title")))
    fresh = index.refresh_index(
        stored, now.filter("fingerprint = 'pilot'"), index.corpus_of(now), corpus.filter("fingerprint = 'baker'"))
    for typed in ("oven", "lotse OR thun", "ofen"):
        got = [tuple(r) for r in index.search_index(fresh, now, typed).select("fingerprint", "rank").collect()]
        assert got == [tuple(r) for r in search.search(now, typed).select("fingerprint", "rank").collect()]
    assert set(keys(index.search_index(fresh, now, "oven"))) == {"clerk", "pilot"}


def test_index_lookup_is_pruned(stored):
    plan = index.index_hits(stored, Box.read("oven harb*"))._jdf.queryExecution().toString()
    assert "EqualTo(term,oven)" in plan and "StringStartsWith(term,harb)" in plan


WORDS = "alpha beta gamma delta épsilon zêta eta theta".split()


def test_rank_equals_a_full_text_engine(spark):
    """Random postings and queries against SQLite's own full-text ranking."""
    rng = random.Random(7)
    fields = ("title", "company", "city", "description", "keywords", "skills")
    rows = []
    for i in range(60):
        text = {f: " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for f in fields[:4]}
        lists = {f: rng.choices(WORDS, k=rng.randint(0, 3)) for f in fields[4:]}
        rows.append(posting(f"{i:02d}", **text, **lists))
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"CREATE VIRTUAL TABLE t USING fts5({', '.join(fields)}, "
                    "tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine here")
    for r in df.orderBy("fingerprint").collect():
        con.execute(f"INSERT INTO t(rowid, {', '.join(fields)}) VALUES (?,?,?,?,?,?,?)",
                    (int(r.fingerprint), *[r[f] if isinstance(r[f], str) else " ".join(r[f]) for f in fields]))
    queries = {
        "alpha": '"alpha"', "alpha beta": '"alpha" "beta"', "epsilon OR zet*": '"epsilon" OR "zet"*',
        '"alpha beta" gamma': '"alpha beta" "gamma"', "eta NOT theta": '"eta" NOT "theta"',
        "alpha NOT beta gamma": '"alpha" NOT "beta" "gamma"',
        "alpha-bet* OR delta AND zeta": '"alpha-bet"* OR "delta" AND "zeta"',
        "beta beta": '"beta" "beta"',
    }
    path = scratch_path(spark, "index")
    index.write_index(df, path)
    stored = index.read_index(spark, path)
    for typed, match in queries.items():
        want = con.execute(
            "SELECT rowid, bm25(t, 10, 3, 4, 1, 6, 8) FROM t WHERE t MATCH ? ORDER BY 2, 1", (match,)
        ).fetchall()
        for found in (search.search(df, typed, limit=None),
                      index.search_index(stored, df, typed, limit=None)):
            got = {int(r.fingerprint): r["rank"] for r in found.collect()}
            assert got.keys() == dict(want).keys(), typed
            for key, rank in want:
                assert got[key] == pytest.approx(rank, abs=1e-9), (typed, key)


def test_all_facets_are_single_ones_from_one_scan(spark, tmp_path):
    from postlake.plans import corpus as given

    path = str(tmp_path / "state")
    given.postings(spark, "/root/testdata/sf0.001").withColumn("remote_policy", F.lit(None).cast("string")).withColumn(
        "seniority", F.lit("")).write.parquet(path)
    state = spark.read.parquet(path)
    whole = reports.all_facets(state, 3, country="CH")
    single = [(f, r.value, r["count"]) for f in reports.FACETS for r in reports.facets(state, f, 3, country="CH").collect()]
    assert sorted(map(tuple, whole.collect())) == sorted(single)
    text = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("FileScan") == 1 and "Expand" in text and "WindowGroupLimit" in text
    with pytest.raises(ValueError):
        reports.all_facets(state, fields=("title",))
    told = reports.summary(state)
    assert [tuple(r) for r in told["by_source"].collect()] == [tuple(r) for r in reports.facets(state, "source", 50).collect()]
    assert [tuple(r) for r in told["totals"].collect()] == [tuple(r) for r in reports.totals(state).collect()]
    none = state.limit(0)
    assert [tuple(r) for r in reports.summary(none)["totals"].collect()] == [tuple(r) for r in reports.totals(none).collect()]


def test_a_look_up_by_key_skips_row_groups(spark, tmp_path):
    from postlake.session import keyed

    path = str(tmp_path / "keyed")
    rows = spark.range(40_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("fingerprint"), F.repeat(F.lit("x"), 200).alias("text"))
    keyed(rows.repartition(1).write.option("parquet.block.size", 1 << 18)).parquet(path)
    table = spark.read.parquet(path)
    wanted = rows.limit(1).select("fingerprint")
    found = search.get_many(table, wanted)
    assert found.count() == 1

    def scanned(df):
        df.collect()
        leaves, stack = [], [df._jdf.queryExecution().executedPlan()]
        while stack:
            node = stack.pop()
            if "Adaptive" in node.nodeName():
                node = node.executedPlan()
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
            if not children.size():
                leaves.append(node.metrics().apply("numOutputRows").value())
        return sum(leaves)

    assert scanned(found) < 40_000 / 4
    absent = table.filter(F.col("fingerprint") == "0" * 39 + "g")
    assert scanned(absent) == 0
    assert search.get_many(table, rows.select("fingerprint")).count() == 40_000


def test_segments_of_bounded_texts(spark):
    from postlake.plans.corpus import postings

    state = postings(spark, "/root/testdata/sf0.001").coalesce(1)
    path = scratch_path(spark, "index")
    index.write_index(state, path, segment=50_000)
    stored = index.read_index(spark, path)
    sizes = [r["count"] for r in stored.rows.groupBy(F.input_file_name()).count().collect()]
    whole = index.index_rows(state).count()
    assert sum(sizes) == whole and len(sizes) > 4 and max(sizes) < whole / 3
    found = index.search_index(stored, state, "the of", limit=None)
    assert [(r.external_id, r["rank"]) for r in found.collect()] == [(r.external_id, r["rank"]) for r in search.search(state, "the of", limit=None).collect()]
