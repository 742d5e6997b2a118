"""Normalisation, validation, duplicates, enrichment and whole runs."""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.operators import dedup, enrich, validate
from postlake.operators.normalise import normalise
from postlake.operators.index import search_index
from postlake.operators.search import search
from postlake.operators.state import as_batch
from postlake.plans.ingest import Run, ingest, replay
from postlake.plans.store import Store
from postlake.schema import POSTING_SCHEMA, RAW_SCHEMA, STATE_COLUMNS
from postlake.session import scratch_path
from postlake.streaming import ingest as stream

NOW = "2026-09-01T00:00:00Z"


def raw(spark, *rows):
    """Loose postings from dicts, in order."""
    base = {"source": "x", "url": "https://x/1", "title": "T"}
    full = [{**base, **r} for r in rows]
    data = [tuple(r.get(f) for f in RAW_SCHEMA.names) + (i,) for i, r in enumerate(full)]
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField("ingest_seq", T.LongType())])
    return spark.createDataFrame(data, schema)


def one(spark, **fields):
    return normalise(raw(spark, fields), NOW).first()


def test_normalise_text_country_date_and_key(spark):
    out = one(spark, title="  Chef  de projet ", country="Suisse", posted_at="21/08/2026")
    assert (out.title, out.country, out.posted_at) == ("Chef de projet", "CH", "2026-08-21")
    assert out.fingerprint == hashlib.sha1(b"x|https://x/1").hexdigest()
    assert out.scraped_at == NOW


def test_unknown_columns_are_ignored_and_types_fixed(spark):
    loose = spark.createDataFrame([("x", "https://x/1", "T", 1, 80)],
                                  "source string, url string, title string, cle int, workload_min int")
    out = normalise(loose, NOW)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in POSTING_SCHEMA]
    assert out.first().workload_min == 80


def test_workload_is_clamped_and_ordered(spark):
    out = one(spark, workload_min="150", workload_max="-10")
    assert (out.workload_min, out.workload_max) == (0, 100)


def test_lists_are_cleaned_and_distinct(spark):
    out = one(spark, skills=["python", "python", " Go ", None, "&nbsp;"])
    assert out.skills == ["python", "Go"] and out.keywords == []


def test_fingerprint_prefers_identifier_and_trusts_a_given_one(spark):
    df = normalise(raw(
        spark, {"source": " X ", "external_id": " 7 ", "url": "https://a"},
        {"external_id": "7", "url": "https://b"}, {"url": "https://a"}, {"fingerprint": "mine"},
    ), NOW).orderBy("ingest_seq")
    a, b, c, d = [r.fingerprint for r in df.collect()]
    assert a == b != c and d == "mine"


def test_validation_gives_one_reason(spark):
    rows = [{"source": None}, {"url": ""}, {"title": " "}, {"url": "ftp://x/1"}, {"url": "HTTP://x"}, {}]
    judged = validate.judge(normalise(raw(spark, *rows), NOW)).orderBy("ingest_seq").collect()
    assert [r.reject_reason for r in judged] == ["incomplete"] * 3 + ["bad_url"] * 2 + [None]
    assert [r.missing_fields for r in judged[:3]] == [["source"], ["url"], ["title"]]


def test_first_record_wins_whatever_the_order(spark):
    df = spark.createDataFrame(
        [("r", "s", "a", i, f"t{i}") for i in range(50)]
        + [("r", "s", None, 100, "n1"), ("r", "s", "", 101, "n2"), ("r", "u", "a", 0, "u"), ("r", "u", "a", 7, "u7"),
           ("q", "s", "a", 103, "q"), ("r", None, "a", 5, "w"), ("r", None, "a", 6, "w6")],
        "run_id string, source string, fingerprint string, ingest_seq long, title string",
    ).orderBy(F.rand(3))
    kept = dedup.first_per_fingerprint(df)
    assert sorted(r.title for r in kept.collect()) == ["n1", "n2", "q", "t0", "u", "w"]
    dropped = dedup.duplicates(df)
    assert sorted(r.title for r in dropped.collect()) == sorted([f"t{i}" for i in range(1, 50)] + ["u7", "w6"])
    assert sum(r.duplicates for r in dedup.duplicate_counts(df).collect()) == 51
    # No window, and no aggregate over what a posting holds.
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and not any("title" in line for line in plan.splitlines() if "Aggregate" in line)


def test_chain_of_steps():
    def build(**options):
        return lambda df: df

    def broken(**options):
        raise RuntimeError("no")

    plans = [
        enrich.StepPlan("mid", build), enrich.StepPlan("end", build, place=900), enrich.StepPlan("alpha", build),
        enrich.StepPlan("keyed", build, needs=("SECRET_A", "SECRET_B")), enrich.StepPlan("faulty", broken, place=1),
    ]
    chain = enrich.build_chain(plans, env={"SECRET_A": "x"})
    assert [n for n, _ in chain.steps] == ["alpha", "mid", "end"]
    assert chain.left_out == {"keyed": "needs SECRET_B", "faulty": "RuntimeError: no"}
    only = enrich.build_chain(plans, only=["end", "keyed"], env={"SECRET_A": "x", "SECRET_B": "y"})
    assert [n for n, _ in only.steps] == ["keyed", "end"] and not only.left_out
    given = {}
    declared = [enrich.StepPlan("s", lambda **kw: given.update(kw) or build(), options={"low": 1, "high": 2})]
    enrich.build_chain(declared, options={"s": {"high": 9}, "other": {"low": 5}})
    assert given == {"low": 1, "high": 9}


def test_a_failing_step_keeps_the_row(spark):
    def fails(row):
        assert set(row) == {"title", "workload_min"}
        if row["title"] == "breaks":
            raise RuntimeError
        if row["title"] == "mistyped":
            return {"seniority": "junior", "workload_max": "many"}
        if row["title"] == "silent":
            return None
        return {"seniority": "senior", "workload_max": row["workload_min"] + 5, "ignored": 1}

    df = normalise(raw(
        spark, {"title": "breaks", "skills": ["a"], "workload_max": "7"}, {"title": "works", "workload_min": "80"},
        {"title": "mistyped", "workload_max": "9"}, {"title": "silent", "seniority": "old"},
    ), NOW)
    step = enrich.python_step("step", fails, ["title", "workload_min"], "seniority string, workload_max int")
    out = enrich.enrich(df, [("step", step)])
    rows = {r.title: r for r in out.collect()}
    assert rows["breaks"].seniority is None and rows["breaks"]._enrich_errors == ["step"]
    assert rows["breaks"].skills == ["a"] and rows["breaks"].workload_max == 7
    assert rows["works"].seniority == "senior" and rows["works"]._enrich_errors == []
    assert rows["works"].workload_max == 85
    assert rows["mistyped"].seniority is None and rows["mistyped"].workload_max == 9
    assert rows["silent"].seniority == "old" and rows["silent"]._enrich_errors == []
    assert [tuple(r) for r in enrich.failure_counts(out).collect()] == [("step", 2)]


def test_tagging(spark):
    taxonomy = {"python": [], "data-eng": ["data engineer", "ingénieur données"], "c": [], "cpp": ["C++"], "net": [".NET"]}
    df = normalise(raw(
        spark, {"title": "Data-Engineer C", "skills": ["zeta"]},
        {"url": "https://x/2", "description": "INGENIEUR\nDONNEES, Pythonic, c++11"}, {"url": "https://x/3"},
        {"url": "https://x/4", "title": "C++/.Net", "description": "salaire net"}, {"url": "https://x/5", "title": "c+"},
    ), NOW)
    tag = enrich.tag_skills(taxonomy)
    want = [["c", "data-eng", "zeta"], ["c", "data-eng"], [], ["c", "cpp", "net"], ["c"]]
    for keyed in (df, df.withColumn("fingerprint", F.when(F.col("ingest_seq") > 1, F.lit("same")))):
        got = [r.skills for r in tag(keyed).orderBy("ingest_seq").collect()]
        assert got[0] == want[0] and got[2] == [] and got[3] == want[3]
        assert "data-eng" in got[1] and "cpp" not in got[1] and "cpp" not in got[4]


def test_a_run_end_to_end_and_again(spark):
    store = Store(spark, scratch_path(spark, "t"))
    def fails(row):
        raise RuntimeError

    steps = [("step", enrich.python_step("step", fails, ["title"], "seniority string"))]
    rows = [{"external_id": "1"}, {"external_id": "1", "title": "late"}, {"external_id": "2"},
            {"source": None}, {"url": "ftp://x"}]
    first = ingest(raw(spark, *rows), store, Run("r1", 1, NOW, steps=steps))
    assert first == {"valid": 3, "dropped/incomplete": 1, "dropped/bad_url": 1, "dropped/duplicate": 1,
                     "enrich_failed/step": 2, "new": 2, "updated": 0}
    later = "2026-10-01T00:00:00Z"
    second = [{"external_id": "2", "title": "changed"}, {"external_id": "3"}]
    for _ in range(2):
        # The second time round stands for a repeated run: nothing changes.
        counters = ingest(raw(spark, *second), store, Run("r2", 2, later))
        assert (counters["new"], counters["updated"]) == (1, 1)
        state = {r.external_id: r for r in store.state().collect()}
        assert set(state) == {"1", "2", "3"} and store.state().columns == list(STATE_COLUMNS)
        assert state["2"].title == "changed"
        assert (state["2"].first_seen_at, state["2"].last_seen_at) == (NOW, later)
        assert state["1"].last_seen_at == NOW
        from postlake.sources.archive import read_archive
        archived = read_archive(spark, store.folder("archive"))
        assert archived.count() == 4
        assert store.metrics().filter("run_id = 'r2'").count() == 6
    assert store.rejects().count() == 3
    assert store.latest_version() == 2 and store.state(0).count() == 2
    # The run that was repeated was taken back first: both times it stood on version 0.
    assert [store.published(v).before for v in range(3)] == [None, 0, 0]


def batch_of(spark, run, keys, **fields):
    rows = [{"external_id": str(k), "title": f"run{run} word{k}", "url": "https://x/u", **fields} for k in keys]
    return as_batch(normalise(raw(spark, *rows), NOW), f"2026-0{run}-01")


def test_state_of_many_runs_removal_and_index(spark):
    """An index that was built early finds the newest content and nothing that went."""
    store = Store(spark, scratch_path(spark, "runs"), buckets=4)
    built, written = None, {}
    for run in range(1, 8):
        keys = range(run, run + 3)
        counts = store.upsert(batch_of(spark, run, keys, company=None if run % 2 else "c"), f"r{run}")
        assert counts == ({"new": 3, "updated": 0} if run == 1 else {"new": 1, "updated": 2})
        for k in keys:
            written.setdefault(str(k), []).append(run)
        if run == 3:
            built = store.write_index()
    got = {r.external_id: r for r in store.state().collect()}
    assert set(got) == set(written) and store.state(1).count() == 4
    for key, runs in written.items():
        assert got[key].title == f"run{runs[-1]} word{key}" and got[key].company == (None if runs[-1] % 2 else "c")
        assert (got[key].first_seen_at, got[key].last_seen_at) == (f"2026-0{runs[0]}-01", f"2026-0{runs[-1]}-01")
    store.remove(store.state().filter("external_id in ('3', '9')"), "gone")
    assert {r.external_id for r in store.state().collect()} == set(written) - {"3", "9"}
    store.upsert(batch_of(spark, 8, [9]), "r8")

    def pick(df):
        return [tuple(r) for r in df.select("fingerprint", F.round("rank", 9)).collect()]

    for typed in ("run7 OR word3", "run8 OR word9", "word1"):
        assert pick(search_index(store.index(built), store.state(), typed)) == pick(search(store.state(), typed))
    assert len(pick(search(store.state(), "run7 OR word3"))) == 2


def test_no_run_is_lost(spark):
    store = Store(spark, scratch_path(spark, "late"), buckets=4)
    store.upsert(batch_of(spark, 5, [1, 2]), "5")
    store.upsert(batch_of(spark, 3, [2, 3]), "3")
    store.upsert(batch_of(spark, 3, [4]), "3, other source")
    got = {r.external_id: r for r in store.state().collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["2"].title == "run3 word2"
    # A run that another one overtook starts again from what that one published.
    slow = Store(spark, store.path, buckets=4)
    commit, stale = slow.newest, [slow.newest()]
    object.__setattr__(slow, "newest", lambda: stale.pop() if stale else commit())
    store.upsert(batch_of(spark, 6, [5]), "6")
    slow.upsert(batch_of(spark, 7, [6]), "7")
    assert {r.external_id for r in store.state().collect()} == {"1", "2", "3", "4", "5", "6"}


def test_a_report_scans_only_its_columns(spark):
    store = Store(spark, scratch_path(spark, "plain"), buckets=4)
    for run in (1, 2):
        store.upsert(batch_of(spark, run, [run]), str(run))
    plan = store.state().select("source")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert "ReadSchema: struct<source:string>" in plan


def test_replay_from_landing(spark):
    landed, target = (Store(spark, scratch_path(spark, n)) for n in ("landed", "target"))
    landed.land(raw(spark, {"external_id": "1", "title": "a"}, {"external_id": "1", "title": "b"}), "one", 1)
    landed.land(raw(spark, {"external_id": "1", "title": "c", "company": None}), "two", 2)
    replay(landed, target, [Run("two", 2, "2026-02-01T00:00:00Z"), Run("one", 1, "2026-01-01T00:00:00Z")])
    row = target.state().first()
    assert (row.title, row.first_seen_at[:7], row.last_seen_at[:7]) == ("c", "2026-01", "2026-02")


def test_stream_equals_batch(spark):
    rows = [{"external_id": str(i % 7), "title": f"t{i}", "url": f"https://x/{i}"} for i in range(40)]
    df = raw(spark, *rows)
    landing = scratch_path(spark, "landing")
    df.filter("ingest_seq < 20").coalesce(1).write.json(landing)
    df.filter("ingest_seq >= 20").coalesce(1).write.mode("append").json(landing)
    streamed, batch = (Store(spark, scratch_path(spark, n)) for n in ("streamed", "batch"))
    query = stream.start(
        stream.read_landing(spark, landing), streamed, scratch_path(spark, "ck"),
        clock=lambda n: NOW,
    )
    query.awaitTermination()
    assert query.exception() is None
    ingest(df, batch, Run("b", 0, NOW))
    content = [c for c in STATE_COLUMNS]
    assert sorted(map(str, streamed.state().select(content).collect())) == sorted(
        map(str, batch.state().select(content).collect()))


def test_streams_do_not_hide_each_other(spark):
    store = Store(spark, scratch_path(spark, "both"))
    for key in ("A", "B"):
        landing = scratch_path(spark, "landing")
        for title in ("first", "second"):
            raw(spark, {"external_id": key, "title": f"{title} {key}"}).coalesce(1).write.mode("append").json(landing)
        query = stream.start(stream.read_landing(spark, landing, files_per_batch=1), store, scratch_path(spark, "ck"),
                             clock=lambda n: NOW)
        query.awaitTermination()
        assert query.exception() is None
    assert sorted(r.title for r in store.state().collect()) == ["first A", "first B"]
    counters = {r.counter: r.n for r in store.metrics().groupBy("counter").agg(F.sum("n").alias("n")).collect()}
    assert (counters["new"], counters["updated"], counters["dropped/duplicate"]) == (2, 0, 2)


def test_a_batch_that_was_published_is_left_alone(spark):
    store = Store(spark, scratch_path(spark, "again"))
    given = raw(spark, {"external_id": "1"}, {"external_id": "2"})
    first = ingest(given, store, Run("s-0", 0, NOW), mark=("s", 0))
    store.upsert(batch_of(spark, 2, [2], source="x"), "other")
    assert ingest(given, store, Run("s-0", 0, "2030"), mark=("s", 0)) == first
    assert {r.external_id: r.title for r in store.state().collect()} == {"1": "T", "2": "run2 word2"}


def test_stream_forgets_after_the_delay(spark):
    """Days of new postings, each repeated on the next day: the state holds those of the
    time that is remembered, whatever the age of the stream; late rows are dropped."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "ck")
    store, held = Store(spark, scratch_path(spark, "bounded")), []
    for day in range(8):
        new = [{"external_id": f"{day}-{i}", "title": f"day {day}", "scraped_at": f"2026-08-{day + 1:02d}T00:00:{i:02d}Z"} for i in range(20)]
        again = [{"external_id": f"{day - 1}-{i}", "title": "again", "scraped_at": f"2026-08-{day + 1:02d}T00:00:30Z"} for i in range(20) if day]
        late = [{"external_id": f"late-{day}", "title": "late", "scraped_at": "2026-08-01T00:00:00Z"}] if day > 4 else []
        raw(spark, *new, *again, *late).write.mode("append").json(landing)
        query = stream.start(stream.read_landing(spark, landing), store, checkpoint, clock=lambda n: NOW, delay="6 hours")
        query.awaitTermination()
        assert query.exception() is None
        held.append(max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]))
    rows = store.state().collect()
    assert len(rows) == 160 and {r.title for r in rows} == {f"day {d}" for d in range(8)}
    assert max(held) <= 60
    counters = {r.counter: r.n for r in store.metrics().groupBy("counter").agg(F.sum("n").alias("n")).collect()}
    assert counters["dropped/duplicate"] == 7 * 20 + 3
    assert stream_folders(store) == {"archive", "rejects", "state", "published", "run_metrics"}


def stream_folders(store):
    import pathlib

    return {p.name for p in pathlib.Path(store.path.removeprefix("file:")).iterdir()}


def test_stream_dedup_within_watermark(spark):
    rows = [{"external_id": "1", "scraped_at": NOW}, {"external_id": "1", "scraped_at": NOW},
            {"external_id": "2", "scraped_at": NOW}]
    landing = scratch_path(spark, "landing")
    normalise(raw(spark, *rows), NOW).coalesce(1).write.json(landing)
    source = stream.deduplicated(stream.read_landing(spark, landing))
    out = scratch_path(spark, "out")
    query = (source.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_tagging_by_a_table(spark):
    taxonomy = spark.createDataFrame(
        [("Data Engineer", "data"), ("engineer", "engineering"), ("senior data engineer", "senior"), ("SQL", "sql"), ("sql", "databases"),
         ("Ingénieur", "engineering"), ("C++", "c"), (None, "none"), ("", "none"), ("the data the", "loop"), ("sql", None)], "alias string, skill string")
    rows = [(1, "Senior Data-Engineer", "engineer"), (2, "data engineer", None), (3, "nothing here", "SQL sql"), (4, None, "ingenieur"),
            (5, "the data the data the", ""), (6, "", "c")]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    found = {r.id: r.skills for r in enrich.tagged(df, taxonomy, "id").collect()}
    assert found == {1: ["engineering", "senior"], 2: ["data"], 3: ["databases", "sql"], 4: ["engineering"], 5: ["loop"], 6: ["c"]}
    assert enrich.tagged(df, taxonomy.limit(0), "id").collect() == []
    plan = enrich.tagged(df, taxonomy, "id")._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan.split("Exchange", 1)[0] and "ingenieur" not in plan


def test_skills_of_an_alias_do_not_multiply_its_places(spark):
    many = [("a", f"s{i:03}") for i in range(200)] + [("a b", "pair"), ("c", "s007")]
    taxonomy = spark.createDataFrame(many, "alias string, skill string")
    df = spark.createDataFrame([(1, "a c " * 50, "a"), (2, "a b", "b a b"), (3, None, "b c")], "id bigint, title string, description string")
    tagged = enrich.tagged(df, taxonomy, "id")
    assert {r.id: r.skills for r in tagged.collect()} == {1: [f"s{i:03}" for i in range(200)], 2: ["pair"], 3: ["s007"]}
    # Skills join in above the window over places, so 200 of them are not 200 rows a place.
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert "skill" not in plan[plan.index("Window"):].split("Relation")[0]


def test_small_keyed_files_have_small_filters(spark):
    import pathlib

    from postlake.session import keyed

    path = scratch_path(spark, "keyed")
    keyed(spark.range(50).selectExpr("cast(id as string) AS fingerprint").coalesce(1).write).parquet(path)
    file = next(pathlib.Path(path.removeprefix("file:")).glob("*.parquet"))
    assert file.stat().st_size < 8000
    held = spark._jvm.org.apache.parquet.hadoop
    reader = held.ParquetFileReader.open(held.util.HadoopInputFile.fromPath(
        spark._jvm.org.apache.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration()))
    block = reader.getFooter().getBlocks().get(0)
    assert reader.getBloomFilterDataReader(block).readBloomFilter(block.getColumns().get(0)) is not None
    reader.close()


def test_a_run_writes_a_file_for_each_bucket(spark):
    import pathlib

    from postlake.operators.state import fold as state_fold

    store = Store(spark, scratch_path(spark, "files"), buckets=4)
    for number in range(3):
        rows = spark.range(40 * (number + 1)).repartition(8).select(
            F.sha1(F.col("id").cast("string").cast("binary")).alias("fingerprint"), F.lit("s").alias("source"),
            F.concat(F.lit(f"{number} "), "id").alias("title"), F.lit(number).cast("bigint").alias("run_seq"),
            F.col("id").alias("ingest_seq"), F.lit(NOW).alias("seen_at"))
        empty = {f.name: F.lit(None).cast(f.dataType) for f in store.empty_state().schema.fields
                 if f.name not in (*rows.columns, "first_seen_at", "last_seen_at")}
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            store.upsert(state_fold(rows.withColumns(empty)), f"r/{number}")
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list(pathlib.Path(store.folder("state").removeprefix("file:")).rglob("*.parquet"))
    assert store.state().count() == 120 and len(files) == 3 * 4


def test_a_run_leaves_no_tables_of_its_own(spark, monkeypatch):
    """Buckets are rewritten a few at a time, and what a run only writes for itself goes."""
    import pathlib

    from postlake import session
    from postlake.plans import store as stores

    def own():
        folder = pathlib.Path(session._session_folder(spark).removeprefix("file:"))
        return {p.name for p in folder.iterdir() if p.name.startswith(("stage-", "kept-", "batch-", "micro-batch-"))}

    monkeypatch.setattr(stores, "_AT_ONCE", 1, raising=False)
    store, landing = Store(spark, scratch_path(spark, "tidied"), buckets=4), scratch_path(spark, "landing")
    checkpoint = scratch_path(spark, "ck")
    spark.range(1).write.parquet(scratch_path(spark, "any"))
    before = own()
    for day in (1, 2):
        raw(spark, *[{"external_id": str(i), "title": f"day {day}"} for i in range(20 * day)]).write.mode("append").json(landing)
        query = stream.start(stream.read_landing(spark, landing), store, checkpoint, clock=lambda n: NOW)
        query.awaitTermination()
        assert query.exception() is None
    again = raw(spark, *[{"external_id": str(i), "title": "batch"} for i in range(30, 50)])
    assert ingest(again, store, Run("b", 9, NOW))["updated"] == 10
    assert own() == before
    titles = {r.external_id: r.title for r in store.state().collect()}
    assert len(titles) == 50 and titles["49"] == titles["30"] == "batch" and titles["29"] == "day 2"
    for bucket, place in store.newest().folders.items():
        written = pathlib.Path(f"{store.folder(place)}/bucket={bucket}".removeprefix("file:"))
        assert len(list(written.glob("*.parquet"))) == 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
