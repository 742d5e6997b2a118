"""Landed pages, dumps, sitemaps, quotas, JSON-LD and state."""

import json

import pytest
from pyspark.sql import functions as F

from postlake.operators import jsonld, state as st
from postlake.sources import api, pages, tables
from postlake.sources.config import ready
from postlake.session import scratch_path


def page(*blocks):
    scripts = "".join(
        '<SCRIPT class=x type="application/ld+json">%s</script>' % (b if isinstance(b, str) else json.dumps(b))
        for b in blocks
    )
    hidden = '<!-- <script type="application/ld+json">{"@type":"JobPosting","title":"no"}</script> -->'
    return f"<html>{hidden}{scripts}<script type='text/plain'>x</script></html>"


FULL = {
    "@type": ["Thing", "JobPosting"], "title": "Team Lead &ndash; Développement",
    "description": "<p>a</p><ul><li>b</li></ul>", "identifier": {"value": "id-7"},
    "datePosted": "2026-08-07T02:02:37+02:00", "employmentType": ["", "durée indéterminée", "x"],
    "hiringOrganization": [{"name": "Acme"}], "jobLocationType": "telecommute",
    "jobLocation": {"address": [{"addressRegion": "Prilly", "postalCode": 1008, "streetAddress": ["", "Rue 1"],
                                 "addressCountry": {"@type": "Country", "name": "Suisse"}}],
                    "geo": {"latitude": "47.405", "longitude": 0}},
    "baseSalary": {"currency": "CHF", "value": {}},
}


def fields(spark, *blocks):
    df = spark.createDataFrame([("https://x.test/1", page(*blocks))], "url string, html string")
    row = jsonld.posting_fields(df).first()
    return {k: v for k, v in row.asDict().items() if v is not None and k != "page_url"}


def test_full_posting(spark):
    assert fields(spark, "{ceci n'est pas du json}", FULL) == {
        "title": "Team Lead – Développement", "description": "a\n- b", "external_id": "id-7",
        "url": "https://x.test/1", "apply_url": "https://x.test/1", "posted_at": "2026-08-07",
        "contract_type": "permanent", "company": "Acme", "remote_policy": "remote", "city": "Prilly",
        "postal_code": "1008", "country": "CH", "location_raw": "Rue 1, 1008, Prilly", "lat": 47.405, "lon": 0.0,
    }


def test_pages_without_a_posting(spark):
    assert fields(spark) == {} == fields(spark, "{ceci}") == fields(spark, {"@type": "Person"}, "[1]", "null")


def test_envelopes_and_kinds(spark):
    graph = {"@graph": [{"@type": "WebPage"}, 5, {"@type": "JobPosting", "title": "Testeur"}]}
    assert fields(spark, graph)["title"] == "Testeur"
    assert fields(spark, [1, {"@type": "JobPosting", "title": {"@value": ["", "&nbsp;", "x "]}}])["title"] == "x"
    assert fields(spark, {"@type": "JobPosting", "title": "a"}, {"@type": "JobPosting", "title": "b"})["title"] == "a"
    assert fields(spark, '{"@type":"JobPosting","title":"a","title":"b"}')["title"] == "b"
    assert fields(spark, {"@type": "JobPosting", "identifier": 12, "hiringOrganization": "Acme"}).items() >= {
        "external_id": "12", "company": "Acme"}.items()


def test_deep_text_beside_strings_with_backslashes_and_quotes(spark):
    for text in ("\\", "a\\", "\\\\", '"', '\\"', '[{,"\\'):
        deep = {"@type": "JobPosting", "title": {"a": text, "name": [[[[[["", text, "ok"]]]]]], "b": text}}
        assert fields(spark, deep)["title"] == text
        deep["title"] = {"a": text, "name": [[[[[["", {"other": text}, {"name": [["ok"]]}]]]]]], "b": text}
        assert fields(spark, deep)["title"] == "ok"


@pytest.mark.parametrize("salary,want", [
    ({"currency": "CHF", "value": {"minValue": 1000, "maxValue": "2'000"}}, (1000.0, 2000.0, "CHF")),
    ([{"currencyCode": "EUR", "value": {"value": "55 000"}}], (55000.0, 55000.0, "EUR")),
    ({"currency": "EUR", "value": 40000}, (40000.0, 40000.0, "EUR")),
    ({"value": [{"minValue": 7}]}, (7.0, None, None)),
    ({"currency": "CHF"}, (None, None, None)), ("80000", (None, None, None)),
])
def test_structured_salary(spark, salary, want):
    got = fields(spark, {"@type": "JobPosting", "baseSalary": salary})
    assert tuple(got.get(k) for k in ("salary_min", "salary_max", "salary_currency")) == want


def test_locality_beats_region(spark):
    got = fields(spark, {"@type": "JobPosting", "jobLocation": [
        "somewhere", {"address": "text"},
        {"address": {"addressLocality": "Genève", "addressRegion": "GE", "addressCountry": "fr"}}]})
    assert (got["city"], got["region"], got["country"], got["location_raw"]) == ("Genève", "GE", "FR", "Genève")


def test_overlay_wins_and_untitled_pages_go(spark):
    rows = [("u1", page({"@type": "JobPosting", "title": "a", "hiringOrganization": "A"})), ("u2", page())]
    found = jsonld.posting_fields(spark.createDataFrame(rows, "url string, html string"))
    laid = pages.overlay(found, {"company": F.lit(None).cast("string")})
    assert [(r.url, r.title, r.company) for r in pages.accept(laid).collect()] == [("u1", "a", None)]


def test_listing_links(spark):
    html = (
        '<a href="/offre/1">a</a><a class="next" href="?page=2">n</a><A HREF=\'offre/../b/./2&amp;x\'>q</A>'
        '<a href=//h/offre/3>w</a><!-- <a href="/offre/9"> --><a href="/offre/1">again</a>'
        "<script>var x = '<a href=\"/offre/8\">';</script><abbr href='/offre/7'>"
    )
    df = spark.createDataFrame(
        [("https://x.test/liste/a?page=1", html), ("https://x.test/empty", "<p>")], "url string, html string")
    links = [(r.link_pos, r.link) for r in pages.listing_links(df).collect()]
    assert links == [(0, "https://x.test/offre/1"), (1, "https://x.test/liste/a?page=2"),
                     (2, "https://x.test/liste/b/2&x"), (3, "https://h/offre/3")]
    kept = [r.link for r in pages.listing_links(df, "/offre/").collect()]
    assert kept == ["https://x.test/offre/1", "https://h/offre/3"]


def test_api_dumps(spark):
    dumps = spark.createDataFrame([
        ("s", 0, '[{"t":"a","n":1},{"t":"b"},null,5]'), ("s", 1, '[{"t":"c"}]'), ("s", 2, '{"a":1}'),
        ("s", 3, "<html>"), ("s", 4, None),
    ], "source string, page int, body string")
    rows = api.map_rows(api.page_rows(dumps), {"title": "$.t", "n": "$.n"}, keep=("page",))
    assert sorted(tuple(r) for r in rows.collect()) == [(0, "a", "1"), (0, "b", None), (1, "c", None)]
    assert [r.page for r in api.unreadable_pages(dumps).collect()] == [3]
    report = {r.page: tuple(r)[2:] for r in api.page_report(dumps, 4).collect()}
    assert report[0] == (4, False, False) and report[1] == (1, True, False) and report[2] == (0, True, True)
    assert {r.page: r.is_last for r in api.page_report(dumps, 1, max_pages=1).collect()}[0] is True


def test_sitemaps(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<urlset><url><loc> https://x/job/2 </loc><lastmod>2026-01-01</lastmod></url>"
        "<url><loc>https://x/about</loc></url></urlset>")
    (tmp_path / "b.xml").write_text("<urlset><url><loc>https://x/job/1</loc></url></urlset>")
    assert sorted(r["loc"] for r in pages.read_sitemaps(spark, str(tmp_path), "/job/").collect()) == [
        "https://x/job/1", "https://x/job/2"]
    assert [r["loc"] for r in pages.read_sitemaps(spark, str(tmp_path), "/job/", limit=1).collect()] == ["https://x/job/2"]
    # The quota counts entries before the rule: the second one is no job.
    assert len(pages.read_sitemaps(spark, str(tmp_path), "/job/", limit=2).collect()) == 1
    assert len(pages.read_sitemaps(spark, str(tmp_path), "/job/", limit=3).collect()) == 2
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "i.xml").write_text("<sitemapindex><sitemap><loc>https://x/s.xml</loc></sitemap></sitemapindex>")
    assert pages.read_sitemap_indexes(spark, str(tmp_path / "i")).first()["loc"] == "https://x/s.xml"


@pytest.mark.parametrize("limit", [None, "", "0", 3, "70000"])
def test_quota(spark, limit):
    # One source holds most rows and more than one slice of the landing order.
    df = spark.range(150_000).select(
        (F.col("id") * 3).alias("ingest_seq"),
        F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 1000 == 1, None).otherwise("big").alias("source"),
    ).orderBy(F.rand(1))
    got = {r.source: (r.n, r.last) for r in tables.quota_per_source(df, limit).groupBy("source").agg(
        F.count("*").alias("n"), F.max("ingest_seq").alias("last")).collect()}
    n = None if limit in (None, "", "0") else int(limit)
    for source in ("small", "big", None):
        mine = [i * 3 for i in range(150_000)
                if ("small" if i % 10 == 0 else None if i % 1000 == 1 else "big") == source][:n]
        assert got[source] == (len(mine), mine[-1])


def test_sources_ready():
    needs = {"second": (), "first": ("TOKEN",), "third": ("TOKEN", "SECRET")}
    assert ready(needs, {"TOKEN": "t"}) == ["first", "second"]
    assert ready(needs, {}) == ["second"] and ready({}, {}) == []


def test_union_and_stamp(spark):
    a = spark.createDataFrame([(1, "t")], "ingest_seq long, title string")
    b = spark.createDataFrame([(1, "own"), (2, None)], "ingest_seq long, source string")
    both = tables.union_sources({"b": b, "a": a})
    assert sorted((r.source, r.title) for r in both.collect()) == [("a", "t"), ("b", None), ("own", None)]
    assert [tuple(r) for r in tables.stamp(b, "z", "now").collect()] == [(1, "own", "now"), (2, "z", "now")]


def sighting(spark, *rows):
    return spark.createDataFrame(rows, "fingerprint string, run_seq long, ingest_seq long, title string, seen_at string")


def test_fold_equals_upsert_run_by_run(spark):
    rows = [("a", 1, 0, "t1", "2026-01-01"), ("a", 1, 1, "t2", "2026-01-01"), ("b", 1, 2, "x", "2026-01-01"),
            ("a", 2, 0, None, "2026-06-01"), ("c", 3, 0, "c", "2026-05-01"), ("b", 3, 1, "y", "2026-05-01")]
    history = sighting(spark, *rows)
    fold = lambda df: st.fold(df, content=("title",))
    state = fold(history.filter("run_seq = 1"))
    for run in (2, 3):
        step = st.upsert(state, fold(history.filter(f"run_seq = {run}")), content=("title",))
        counts = st.upsert_counts(step).first()
        assert tuple(counts) == ((0, 1) if run == 2 else (1, 1))
        state = step.drop("is_new")
    want = {("a", None, "2026-01-01", "2026-06-01"), ("b", "y", "2026-01-01", "2026-05-01"), ("c", "c", "2026-05-01", "2026-05-01")}
    assert {tuple(r) for r in state.collect()} == want == {tuple(r) for r in fold(history.orderBy(F.rand(5))).collect()}
    removed = st.remove(state, spark.createDataFrame([("a",)], "fingerprint string"))
    assert {r.fingerprint for r in removed.collect()} == {"b", "c"}


def test_archive_keeps_bad_lines(spark):
    from postlake.sources.archive import read_archive

    path = scratch_path(spark, "archive")
    spark.createDataFrame([('{"title":"a","skills":["x"]}',), ("{broken",)], "value string").write.text(
        f"{path}/source=s/run_id=r")
    rows = {r.title: r for r in read_archive(spark, path).collect()}
    assert rows["a"].skills == ["x"] and rows["a"].source == "s" and rows["a"].run_id == "r"
    assert rows[None]._bad_line == "{broken"
