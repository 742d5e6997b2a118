"""Sitemap trees, exact quantiles, and the fold that fetches content last."""

import gzip
import hashlib
import math
import pathlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.operators import reports, state as st
from postlake.plans import queries
from postlake.session import scratch_path
from postlake.sources import pages

ROOT = "https://s.example.org/root.xml"


def land(folder: str, address: str, *locs: str, index: bool = False) -> None:
    site = pathlib.Path(folder) / f"site={hashlib.sha1(address.encode()).hexdigest()}"
    site.mkdir(parents=True)
    root, row = ("sitemapindex", "sitemap") if index else ("urlset", "url")
    rows = "".join(f"<{row}><loc> {loc} </loc><lastmod>2026-01-01</lastmod></{row}>" for loc in locs)
    (site / "f.xml.gz").write_bytes(gzip.compress(f"<{root}>{rows}<{row}><lastmod>x</lastmod></{row}></{root}>".encode()))


@pytest.fixture
def landed(tmp_path):
    """The root names b, an index c and a; c names a deeper index, itself, the root and b."""
    folder = str(tmp_path / "maps")
    at = "https://s.example.org/{}.xml".format
    land(folder, ROOT, at("b"), at("c"), at("a"), at("missing"), index=True)
    land(folder, at("c"), at("d"), at("c"), ROOT, at("b"), index=True)
    land(folder, at("d"), at("e"), index=True)
    for name, n in (("a", 3), ("b", 2), ("e", 4), ("orphan", 5)):
        land(folder, at(name), *[f"https://x.example.org/{name}{i}" for i in range(n)])
    return folder


def ends(df):
    return [r.loc.rsplit("/", 1)[1] for r in df.collect()]


def test_a_tree_is_followed_once(spark, landed):
    found = ends(pages.read_sitemap_tree(spark, landed, [ROOT]))
    assert sorted(found) == ["a0", "a1", "a2", "b0", "b1", "e0", "e1", "e2", "e3"]
    assert sorted(ends(pages.read_sitemap_tree(spark, landed, [ROOT], keep="0$"))) == ["a0", "b0", "e0"]
    files = pages.sitemap_files(spark, landed, [ROOT, ROOT])
    assert files.select("site").distinct().count() == files.count()


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 6, 9, 100])
def test_quota_in_the_order_of_the_tree(spark, landed, limit):
    order = ["b0", "b1", "a0", "a1", "a2", "e0", "e1", "e2", "e3"]
    assert sorted(ends(pages.read_sitemap_tree(spark, landed, [ROOT], limit=limit))) == sorted(order[:limit])


def test_unknown_roots_give_nothing(spark, landed):
    assert pages.read_sitemap_tree(spark, landed, ["https://other.example.org/"], limit=3).collect() == []


def texts(spark, folder):
    """The landed files of a folder as a table, addressed by the tests' names."""
    names = [ROOT, *[f"https://s.example.org/{n}.xml" for n in ("a", "b", "c", "d", "e", "orphan")]]
    found = {hashlib.sha1(n.encode()).hexdigest(): n for n in names}
    rows = [(found[p.name[5:]], gzip.decompress((p / "f.xml.gz").read_bytes()).decode()) for p in pathlib.Path(folder).iterdir()]
    return spark.createDataFrame(rows, "address string, body string").repartition(3)


def test_a_table_of_sitemaps_is_read_as_the_folder(spark, landed):
    table = texts(spark, landed)
    for given in ({"keep": "0$"}, {"limit": 4}):
        in_folder = pages.read_sitemap_tree(spark, landed, [ROOT], **given)
        assert sorted(pages.read_sitemap_tree(spark, table, [ROOT], **given).collect()) == sorted(in_folder.collect()), given
    routes = pages.sitemap_files(spark, table, [ROOT]).collect()
    assert sorted(map(str, routes)) == sorted(map(str, pages.sitemap_files(spark, landed, [ROOT]).collect()))


@pytest.mark.parametrize("body, found", [
    ("<urlset>{a}<url><loc>b?x&y</loc></url>{c}</urlset>", "ac"),
    ("<urlset>{a}<url ><loc>b</lc></url >{c}", "ac"),
    ("<urlset>{a}{c}<url><loc>b</lo", "ac"),
    ("<urlset>{a}<url><loc>b</loc>{c}</urlset>", "ac"),
    ("<urlset>{a}<!-- {b} -->{c}<url>", "ac"),
    ("<urlset>{a}<!-- {b} -->{c}</urlset>", "ac"),
    ("<urlset><url/><url><loc><![CDATA[</url>b]]></loc></url>{c}</urlset>", "</url>bc"),
    ('<?xml version="1.0" encoding="ISO-8859-1"?><urlset xmlns:i="i"><url id="1"><loc> é </loc><i:x><i:loc>b</i:loc></i:x></url></urlset>', "é"),
    ("<html>{b}</html>", "b"), ("", ""), (None, ""), ("<urlset></urlset>", ""), ("</url></url>", ""),
])
def test_odd_sitemap_texts(spark, body, found):
    named = {n: f"<url><loc>{n}</loc><lastmod>1</lastmod></url>" for n in "abc"}
    table = spark.createDataFrame([(ROOT, body and body.format(**named))], "address string, body string")
    rows = pages._landed(spark, table, "url", "loc string, lastmod string").orderBy("place").collect()
    assert "".join(r.loc for r in rows) == found


def test_a_text_is_hashed_and_read_once_whatever_its_entries(spark, landed):
    path = scratch_path(spark, "texts")
    texts(spark, landed).write.parquet(path)
    rows = pages._landed(spark, spark.read.parquet(path), "url", "loc string, lastmod string")
    above, generate, below = rows._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert generate and "sha1(" not in above and "from_xml(" not in above
    # The whole text, and its entries where that fails: no filter asks for them again.
    assert below.count("from_xml(") == 2 and "Filter" not in below


def test_sitemaps_do_not_lie_in_a_file_each(spark, tmp_path):
    spark.range(4000).selectExpr(
        "id AS doc_id", "'' AS text", "'en' AS lang", "concat('s', id % 3) AS source").write.parquet(f"{tmp_path}/documents.parquet")
    landed = queries._sitemaps(spark, str(tmp_path))
    assert landed.count() == 100 + 15 + 1
    assert len(landed.inputFiles()) <= 12
    found = ends(queries.QUERIES["sitemap_tree"](spark, str(tmp_path)))
    assert sorted(map(int, found)) == [i for i in range(4000) if i // 40 % 5 != 4]
    first = [i for i in range(4000) if i // 40 % 5 != 4][:queries.MAP_QUOTA]
    assert sorted(map(int, ends(queries.QUERIES["sitemap_tree_quota"](spark, str(tmp_path))))) == first


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles(spark, parts):
    rng = random.Random(5)
    rows = [("hot", round(rng.lognormvariate(3, 2), rng.randint(0, 3))) for _ in range(3000)]
    rows += [(f"g{i % 9}", float(rng.randint(-5, 5))) for i in range(400)]
    rows += [("same", 4.25)] * 50 + [("one", -1.5), (None, 2.0), (None, 8.0), ("hot", None), ("none", None), ("one", math.nan)]
    shares = [0, 0.01, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.k: (r.n, r.quantiles) for r in reports.quantiles(df, "k", "v", shares).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    given = defaultdict(list)
    for k, v in rows:
        if v is not None and not math.isnan(v):
            given[k].append(v)
    assert set(found) == set(given)
    for k, values in given.items():
        assert found[k][0] == len(values)
        assert np.allclose(found[k][1], np.quantile(values, shares), rtol=1e-12, atol=1e-12), k


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert reports.quantiles(df, "k", "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        reports.quantiles(df, "k", "v", [1.5])


def test_content_is_fetched_last(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), rng.choice([None, f"text {i}"]), rng.choice([None, 1, 2, 3]), i, f"2026-01-{i % 28 + 1:02d}")
            for i in range(200)]
    seen = spark.createDataFrame(rows, "fingerprint string, description string, run_seq long, ingest_seq long, seen_at string")
    path = scratch_path(spark, "history")
    table = f"history_{path.rsplit('-', 1)[1]}"
    st.write_history(seen.filter("ingest_seq < 90"), table, path, buckets=4)
    history = st.write_history(seen.filter("ingest_seq >= 90"), table, path, buckets=4)
    wide = st.fold_wide(history, content=("description",))
    plain = st.fold(seen, content=("description",))
    assert sorted(map(str, wide.collect())) == sorted(map(str, plain.select(*wide.columns).collect()))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert not any("description" in line for line in plan.splitlines() if "Aggregate" in line)
