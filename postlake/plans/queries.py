"""The registered queries: every operator over the given tables, whole."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import to_iso_date
from ..functions.numbers import to_float
from ..functions.text import decode_entities, html_to_text, slug, tokens
from ..functions.variants import text_of
from ..operators import (
    dedup, enrich, index, jsonld, lists, normalise as norm, reports, search, state as st, validate,
)
from ..schema import RAW_SCHEMA
from ..session import keyed, materialise, prepare, scratch_path
from ..sources import api, archive, pages
from ..sources.tables import quota_per_source, read_table, stamp, union_sources
from ..streaming import ingest as stream
from . import corpus
from .ingest import Run, ingest, replay
from .store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The searches, by query name: what is typed and the filters beside it.
SEARCHES: dict[str, tuple[str, dict]] = {
    "search_bm25": ("thatin OR belich", {}),
    "search_phrase": ('"of the" "in that"', {}),
    "search_prefix": ("erkei* und", {}),
    "search_boolean": ("der and die NOT thatin OR the of not que", {}),
    "search_accents": ("NEUCHATEL für OR Étoile", {}),
    "search_filtered": (
        "the", {"region": "NE", "skills": ["python", "spark"], "workload_min": 60,
                "salary_min": 60000.0, "lang": "en"},
    ),
}
INDEXED = ("search_boolean", "search_phrase", "search_filtered", "search_prefix")
WANTED = hashlib.sha1(b"src0|0").hexdigest()

TAXONOMY = {
    "articles": ["the", "der", "la", "el"],
    "of-the": ["of the", "de la", "von der"],
    "greeting": ["aich belich", "für"],
    "numbers": ["un", "ein", "uno"],
}


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(prepare(spark), folder)

    QUERIES[function.__name__] = run
    return function


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("external_id", F.round("rank", 6).alias("rank"))


# -- search ---------------------------------------------------------------


def _lists(spark: SparkSession, folder: str, bits: int = 8) -> lists.Lists:
    return lists.write_lists(corpus.postings(spark, folder), scratch_path(spark, "lists"), folders=8, bits=bits)


def _register_searches() -> None:
    def scanned(text: str, filters: dict) -> Query:
        return lambda spark, folder: _ranks(
            search.search(corpus.postings(spark, folder), text, limit=None, **filters)
        )

    def indexed(text: str, filters: dict) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            state = corpus.postings(spark, folder)
            path = scratch_path(spark, "index")
            index.write_index(state, path)
            light = corpus.postings(spark, folder)
            stored = index.read_index(spark, path)
            return _ranks(index.search_index(stored, light, text, limit=None, **filters))

        return run

    def listed(text: str, filters: dict) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            stored = _lists(spark, folder)
            return _ranks(lists.search_lists(stored, corpus.postings(spark, folder), text, limit=None, **filters))

        return run

    for name, (text, filters) in SEARCHES.items():
        function = scanned(text, filters)
        function.__name__ = name
        query(function)
    for name in INDEXED:
        function = indexed(*SEARCHES[name])
        function.__name__ = name.replace("search_", "index_search_")
        query(function)
        function = listed(*SEARCHES[name])
        function.__name__ = name.replace("search_", "lists_search_")
        query(function)


_register_searches()


@query
def search_page(spark, folder):
    found = search.search(corpus.postings(spark, folder), "the of", limit=20, offset=20)
    return _ranks(found)


@query
def search_full_rows(spark, folder):
    """A page with all columns of its postings."""
    found = search.search(corpus.postings(spark, folder), "the of", limit=20)
    return found.withColumns({
        "rank": F.round("rank", 6), "keywords": F.array_join("keywords", "|"), "skills": F.array_join("skills", "|")})


@query
def browse_offset(spark, folder):
    """Everything after the first hits, without a limit."""
    found = search.search(corpus.postings(spark, folder), None, limit=None, offset=37, lang="en")
    return found.select("external_id", "posted_at")


@query
def search_offset(spark, folder):
    found = search.search(corpus.postings(spark, folder), "the of", limit=None, offset=11)
    return _ranks(found)


@query
def index_dictionary(spark, folder):
    """Every term of the index and the postings that have it."""
    return _lists(spark, folder).dictionary.select("term", "postings")


@query
def index_phrase_pairs(spark, folder):
    """Every two common words that follow each other: the postings a phrase of them
    reads, the places in these, and the postings that the lists of both words hold."""
    stored = _lists(spark, folder)
    pairs = stored.listed("pairs").select("term", F.inline("entries")).groupBy("term").agg(
        F.count("*").alias("postings"), F.sum(F.size("places")).cast("bigint").alias("places"))
    words = stored.dictionary.select("term", F.col("postings").alias("n"))
    named = pairs.select("*", *[F.split_part("term", F.lit(" "), F.lit(i + 1)).alias(w) for i, w in enumerate("ab")])
    return (
        named.join(words.withColumnsRenamed({"term": "a", "n": "_a"}), "a")
        .join(words.withColumnsRenamed({"term": "b", "n": "_b"}), "b")
        .select("term", "postings", "places", (F.col("_a") + F.col("_b")).alias("in_lists"))
    )


#: Words of which some are rare, so that few blocks can hold the best postings.
TOP = "thatin OR belich OR neuchatel OR the"


@query
def index_top_k(spark, folder):
    """The best postings by block bounds."""
    found, _ = lists.top_k(_lists(spark, folder, bits=3), corpus.postings(spark, folder), TOP, 20)
    return _ranks(found)


@query
def get_many(spark, folder):
    """The postings of all labelled documents, from a table with filters of its keys."""
    rows = corpus.postings(spark, folder).select("fingerprint", "external_id", "title", "description")
    path = scratch_path(spark, "keyed")
    keyed(rows.repartition(8).write).parquet(path)
    labelled = read_table(spark, folder, "labels", "doc_id").distinct()
    keys = corpus.documents(spark, folder, "doc_id", "source").join(labelled, "doc_id", "left_semi").select(
        norm.fingerprint(F.col("source"), F.col("doc_id").cast("string"), F.lit(None)).alias("fingerprint"))
    return search.get_many(spark.read.parquet(path), keys)


@query
def search_browse(spark, folder):
    found = search.search(
        corpus.postings(spark, folder), "  ", limit=50, city="neuch", company="r_a%",
        posted_since="2026-03-01",
    )
    return found.select("external_id", "rank", "city", "posted_at")


@query
def search_count(spark, folder):
    return search.count(corpus.postings(spark, folder), "the NOT of", country="CH", workload_min=70)


@query
def index_refresh(spark, folder):
    """The index follows changed and removed postings."""
    state = corpus.postings(spark, folder)
    labels = read_table(spark, folder, "labels", "doc_id", "toxic")
    labelled = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = materialise(state.join(labelled, "doc_id", "left"), "marked")
    old = marked.withColumn(
        "title", F.when(F.col("toxic").isNotNull(), F.lit("old thatin")).otherwise(F.col("title"))
    )
    gone = marked.filter("toxic = 1")
    now = marked.filter("toxic is null or toxic = 0")
    path = scratch_path(spark, "index")
    index.write_index(old, path)
    fresh = index.refresh_index(
        index.read_index(spark, path), now.filter("toxic = 0"), index.corpus_of(now), gone
    )
    return _ranks(index.search_index(fresh, now, "thatin OR der", limit=None))


@query
def index_refresh_all(spark, folder):
    """Hits in changed, unchanged and no longer in removed postings, by kind."""
    state = corpus.postings(spark, folder)
    k = F.col("doc_id") % 4
    old = state.withColumn("title", F.when(k == 0, F.lit("zyxold")).when(k == 1, F.lit("zyxgone")).otherwise(F.lit("zyxkept")))
    now = state.filter(k != 1).withColumn("title", F.when(k == 0, F.lit("zyxnew")).otherwise(F.lit("zyxkept")))
    path = scratch_path(spark, "index")
    index.write_index(old, path)
    fresh = index.refresh_index(
        index.read_index(spark, path), now.filter(k == 0), index.corpus_of(now), old.filter(k == 1).select("fingerprint"))
    return _ranks(index.search_index(fresh, now, "zyxold OR zyxgone OR zyxnew OR zyxkept", limit=None))


@query
def get_by_fingerprint(spark, folder):
    found = search.get(corpus.postings(spark, folder), WANTED)
    return found.select("fingerprint", "external_id", "url", "title", "description")


# -- reports --------------------------------------------------------------


def _light(spark, folder):
    return corpus.postings(spark, folder)


@query
def facet_source(spark, folder):
    return reports.facets(_light(spark, folder), "source", limit=50)


@query
def facet_lang(spark, folder):
    return reports.facets(_light(spark, folder), "lang")


@query
def facet_company(spark, folder):
    return reports.facets(_light(spark, folder), "company", country="CH", salary_min=55000.0)


@query
def facet_city_filtered(spark, folder):
    return reports.facets(
        _light(spark, folder), "city", lang="en", skills=["sql"], posted_since="2026-02-01"
    )


@query
def top_skills(spark, folder):
    return reports.top_terms(_light(spark, folder), "skills", workload_min=0)


@query
def top_terms_text(spark, folder):
    docs = corpus.documents(spark, folder, "doc_id", "text")
    return reports.top_terms(docs.select(tokens(F.col("text")).alias("keywords")), "keywords", 100)


@query
def timeline_days(spark, folder):
    events = corpus.sightings(spark, folder).select(
        F.lit(None).cast("string").alias("posted_at"), F.col("seen_at").alias("first_seen_at")
    )
    return reports.timeline(events, days=20)


@query
def timeline_postings(spark, folder):
    return reports.timeline(_light(spark, folder), days=45, contract_type="permanent")


@query
def summary(spark, folder):
    return reports.summary(_light(spark, folder))["totals"]


@query
def facets_all(spark, folder):
    """Nine facets from one scan."""
    return reports.all_facets(_light(spark, folder).withColumns({
        "remote_policy": F.lit(None).cast("string"), "seniority": F.lit("")}), 20, workload_min=50)


@query
def summary_by_country(spark, folder):
    return reports.summary(_light(spark, folder))["by_country"]


@query
def counts_by_source(spark, folder):
    return reports.counts_by_source(_light(spark, folder))


@query
def total(spark, folder):
    return reports.total(_light(spark, folder))


# -- normalisation --------------------------------------------------------


def _normalised(spark, folder):
    raw = corpus.raw_postings(spark, folder)
    return norm.normalise(raw, "2026-09-01T00:00:00Z").withColumnRenamed("ingest_seq", "doc_id")


@query
def normalise_text(spark, folder):
    return _normalised(spark, folder).select("doc_id", "title", "description", "external_id", "scraped_at")


@query
def normalise_numbers(spark, folder):
    return _normalised(spark, folder).select(
        "doc_id", "lat", "salary_min", "salary_currency", "workload_min", "workload_max"
    )


@query
def normalise_dates(spark, folder):
    return _normalised(spark, folder).select("doc_id", "posted_at")


@query
def normalise_lists(spark, folder):
    df = _normalised(spark, folder)
    return df.select(
        "doc_id", F.array_join("skills", "|").alias("skills"), F.size("keywords").alias("n_keywords")
    )


@query
def normalise_country(spark, folder):
    return _normalised(spark, folder).select("doc_id", "country")


@query
def normalise_fingerprint(spark, folder):
    return _normalised(spark, folder).select("doc_id", "fingerprint")


@query
def salary_extract(spark, folder):
    return norm.with_salary(corpus.pay_texts(spark, folder), "pay", "hint").select(
        "doc_id", "salary_min", "salary_max", "salary_currency"
    )


@query
def salary_coverage(spark, folder):
    df = norm.with_salary(corpus.pay_texts(spark, folder), "pay", "hint")
    return norm.coverage(df, "salary_min", "salary_max")


@query
def workload_extract(spark, folder):
    return norm.with_workload(corpus.pay_texts(spark, folder), "rate").select(
        "doc_id", "workload_min", "workload_max"
    )


@query
def workload_in_texts(spark, folder):
    """Workload reading over whole texts, with its coverage."""
    df = norm.with_workload(corpus.pay_texts(spark, folder), "text")
    return norm.coverage(df, "workload_min", "workload_max")


@query
def dates_written(spark, folder):
    """Order dates in all spellings, a partial one among them."""
    df = corpus.written_dates(spark, folder)
    return df.select("o_orderkey", to_iso_date(F.col("written")).alias("day"))


@query
def amounts_written(spark, folder):
    """Prices in all spellings."""
    df = corpus.written_amounts(spark, folder)
    cents = F.round(to_float(F.col("written")) * 100).cast("bigint")
    return df.select("l_orderkey", "l_linenumber", cents.alias("cents"))


@query
def workload_numbers(spark, folder):
    """Numeric columns as workload and as salary."""
    df = read_table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    df = df.withColumns({"half": F.col("l_quantity") + 0.5, "pay": F.col("l_extendedprice") * 1000})
    df = norm.with_salary(norm.with_workload(df, "half"), "pay").drop("salary_max", "salary_currency")
    hinted = norm.with_salary(df.withColumn("hint", F.lit("CHF")), "pay", "hint")
    return hinted.select("l_orderkey", "l_linenumber", "workload_min", "workload_max",
                         F.round("salary_min", 1).alias("salary_min"), "salary_currency")


@query
def entities_numeric(spark, folder):
    """Every number as a decimal and a hexadecimal reference behind leading zeros."""
    k = F.col("doc_id") % 1000 + 33
    text = F.concat(
        F.lit("&#"), F.lpad(k.cast("string"), 14, "0"), F.lit(";&#x"), F.lpad(F.hex(k), 17, "0"), F.lit(";&#"),
        F.lpad(k.cast("string"), 25, "9"), F.lit(";"))
    docs = corpus.documents(spark, folder, "doc_id")
    return docs.select("doc_id", F.hex(F.encode(decode_entities(text), "UTF-8")).alias("bytes"))


@query
def slugs(spark, folder):
    docs = corpus.documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", slug(F.col("text")).alias("slug"))


@query
def pages_to_text(spark, folder):
    df = read_table(spark, folder, "pages", "page_id", "html")
    return df.select("page_id", html_to_text(F.col("html")).alias("text"))


# -- sources --------------------------------------------------------------


@query
def page_links(spark, folder):
    df = read_table(spark, folder, "pages", "page_id", "url", "html")
    return pages.listing_links(df).select("page_id", "link_pos", "link")


@query
def page_links_kept(spark, folder):
    df = read_table(spark, folder, "pages", "page_id", "url", "html")
    return pages.listing_links(df, r"^/(the|and|de)").select("page_id", "link_pos", "link")


@query
def jsonld_postings(spark, folder):
    found = jsonld.posting_fields(corpus.detail_pages(spark, folder))
    return pages.accept(found).drop("page_url", "source")


@query
def jsonld_blocks(spark, folder):
    blocks = jsonld.extract_blocks(corpus.detail_pages(spark, folder))
    kinds = blocks.withColumn("is_posting", jsonld.is_posting(F.col("block")))
    return kinds.groupBy("source", "block_pos", "is_posting").agg(F.count("*").alias("n"))


@query
def jsonld_deep(spark, folder):
    """Whole texts nested as deep as the document's number says."""
    k = F.col("doc_id") % 12
    docs = corpus.documents(spark, folder, "doc_id", "text")
    whole = F.to_json(F.struct(F.col("text").alias("name")))
    deep = F.aggregate(F.sequence(F.lit(1), k + 1), whole, lambda inner, i: F.when(
        i % 3 == 0, F.concat(F.lit('[null,"",{"other":"no"},'), inner, F.lit(',"late"]'))
    ).otherwise(F.concat(F.lit('{"text":"no","value":'), inner, F.lit("}"))))
    return docs.select("doc_id", text_of(F.try_parse_json(deep)).alias("text"))


@query
def sources_stamped(spark, folder):
    """Source and time where a row has none of its own."""
    docs = read_table(spark, folder, "documents", "doc_id", "source", "lang").withColumn(
        "source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    return stamp(docs, "stamped", F.concat(F.lit("2026-09-0"), (F.col("doc_id") % 9 + 1).cast("string")))


@query
def detail_overlay(spark, folder):
    """A site's own columns win over the embedded ones, with NULL as well."""
    found = jsonld.posting_fields(corpus.detail_pages(spark, folder))
    laid = pages.overlay(found, {
        "company": F.col("source"),
        "city": F.lit(None).cast("string"),
        "title": F.when(F.col("source") == "src3", F.lit("")).otherwise(F.col("title")),
    })
    return pages.accept(laid).select("url", "title", "company", "city", "contract_type")


def _dumps(spark, folder):
    """Documents as landed API pages of a hundred rows each."""
    docs = read_table(spark, folder, "documents", "doc_id", "lang", "n_chars")
    row = F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("name"), "n_chars")
    page = F.floor(F.col("doc_id") / 100).cast("int")
    lists = docs.groupBy(page.alias("page")).agg(
        F.to_json(F.sort_array(F.collect_list(row))).alias("body")
    )
    p = F.col("page")
    body = (
        F.when(p % 7 == 6, F.lit("<html>busy</html>"))
        .when(p % 7 == 5, F.concat(F.lit('{"rows":'), F.col("body"), F.lit("}")))
        .otherwise(F.concat(F.lit("[null,7,"), F.expr("substr(body, 2)")))
    )
    return lists.select(F.concat(F.lit("api"), (p % 2).cast("string")).alias("source"), "page",
                        body.alias("body"))


@query
def api_rows(spark, folder):
    rows = api.page_rows(_dumps(spark, folder))
    return api.map_rows(
        rows,
        {"external_id": "$.id", "title": "$.name",
         "size": F.try_variant_get("row", "$.n_chars", "bigint")},
        keep=("source", "page"),
    )


@query
def api_unreadable(spark, folder):
    return api.unreadable_pages(_dumps(spark, folder))


@query
def api_page_report(spark, folder):
    return api.page_report(_dumps(spark, folder), page_size=102)


@query
def sitemap_urls(spark, folder):
    links = _light(spark, folder).select(
        F.col("url").alias("loc"), F.col("posted_at").alias("lastmod")
    )
    path = scratch_path(spark, "sitemap")
    links.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").option(
        "compression", "gzip").save(path)
    return pages.read_sitemaps(spark, path, keep="src1")


#: Entries of a sitemap, sitemaps of an index, and the quota of entries.
MAP_SIZE, INDEX_SIZE, MAP_QUOTA = 40, 7, 130
_ROOT = "https://maps.example.org/root.xml"


def _sitemaps(spark, folder) -> DataFrame:
    """The postings as landed sitemaps below indexes below a root index, a row with the XML
    text of each. Each index leads back to the root and names its first sitemap twice; every
    fifth sitemap is in none."""
    number = F.expr(f"doc_id div {MAP_SIZE}")

    def address(kind: str, n) -> F.Column:
        return F.concat(F.lit(f"https://maps.example.org/{kind}-"), n.cast("string"), F.lit(".xml"))

    def land(rows: DataFrame, root: str, tag: str, order: str, *fields: str) -> DataFrame:
        # The format bounds the entries of a file, so a list of them is bounded too.
        listed = F.sort_array(F.collect_list(F.struct(order, *fields)))
        entries = F.transform(listed, lambda e: F.struct(*[e[c].alias(c) for c in fields]))
        return rows.groupBy("address").agg(F.to_xml(F.struct(entries.alias(tag)), {"rowTag": root}).alias("body"))

    urls = land(_light(spark, folder).select(
        "doc_id", F.col("url").alias("loc"), F.col("posted_at").alias("lastmod"),
        address("urls", number).alias("address")), "urlset", "url", "doc_id", "loc", "lastmod")
    maps = corpus.documents(spark, folder, "doc_id").select(number.alias("n")).distinct()
    upper = F.expr(f"n div {INDEX_SIZE}")
    named = maps.filter("n % 5 <> 4").select(upper.alias("u"), "n", address("urls", F.col("n")).alias("loc"))
    indexes = named.groupBy("u").agg(F.min(F.struct("n", "loc")).alias("first"))
    back = indexes.select("u", F.inline(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("n"), F.lit(_ROOT).alias("loc")),
        F.struct(F.lit(1 << 60).alias("n"), F.col("first.loc").alias("loc")))))
    middle = land(named.unionByName(back).withColumn("address", address("index", F.col("u"))),
                  "sitemapindex", "sitemap", "n", "loc")
    top = land(indexes.select("u", address("index", F.col("u")).alias("loc"), F.lit(_ROOT).alias("address")),
               "sitemapindex", "sitemap", "u", "loc")
    return materialise(urls.unionByName(middle).unionByName(top), "maps")


@query
def sitemap_tree(spark, folder):
    """Entries of all sitemaps that a root index leads to."""
    return pages.read_sitemap_tree(spark, _sitemaps(spark, folder), [_ROOT])


@query
def sitemap_tree_quota(spark, folder):
    """The first entries in the order of the tree."""
    return pages.read_sitemap_tree(spark, _sitemaps(spark, folder), [_ROOT], limit=MAP_QUOTA)


@query
def quota(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id", "source", "lang")
    return quota_per_source(docs.withColumnRenamed("doc_id", "ingest_seq"), 17)


@query
def all_sources(spark, folder):
    """Three sources in one run, each held to the same quota."""
    docs = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("ingest_seq"), F.col("doc_id").cast("string").alias("external_id"), "lang"
    )
    landed = read_table(spark, folder, "pages").select(
        F.col("page_id").alias("ingest_seq"), F.col("page_id").cast("string").alias("external_id"), "url"
    )
    talks = read_table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ingest_seq"),
        F.concat_ws("-", "conv_id", "turn").alias("external_id"),
        F.lit("talk").alias("source"),
    )
    return union_sources({"docs": docs, "pages": landed, "conversations": talks}, "300")


@query
def archive_roundtrip(spark, folder):
    state = _light(spark, folder)
    out = norm.normalise(state, "2026-09-01T00:00:00Z").withColumn("run_id", F.lit("r1"))
    path = scratch_path(spark, "archive")
    archive.append_archive(out, path)
    back = archive.read_archive(spark, path)
    return back.select(
        "source", "run_id", "external_id", "title", F.array_join("skills", "|").alias("skills"),
        "workload_max", "salary_max", "posted_at",
    )


# -- validation, duplicates, state ----------------------------------------


@query
def validate_rejects(spark, folder):
    judged = validate.judge(_normalised(spark, folder))
    return validate.rejects(judged).select(
        "doc_id", "reject_reason", F.array_join("missing_fields", "|").alias("missing_fields")
    )


@query
def validate_counts(spark, folder):
    return validate.reject_counts(validate.judge(_normalised(spark, folder)))


def _copies(spark, folder):
    """Documents keyed by their text, so copies share a fingerprint."""
    docs = read_table(spark, folder, "documents")
    keyless = F.col("doc_id") % 29 == 0
    return docs.select(
        F.lit("r1").alias("run_id"),
        F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("source"),
        F.when(~keyless, F.sha1(F.col("text").cast("binary"))).alias("fingerprint"),
        F.col("doc_id").alias("ingest_seq"), "lang",
    )


@query
def dedup_run(spark, folder):
    return dedup.first_per_fingerprint(_copies(spark, folder)).select("ingest_seq", "source", "lang")


@query
def dedup_dropped(spark, folder):
    return dedup.duplicates(_copies(spark, folder)).select("ingest_seq", "source", "lang")


@query
def dedup_counts(spark, folder):
    return dedup.duplicate_counts(_copies(spark, folder))


_SIGHTED = ("source", "title", "salary_min")


@query
def state_fold(spark, folder):
    return st.fold(corpus.sightings(spark, folder), content=_SIGHTED)


_TOLD = ("source", "title", "description")


@query
def state_fold_wide(spark, folder):
    """Whole texts seen under the key of their source and length: content of the last one."""
    k = F.col("doc_id")
    seen = corpus.documents(spark, folder, "doc_id", "source", "lang", "n_chars", "text").select(
        F.sha1(F.concat_ws("|", "source", "lang", F.expr("n_chars div 100")).cast("binary")).alias("fingerprint"),
        "source", F.when(k % 5 != 0, F.concat(F.lit("seen "), k.cast("string"))).alias("title"),
        F.col("text").alias("description"), (k % 7).alias("run_seq"), k.alias("ingest_seq"),
        F.concat(F.lit("2026-09-0"), (k % 7 + 1).cast("string")).alias("seen_at"))
    path = scratch_path(spark, "history")
    history = st.write_history(seen, f"history_{path.rsplit('-', 1)[1]}", path, buckets=16)
    return st.fold_wide(history, content=_TOLD)


def _halves(spark, folder):
    seen = corpus.sightings(spark, folder)
    return (
        st.fold(seen.filter("day < '2024-01-16'"), content=_SIGHTED),
        st.fold(seen.filter("day >= '2024-01-16'"), content=_SIGHTED),
    )


@query
def state_upsert(spark, folder):
    """Two runs, one after the other: the same state as one fold over both."""
    return st.upsert(*_halves(spark, folder), content=_SIGHTED)


@query
def upsert_new_updated(spark, folder):
    return st.upsert_counts(st.upsert(*_halves(spark, folder), content=_SIGHTED))


def _batch(store: Store, seen: DataFrame, bounds: str) -> DataFrame:
    """The sightings within some bounds as the batch of one run."""
    part = seen.filter(bounds).select("*", *[
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in store.empty_state().schema.fields
        if f.name not in (*_SIGHTED, "fingerprint", "first_seen_at", "last_seen_at")
    ])
    return st.fold(part)


def _applied(spark, folder, runs: list[tuple[str, str]]) -> DataFrame:
    """The state after runs (name, bounds) in the order given."""
    store = Store(spark, scratch_path(spark, "store"), buckets=8)
    seen = corpus.sightings(spark, folder)
    for name, bounds in runs:
        store.upsert(_batch(store, seen, bounds), name)
    return store.state().select("fingerprint", *_SIGHTED, "first_seen_at", "last_seen_at")


_WEEKS = ("day < '2024-01-09'", "day >= '2024-01-09' and day < '2024-01-17'",
          "day >= '2024-01-17' and day < '2024-01-25'", "day >= '2024-01-25'")


@query
def state_snapshots(spark, folder):
    """Run by run through the stored state."""
    return _applied(spark, folder, [(f"r/{i}", bounds) for i, bounds in enumerate(_WEEKS)])


@query
def state_late_run(spark, folder):
    """The run with the largest number first: the order of writing counts."""
    return _applied(spark, folder, [(f"r/{i}", _WEEKS[i]) for i in (3, 0, 2, 1)])


@query
def state_two_sources(spark, folder):
    """Runs of several sources under one number."""
    kinds = ("source < 'd'", "source >= 'd' and source < 'r'", "source >= 'r'")
    return _applied(spark, folder, [(f"r{i}/1", bounds) for i, bounds in enumerate(kinds)])


@query
def state_rerun(spark, folder):
    """A run that is repeated at once, and one that is repeated later."""
    runs = [(f"r/{i}", bounds) for i, bounds in enumerate(_WEEKS[:3])]
    return _applied(spark, folder, [runs[0], runs[1], runs[1], runs[2], runs[2], runs[1]])


@query
def state_removed(spark, folder):
    """Postings that were taken out, and one group of them written again."""
    store = Store(spark, scratch_path(spark, "store"), buckets=8)
    seen = corpus.sightings(spark, folder)
    for i, bounds in enumerate(_WEEKS[:2]):
        store.upsert(_batch(store, seen, bounds), f"r/{i}")
    store.remove(seen.filter("source like 'c%'"), "removal")
    store.upsert(_batch(store, seen, _WEEKS[2]), "r/2")
    return store.state().select("fingerprint", *_SIGHTED, "first_seen_at", "last_seen_at")


@query
def publication_duration(spark, folder):
    folded = st.fold(corpus.sightings(spark, folder), content=_SIGHTED)
    return st.publication_duration(folded)


@query
def salary_quantiles(spark, folder):
    """Exact tenths, quartiles and median of what the sightings of a source pay."""
    found = reports.quantiles(corpus.sightings(spark, folder), "source", "salary_min", (0.1, 0.25, 0.5, 0.75, 0.9))
    return found.select("source", "n", *[
        F.round(F.col("quantiles")[i], 4).alias(name) for i, name in enumerate(("p10", "p25", "p50", "p75", "p90"))])


@query
def state_removal(spark, folder):
    state = _light(spark, folder)
    labels = read_table(spark, folder, "labels", "doc_id", "toxic").filter("toxic = 1")
    gone = state.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return st.remove(state, gone).select("external_id", "fingerprint")


# -- enrichment -----------------------------------------------------------


def _tagged(spark, folder, fingerprint):
    state = corpus.postings(spark, folder).withColumn("skills", F.array().cast("array<string>"))
    step = enrich.tag_skills(TAXONOMY)
    return step(state.withColumn("fingerprint", fingerprint)).select(
        "external_id", F.array_join("skills", "|").alias("skills"))


@query
def skill_tagging(spark, folder):
    return _tagged(spark, folder, F.col("fingerprint"))


@query
def skill_tagging_joined(spark, folder):
    """Rows that share a fingerprint, or have none, are tagged by themselves."""
    return _tagged(spark, folder, F.when(F.col("doc_id") % 3 > 0, F.col("source")))


@query
def skill_tagging_signs(spark, folder):
    """Aliases with signs of their own, in texts as they are and with signs added."""
    docs = corpus.documents(spark, folder, "doc_id", "text").withColumns({
        "skills": F.array().cast("array<string>"),
        "title": F.when(F.col("doc_id") % 3 == 0, F.lit("C++, c# & the rest")).when(
            F.col("doc_id") % 3 == 1, F.lit("vitamin c, c+ and nets")).otherwise(F.lit("some .NET/C#")),
        "description": F.col("text")})
    step = enrich.tag_skills({"cpp": ["C++"], "csharp": ["C#"], "dotnet": [".net"], "symbols": ["%%%", "???"]})
    return step(docs).select("doc_id", F.array_join("skills", "|").alias("skills"))


#: Aliases that each document gives to the taxonomy: runs of one to three of its words.
ALIASES, SKILL_COUNT = 20, 97


@query
def skill_tagging_table(spark, folder):
    """Tagging by a table of aliases that are drawn from the texts themselves."""
    docs = corpus.documents(spark, folder, "doc_id", "text")
    given = materialise(docs.select("doc_id", tokens(F.col("text")).alias("t")), "drawn")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(ALIASES - 1)), lambda i: F.struct(
        F.array_join(F.slice("t", 5 * i + 1, 1 + i % 3), " ").alias("alias"),
        F.concat(F.lit("s"), (F.col("doc_id") * ALIASES + i) % SKILL_COUNT).alias("skill")))
    taxonomy = given.select(F.inline(drawn)).filter("alias <> ''")
    texts = docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("description"))
    found = enrich.tagged(texts, taxonomy, "doc_id", ("title", "description"))
    return found.select("doc_id", F.array_join("skills", "|").alias("skills"))


def _seniority(row: dict) -> dict | None:
    """A plain Python step that fails on rows without a company."""
    return {"seniority": "senior" if "AG" in row["company"].split() else None}


@query
def enrich_chain(spark, folder):
    chain = enrich.build_chain([
        enrich.StepPlan("seniority", lambda: enrich.python_step(
            "seniority", _seniority, ["company"], "seniority string"), place=200),
        enrich.StepPlan("remote", lambda: lambda df: df.withColumn(
            "remote_policy", F.when(F.col("seniority") == "senior", F.lit("remote")))),
        enrich.StepPlan("absent", lambda: None, needs=("POSTLAKE_UNSET_VARIABLE",)),
    ])
    narrow = _light(spark, folder).select("external_id", "company", "source")
    return enrich.enrich(narrow, chain.steps).select(
        "external_id", "seniority", "remote_policy",
        F.array_join(enrich.ERRORS, "|").alias("failed"),
    )


# -- whole runs -----------------------------------------------------------


def _two_sources(spark, folder):
    """Raw postings where every eleventh repeats the identifier before it."""
    raw = corpus.raw_postings(spark, folder)
    k = F.col("ingest_seq")
    repeated = F.when(k % 11 == 10, k - 10).otherwise(k).cast("string")
    return raw.withColumns({
        "external_id": repeated,
        "source": F.when(k % 19 != 0, F.concat(F.lit("s"), (k % 3).cast("string"))),
    })


def _ingested(spark, folder) -> Store:
    store = Store(spark, scratch_path(spark, "store"))
    ingest(_two_sources(spark, folder), store, Run("r1", 1, "2026-09-01T00:00:00Z"))
    return store


@query
def ingest_state(spark, folder):
    return _ingested(spark, folder).state().select(
        "fingerprint", "source", "external_id", "title", "posted_at", "first_seen_at"
    )


@query
def ingest_counters(spark, folder):
    return _ingested(spark, folder).metrics().select("counter", "n")


@query
def ingest_rejects(spark, folder):
    return _ingested(spark, folder).rejects().groupBy("reject_reason").agg(F.count("*").alias("n"))


@query
def ingest_overlapping(spark, folder):
    """Rejects of a run whose sources number their rows alike."""
    raw = _two_sources(spark, folder).withColumn("ingest_seq", F.expr("ingest_seq div 3"))
    store = Store(spark, scratch_path(spark, "store"))
    ingest(raw.filter("source is not null"), store, Run("r1", 1, "2026-09-01T00:00:00Z"))
    return store.rejects().groupBy("source", "reject_reason").agg(F.count("*").alias("n"))


@query
def replayed_state(spark, folder):
    """Raw rows landed in two runs and processed from the landing."""
    raw = _two_sources(spark, folder)
    landed = Store(spark, scratch_path(spark, "landed"))
    landed.land(raw.filter("ingest_seq % 2 = 0"), "a", 1)
    landed.land(raw.filter("ingest_seq % 2 = 1"), "b", 2)
    target = Store(spark, scratch_path(spark, "replayed"))
    replay(landed, target, [Run("b", 2, "2026-09-02T00:00:00Z"), Run("a", 1, "2026-09-01T00:00:00Z")])
    return target.state().select(
        "fingerprint", "source", "title", "first_seen_at", "last_seen_at"
    )


@query
def stream_ingest(spark, folder):
    """The same postings from a landing folder, as a stream that takes what is there."""
    raw = _two_sources(spark, folder)
    landing = scratch_path(spark, "landing")
    raw.select(*[c for c in RAW_SCHEMA.names if c in raw.columns], "ingest_seq").write.json(landing)
    store = Store(spark, scratch_path(spark, "streamed"))
    started = stream.start(
        stream.read_landing(spark, landing), store, scratch_path(spark, "stream"),
        clock=lambda number: "2026-09-01T00:00:00Z",
    )
    started.awaitTermination()
    if started.exception():
        raise started.exception()
    return store.state().select(
        "fingerprint", "source", "external_id", "title", "posted_at", "first_seen_at"
    )


def _in_waves(spark, waves: list[DataFrame], begin) -> None:
    """Run a stream over a landing folder that grows by a wave of rows at a time; each
    wave is written by all tasks and is a micro-batch. `begin` starts the stream of a
    landing, from a checkpoint, for the nth wave."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    for number, wave in enumerate(waves, 1):
        wave.write.mode("append").option("compression", "gzip").json(landing)
        started = begin(stream.read_landing(spark, landing), checkpoint, number)
        started.awaitTermination()
        if started.exception():
            raise started.exception()


def _fed(spark, folder, waves: list[DataFrame], **options) -> Store:
    """A store fed by one stream, wave by wave."""
    store = Store(spark, scratch_path(spark, "streamed"))
    _in_waves(spark, waves, lambda rows, checkpoint, day: stream.start(
        rows, store, checkpoint, clock=lambda number: f"2026-09-{day:02d}T00:00:00Z", **options))
    return store


def _many_batches(spark, folder) -> Store:
    """The postings in four micro-batches; repeats fall into others."""
    raw = _two_sources(spark, folder)
    columns = [*[c for c in RAW_SCHEMA.names if c in raw.columns], "ingest_seq"]
    return _fed(spark, folder, [raw.filter(F.col("ingest_seq") % 4 == part).select(*columns) for part in range(4)])


@query
def stream_many_batches(spark, folder):
    return _many_batches(spark, folder).state().select(
        "fingerprint", "source", "external_id", "title", "first_seen_at", "last_seen_at")


@query
def stream_many_counters(spark, folder):
    return _many_batches(spark, folder).metrics().groupBy("counter").agg(F.sum("n").alias("n"))


#: Waves of the stream with late rows, a day apart, and how long it remembers a posting.
WAVES, DELAY = 6, "6 hours"


def _sightings(spark, folder) -> DataFrame:
    """Every document as a posting that is seen on one of three days; half of them again
    on the next day, a fifth three days later, and for a seventh another posting that
    comes two days late. Columns of the landing and the wave that a row comes in."""
    docs = corpus.documents(spark, folder, "doc_id", "text", "source").repartition(8)
    k = F.col("doc_id")
    day = k % 3

    def seen(wave, on, ident, wanted):
        return F.when(wanted, F.struct(
            wave.cast("int").alias("wave"), ident.alias("external_id"),
            F.date_format(F.timestamp_add("SECOND", k % 3600, F.timestamp_add("DAY", on.cast("int"), F.lit("2026-08-01").cast("timestamp"))),
                          "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scraped_at")))

    ident = k.cast("string")
    rows = F.array_compact(F.array(
        seen(day, day, ident, F.lit(True)), seen(day + 1, day + 1, ident, k % 2 == 0),
        seen(day + 3, day + 3, ident, k % 5 == 0), seen(day + 2, day, F.concat(ident, F.lit("-late")), k % 7 == 0)))
    return docs.select(
        "source", F.concat(F.lit("https://x.example.org/"), ident).alias("url"),
        F.concat(F.lit("posting "), ident).alias("title"), F.col("text").alias("description"), k.alias("ingest_seq"),
        F.inline(rows))


def _sighted_waves(spark, folder) -> list[DataFrame]:
    rows = materialise(_sightings(spark, folder), "sightings")
    return [rows.filter(F.col("wave") == n).drop("wave") for n in range(WAVES)]


@query
def stream_watermark_dedup(spark, folder):
    """Six micro-batches with repeats, late rows and postings that come back after the
    stream has forgotten them."""
    return _fed(spark, folder, _sighted_waves(spark, folder), delay=DELAY).state().select(
        "source", "external_id", "title", "first_seen_at", "last_seen_at")


@query
def stream_closed(spark, folder):
    """Postings of the same six micro-batches that were not seen for thirty hours."""
    out = scratch_path(spark, "closed")
    _in_waves(spark, _sighted_waves(spark, folder), lambda rows, checkpoint, day: (
        stream.closed(rows, "30 hours", DELAY).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out, format="parquet")))
    return spark.read.parquet(out)
