"""Landed HTML pages: links of listings, postings of detail pages, sitemaps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decode_entities
from ..functions.urls import url_join
from ..session import materialise

# An anchor with a link target; comments, scripts and styles are matched first
# so that anchors written inside them do not count.
_ANCHOR = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<a(?=\s)[^>]*?\shref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
)


def _distinct_links(html: Column, url: Column, keep: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
    anchors = F.filter(found, lambda m: m.rlike(r"(?i)^<a\s"))
    raw = F.transform(anchors, lambda m: F.regexp_extract(m, r"(?is)^<a(?=\s).*?\shref\s*=\s*(.*)$", 1))
    hrefs = F.transform(
        raw, lambda h: decode_entities(F.regexp_replace(h, r"^[\"']|[\"']$", ""))
    )
    wanted = F.filter(hrefs, lambda h: (h != "") & h.rlike(keep)) if keep else hrefs
    return F.array_distinct(F.transform(wanted, lambda h: url_join(url, h)))


def listing_links(pages: DataFrame, keep: str = "") -> DataFrame:
    """Links of listing pages: those matching `keep`, absolute, once per page,
    in page order. A page without any gives no row, which ends its listing."""
    links = _distinct_links(F.col("html"), F.col("url"), keep)
    others = [c for c in pages.columns if c not in ("html", "url")]
    return pages.select(
        *others, F.col("url").alias("page_url"), F.posexplode(links).alias("link_pos", "link")
    )


def read_sitemaps(
    spark: SparkSession, path: str, keep: str = "", limit: int | None = None
) -> DataFrame:
    """`<url>` entries of landed sitemaps, compressed ones included, that match `keep`.
    `limit` is a quota of entries in the order of the files, by name, and within each;
    it is taken before `keep` is asked."""
    entries = (
        spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
        .select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod"),
                F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_place"))
        .filter(F.col("loc").isNotNull())
    )
    if limit:
        # Within a split the number grows with the place in the file.
        entries = entries.orderBy("_file", "_block", "_place").limit(limit)
    return entries.filter(F.col("loc").rlike(keep or "")).select("loc", "lastmod")


def read_sitemap_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of the sitemaps an index file names."""
    return (
        spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
        .select(F.trim("loc").alias("loc")).filter("loc is not null")
    )


def sitemap_key(address: Column) -> Column:
    """The folder (`site=<key>`) in which the landing job puts the file of an address."""
    return F.sha1(F.trim(address).cast("binary"))


def _entries(bodies: DataFrame, row: str, fields: str) -> DataFrame:
    """Entries of sitemaps kept as texts, with the key of their file and their place in it.
    A text that is not well-formed is cut where entries end, and each is read by itself."""
    whole = F.from_xml("body", f"{row} array<struct<{fields}>>")[row]
    parts = F.split(F.regexp_replace("body", r"(?s)<!--.*?-->", ""), rf"</{row}\s*>")
    closed = F.slice(parts, 1, F.size(parts) - 1)
    each = F.transform(closed, lambda p: F.from_xml(
        F.concat(F.regexp_extract(p, rf"(?s)^.*(<{row}(?:\s[^>]*)?>.*)$", 1), F.lit(f"</{row}>")), fields))
    # Hashes are taken before the entries are dealt out: once for a text, not for each entry.
    # The outer form keeps Spark from asking beforehand, by a second reading, whether there are any.
    texts = bodies.select(
        sitemap_key(F.col("address")).alias("site"), F.sha1("body").alias("text"), F.coalesce(whole, each).alias("entries"))
    return texts.select("site", "text", F.posexplode_outer("entries").alias("pos", "entry")).select(
        "site", "entry.*", F.struct("text", "pos").alias("place"))


def _landed(spark: SparkSession, landed: str | DataFrame, row: str, fields: str) -> DataFrame:
    """Entries of all landed files with the key of their file and their place in it."""
    if isinstance(landed, DataFrame):
        rows = _entries(landed, row, fields)
    else:
        rows = (
            spark.read.format("xml").option("rowTag", row).schema(f"{fields}, site string").option("basePath", landed)
            .load(landed)
            .withColumn("place", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                          F.monotonically_increasing_id().alias("place")))
        )
    return rows.select(
        "site", *[F.trim(c).alias(c) for c in rows.columns if c not in ("site", "place")], "place"
    ).filter(F.col("loc").isNotNull())


def sitemap_files(spark: SparkSession, landed: str | DataFrame, roots: list[str]) -> DataFrame:
    """Landed files (`site`) that the root addresses lead to, over indexes of indexes, and
    their `route`: files sort by it level by level, and within a level in the order in
    which the indexes name them. Each round asks for the children of the files found last
    and leaves out those that are known, so an index that leads back to itself ends."""
    # An index file names at most 50,000 files by its format: the window is bounded.
    in_file = Window.partitionBy("site").orderBy("place")
    links = materialise(
        _landed(spark, landed, "sitemap", "loc string").select(
            "site", sitemap_key(F.col("loc")).alias("child"),
            F.lpad(F.row_number().over(in_file).cast("string"), 6, "0").alias("place")),
        "sitemap-links")
    given = spark.createDataFrame([(i, r) for i, r in enumerate(roots)], "i int, loc string")
    files = frontier = materialise(
        given.groupBy(sitemap_key(F.col("loc")).alias("site")).agg(F.lpad(F.min("i").cast("string"), 6, "0").alias("route"))
        .withColumn("level", F.lit(0)), "sitemap-files")
    level = 0
    while not frontier.isEmpty():
        level += 1
        found = (
            links.join(frontier.select("site", "route"), "site")
            .groupBy("child").agg(F.min(F.concat("route", "place")).alias("route"))
            .select(F.col("child").alias("site"), "route", F.lit(level).alias("level"))
        )
        frontier = materialise(found.join(files.select("site"), "site", "left_anti"), "sitemap-files")
        files = files.unionByName(frontier)
    return files


def read_sitemap_tree(
    spark: SparkSession, landed: str | DataFrame, roots: list[str], keep: str = "", limit: int | None = None
) -> DataFrame:
    """`<url>` entries of all sitemaps that the root addresses lead to, that match `keep`.
    `landed` is a table of files (`address`, `body` as XML text), or a path below which each
    lies in a folder of its `sitemap_key`: a folder costs listing and opening for each file,
    so many small files belong in a table. Addresses without a file give nothing. `limit` is a quota of entries in the order of `sitemap_files` and of
    each file, taken before `keep` is asked: entries are counted per file, and only those
    of the file in which the quota ends are ranked."""
    entries = _landed(spark, landed, "url", "loc string, lastmod string").join(
        sitemap_files(spark, landed, roots), "site")
    if limit:
        counted = entries.groupBy("level", "route", "site").agg(F.count("*").alias("_n"))
        # Each file has an entry, so the quota ends within the first `limit` files.
        first = counted.orderBy("level", "route").limit(limit)
        before = F.sum("_n").over(Window.orderBy("level", "route").rowsBetween(Window.unboundedPreceding, -1))
        needed = first.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < limit)
        entries = entries.join(needed.select("site", "_n", "_before"), "site")
        whole = F.col("_before") + F.col("_n") <= limit
        place = F.row_number().over(Window.partitionBy("site").orderBy("place"))
        cut = entries.filter(~whole).withColumn("_at", place).filter(F.col("_at") + F.col("_before") <= limit)
        entries = entries.filter(whole).unionByName(cut.drop("_at"))
    return entries.filter(F.col("loc").rlike(keep or "")).select("loc", "lastmod")


def overlay(fields: DataFrame, corrections: Mapping[str, Column]) -> DataFrame:
    """Site-specific columns laid over extracted ones. A correction wins even
    with NULL; to keep the extracted value for some rows, say so in its column."""
    return fields.withColumns(dict(corrections))


def accept(fields: DataFrame, page_url: str = "page_url", condition: Column | None = None):
    """Default the address to that of the page and keep rows that have a title."""
    filled = fields.withColumn("url", F.coalesce("url", page_url))
    rule = F.coalesce(F.length("title"), F.lit(0)) > 0 if condition is None else condition
    return filled.filter(rule)
