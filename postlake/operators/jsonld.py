"""Job postings embedded in pages as JSON-LD, page by page without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.numbers import to_float
from ..functions.places import contract_type, read_country
from ..functions.text import clean_text, html_to_text, with_each
from ..functions.variants import (
    as_list, elements, first_object, is_object, member, objects_in, scalar_text, text_of,
)

# Scripts of exactly this type; comments are matched first so that scripts
# inside them do not count.
_SCRIPT = (
    r"(?s)<!--.*?-->|<(?i:script)\b[^>]*?\s(?i:type)\s*=\s*"
    r"(?:\"application/ld\+json\"|'application/ld\+json'|application/ld\+json(?=[\s>]))"
    r"[^>]*>(.*?)</(?i:script)\s*>"
)

FIELDS = (
    "title", "description", "external_id", "url", "posted_at", "expires_at", "contract_type",
    "apply_url", "company", "remote_policy", "city", "region", "postal_code", "country",
    "location_raw", "lat", "lon", "salary_min", "salary_max", "salary_currency",
)


def blocks_of(html: Column) -> Column:
    """All JSON-LD objects of a page in document order, `@graph` unrolled."""
    scripts = F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1))
    parsed = F.transform(scripts, lambda s: F.try_parse_json(F.trim(s)))

    def unrolled(entry: Column) -> Column:
        graph = member(entry, "@graph")
        return F.when(
            graph.isNotNull(), F.coalesce(objects_in(graph), F.array().cast("array<variant>"))
        ).otherwise(F.array(entry))

    entries = F.flatten(F.filter(F.transform(parsed, objects_in), lambda a: a.isNotNull()))
    return F.flatten(F.transform(entries, unrolled))


def is_posting(block: Column) -> Column:
    kinds = as_list(member(block, "@type"))
    return F.coalesce(F.exists(kinds, lambda t: scalar_text(t) == "JobPosting"), F.lit(False))


def extract_blocks(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD object: the page's other columns, `block_pos`, `block`."""
    others = [c for c in pages.columns if c != "html"]
    return pages.select(*others, F.posexplode(blocks_of(F.col("html"))).alias("block_pos", "block"))


def with_posting(pages: DataFrame, into: str = "posting") -> DataFrame:
    """Replace `html` by the first JobPosting of the page, NULL if it has none."""
    found = F.filter(blocks_of(F.col("html")), is_posting)
    others = [c for c in pages.columns if c != "html"]
    return pages.select(*others, F.explode_outer(F.slice(found, 1, 1)).alias(into))


def _first_place(posting: Column) -> Column:
    """First place of the posting whose address is, or holds, an object."""
    with_address = F.filter(
        objects_in(member(posting, "jobLocation")),
        lambda p: first_object(member(p, "address")).isNotNull(),
    )
    return F.get(with_address, F.lit(0))


def _organisation(posting: Column) -> Column:
    """What names the employer: an object's name, else the value itself."""
    held = member(posting, "hiringOrganization")
    named = first_object(held)
    single = F.when(elements(held).isNull(), held)
    return F.when(named.isNotNull(), member(named, "name")).otherwise(single)


def posting_fields(pages: DataFrame) -> DataFrame:
    """Posting columns of every page (`url`, `html`, others kept as they are);
    all NULL but the address where a page embeds no posting. Adds `page_url`."""
    others = [c for c in pages.columns if c not in ("html", "url")]
    found = with_posting(pages, "_p").withColumnRenamed("url", "page_url")
    p = F.col("_p")
    parts = found.withColumns(
        {
            "_place": _first_place(p),
            "_salary": first_object(member(p, "baseSalary")),
            "_id": member(p, "identifier"),
            "_kinds": as_list(member(p, "jobLocationType")),
        }
    ).withColumns(
        {
            "_address": first_object(member(F.col("_place"), "address")),
            "_geo": member(F.col("_place"), "geo"),
            "_held": member(F.col("_salary"), "value"),
        }
    )
    held = F.col("_held")
    amount = F.when(elements(held).isNotNull(), first_object(held)).otherwise(held)

    parts = parts.withColumn("_amount", amount)
    amount = F.col("_amount")
    address, salary = F.col("_address"), F.col("_salary")
    texts = {
        "title": member(p, "title"),
        "link": member(p, "url"),
        "posted": member(p, "datePosted"),
        "expires": member(p, "validThrough"),
        "company": _organisation(p),
        "id": F.when(~is_object(F.col("_id")), F.col("_id")),
        "id_value": member(F.col("_id"), "value"),
        "id_name": member(F.col("_id"), "name"),
        "currency": member(salary, "currency"),
        "currency_code": member(salary, "currencyCode"),
        "locality": member(address, "addressLocality"),
        "region": member(address, "addressRegion"),
        "postal": member(address, "postalCode"),
        "country": member(address, "addressCountry"),
        "street": member(address, "streetAddress"),
    }
    numbers = {
        "lat": member(F.col("_geo"), "latitude"),
        "lon": member(F.col("_geo"), "longitude"),
        "low": member(amount, "minValue"),
        "high": member(amount, "maxValue"),
        "single": F.when(is_object(amount), member(amount, "value")).otherwise(amount),
    }
    read = with_each(parts, "_t", texts, lambda v: clean_text(text_of(v)))
    read = with_each(read, "_n", numbers, lambda v: to_float(scalar_text(v)))
    days = {c: F.col(f"_t.{c}") for c in ("posted", "expires")}
    read = with_each(read, "_d", days, read_date)

    def text(name: str) -> Column:
        return F.col(f"_t.{name}")

    def number(name: str) -> Column:
        return F.col(f"_n.{name}")

    low, high, single = number("low"), number("high"), number("single")
    neither = low.isNull() & high.isNull()
    contracts = F.filter(
        F.transform(as_list(member(p, "employmentType")), scalar_text), lambda t: t != ""
    )
    city = F.coalesce(text("locality"), text("region"))
    link = F.when(p.isNotNull(), F.coalesce(text("link"), F.col("page_url")))
    made = {
        "title": text("title"),
        "description": html_to_text(scalar_text(member(p, "description"))),
        "external_id": F.coalesce(text("id_value"), text("id_name"), text("id")),
        "url": link,
        "posted_at": F.col("_d.posted"),
        "expires_at": F.col("_d.expires"),
        "contract_type": contract_type(F.get(contracts, F.lit(0))),
        "apply_url": link,
        "company": text("company"),
        "remote_policy": F.when(
            F.exists("_kinds", lambda k: F.upper(scalar_text(k)) == "TELECOMMUTE"),
            F.lit("remote"),
        ),
        "city": city,
        "region": F.when(text("locality").isNotNull(), text("region")),
        "postal_code": text("postal"),
        "country": read_country(text("country")),
        "location_raw": F.nullif(
            F.concat_ws(", ", text("street"), text("postal"), city), F.lit("")
        ),
        "lat": number("lat"),
        "lon": number("lon"),
        "salary_min": F.when(neither, single).otherwise(low),
        "salary_max": F.when(neither, single).otherwise(high),
    }
    shaped = read.select(
        *others, "page_url", *[made[f].alias(f) for f in FIELDS if f in made],
        F.coalesce(text("currency"), text("currency_code")).alias("_currency"),
    )
    # A currency without any amount says nothing.
    paid = F.coalesce("salary_min", "salary_max").isNotNull()
    return shaped.withColumn("salary_currency", F.when(paid, F.col("_currency"))).drop("_currency")
