"""The given tables seen as postings: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalise import fingerprint
from ..sources.tables import read_table

SEEN_AT = "2026-08-31T00:00:00Z"

COMPANIES = ("Orma SA", "Quai Douze", "Atelier Étoile", "Müller AG", "ÉCLAIR SARL", "Nordwind GmbH", None)
PLACES = (
    ("Neuchâtel", "NE", "CH"), ("Köln", "NW", "DE"), ("Nîmes", "30", "FR"),
    ("Sion", "VS", "CH"), ("NEUCHÂTEL", "NE", "CH"),
)
SKILLS = ("python", "spark", "sql", "django", "agile", "kubernetes", "go")
CONTRACTS = ("permanent", "fixed_term", "full_time", None)

RAW_COUNTRIES = ("Germany", " svizzera ", "LUXEMBOURG", "Belgium.", "pt", "Atlantis", None, "Switzerland", "Fr&agrave;nce")
RAW_NUMBERS = ("46.52", "-0.75", "12'500", "9 870", "33,25", "ca. 2'750.40", "NaN", "offen", None, "3.141.592,6")
RAW_WORKLOADS = ("90 %", "50 bis 70%", "30%/60%", "Vollzeit", "2500%", None, "Pensum 20 &ndash; 40 Prozent")
RAW_HINTS = (None, "CHF", None, "EUR")
MONTHS = ("Jan", "Feb", "March", "apr", "May", "June", "Jul", "August", "Sept", "Oct", "November", "Dec")


def pick(values: tuple, number: Column) -> Column:
    """One of the values, by the row's number."""
    return F.get(F.array(*[F.lit(v) for v in values]), number)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents", *columns)


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a clean posting of the current state; the text as its
    description, the first line as its title."""
    k = F.col("doc_id").cast("int")
    docs = documents(spark, folder, "doc_id", "text", "lang", "source")
    low = F.when(k % 5 != 0, 40 + (k % 7) * 10)
    pay = F.when(k % 4 != 0, (50000 + (k % 40) * 1000).cast("double"))
    skills = F.slice(F.array(*[F.lit(s) for s in SKILLS * 2]), k % 7 + 1, k % 4)
    ident = F.col("doc_id").cast("string")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), ident)
    return docs.select(
        "doc_id",
        fingerprint(F.col("source"), ident, url).alias("fingerprint"),
        "source", ident.alias("external_id"), url.alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        pick(COMPANIES, k % 7).alias("company"),
        F.col("text").alias("description"),
        *[pick(tuple(p[i] for p in PLACES), k % 5).alias(n)
          for i, n in enumerate(("city", "region", "country"))],
        F.when(k % 3 != 0, F.lit(46.2)).alias("lat"),
        pick(CONTRACTS, k % 4).alias("contract_type"),
        low.alias("workload_min"),
        F.when(k % 9 != 0, F.least(F.lit(100), low + 20)).alias("workload_max"),
        pay.alias("salary_min"),
        F.when(k % 3 != 0, pay + 15000.0).alias("salary_max"),
        F.when(
            k % 13 != 0,
            F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), k % 240), "yyyy-MM-dd"),
        ).alias("posted_at"),
        "lang",
        F.array("source", "lang").alias("keywords"),
        skills.alias("skills"),
        F.lit(SEEN_AT).alias("first_seen_at"),
        F.lit(SEEN_AT).alias("last_seen_at"),
    )


def _loose_date(k: Column) -> Column:
    """The same sort of date written in many ways."""
    day, month = (k % 28 + 1).cast("string"), (k % 12 + 1).cast("string")
    year = (2020 + k % 6).cast("string")
    two = lambda c: F.lpad(c, 2, "0")
    iso = F.concat_ws("-", year, two(month), two(day))
    forms = (
        iso,
        F.concat(iso, F.lit("T00:02:37+02:00")),
        F.concat_ws("/", two(day), two(month), year),
        F.concat_ws(".", day, month, year),
        F.concat_ws(" ", day, pick(MONTHS, k % 12), year),
        F.concat(pick(MONTHS, k % 12), F.lit(" "), day, F.lit(", "), year),
        F.concat(year, two(month), two(day)),
        F.concat_ws("-", year, two(month), F.lit("31")),
        F.lit("bald möglichst"),
        F.concat_ws("/", month, F.lit("27"), year),
    )
    return F.get(F.array(*forms), k % 11)


def raw_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a loose posting, the way sources write them."""
    k = F.col("doc_id").cast("int")
    ident = F.col("doc_id").cast("string")
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    scheme = F.when(k % 17 == 0, F.lit("ftp://")).otherwise(F.lit("https://"))
    return documents(spark, folder, "doc_id", "text", "lang", "source").select(
        "doc_id",
        F.when(k % 19 != 0, F.col("source")).alias("source"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), ident)).alias("external_id"),
        F.concat(scheme, F.col("source"), F.lit(".example.org/"), ident).alias("url"),
        F.when(k % 23 == 0, F.lit(" &nbsp; ")).otherwise(
            F.concat(F.lit("  "), first_line, F.lit(" &amp;\t R&eacute;f&#233;rence&nbsp;"), ident)
        ).alias("title"),
        F.concat(F.lit(" \n"), F.replace("text", F.lit("\n"), F.lit(" \r\n\t")), F.lit("\n ")).alias(
            "description"
        ),
        pick(RAW_COUNTRIES, k % 9).alias("country"),
        pick(RAW_NUMBERS, k % 10).alias("lat"),
        pick(RAW_NUMBERS, (k + 3) % 10).alias("salary_min"),
        pick(("chf", "", None, "Eur"), k % 4).alias("salary_currency"),
        (150 - k % 160).cast("string").alias("workload_min"),
        F.concat((k % 130 - 10).cast("string"), F.lit(".5")).alias("workload_max"),
        _loose_date(k).alias("posted_at"),
        F.array(
            F.lit("python"), F.lit("python"), F.lit(" Go "), F.lit(None), F.col("lang"),
            F.lit("&nbsp;"), pick(SKILLS, k % 7),
        ).alias("skills"),
        F.lit("dropped").alias("unknown_key"),
        F.col("doc_id").alias("ingest_seq"),
    )


def pay_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with a salary and a workload mention in free text."""
    k = F.col("doc_id").cast("int")
    low, high = 40 + k % 50, 60 + k % 70

    def written(mark: str) -> Column:
        return F.concat(low.cast("string"), F.lit(mark))

    texts = (
        F.concat(written("k€ bis "), high.cast("string"), F.lit("k€")),
        F.concat(F.lit("Lohn "), written("'000 / "), high.cast("string"), F.lit("'000 Fr.")),
        F.concat(F.lit("Annual compensation: "), written(" 500 £")),
        F.lit("nach Verabr&eacute;dung"),
        F.concat(F.lit("Beginn 20"), (10 + k % 80).cast("string"), F.lit(", Pensum 80%")),
        F.concat(F.lit("Gehalt 2031 ab $ "), written(".250,75")),
        F.concat(F.lit("zwischen "), written("&nbsp;900 und "), high.cast("string"), F.lit("&nbsp;900")),
        F.concat(F.lit("Salary EUR "), written("00 or frs")),
    )
    return documents(spark, folder, "doc_id", "source", "text").select(
        "doc_id", "source",
        F.get(F.array(*texts), k % 8).alias("pay"),
        pick(RAW_HINTS, k % 4).alias("hint"),
        pick(RAW_WORKLOADS, k % 7).alias("rate"),
        "text",
    )


def detail_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a landed page that embeds it as a JSON-LD posting."""
    k = F.col("doc_id").cast("int")
    ident = F.col("doc_id").cast("string")
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    place = F.to_json(F.struct(
        F.struct(
            F.when(k % 2 == 0, pick(tuple(p[0] for p in PLACES), k % 5)).alias("addressLocality"),
            pick(tuple(p[1] for p in PLACES), k % 5).alias("addressRegion"),
            (1000 + k % 9000).alias("postalCode"),
            F.struct(F.lit("Country").alias("@type"), pick(("Svizzera", "BELGIUM", "Peru"), k % 3).alias("name")).alias("addressCountry"),
        ).alias("address"),
        F.struct(F.lit("46.2").alias("latitude"), (k % 90).alias("longitude")).alias("geo"),
    ))
    salary = F.to_json(F.struct(
        F.lit("CHF").alias("currency"),
        F.struct(
            F.when(k % 3 == 0, 50000 + k % 1000).alias("minValue"),
            F.when(k % 3 == 0, 60000 + k % 1000).alias("maxValue"),
            F.when(k % 3 == 1, F.lit("80'000")).alias("value"),
        ).alias("value"),
    ))
    paragraphs = F.concat(
        F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>")
    )
    # The object is closed after the parts that are JSON already.
    head = F.to_json(F.struct(
        F.when(k % 2 == 0, F.array(F.lit("Thing"), F.lit("JobPosting")))
        .otherwise(F.array(F.lit("JobPosting"))).alias("@type"),
        first_line.alias("title"),
        paragraphs.alias("description"),
        F.struct(ident.alias("value")).alias("identifier"),
        F.concat(F.lit("2026-08-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"),
                 F.lit("T00:02:37+02:00")).alias("datePosted"),
        F.array(F.lit(""), pick(("Unbefristet", "TEMPS_PARTIEL", "Night-Shift Only", "Lehrstelle"), k % 4))
        .alias("employmentType"),
        F.array(F.struct(F.lit(" Fig &amp; Sons ").alias("name"))).alias("hiringOrganization"),
        F.when(k % 5 == 0, F.lit("telecommute")).alias("jobLocationType"),
    ))
    posting = F.concat(
        F.expr("substring(`_head`, 1, char_length(`_head`) - 1)"),
        F.lit(',"jobLocation":'), F.col("_place"), F.lit(',"baseSalary":'), F.col("_salary"), F.lit("}"),
    )
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage","title":"no"},'), posting, F.lit("]}"))
    listed = F.concat(F.lit('[1,{"@type":"Thing"},'), posting, F.lit("]"))
    body = F.when(k % 3 == 0, graph).when(k % 3 == 1, listed).otherwise(posting)
    tag = F.lit('<script type="application/ld+json">')
    close = F.lit("</script>")
    html = F.concat(
        F.lit("<html><head>"), tag, F.lit("{no object"), close,
        F.when(k % 10 == 9, F.lit("")).otherwise(F.concat(tag, body, close)),
        F.lit("</head></html>"),
    )
    rows = documents(spark, folder, "doc_id", "text", "source").withColumns(
        {"_head": head, "_place": place, "_salary": salary}
    )
    return rows.select(
        "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), ident).alias("url"),
        html.alias("html"),
    )


def written_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The date of every order, written in one of many ways."""
    day = F.to_date("o_orderdate")

    def shown(pattern: str) -> Column:
        return F.date_format(day, pattern)

    forms = (
        shown("yyyy-MM-dd"), shown("dd.MM.yyyy"), shown("d/M/yyyy"), shown("yyyyMMdd"), shown("d MMM yyyy"),
        shown("MMMM d, yyyy"), shown("d-MMM-yy"), F.concat(shown("d MMM yy"), F.lit(" 10:00")),
        F.concat(shown("EEE, d MMM yyyy"), F.lit(" 23:59:59 GMT")), F.concat(shown("yyyy-MM-dd"), F.lit("T23:59:59-11:00")),
        shown("d MMM"),
    )
    return read_table(spark, folder, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", day.alias("day"), F.get(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int")).alias("written"))


def written_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """The price of every line item, written in one of many ways."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)

    def with_marks(thousands: str, decimal: str) -> Column:
        return F.concat(F.translate(grouped, ",", thousands), F.lit(decimal), part)

    forms = (
        with_marks("'", "."), with_marks(" ", ","), with_marks(".", ","), with_marks("\u00a0", "."), with_marks(",", "."),
        F.concat(F.lit("CHF "), with_marks("’", ".")), F.concat(whole.cast("string"), F.lit("."), part),
        F.concat(F.lit("- ab "), with_marks("\u202f", ","), F.lit(" Euro")),
    )
    place = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(forms)
    return read_table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_quantity", cents.alias("cents"), F.get(F.array(*forms), place.cast("int")).alias("written"))


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a sighting of the posting its type and user stand for."""
    return read_table(spark, folder, "events").select(
        F.sha1(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).cast("binary"))
        .alias("fingerprint"),
        F.col("event_type").alias("source"),
        # Every fifth write has no title: the NULL overwrites what was known.
        F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("title"),
        F.col("value").alias("salary_min"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("seen_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.dayofyear("ts").cast("bigint").alias("run_seq"),
        F.col("event_id").alias("ingest_seq"),
    )
