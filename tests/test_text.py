"""Cleaning and reading of loosely written values, one table per rule."""

from pyspark.sql import functions as F

from postlake.functions import dates, numbers, places, text, urls


def results(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.coalesce(1).select("i", function(F.col("v")).alias("r")).collect()
    out = {r.i: r.r for r in rows}
    return [tuple(v) if isinstance(v, tuple) else v for v in (out[i] for i in range(len(values)))]


def check(spark, function, table):
    assert results(spark, function, [raw for raw, _ in table]) == [want for _, want in table]


def test_clean_text(spark):
    check(spark, text.clean_text, [
        ("Chef de projet   ", "Chef de projet"),
        ("a &amp;lt; b", "a &lt; b"),
        ("&#38;lt; &#x20AC; &#128; &eacute;", "&lt; € € é"),
        ("&unknown; &unknown AT&T &lt", "&unknown AT&T <"),
        ("&#55296;x&#99999999999;", "x"),
        (" \t\x1f&nbsp; ", None), ("", None), (None, None),
    ])


def test_html_to_text(spark):
    check(spark, text.html_to_text, [
        ("<div>Wir bieten</div><ol><li>Zeit&nbsp;und Raum</li><LI class='x'>Brot</li></ol>",
         "Wir bieten\n- Zeit und Raum\n- Brot"),
        (" a<br/>  \n\n b < c <!-- x --> d", "a\nb < c d"),
        ("<h3>Kopf</h3 ><td>eins</td><td>zwei</td></tr>drei", "Kopf\neinszwei\ndrei"),
        ("<p> </p>", None), (None, None),
    ])


def test_description_keeps_its_lines(spark):
    check(spark, text.strip_lines, [
        ("  a \n \n b  \r\n c\n\n", "a\n\nb\nc"), ("a &amp;  b", "a &amp;  b"), ("  ", None), (None, None),
    ])


def test_slug(spark):
    check(spark, text.slug, [
        ("Größe & Ärztin (m/w/d)", "gro-e-arztin-m-w-d"),
        ("  m² & ﬁn ", "m2-fin"), ("--A__b--", "a-b"),
    ])


def test_tokens(spark):
    check(spark, text.tokens, [
        ("Bäckerei C++ / œuvre x²", ["backerei", "c", "œuvre", "x²"]),
        ("été", ["ete"]), ("", []), (None, []),
    ])


def test_to_float(spark):
    check(spark, numbers.to_float, [
        ("46.948", 46.948), ("7.4474", 7.4474), ("-12", -12.0), (".5", 0.5), ("+3.", 3.0),
        ("3'250", 3250.0), ("7\u202f500", 7500.0), ("12\xa0000,5", 12000.5), ("9,75", 9.75),
        ("rund 4’300.25 Fr.", 4300.25), ("2.718.281,8", 2718281.8), ("25e2", 2500.0),
        ("nan", None), ("1e999", None), ("keine", None), (None, None),
    ])


def test_to_int_rounds_half_to_even(spark):
    check(spark, numbers.to_int, [("7 654", 7654), ("4.5", 4), ("5.5", 6), ("?", None)])


def test_percent_is_held_in_range(spark):
    check(spark, numbers.percent, [("101", 100), ("-1", 0), ("35 %", 35), (None, None)])


def test_workload(spark):
    check(spark, numbers.workload_range, [
        ("Pensum 50%", (50, 50)), ("20 bis 40 %", (20, 40)), ("90%/70%", (70, 90)), ("15", (15, 15)),
        ("2500", (0, 0)), ("ganztags", (None, None)), (None, (None, None)),
    ])


def test_workload_of_numbers(spark):
    from postlake.operators.normalise import with_workload

    for kind, table in (("double", [(82.5, 82), (83.5, 84), (80.0, 80), (120.0, 120), (float("nan"), None), (None, None)]),
                        ("int", [(120, 120), (0, 0), (None, None)]), ("decimal(5,1)", [(None, None)])):
        df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(table)], f"i int, v {kind}")
        rows = with_workload(df, "v").orderBy("i").collect()
        assert [(r.workload_min, r.workload_max) for r in rows] == [(w, w) for _, w in table]


def test_salary_of_numbers(spark):
    from postlake.operators.normalise import with_salary

    values = [12000000.0, 65000.5, 12.0, 2026.0, 98765432.1]
    df = spark.createDataFrame([(i, v, "CHF") for i, v in enumerate(values)], "i int, v double, c string")
    rows = with_salary(df, "v", "c").orderBy("i").collect()
    assert [r.salary_min for r in rows] == [12000000.0, 65000.5, None, 2026.0 if rows[3].salary_min else None, 98765432.1]


def test_salary(spark):
    nothing = None
    check(spark, numbers.salary_range, [
        ("Lohn 4'500.- bis 6'200.-", (4500.0, 6200.0, None)), ("von 48 bis 55k€", (48000.0, 55000.0, "EUR")),
        ("£ 61,250.75 pro Jahr", (61250.75, 61250.75, "GBP")), ("Jahresgehalt 70\xa0000", (70000.0, 70000.0, None)),
        ("$ 3000 / Fr. 2800", (2800.0, 3000.0, "CHF")), ("$ 3000 / Fr. 1999", (3000.0, 3000.0, "CHF")),
        ("USD 2044", (None, None, "USD")), ("EUR 3 k", (3000.0, 3000.0, "EUR")),
        ("nach Absprache", nothing), ("", nothing), (None, nothing), ("Eintritt 2031, Pensum 60%", nothing),
    ])


def test_salary_hint(spark):
    df = spark.createDataFrame([("50000", "GBP"), ("50000 EUR", "GBP"), ("50000", None)], "t string, h string")
    rows = df.select(numbers.salary_range(F.col("t"), F.col("h")).alias("r")).collect()
    assert [r.r and r.r.currency for r in rows] == ["GBP", "EUR", None]


def test_to_iso_date(spark):
    check(spark, dates.to_iso_date, [
        ("2031-05-17T08:00:59.123+0530", "2031-05-17"), ("17/05/2031", "2031-05-17"), ("2031-05-17", "2031-05-17"),
        ("2031-03-04", "2031-03-04"), ("04/03/2031", "2031-03-04"), ("2031-05-17T23:59:59-11:00", "2031-05-17"),
        ("2031-05-17 08:00", "2031-05-17"), ("20310517", "2031-05-17"), ("2031-W20-6", "2031-05-17"),
        ("17.5.31", "2031-05-17"), ("17.5.76", "1976-05-17"), ("17 May 2031", "2031-05-17"), ("May 17th, 2031", "2031-05-17"),
        ("Sat, 17 May 2031 12:30:00 GMT", "2031-05-17"), ("05/17/2031", "2031-05-17"), ("2031/05/17", "2031-05-17"),
        ("17-May-31", "2031-05-17"), ("17 May 31 12:30", "2031-05-17"), ("17 May 99", "1999-05-17"),
        ("17 May 12:30", None), ("17 mai 2031", None), ("demnächst", None), ("2031-02-29", None), ("30.02.2031", None),
        ("17 May", None), ("", None), (None, None),
    ])


def test_country(spark):
    check(spark, places.country_code, [
        ("Germany", "DE"), ("DEUTSCHLAND", "DE"), (" Svizzera. ", "CH"), ("Belgium", "BE"), ("Luxembourg", "LU"),
        ("fr", "FR"), ("pt", "PT"), ("Italie", "IT"), ("Atlantis", None), (None, None),
    ])


def test_contract_type(spark):
    check(spark, places.contract_type, [
        ("Unbefristet", "permanent"), ("TEMPS_PARTIEL", "part_time"), ("Praktikum", "internship"),
        ("sélbständig", "contractor"), ("Night-Shift Only", "night_shift_only"), ("", None), ("on_call", "on_call"),
    ])


def test_url_join(spark):
    base = "https://x.test/liste/a?page=1#top"
    table = [
        ("/stelle/7", "https://x.test/stelle/7"), ("?page=2", "https://x.test/liste/a?page=2"),
        ("b/./c/../d?q#f", "https://x.test/liste/b/d?q#f"), ("//h/x", "https://h/x"),
        ("../../../up", "https://x.test/up"), ("..", "https://x.test/"), ("#f", "https://x.test/liste/a?page=1#f"),
        ("https://q/z", "https://q/z"), (" /a\n ", "https://x.test/a"), ("mailto:a@b", "mailto:a@b"),
    ]
    check(spark, lambda c: urls.url_join(F.lit(base), c), table)


def test_text_of_any_depth(spark):
    import json

    from postlake.functions import variants

    def nested(depth, leaf):
        return leaf if not depth else {"other": "no", "value" if depth % 2 else "name": nested(depth - 1, leaf)}

    table = [
        ("deep", nested(5, "deep")), ("deeper", nested(40, "deeper")), ("b", [None, "", " ", {"x": 1}, [[{"name": ["", "b"]}]], "c"]),
        ("name first", {"value": "later", "name": "name first"}), (None, {"name": {"other": "x"}}), ("7", {"text": 7}),
        ("True", [[], {}, True]), ("a, [b {c", [{"name": "a, [b {c"}]), (None, []), (None, {"name": None}),
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (_, v) in enumerate(table)], "i int, j string")
    rows = df.select("i", variants.text_of(F.parse_json("j")).alias("t")).orderBy("i").collect()
    assert [r.t or None for r in rows] == [want for want, _ in table]


def test_long_runs_of_space(spark):
    """Runs of blank lines that no stack holds, and each kind of white space alone."""
    runs = [("a" + run * 50_000 + "b", "a\nb", "a b") for run in ("\n", " \n", "\r\n\u2028", "\xa0\x85")]
    runs += [("a" + "\u3000 \t" * 50_000 + "b", "a b", "a b"), (" \n" * 50_000, None, None)]
    for char in map(chr, range(0x3002)):
        if char.isspace():
            ends = char in "\n\v\f\r\x1c\x1d\x1e\x85\u2028\u2029"
            runs += [(f"{char}é{char}b{char} {char}c{char}", "é\nb\nc" if ends else "é b c", "é b c")]
    df = spark.createDataFrame(runs, "given string, lines string, blanks string")
    found = df.select("lines", "blanks", text.html_to_text(F.col("given")).alias("l"), text.clean_text(F.col("given")).alias("b"))
    assert found.filter("NOT (lines <=> l) OR NOT (blanks <=> b)").collect() == []


def test_plain_texts_are_only_looked_through(spark):
    """Letters, single blanks and line feeds ask for no replacement."""
    plain = "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x1680), 0x2010, 0x200B, 0x3001, 0xFEFF, 0x1F600]))
    df = spark.createDataFrame([(plain,), (f"a{chr(10)}b c",)], "t string")
    assert df.filter(F.col("t").rlike(text._RARE_SPACE)).collect() == []
