import itertools
import math
import random
import html
import time

import pytest

from postlake.llm import html_extraction, url_filters

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x") for i, (u, h) in enumerate(rows)],
                                 "page_id bigint, url string, html string, text string, tokens string")


def given(url):
    """The longest rule that fits, said another way."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None, None
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(v, h + p) for v, h, p in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    verdict, rule = max(fits, key=lambda f: len(f[1]), default=(None, None))
    return host, path, rule, verdict


def test_given_rules(spark):
    urls = [
        None, "", "no scheme", "http://Example.ORG/es/1", "http://a.example.org/en/12", "http://example.org/en/2",
        "https://x.com/fr/a", "https://x.com/de/a?q=1#f", "https://xcom/de/a", "https://com/de/", "http://a.org",
        "http://a.org?x=/es/", "a://b://c.org/de/", "http://ÄÖ.org/é", "http://a.org/\nb", "https://x.com/de/a?q=1#f",
    ]
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, n_urls bigint")
    rows = url_filters.judged(pages(spark, [(u, "") for u in urls]), RULES, none).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = given(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules(spark):
    rows = [(f"http://{h}.net/{p}/{i}", h == "pills" and p == "buy") for i in range(60)
            for h in ("pills", "news") for p in ("buy", "read")]
    labelled = spark.createDataFrame(rows, "url string, bad boolean").select(url_filters.tokens("url").alias("tokens"), "bad")
    rules = url_filters.mine(labelled, confidence=0.9, least=5)
    found = {frozenset(r.antecedent) for r in rules.collect()}
    assert len(found) == 1 and {"p:buy", "h:pills", "w:pills"} == set(next(iter(found)))
    again = [("http://a.pills.net/x/buy?q", ""), ("http://pills.net/read", ""), ("http://news.net/buy", ""), (None, "")] * 2
    verdicts = {r.page_id: r.verdict for r in url_filters.judged(pages(spark, again), RULES, rules).collect()}
    assert [verdicts[i] for i in range(8)] == ["block", "allow", "allow", "allow"] * 2


def recounted(rows, share, floor, least, z=2.58):
    """Rules by trying every set of tokens, those of equal rows as one."""
    places = {}
    for i, (tokens, _) in enumerate(rows):
        for token in tokens:
            places.setdefault(token, set()).add(i)
    groups = {}
    for token, at in places.items():
        groups.setdefault(frozenset(at), []).append(token)
    items = [(at, same) for at, same in groups.items() if len(at) >= least]
    bad, rules = {i for i, r in enumerate(rows) if r[1]}, {}
    for size in range(1, len(items) + 1):
        for some in itertools.combinations(items, size):
            at = frozenset.intersection(*(s[0] for s in some))
            n, k = len(at), len(at & bad)
            if k < least or k / n < floor:
                continue
            low = (k / n + z * z / 2 / n - z * math.sqrt(k / n * (1 - k / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)
            if low > share:
                rules[frozenset(t for s in some for t in s[1])] = (round(k / n, 9), k)
    return {r: v for r, v in rules.items() if not any(o < r and w[0] >= v[0] for o, w in rules.items())}


def test_mined_rules_against_a_recount(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(600):
        tokens = [t for t in "abcdefgh" if rnd.random() < 0.4] + ["z", "y"]
        rate = 0.2 + 0.3 * ("a" in tokens) + 0.45 * ("b" in tokens and "c" in tokens)
        rows.append((tokens, rnd.random() < rate))
    share = sum(b for _, b in rows) / len(rows)
    table = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    for confidence, floor in ((None, min(0.8, 1.5 * share)), (0.5, 0.5)):
        got = {frozenset(r.antecedent): (round(r.confidence, 9), r.n_urls)
               for r in url_filters.mine(table, confidence=confidence).collect()}
        assert got == recounted(rows, share, floor, 10) and len(got) >= 3


def test_no_rule_where_labels_are_by_chance(spark):
    rnd = random.Random(4)
    rows = [([t for t in "abcdefgh" if rnd.random() < 0.4], rnd.random() < 0.9) for _ in range(400)]
    assert url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).count() == 0


def test_a_repeated_long_url_is_one_item(spark):
    long = "http://h.net/" + "/".join(f"s{i}" for i in range(60))
    labelled = spark.createDataFrame([(long, True)] * 40 + [("http://o.net/a", False)] * 40, "url string, bad boolean")
    rules = url_filters.mine(labelled.select(url_filters.tokens("url").alias("tokens"), "bad"), least=5).collect()
    assert len(rules) == 1 and len(rules[0].antecedent) > 60


def test_labels_by_number(spark):
    given = pages(spark, [("http://a.net/en/7.html", ""), ("http://a.net/en/8", ""), ("http://a.net/x", ""), (None, "")])
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 0), (8, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = url_filters.labelled_by_number(given, labels).collect()
    assert sorted((r.bad, "w:a" in r.tokens) for r in rows) == [(False, True), (True, True)]
    empty = url_filters.mine(url_filters.labelled_by_number(given.limit(0), labels))
    assert empty.count() == 0 and url_filters.judged(given.limit(0), RULES, empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body><nav><ul><li><a href="/a">menu one</a></li><li>menu two</li></ul></nav><div class="ad">Buy these many
fine things now now now</div><article><h1>The %s &amp; head</h1><p>First <b>bo</b>ld&nbsp;line.<br>More words
here</p><aside>side words</aside><p>%s</article><footer>&copy; somebody and some more words</footer></body></html>"""


def expected(k, body):
    return f"The {k} & head First bold line. More words here {body}".strip()


def test_main_text(spark):
    rows = [("u", PAGE % (k, "last " * (k % 9))) for k in range(40)]
    found = {r.page_id: r for r in html_extraction.extracted(pages(spark, rows)).collect()}
    for k in range(40):
        assert found[k].text == expected(k, " ".join(["last"] * (k % 9)))
        assert found[k].n_chars == len(found[k].text)


def test_awkward_pages(spark):
    rows = [("u", None), ("u", ""), ("u", "<"), ("u", "<p"), ("u", "<!-- a"), ("u", "<script>x"), (None, "plain words"),
            ("u", '<p title="a>b">in</p>'), ("u", "&lt;b&gt; &#65;" * 2000)]
    found = {r.page_id: r.text for r in html_extraction.extracted(pages(spark, rows)).collect()}
    assert len(found) == 9 and found[0] == found[1] == "" and found[6] == "plain words" and found[7] == "in"
    assert found[8] == html.unescape("&lt;b&gt; &#65;" * 2000)
    assert html_extraction.extracted(pages(spark, rows).limit(0)).count() == 0


def test_best_run_against_all_runs():
    import itertools
    import random

    import numpy as np

    rnd = random.Random(6)
    for _ in range(200):
        scores = np.array([rnd.choice((-3.0, -1.0, 1.0, 2.0)) for _ in range(rnd.randrange(12))])
        start, end = html_extraction.best_run(scores)
        best = max((scores[a:b].sum() for a, b in itertools.combinations(range(len(scores) + 1), 2)), default=0.0)
        assert scores[start:end].sum() == max(best, 0.0)




def test_class_names_and_ids_count(spark):
    body = " ".join(f"word{i}" for i in range(30))
    page = ('<div class="page"><article data-class="ad"><p>{b}</p><div class="box advert"><p>buy this now</p></div>'
            "<p>{b}</p><ul id=comments><li>first!<li>second</ul><p title='a > b'>{b}</p></article></div>").format(b=body)
    found = html_extraction.extracted(pages(spark, [("u", page)])).collect()[0].text
    assert found == " ".join([body] * 3)


def test_markup_is_read_as_far_as_it_goes():
    words = [w for k, _, w in html_extraction.tokens("a <b class='x>y <i>z</i> < 3 <p title='k>m'>n<q") if k == "word"]
    assert words == ["a", "y", "z", "<", "3", "n", "<", "q"]
    blocks = [s[0] for s, w, *_ in html_extraction.walk("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><th>e</table><p>f<p>g") if w]
    assert blocks == [f"word in {b}" for b in ("li", "li", "td", "td", "th", "p", "p")]


@pytest.mark.parametrize("unit", ["<p>word text", '<a "x', "<a 'x>\"<b y", "<div>", "</b><b>", "<", "<!-- x", '<a x=">', "<a class='", "</"])
def test_broken_pages_are_read_in_linear_time(unit):
    def seconds(size):
        page = unit * (size // len(unit))
        begun = time.process_time()
        html_extraction.main_text(page, html_extraction.DEFAULT_WEIGHTS)
        return time.process_time() - begun

    assert seconds(2_000_000) < 20
