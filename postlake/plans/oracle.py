"""The registered queries once more as plain SQL over the same tables."""

from __future__ import annotations

from ..operators.query import Box
from ..operators.search import FIELD_WEIGHTS
from . import corpus
from .queries import ALIASES, DELAY, INDEXED, SEARCHES, SKILL_COUNT, TAXONOMY, TOP, WANTED

ORACLES: dict[str, str] = {}


def _lit(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _pick(values, number: str) -> str:
    return f"([{', '.join(_lit(v) for v in values)}])[CAST({number} AS INT) + 1]"


_WORDS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def words(text: str) -> str:
    return _WORDS.format(text)


_URL = "'https://' || source || '.example.org/' || doc_id"

POSTINGS = f"""postings AS (
  SELECT doc_id, sha1(lower(source) || '|' || doc_id) AS fingerprint, source,
    CAST(doc_id AS VARCHAR) AS external_id, {_URL} AS url,
    split_part(text, chr(10), 1) AS title, {_pick(corpus.COMPANIES, 'doc_id % 7')} AS company,
    text AS description,
    {_pick([p[0] for p in corpus.PLACES], 'doc_id % 5')} AS city,
    {_pick([p[1] for p in corpus.PLACES], 'doc_id % 5')} AS region,
    {_pick([p[2] for p in corpus.PLACES], 'doc_id % 5')} AS country,
    CASE WHEN doc_id % 3 <> 0 THEN 46.2 END AS lat,
    {_pick(corpus.CONTRACTS, 'doc_id % 4')} AS contract_type,
    CAST(CASE WHEN doc_id % 5 <> 0 THEN 40 + doc_id % 7 * 10 END AS INT) AS workload_min,
    CAST(CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 5 <> 0
      THEN least(100, 60 + doc_id % 7 * 10) ELSE 100 END END AS INT) AS workload_max,
    CAST(CASE WHEN doc_id % 4 <> 0 THEN 50000 + doc_id % 40 * 1000 END AS DOUBLE) AS salary_min,
    CAST(CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN 65000 + doc_id % 40 * 1000 END
      AS DOUBLE) AS salary_max,
    CASE WHEN doc_id % 13 <> 0 THEN strftime(DATE '2026-01-01' + CAST(doc_id % 240 AS INT), '%Y-%m-%d')
      END AS posted_at,
    lang, [source, lang] AS keywords,
    list_slice([{', '.join(_lit(s) for s in corpus.SKILLS * 2)}], doc_id % 7 + 1, doc_id % 7 + doc_id % 4) AS skills,
    {_lit(corpus.SEEN_AT)} AS first_seen_at
  FROM documents)"""


# -- search ---------------------------------------------------------------


def _filter(f: dict) -> str:
    tests = [f"{c} = {_lit(f[c])}" for c in ("source", "region", "country", "contract_type", "lang") if c in f]
    tests += [f"list_contains(skills, {_lit(s)})" for s in f.get("skills", ())]
    if "workload_min" in f:
        tests.append(f"coalesce(workload_max, workload_min) >= {f['workload_min']}")
    if "salary_min" in f:
        tests.append(f"coalesce(salary_max, salary_min) >= {f['salary_min']}")
    if "posted_since" in f:
        tests.append(f"coalesce(posted_at, first_seen_at) >= {_lit(f['posted_since'])}")
    return " AND ".join(tests) or "true"


def _token_table(source: str) -> str:
    parts = []
    for i, field in enumerate(FIELD_WEIGHTS):
        text = f"array_to_string({field}, ' ')" if field in ("keywords", "skills") else field
        parts.append(f"SELECT fingerprint, {i} AS f, {words(f'coalesce({text}, {_lit('')})')} AS ws FROM {source}")
    return f"""fields AS ({' UNION ALL '.join(parts)}),
sizes AS (SELECT fingerprint, CAST(sum(len(ws)) AS BIGINT) AS d FROM fields GROUP BY 1),
corpus AS (SELECT count(*) AS n, sum(d) / count(*) AS avgdl FROM sizes),
toks AS (SELECT fingerprint, f, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM fields)"""


def _search_sql(typed: str, filters: dict, source: str = "postings", before: str = "",
                tail: str = "", counted: bool = False) -> str:
    """Ranked search written out: one hit table per phrase, then the formula."""
    box = Box.read(typed)
    weights = "[" + ", ".join(str(w) for w in FIELD_WEIGHTS.values()) + "]"
    hits, joins, columns = [], [], []
    for i, phrase in enumerate(box.phrases):
        def test(alias: str, k: int, phrase=phrase) -> str:
            term = phrase.terms[k]
            if phrase.prefix and k == len(phrase.terms) - 1:
                return f"starts_with({alias}.w, {_lit(term)})"
            return f"{alias}.w = {_lit(term)}"

        following = " ".join(
            f"JOIN toks t{k} ON t{k}.fingerprint = t0.fingerprint AND t{k}.f = t0.f"
            f" AND t{k}.p = t0.p + {k} AND {test(f't{k}', k)}"
            for k in range(1, len(phrase.terms))
        )
        hits.append(
            f"h{i} AS (SELECT t0.fingerprint, sum(({weights})[t0.f + 1]) AS v FROM toks t0"
            f" {following} WHERE {test('t0', 0)} GROUP BY 1),"
            f" n{i} AS (SELECT greatest(ln((c.n - x.k + 0.5) / (x.k + 0.5)), 1e-6) AS idf"
            f" FROM corpus c, (SELECT count(*) AS k FROM h{i}) x)"
        )
        joins.append(f"LEFT JOIN h{i} ON h{i}.fingerprint = s.fingerprint CROSS JOIN n{i}")
        columns.append(f"coalesce(h{i}.v, 0) AS v{i}, n{i}.idf AS idf{i}")

    def group(numbers) -> str:
        return "(" + " AND ".join(f"v{i} > 0" for i in numbers) + ")"

    branches, parts = [], []
    for branch in box.tree:
        sides = []
        for first, *excluded in branch:
            sides.append("(" + " AND NOT ".join(group(g) for g in (first, *excluded)) + ")")
        whole = "(" + " AND ".join(sides) + ")"
        branches.append(whole)
        parts += [(i, whole) for first, *_ in branch for i in first]
    score = " + ".join(
        f"CASE WHEN {whole} THEN idf{i} * (v{i} * 2.2) / (v{i} + 1.2 * (0.25 + 0.75 * d / avgdl)) ELSE 0 END"
        for i, whole in parts
    )
    what = "count(*) AS n" if counted else "external_id, round(-score, 6) AS rank"
    return f"""WITH {before}{POSTINGS},
{_token_table(source)},
{', '.join(hits)},
joined AS (SELECT s.fingerprint, s.d, c.avgdl, {', '.join(columns)} FROM sizes s CROSS JOIN corpus c {' '.join(joins)}),
scored AS (SELECT fingerprint, {score} AS score FROM joined WHERE {' OR '.join(branches)})
SELECT {what} FROM scored JOIN {source} USING (fingerprint) WHERE {_filter(filters)} {tail}"""


for _name, (_typed, _filters) in SEARCHES.items():
    ORACLES[_name] = _search_sql(_typed, _filters)
for _name in INDEXED:
    ORACLES[_name.replace("search_", "index_search_")] = ORACLES[_name]
    ORACLES[_name.replace("search_", "lists_search_")] = ORACLES[_name]
ORACLES["index_top_k"] = _search_sql(TOP, {}, tail="ORDER BY -score, fingerprint LIMIT 20")
ORACLES["index_dictionary"] = f"""WITH {POSTINGS}, {_token_table("postings")}
SELECT w AS term, count(DISTINCT fingerprint) AS postings FROM toks GROUP BY 1"""
ORACLES["index_phrase_pairs"] = f"""WITH {POSTINGS}, {_token_table("postings")},
df AS (SELECT w, count(DISTINCT fingerprint) AS n FROM toks GROUP BY 1),
common AS (SELECT * FROM df WHERE n >= greatest(2, 0.1 * (SELECT n FROM corpus)))
SELECT a.w || ' ' || b.w AS term, count(DISTINCT a.fingerprint) AS postings, count(*) AS places,
  any_value(ca.n + cb.n) AS in_lists
FROM toks a JOIN toks b ON a.fingerprint = b.fingerprint AND a.f = b.f AND a.p + 1 = b.p
JOIN common ca ON ca.w = a.w JOIN common cb ON cb.w = b.w GROUP BY 1"""
ORACLES["search_page"] = _search_sql(
    "the of", {}, tail="ORDER BY -score, fingerprint LIMIT 20 OFFSET 20"
)
ORACLES["search_offset"] = _search_sql("the of", {}, tail="ORDER BY -score, fingerprint OFFSET 11")
ORACLES["search_full_rows"] = _search_sql("the of", {}, tail="ORDER BY -score, fingerprint LIMIT 20").replace(
    "SELECT external_id, round(-score, 6) AS rank FROM",
    "SELECT postings.* REPLACE (CAST(lat AS DOUBLE) AS lat, array_to_string(keywords, '|') AS keywords, array_to_string(skills, '|') AS skills),"
    f" {_lit(corpus.SEEN_AT)} AS last_seen_at, round(-score, 6) AS rank FROM")
ORACLES["browse_offset"] = f"""WITH {POSTINGS} SELECT external_id, posted_at FROM postings WHERE lang = 'en'
ORDER BY coalesce(posted_at, first_seen_at) DESC, fingerprint OFFSET 37"""
ORACLES["index_refresh_all"] = _search_sql("zyxnew OR zyxkept", {}, source="living").replace(
    f"{POSTINGS},", f"{POSTINGS}, living AS (SELECT * REPLACE (CASE doc_id % 4 WHEN 0 THEN 'zyxnew' ELSE 'zyxkept' END"
    " AS title) FROM postings WHERE doc_id % 4 <> 1),")
ORACLES["search_count"] = _search_sql(
    "the NOT of", {"country": "CH", "workload_min": 70}, counted=True
)
ORACLES["index_refresh"] = _search_sql("thatin OR der", {}, source="living").replace(
    f"{POSTINGS},",
    f"{POSTINGS}, living AS (SELECT * FROM postings WHERE doc_id NOT IN"
    " (SELECT doc_id FROM labels WHERE toxic = 1)),",
)
ORACLES["search_browse"] = f"""WITH {POSTINGS}
SELECT external_id, CAST(NULL AS DOUBLE) AS rank, city, posted_at FROM postings
WHERE translate(city, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%neuch%'
  AND translate(company, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%r_a%%'
  AND coalesce(posted_at, first_seen_at) >= '2026-03-01'
ORDER BY coalesce(posted_at, first_seen_at) DESC, fingerprint LIMIT 50"""
ORACLES["get_many"] = f"""WITH {POSTINGS}
SELECT fingerprint, external_id, title, description FROM postings WHERE doc_id IN (SELECT doc_id FROM labels)"""
ORACLES["get_by_fingerprint"] = f"""WITH {POSTINGS}
SELECT fingerprint, external_id, url, title, description FROM postings WHERE fingerprint = {_lit(WANTED)}"""


# -- reports --------------------------------------------------------------


def _facet(field: str, limit: int, where: str = "true") -> str:
    return f"""WITH {POSTINGS} SELECT {field} AS value, count(*) AS count FROM postings
WHERE {where} AND {field} IS NOT NULL AND {field} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"""


ORACLES["facet_source"] = _facet("source", 50)
ORACLES["facet_lang"] = _facet("lang", 30)
ORACLES["facet_company"] = _facet("company", 30, _filter({"country": "CH", "salary_min": 55000.0}))
ORACLES["facet_city_filtered"] = _facet(
    "city", 30, _filter({"lang": "en", "skills": ["sql"], "posted_since": "2026-02-01"})
)
ORACLES["facets_all"] = f"""WITH {POSTINGS}, kept AS (SELECT * FROM postings WHERE coalesce(workload_max, workload_min) >= 50),
values_ AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM kept" for f in ("source", "region", "city", "company", "country", "contract_type", "lang"))}),
counted AS (SELECT field, value, count(*) AS count FROM values_ WHERE value <> '' GROUP BY 1, 2)
SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY field ORDER BY count DESC, value) <= 20"""
ORACLES["summary_by_country"] = _facet("country", 20)
ORACLES["top_skills"] = f"""WITH {POSTINGS}, t AS (SELECT unnest(skills) AS value FROM postings
WHERE coalesce(workload_max, workload_min) >= 0)
SELECT value, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"""
ORACLES["top_terms_text"] = f"""WITH t AS (SELECT unnest({words('text')}) AS value FROM documents)
SELECT value, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100"""
ORACLES["timeline_days"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events
GROUP BY 1 ORDER BY 1 DESC LIMIT 20"""
ORACLES["timeline_postings"] = f"""WITH {POSTINGS}
SELECT substr(coalesce(posted_at, first_seen_at), 1, 10) AS day, count(*) AS count FROM postings
WHERE contract_type = 'permanent' GROUP BY 1 ORDER BY 1 DESC LIMIT 45"""
ORACLES["summary"] = f"""WITH {POSTINGS}
SELECT count(*) AS total, count(DISTINCT source) AS sources, count(DISTINCT company) AS companies,
  min(coalesce(posted_at, first_seen_at)) AS oldest, max(coalesce(posted_at, first_seen_at)) AS newest,
  CAST(sum(CASE WHEN lat IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS geolocated FROM postings"""
ORACLES["counts_by_source"] = "SELECT source, count(*) AS n FROM documents GROUP BY 1"
ORACLES["total"] = "SELECT count(*) AS n FROM documents"


# -- normalisation --------------------------------------------------------

_CLEAN = r"nullif(trim(regexp_replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&eacute;', 'é'), '&#233;', 'é'), '&amp;', '&'), '\s+', ' ', 'g')), '')"


def _clean(text: str) -> str:
    return _CLEAN.format(text)


_RAW_TITLE = (
    "CASE WHEN doc_id % 23 = 0 THEN ' &nbsp; ' ELSE '  ' || split_part(text, chr(10), 1)"
    " || ' &amp;' || chr(9) || ' R&eacute;f&#233;rence&nbsp;' || doc_id END"
)
_RAW_URL = "CASE WHEN doc_id % 17 = 0 THEN 'ftp://' ELSE 'https://' END || source || '.example.org/' || doc_id"
_RAW_SOURCE = "CASE WHEN doc_id % 19 <> 0 THEN source END"
_RAW_FINGERPRINT = (
    f"sha1(coalesce({_RAW_SOURCE}, '') || '|' || CASE WHEN doc_id % 2 = 0"
    f" THEN CAST(doc_id AS VARCHAR) ELSE {_RAW_URL} END)"
)
ORACLES["normalise_text"] = rf"""SELECT doc_id, {_clean(_RAW_TITLE)} AS title,
  nullif(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), chr(10)),
    ' ' || chr(10)), '') AS description,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS external_id,
  '2026-09-01T00:00:00Z' AS scraped_at FROM documents"""
# What each written number stands for.
_NUMBERS = ("46.52", "-0.75", "12500", "9870", "33.25", "2750.4", None, None, None, "3141592.6")


def _number(index: str) -> str:
    return f"CAST({_pick(_NUMBERS, index)} AS DOUBLE)"


ORACLES["normalise_numbers"] = f"""WITH w AS (SELECT *, greatest(0, least(100, 150 - doc_id % 160)) AS a,
  greatest(0, least(100, CAST(round_even(doc_id % 130 - 10 + CASE WHEN doc_id % 130 < 10 THEN -0.5 ELSE 0.5 END, 0) AS INT))) AS b
  FROM documents)
SELECT doc_id, {_number('doc_id % 10')} AS lat, {_number('(doc_id + 3) % 10')} AS salary_min,
  ['CHF', NULL, NULL, 'EUR'][CAST(doc_id % 4 AS INT) + 1] AS salary_currency,
  CAST(least(a, b) AS INT) AS workload_min, CAST(greatest(a, b) AS INT) AS workload_max FROM w"""
ORACLES["normalise_dates"] = """WITH p AS (SELECT doc_id, doc_id % 28 + 1 AS d, doc_id % 12 + 1 AS m,
  2020 + doc_id % 6 AS y FROM documents), q AS (SELECT *, CASE
  WHEN doc_id % 11 IN (8, 10) THEN NULL
  WHEN doc_id % 11 = 7 THEN printf('%d-%02d-31', y, m)
  WHEN doc_id % 11 = 9 THEN printf('%d-%02d-27', y, m)
  ELSE printf('%d-%02d-%02d', y, m, d) END AS t FROM p)
SELECT doc_id, strftime(try_strptime(t, '%Y-%m-%d'), '%Y-%m-%d') AS posted_at FROM q"""
ORACLES["normalise_lists"] = f"""SELECT doc_id, array_to_string(list_filter(
  ['python', 'Go', lang, CASE WHEN {_pick(corpus.SKILLS, 'doc_id % 7')} NOT IN ('python', 'Go', lang)
    THEN {_pick(corpus.SKILLS, 'doc_id % 7')} END], lambda x: x IS NOT NULL), '|') AS skills,
  CAST(0 AS INT) AS n_keywords FROM documents"""
ORACLES["normalise_country"] = """SELECT doc_id,
  ['DE', 'CH', 'LU', 'BE', 'PT', NULL, NULL, 'CH', 'FR'][CAST(doc_id % 9 AS INT) + 1] AS country FROM documents"""
ORACLES["normalise_fingerprint"] = f"SELECT doc_id, {_RAW_FINGERPRINT} AS fingerprint FROM documents"

_PAY = """pay AS (SELECT doc_id, source, 40 + doc_id % 50 AS a, 60 + doc_id % 70 AS b, 10 + doc_id % 80 AS yy,
  CASE doc_id % 4 WHEN 1 THEN 'CHF' WHEN 3 THEN 'EUR' END AS hint FROM documents),
texts AS (SELECT *, CASE doc_id % 8
  WHEN 0 THEN a || 'k€ bis ' || b || 'k€'
  WHEN 1 THEN 'Lohn ' || a || '''000 / ' || b || '''000 Fr.'
  WHEN 2 THEN 'Annual compensation: ' || a || ' 500 £'
  WHEN 3 THEN 'nach Verabrédung'
  WHEN 4 THEN 'Beginn 20' || yy || ', Pensum 80%'
  WHEN 5 THEN 'Gehalt 2031 ab $ ' || a || '.250,75'
  WHEN 6 THEN 'zwischen ' || a || ' 900 und ' || b || ' 900'
  ELSE 'Salary EUR ' || a || '00 or frs' END AS t FROM pay),
seen AS (SELECT *, coalesce(CASE
  WHEN regexp_matches(t, '(?i)\\bCHF\\b|\\bFr\\.|\\bfrs\\b') THEN 'CHF'
  WHEN regexp_matches(t, '(?i)€|\\bEUR\\b|\\beuros?\\b') THEN 'EUR'
  WHEN regexp_matches(t, '(?i)\\bGBP\\b|£') THEN 'GBP'
  WHEN regexp_matches(t, '(?i)\\bUSD\\b|\\$') THEN 'USD' END, hint) AS cur,
  regexp_matches(t, '(?i)\\blohn\\b|\\bcompensation\\b|\\bgehalt|\\bsalary\\b') AS spoken,
  CASE WHEN regexp_matches(t, '\\d\\s*[kK]\\b|\\d\\s*[kK][€$]') THEN 1000.0 ELSE 1.0 END AS k FROM texts),
runs AS (SELECT *, list_transform(regexp_extract_all(t, '\\d[\\d\\s.,''’]*'), lambda r: trim(r)) AS raws FROM seen),
nums AS (SELECT *, list_transform(list_filter(raws, lambda r: NOT (k = 1.0
    AND regexp_full_match(r, '\\d{4}') AND TRY_CAST(r AS INT) BETWEEN 1900 AND 2100)),
  lambda r: k * CAST(CASE WHEN regexp_matches(regexp_replace(r, '[ ''’]', '', 'g'), '[.,]\\d{1,2}$')
    THEN regexp_replace(regexp_replace(regexp_replace(r, '[ ''’]', '', 'g'), '[.,]\\d{1,2}$', ''), '[.,]', '', 'g')
      || '.' || regexp_extract(r, '[.,](\\d{1,2})$', 1)
    ELSE regexp_replace(r, '[ ''’.,]', '', 'g') END AS DOUBLE)) AS ns FROM runs),
paid AS (SELECT doc_id, source,
  CASE WHEN cur IS NOT NULL OR spoken THEN list_min(list_filter(ns, lambda n: n >= 1000)) END AS salary_min,
  CASE WHEN cur IS NOT NULL OR spoken THEN list_max(list_filter(ns, lambda n: n >= 1000)) END AS salary_max,
  cur AS salary_currency FROM nums)""".replace("\\\\", "\\")
ORACLES["salary_extract"] = f"WITH {_PAY} SELECT doc_id, salary_min, salary_max, salary_currency FROM paid"
_COVERAGE = """SELECT source, count(*) AS total, count({low}) AS parsed, min({low}) AS lowest,
  max({high}) AS highest, CAST(median({low}) AS DOUBLE) AS median_low FROM {table} GROUP BY 1"""
ORACLES["salary_coverage"] = f"WITH {_PAY} " + _COVERAGE.format(
    low="salary_min", high="salary_max", table="paid"
)
ORACLES["workload_extract"] = """SELECT doc_id,
  CAST([90, 50, 30, NULL, 0, NULL, 20][CAST(doc_id % 7 AS INT) + 1] AS INT) AS workload_min,
  CAST([90, 70, 60, NULL, 0, NULL, 40][CAST(doc_id % 7 AS INT) + 1] AS INT) AS workload_max FROM documents"""
ORACLES["workload_in_texts"] = r"""WITH r AS (SELECT source, list_filter(list_transform(
  regexp_extract_all(text, '\d{1,3}'), lambda x: CAST(x AS INT)), lambda x: x <= 100) AS ns FROM documents),
w AS (SELECT source, list_min(ns) AS lo, list_max(ns) AS hi FROM r) """ + _COVERAGE.format(
    low="lo", high="hi", table="w"
)
ORACLES["dates_written"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 11 <> 10 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"""
ORACLES["amounts_written"] = """SELECT l_orderkey, l_linenumber,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem"""
ORACLES["workload_numbers"] = """SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity + 0.5, 0) AS INT) AS workload_min,
  CAST(round_even(l_quantity + 0.5, 0) AS INT) AS workload_max, round(l_extendedprice * 1000, 1) AS salary_min,
  'CHF' AS salary_currency FROM lineitem"""
ORACLES["entities_numeric"] = """SELECT doc_id, hex(encode(CASE WHEN doc_id % 1000 + 33 BETWEEN 128 AND 159
  THEN list_extract(['€', '', '‚', 'ƒ', '„', '…', '†', '‡', 'ˆ', '‰', 'Š', '‹', 'Œ', '', 'Ž', '',
    '', '‘', '’', '“', '”', '•', '–', '—', '˜', '™', 'š', '›', 'œ', '', 'ž', 'Ÿ'], CAST(doc_id % 1000 + 33 - 127 AS INT))
  ELSE chr(CAST(doc_id % 1000 + 33 AS INT)) END)) AS one FROM documents""".replace(
    "SELECT doc_id, hex(", "SELECT doc_id, one || one AS bytes FROM (SELECT doc_id, hex(") + ")"
ORACLES["slugs"] = """SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM documents"""

_NAMES = {"amp": "&", "quot": '"', "copy": "©", "middot": "·", "nbsp": " ", "lt": "<", "gt": ">"}
_ENTITY = "&[A-Za-z0-9]+;?"
ORACLES["pages_to_text"] = rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?i)<\s*br\s*/?\s*>', chr(10), 'g'), '(?i)</\s*(p|div|li|tr|h[1-6])\s*>', chr(10), 'g'),
    '(?i)<\s*li[^>]*>', chr(10) || '- ', 'g'), '(?s)</?[^ >/]+.*?>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, array_to_string(list_transform(list_zip(string_split_regex(t, '{_ENTITY}'),
    list_concat(regexp_extract_all(t, '{_ENTITY}'), [''])),
  lambda z: z[1] || CASE z[2] {' '.join(f"WHEN '&{n};' THEN {_lit(c)} WHEN '&{n}' THEN {_lit(c)}" for n, c in _NAMES.items())}
    ELSE CASE WHEN ends_with(z[2], ';') THEN '' ELSE z[2] END END), '') AS t FROM a),
c AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM b)
SELECT page_id, nullif(array_to_string(ls, chr(10)), '') AS text FROM c"""


# -- sources --------------------------------------------------------------


def _links(keep: str) -> str:
    kept = f"WHERE regexp_matches(h, {_lit(keep)})" if keep else ""
    return rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
  regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
b AS (SELECT page_id, origin, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM a),
c AS (SELECT page_id, origin || h AS link, min(i) AS i FROM b {kept} GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS link_pos, link FROM c"""


ORACLES["page_links"] = _links("")
ORACLES["page_links_kept"] = _links("^/(the|and|de)")

_CITY = f"CASE WHEN doc_id % 2 = 0 THEN {_pick([p[0] for p in corpus.PLACES], 'doc_id % 5')} ELSE {_pick([p[1] for p in corpus.PLACES], 'doc_id % 5')} END"
_CONTRACT = "['permanent', 'part_time', 'night_shift_only', 'apprenticeship'][CAST(doc_id % 4 AS INT) + 1]"
_ONE_LINE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
ORACLES["jsonld_postings"] = rf"""SELECT {_ONE_LINE.format("split_part(text, chr(10), 1)")} AS title,
  array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: {_ONE_LINE.format('x')}), lambda x: x <> ''), chr(10)) AS description,
  CAST(doc_id AS VARCHAR) AS external_id, {_URL} AS url,
  printf('2026-08-%02d', doc_id % 28 + 1) AS posted_at, CAST(NULL AS VARCHAR) AS expires_at,
  {_CONTRACT} AS contract_type, {_URL} AS apply_url, 'Fig & Sons' AS company,
  CASE WHEN doc_id % 5 = 0 THEN 'remote' END AS remote_policy, {_CITY} AS city,
  CASE WHEN doc_id % 2 = 0 THEN {_pick([p[1] for p in corpus.PLACES], 'doc_id % 5')} END AS region,
  CAST(1000 + doc_id % 9000 AS VARCHAR) AS postal_code,
  CASE doc_id % 3 WHEN 0 THEN 'CH' WHEN 1 THEN 'BE' END AS country,
  (1000 + doc_id % 9000) || ', ' || {_CITY} AS location_raw,
  CAST(46.2 AS DOUBLE) AS lat, CAST(doc_id % 90 AS DOUBLE) AS lon,
  CAST(CASE doc_id % 3 WHEN 0 THEN 50000 + doc_id % 1000 WHEN 1 THEN 80000 END AS DOUBLE) AS salary_min,
  CAST(CASE doc_id % 3 WHEN 0 THEN 60000 + doc_id % 1000 WHEN 1 THEN 80000 END AS DOUBLE) AS salary_max,
  CASE WHEN doc_id % 3 < 2 THEN 'CHF' END AS salary_currency
FROM documents WHERE doc_id % 10 <> 9"""
ORACLES["jsonld_blocks"] = """WITH b AS (
  SELECT source, unnest(CASE WHEN doc_id % 3 < 2 THEN [false, true] ELSE [true] END) AS is_posting,
    unnest(CASE WHEN doc_id % 3 < 2 THEN [0, 1] ELSE [0] END) AS block_pos
  FROM documents WHERE doc_id % 10 <> 9)
SELECT source, block_pos, is_posting, count(*) AS n FROM b GROUP BY 1, 2, 3"""
ORACLES["jsonld_deep"] = """SELECT doc_id, CASE
  WHEN doc_id % 12 + 1 < 3 THEN text WHEN trim(text) = '' THEN 'late' ELSE text END AS text FROM documents"""
ORACLES["sources_stamped"] = """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE 'stamped' END AS source, lang,
  '2026-09-0' || (doc_id % 9 + 1) AS scraped_at FROM documents"""
ORACLES["detail_overlay"] = rf"""SELECT {_URL} AS url, CASE WHEN doc_id % 10 <> 9 THEN
  {_ONE_LINE.format("split_part(text, chr(10), 1)")} END AS title, source AS company,
  CAST(NULL AS VARCHAR) AS city, {_CONTRACT} AS contract_type
FROM documents WHERE doc_id % 10 <> 9 AND source <> 'src3'"""

ORACLES["api_rows"] = """WITH d AS (SELECT *, CAST(floor(doc_id / 100) AS INT) AS page FROM documents)
SELECT 'api' || page % 2 AS source, page, CAST(doc_id AS VARCHAR) AS external_id, lang AS title, n_chars AS size
FROM d WHERE page % 7 < 5"""
ORACLES["api_unreadable"] = """SELECT DISTINCT 'api' || CAST(floor(doc_id / 100) AS INT) % 2 AS source,
  CAST(floor(doc_id / 100) AS INT) AS page FROM documents WHERE CAST(floor(doc_id / 100) AS INT) % 7 = 6"""
ORACLES["api_page_report"] = """WITH d AS (SELECT CAST(floor(doc_id / 100) AS INT) AS page, count(*) AS n FROM documents GROUP BY 1),
e AS (SELECT 'api' || page % 2 AS source, page, CAST(CASE WHEN page % 7 < 5 THEN n + 2 ELSE 0 END AS BIGINT) AS n_rows FROM d),
f AS (SELECT source, min(page) AS last FROM e WHERE n_rows < 102 GROUP BY 1)
SELECT source, page, n_rows, n_rows < 102 AS is_last, coalesce(page > last, false) AS past_end
FROM e LEFT JOIN f USING (source)"""
ORACLES["sitemap_urls"] = f"""WITH {POSTINGS} SELECT url AS loc, posted_at AS lastmod FROM postings WHERE url LIKE '%src1%'"""
_TREE = f"""{POSTINGS}, tree AS (SELECT doc_id, url AS loc, posted_at AS lastmod, doc_id // 40 AS map
  FROM postings WHERE doc_id // 40 % 5 <> 4)"""
ORACLES["sitemap_tree"] = f"WITH {_TREE} SELECT loc, lastmod FROM tree"
ORACLES["sitemap_tree_quota"] = f"WITH {_TREE} SELECT loc, lastmod FROM tree ORDER BY map, doc_id LIMIT 130"
ORACLES["quota"] = """SELECT doc_id AS ingest_seq, source, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 17"""
ORACLES["all_sources"] = """WITH a AS (
  SELECT doc_id AS ingest_seq, CAST(doc_id AS VARCHAR) AS external_id, lang, 'docs' AS source, NULL AS url FROM documents
  UNION ALL SELECT page_id, CAST(page_id AS VARCHAR), NULL, 'pages', url FROM pages
  UNION ALL SELECT conv_id * 1000 + turn, conv_id || '-' || turn, NULL, 'talk', NULL FROM conversations)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY ingest_seq) <= 300"""
ORACLES["archive_roundtrip"] = rf"""WITH {POSTINGS} SELECT source, 'r1' AS run_id, external_id,
  {_ONE_LINE.format('title')} AS title, array_to_string(skills, '|') AS skills, workload_max, salary_max, posted_at
FROM (SELECT * REPLACE (CASE WHEN workload_min > workload_max THEN workload_min ELSE workload_max END AS workload_max) FROM postings)"""


# -- validation, duplicates, state ----------------------------------------

_JUDGED = f"""judged AS (SELECT doc_id, array_to_string(list_filter([
    CASE WHEN doc_id % 19 = 0 THEN 'source' END, CASE WHEN {{title}} IS NULL THEN 'title' END],
    lambda x: x IS NOT NULL), '|') AS missing_fields, {_RAW_URL} AS url FROM documents),
outcome AS (SELECT *, CASE WHEN missing_fields <> '' THEN 'incomplete'
  WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_url' END AS reject_reason FROM judged)""".format(
    title=_clean(_RAW_TITLE)
)
ORACLES["validate_rejects"] = f"""WITH {_JUDGED} SELECT doc_id, reject_reason, missing_fields FROM outcome
WHERE reject_reason IS NOT NULL"""
ORACLES["validate_counts"] = f"""WITH {_JUDGED} SELECT coalesce(reject_reason, 'valid') AS outcome, count(*) AS n
FROM outcome GROUP BY 1"""

_COPIES = """copies AS (SELECT 's' || doc_id % 2 AS source, lang, doc_id AS ingest_seq,
  CASE WHEN doc_id % 29 <> 0 THEN sha1(text) END AS fp FROM documents),
ranked AS (SELECT *, CASE WHEN fp IS NULL THEN 1 ELSE
  row_number() OVER (PARTITION BY source, fp ORDER BY ingest_seq) END AS rn FROM copies)"""
ORACLES["dedup_run"] = f"WITH {_COPIES} SELECT ingest_seq, source, lang FROM ranked WHERE rn = 1"
ORACLES["dedup_dropped"] = f"WITH {_COPIES} SELECT ingest_seq, source, lang FROM ranked WHERE rn > 1"
ORACLES["dedup_counts"] = f"""WITH {_COPIES} SELECT 'r1' AS run_id, source,
  CAST(count(*) FILTER (rn > 1) AS BIGINT) AS duplicates FROM ranked GROUP BY 2"""

_SEEN = """seen AS (SELECT sha1(event_type || '|' || user_id) AS fingerprint, event_type AS source,
  CASE WHEN event_id % 5 <> 0 THEN props END AS title, value AS salary_min,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seen_at, strftime(ts, '%Y-%m-%d') AS day,
  dayofyear(ts) AS run_seq, event_id FROM events),
ordered AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY run_seq, event_id) AS up,
  row_number() OVER (PARTITION BY fingerprint ORDER BY run_seq DESC, event_id DESC) AS down FROM seen),
folded AS (SELECT z.fingerprint, z.source, z.title, z.salary_min, a.seen_at AS first_seen_at,
  z.seen_at AS last_seen_at FROM ordered z JOIN ordered a USING (fingerprint) WHERE z.down = 1 AND a.up = 1)"""
ORACLES["state_fold"] = f"WITH {_SEEN} SELECT * FROM folded"
ORACLES["state_fold_wide"] = """WITH seen AS (SELECT *, sha1(source || '|' || lang || '|' || n_chars // 100) AS fingerprint,
  doc_id % 7 AS run, '2026-09-0' || (doc_id % 7 + 1) AS seen_at FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY run, doc_id) AS up,
  row_number() OVER (PARTITION BY fingerprint ORDER BY run DESC, doc_id DESC) AS down FROM seen)
SELECT z.fingerprint, z.source, CASE WHEN z.doc_id % 5 <> 0 THEN 'seen ' || z.doc_id END AS title, z.text AS description,
  a.seen_at AS first_seen_at, z.seen_at AS last_seen_at
FROM placed z JOIN placed a USING (fingerprint) WHERE z.down = 1 AND a.up = 1"""
ORACLES["state_snapshots"] = ORACLES["state_fold"]


def _in_order(rank: str, keep: str = "true", content: str = "") -> str:
    """The state after runs applied by `rank`: within a run by its own order; content
    and last sight of the last, first sight of the first one."""
    return f"""WITH {_SEEN}, runs AS (SELECT *, CASE WHEN day < '2024-01-09' THEN 0 WHEN day < '2024-01-17' THEN 1
  WHEN day < '2024-01-25' THEN 2 ELSE 3 END AS week FROM seen), ranked AS (SELECT *, {rank} AS r FROM runs WHERE {keep}),
placed AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY r, run_seq, event_id) AS up,
  row_number() OVER (PARTITION BY fingerprint ORDER BY r DESC, run_seq DESC, event_id DESC) AS down FROM ranked)
SELECT z.fingerprint, z.source, z.title, z.salary_min, a.seen_at AS first_seen_at, z.seen_at AS last_seen_at
FROM placed z JOIN placed a USING (fingerprint) WHERE z.down = 1 AND a.up = 1"""


ORACLES["state_late_run"] = _in_order("CASE week WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END")
ORACLES["state_two_sources"] = _in_order("0")
ORACLES["state_rerun"] = f"""WITH once AS ({_in_order('week', 'week < 3')}),
again AS ({_in_order('week', 'week = 1')})
SELECT fingerprint, coalesce(g.source, o.source) AS source, CASE WHEN g.fingerprint IS NULL THEN o.title ELSE g.title END AS title,
  CASE WHEN g.fingerprint IS NULL THEN o.salary_min ELSE g.salary_min END AS salary_min, o.first_seen_at,
  coalesce(g.last_seen_at, o.last_seen_at) AS last_seen_at FROM once o LEFT JOIN again g USING (fingerprint)"""
ORACLES["state_removed"] = _in_order("week", "week < 3 AND (week = 2 OR source NOT LIKE 'c%')")
_IS_NEW = "CASE WHEN substr(last_seen_at, 1, 10) >= '2024-01-16' THEN substr(first_seen_at, 1, 10) >= '2024-01-16' END"
ORACLES["state_upsert"] = f"WITH {_SEEN} SELECT *, {_IS_NEW} AS is_new FROM folded"
ORACLES["upsert_new_updated"] = f"""WITH {_SEEN}, f AS (SELECT {_IS_NEW} AS is_new FROM folded)
SELECT count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS updated FROM f"""
ORACLES["publication_duration"] = f"""WITH {_SEEN}, d AS (SELECT source, CAST(date_diff('day',
  CAST(substr(first_seen_at, 1, 10) AS DATE), CAST(substr(last_seen_at, 1, 10) AS DATE)) AS INT) AS n FROM folded)
SELECT source, count(*) AS postings, min(n) AS shortest, max(n) AS longest, CAST(sum(n) AS BIGINT) AS total_days,
  CAST(median(n) AS DOUBLE) AS median_days FROM d GROUP BY 1"""
ORACLES["salary_quantiles"] = f"""WITH {_SEEN}, q AS (SELECT source, count(salary_min) AS n,
  quantile_cont(salary_min, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM seen GROUP BY 1)
SELECT source, n, {', '.join(f'round(q[{i}], 4) AS {p}' for i, p in enumerate(('p10', 'p25', 'p50', 'p75', 'p90'), 1))} FROM q"""
ORACLES["state_removal"] = f"""WITH {POSTINGS} SELECT external_id, fingerprint FROM postings
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""


# -- enrichment -----------------------------------------------------------


def _tagging() -> str:
    fields = [
        f"coalesce(array_to_string({f}, ' '), '')" if f in ("keywords", "skills") else f"coalesce({f}, '')"
        for f in FIELD_WEIGHTS if f != "skills"
    ]
    spelled = ", ".join(
        f"' ' || array_to_string({words(f)}, ' ') || ' '" for f in fields
    )
    tests = []
    for skill, names in sorted(TAXONOMY.items()):
        aliases = [skill.replace("-", " "), *names]
        found = " OR ".join(
            f"len(list_filter(fs, lambda x: contains(x, ' ' || strip_accents({_lit(a)}) || ' '))) > 0" for a in aliases
        )
        tests.append(f"CASE WHEN {found} THEN {_lit(skill)} END")
    return f"""WITH {POSTINGS}, spelled AS (SELECT external_id, [{spelled}] AS fs FROM postings)
SELECT external_id, array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), '|') AS skills FROM spelled"""


ORACLES["skill_tagging"] = _tagging()
ORACLES["skill_tagging_table"] = f"""WITH spoken AS (SELECT doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
drawn AS (SELECT doc_id, ws, unnest(range({ALIASES})) AS i FROM spoken),
aliases AS (SELECT DISTINCT array_to_string(list_slice(ws, 5 * i + 1, 5 * i + 1 + i % 3), ' ') AS alias,
  's' || (doc_id * {ALIASES} + i) % {SKILL_COUNT} AS skill FROM drawn WHERE len(ws) > 5 * i),
fields AS (SELECT doc_id, 0 AS f, {words("coalesce(split_part(text, chr(10), 1), '')")} AS ws FROM documents
  UNION ALL SELECT doc_id, 1, ws FROM spoken),
placed AS (SELECT doc_id, f, ws, generate_subscripts(ws, 1) AS p FROM fields),
grams AS (SELECT doc_id, f, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS gram
  FROM placed, (SELECT unnest([1, 2, 3]) AS n) WHERE p + n - 1 <= len(ws)),
met AS (SELECT DISTINCT doc_id, f, p, n, gram FROM grams WHERE gram IN (SELECT alias FROM aliases)),
inner_ AS (SELECT DISTINCT m.doc_id, m.f, m.p + k AS p, s AS n FROM met m, (SELECT unnest([1, 2]) AS s), (SELECT unnest([0, 1, 2]) AS k)
  WHERE s < m.n AND k + s <= m.n),
free AS (SELECT m.* FROM met m ANTI JOIN inner_ i ON m.doc_id = i.doc_id AND m.f = i.f AND m.p = i.p AND m.n = i.n)
SELECT doc_id, string_agg(DISTINCT skill, '|' ORDER BY skill) AS skills FROM free JOIN aliases ON alias = gram GROUP BY 1"""
ORACLES["skill_tagging_joined"] = _tagging()
ORACLES["skill_tagging_signs"] = r"""SELECT doc_id, array_to_string(list_filter([
  CASE WHEN doc_id % 3 = 0 THEN 'cpp' END, CASE WHEN doc_id % 3 <> 1 THEN 'csharp' END,
  CASE WHEN doc_id % 3 = 2 THEN 'dotnet' END,
  CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}+#])%%%($|[^\p{L}\p{N}+#])') THEN 'symbols' END],
  lambda x: x IS NOT NULL), '|') AS skills FROM documents""".replace("\\\\", "\\")
ORACLES["enrich_chain"] = f"""WITH {POSTINGS} SELECT external_id,
  CASE WHEN company = 'Müller AG' THEN 'senior' END AS seniority,
  CASE WHEN company = 'Müller AG' THEN 'remote' END AS remote_policy,
  CASE WHEN company IS NULL THEN 'seniority' ELSE '' END AS failed FROM postings"""


# -- whole runs -----------------------------------------------------------

_RUN = f"""loose AS (SELECT doc_id, CASE WHEN doc_id % 19 <> 0 THEN 's' || doc_id % 3 END AS source,
  CAST(CASE WHEN doc_id % 11 = 10 THEN doc_id - 10 ELSE doc_id END AS VARCHAR) AS external_id,
  {_RAW_URL} AS url, {_clean(_RAW_TITLE)} AS title FROM documents),
dated AS (SELECT l.*, n.posted_at FROM loose l JOIN ({ORACLES['normalise_dates']}) n USING (doc_id)),
judged AS (SELECT *, sha1(coalesce(source, '') || '|' || external_id) AS fingerprint,
  CASE WHEN source IS NULL OR title IS NULL THEN 'incomplete'
    WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_url' END AS reason FROM dated),
valid AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS rn FROM judged WHERE reason IS NULL)"""
ORACLES["ingest_state"] = f"""WITH {_RUN} SELECT fingerprint, source, external_id, title, posted_at,
  '2026-09-01T00:00:00Z' AS first_seen_at FROM valid WHERE rn = 1"""
ORACLES["stream_ingest"] = ORACLES["ingest_state"]
_REASONS = f"""{_RUN}, r AS (SELECT reason AS reject_reason FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT 'duplicate' FROM valid WHERE rn > 1)"""
ORACLES["ingest_rejects"] = f"WITH {_REASONS} SELECT reject_reason, count(*) AS n FROM r GROUP BY 1"
ORACLES["ingest_overlapping"] = f"""WITH {_RUN}, r AS (SELECT source, reason FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT source, 'duplicate' FROM valid WHERE rn > 1)
SELECT source, reason AS reject_reason, count(*) AS n FROM r WHERE source IS NOT NULL GROUP BY 1, 2"""
_STREAMED = f"""{_RUN}, streamed AS (SELECT *, doc_id % 4 AS part,
  row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id % 4, doc_id) AS k FROM valid)"""
ORACLES["stream_many_batches"] = f"""WITH {_STREAMED} SELECT fingerprint, source, external_id, title,
  '2026-09-0' || (part + 1) || 'T00:00:00Z' AS first_seen_at, '2026-09-0' || (part + 1) || 'T00:00:00Z' AS last_seen_at
FROM streamed WHERE k = 1"""
ORACLES["ingest_counters"] = f"""WITH {_REASONS}
SELECT 'dropped/' || k AS counter, (SELECT count(*) FROM r WHERE reject_reason = k) AS n
  FROM (VALUES ('incomplete'), ('bad_url'), ('duplicate')) v(k)
UNION ALL SELECT 'valid', count(*) FROM valid
UNION ALL SELECT 'new', count(*) FROM valid WHERE rn = 1
UNION ALL SELECT 'updated', 0"""
ORACLES["replayed_state"] = f"""WITH {_RUN}, placed AS (SELECT *, doc_id % 2 AS run,
  row_number() OVER (PARTITION BY fingerprint, doc_id % 2 ORDER BY doc_id) AS k FROM valid),
kept AS (SELECT * FROM placed WHERE k = 1)
SELECT fingerprint, arg_max(source, run) AS source, arg_max(title, run) AS title,
  CASE min(run) WHEN 0 THEN '2026-09-01T00:00:00Z' ELSE '2026-09-02T00:00:00Z' END AS first_seen_at,
  CASE max(run) WHEN 0 THEN '2026-09-01T00:00:00Z' ELSE '2026-09-02T00:00:00Z' END AS last_seen_at
FROM kept GROUP BY fingerprint"""
ORACLES["stream_many_counters"] = ORACLES["ingest_counters"].replace("'updated', 0", "'updated', CAST(0 AS BIGINT)")


_WAVES = """days AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS external_id, doc_id % 3 AS wave, doc_id % 3 AS day FROM documents
  UNION ALL SELECT doc_id, source, CAST(doc_id AS VARCHAR), doc_id % 3 + 1, doc_id % 3 + 1 FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, source, CAST(doc_id AS VARCHAR), doc_id % 3 + 3, doc_id % 3 + 3 FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, source, doc_id || '-late', doc_id % 3 + 2, doc_id % 3 FROM documents WHERE doc_id % 7 = 0),
sightings AS (SELECT *, TIMESTAMP '2026-08-01' + to_days(CAST(day AS INT)) + to_seconds(doc_id % 3600) AS at FROM days)"""

# What a stream keeps: no row older than the latest time of the waves before less the
# delay, and of a posting no row while the one that it last kept is remembered.
ORACLES["stream_watermark_dedup"] = f"""WITH {_WAVES},
marks AS (SELECT w.wave, max(s.at) - INTERVAL '{DELAY}' AS mark FROM (SELECT DISTINCT wave FROM sightings) w
  LEFT JOIN sightings s ON s.wave < w.wave GROUP BY 1),
timely AS (SELECT s.*, m.mark FROM sightings s JOIN marks m USING (wave) WHERE m.mark IS NULL OR s.at >= m.mark),
kept AS (SELECT t.* FROM timely t WHERE NOT EXISTS (SELECT 1 FROM timely o WHERE o.source = t.source
  AND o.external_id = t.external_id AND o.wave < t.wave AND o.at + INTERVAL '{DELAY}' > t.mark))
SELECT source, external_id, 'posting ' || any_value(doc_id) AS title,
  '2026-09-0' || (min(wave) + 1) || 'T00:00:00Z' AS first_seen_at, '2026-09-0' || (max(wave) + 1) || 'T00:00:00Z' AS last_seen_at
FROM kept GROUP BY 1, 2"""

# Spans of sightings, none thirty hours after the one before, that lie as far back.
ORACLES["stream_closed"] = f"""WITH {_WAVES},
gaps AS (SELECT s.*, s.at >= lag(s.at) OVER (PARTITION BY s.source, s.external_id ORDER BY s.at) + INTERVAL 30 HOURS AS fresh FROM sightings s),
spans AS (SELECT g.*, count(*) FILTER (g.fresh) OVER (PARTITION BY g.source, g.external_id ORDER BY g.at) AS span FROM gaps g)
SELECT p.source, sha1(lower(p.source) || '|' || p.external_id) AS fingerprint, strftime(min(p.at), '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at,
  strftime(max(p.at), '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at, count(*) AS sightings
FROM spans p GROUP BY p.source, p.external_id, p.span
HAVING max(p.at) + INTERVAL 30 HOURS <= (SELECT max(s.at) - INTERVAL '{DELAY}' FROM sightings s)"""
