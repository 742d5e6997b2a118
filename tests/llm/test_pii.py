import hashlib
import math
import random
import re

from llm_cases import awkward, docs, empty

from postlake.llm import pii
from postlake.llm.queries import op5_pii

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TEXTS = [
    "mail a.b+c@x-y.example.org, x@y, a@b.c%d@e.f @a.b a@b..c", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 0001.002.3.255 9.9.9",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 5500 0000 0000 0004 0", "call +41 (22) 123-45-67. or +1 2 +123456789012345678",
    "é東 \U0001f600 x@y.z 1.1.1.1 4012888888881881 +4122 123 45 67", "a" * 3000 + "@" + "b" * 3000 + ".c", "1" * 5000, "1.2.3.4" * 500,
    "@@ ++ 1-2 3 4  5", "x@y.z" * 300,
]


def checked(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), m.group()) for k, (name, p) in enumerate(PATTERNS)
             for m in re.finditer(p, text or "") if checked(name, m.group())]
    return sorted(found)


def test_pattern_spans_against_brute_force(spark):
    rows = pii.spans(docs(spark, list(enumerate(TEXTS)))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert [(s.start, s.kind, s.end, s.value) for s in r.spans] == brute(TEXTS[r.doc_id])


def test_awkward_rows(spark):
    rows = pii.spans(awkward(spark)).collect()
    assert len(rows) == 11 and all(not r.spans and not r.terms for r in rows)
    assert pii.spans(empty(spark)).count() == 0
    same = pii.sanitised(awkward(spark))
    assert sorted(map(str, same.collect())) == sorted(map(str, awkward(spark).collect()))


def disclosing():
    """`zorbax` stands near one address only; the rest of the words are everywhere."""
    rows = [(i, f"number {i} here zorbax wrote from secret@host.org today about {i}") for i in range(6)]
    rows += [(10 + i, f"number {i} here somebody wrote from there today about {i}") for i in range(60)]
    return [*rows, (100, rows[0][1]), (101, "zorbax alone wrote")]


def test_terms_that_give_an_entity_away(spark):
    table = docs(spark, disclosing(), extra=("lang",))
    found = {r.doc_id: [t.value for t in r.terms] for r in pii.spans(table).collect()}
    assert all(found[i] == ["zorbax"] for i in (*range(6), 100))
    assert not any(found[i] for i in found if i >= 10 and i != 100)
    by_join = {r.doc_id: [t.value for t in r.terms] for r in pii.spans(table, most_broadcast=0).collect()}
    assert by_join == found
    clean = {r.doc_id: r.text for r in pii.sanitised(table).collect()}
    assert clean[3] == "number 3 here  wrote from [EMAIL] today about 3"
    assert clean[10] == disclosing()[6][1] and clean[101] == "zorbax alone wrote"
    general = {r.doc_id: r.text for r in pii.sanitised(table, remove=2.0).collect()}
    assert general[3] == "number 3 here [TERM] wrote from [EMAIL] today about 3"


def test_copies_do_not_make_their_words_disclosing(spark):
    rows = [(i, "once only this unusual sentence names me@host.org in it") for i in range(50)] + [(99, "other words")]
    assert all(not r.terms for r in pii.spans(docs(spark, rows)).collect())


def test_no_python_in_tasks_and_digests(spark, tmp_path):
    docs(spark, list(enumerate(TEXTS)), extra=("lang",)).write.parquet(f"{tmp_path}/documents.parquet")
    result = op5_pii(spark, str(tmp_path))
    plan = result._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for r in result.collect():
        told = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b, _ in brute(TEXTS[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans == told
        assert r.n_email == sum(k == 0 for _, k, _, _ in brute(TEXTS[r.doc_id]))


def test_terms_of_rare_entities_anywhere_in_their_texts(spark):
    """One text, or two: a name far from the address, one of two letters, each place."""
    far = "everyone knows that much was said here " * 8
    rows = [(1, f"Quillon {far}ask one@host.org {far}signed QUILLON"), (2, f"Ng {far}ask two@host.org again"),
            (3, f"from ng and two@host.org {far}"), (4, f"{far}ask again from and signed")]
    rows += [(10 + i, f"{far}ask again from and signed {i}") for i in range(500)]
    found = {r.doc_id: r for r in pii.spans(docs(spark, rows)).collect()}
    got = {i: [(t.start, t.end, t.value) for t in r.terms] for i, r in found.items()}
    places = {i: [m.span() + (m.group(),) for m in re.finditer(r"(?i)\b(quillon|ng)\b", t)] for i, t in rows}
    assert got == places and sum(map(len, got.values())) == 4
    assert found[1].terms[1].start > found[1].spans[0].end + 100


def test_words_that_run_into_spans_are_no_terms(spark):
    rows = [(i, f"zed\u00e9a{i % 2}@b.org\u00e9 1.1.1.1 {'+41 22 123 45 67'}x host \u00e9{i}") for i in range(2)]
    rows += [(10 + i, f"plain text number {i}") for i in range(400)]
    found = {r.doc_id: [t.value for t in r.terms] for r in pii.spans(docs(spark, rows)).collect()}
    assert found[0] == ["host", "\u00e90"] and found[1] == ["host", "\u00e91"]


def disclosures(rows, generalise=0.5, chance=0.05):
    """(text, term): the most that the term tells of an entity of the text, by the formulas."""
    texts = sorted({t for _, t in rows})
    spans = {t: brute(t) for t in texts}
    words = {t: {m.group().lower() for m in re.finditer(r"[^\W_]+", t)} for t in texts}
    free = {t: {m.group().lower() for m in re.finditer(r"[^\W_]+", t)
                if not any(a < m.end() and b > m.start() for a, _, b, _ in spans[t])} for t in texts}
    told = {}
    for entity in {v.lower() for t in texts for *_, v in spans[t]}:
        mine = [t for t in texts if entity in {v.lower() for *_, v in spans[t]}]
        tried = sum(len(free[t]) for t in mine)
        for term in set().union(*(free[t] for t in mine)):
            share = sum(term in free[t] for t in mine) / len(mine)
            common = sum(term in words[t] for t in texts) / len(texts)
            content = -math.log2(len(mine) / len(texts))
            if common >= share or content <= 0:
                continue
            apart = share * math.log(share / common) + (share < 1 and (1 - share) * math.log((1 - share) / (1 - common)))
            rate = math.log2(share / common) / content
            if len(mine) * apart >= math.log(tried / chance) and rate >= generalise:
                for t in (t for t in mine if term in free[t]):
                    told[t, term] = max(rate, told.get((t, term), 0))
    return told


def test_terms_against_a_recount(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(700):
        who = [rnd.randrange(14) for _ in range(rnd.choice((0, 0, 0, 1, 1, 2)))]
        said = [f"w{rnd.randrange(60)}" for _ in range(12)] + [f"name{w}" for w in who if rnd.random() < 0.9]
        said += [f"hint{w % 5}" for w in who] + [f"p{w}@host.org" for w in who] + ["name3"] * (rnd.random() < 0.01)
        rnd.shuffle(said)
        rows.append((i, " ".join(said)))
    rows += [(1000 + i, t) for i, t in rows[:40]]
    want = disclosures(rows)
    assert len(want) > 200 and len({round(v, 6) for v in want.values()}) > 10
    for remove, broadcast in ((0.9, 50_000), (0.7, 0)):
        got = {}
        for r in pii.spans(docs(spark, rows), remove=remove, most_broadcast=broadcast).collect():
            got |= {(dict(rows)[r.doc_id], t.value.lower()): t.replacement == "" for t in r.terms}
        assert got == {k: v >= remove for k, v in want.items()}


def test_what_is_removed_too_much(spark):
    """Of planted names all places are found; of planted rare plain words, which stand in
    as many texts without an entity, few of those beside one."""
    rnd = random.Random(7)
    plain = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choices(plain, k=40))) for i in range(3000)]
    for p in range(20):
        for j in range(6):
            rows.append((4000 + p * 10 + j, f"{' '.join(rnd.choices(plain, k=30))} Name{p} p{p}@host.org rare{rnd.randrange(40)}"))
    rows += [(6000 + i, f"{' '.join(rnd.choices(plain, k=30))} rare{i % 40}") for i in range(120)]
    found = [t.value for r in pii.spans(docs(spark, rows)).collect() for t in r.terms]
    names, rare = (sum(t.startswith(w) for t in found) / 120 for w in ("Name", "rare"))
    print(f"names found {names:.3f}, rare words taken {rare:.3f}, common words taken {len(found) / 120 - names - rare:.3f}")
    assert names == 1 and rare <= 0.1 and not any(t.startswith("w") for t in found)


def test_a_directory_is_not_paired_with_its_words(spark):
    rows = [(1, " ".join(f"user{i}@host{i}.org word{i}x" for i in range(1000)))]
    rows += [(10 + i, f"other text {i} user{i}@host{i}.org plain") for i in range(500)]
    found = pii.base(docs(spark, rows))
    held = found.where("size(spans) > 0").select("body", "text", "spans")
    pii.disclosing(docs(spark, rows), found, held, 0.5, 0.05).collect()
    terms = held.select(pii._free(held).alias("w"), "spans").collect()
    assert sorted(len(t.w) for t in terms)[-1] == 1000 and sum(len(t.spans) for t in terms) == 1500
    assert len(pii.spans(docs(spark, rows)).where("doc_id = 1").first().spans) == 1000


def test_many_spans_and_overlaps_keep_their_places(spark):
    text = " a " + " ".join(f"+41 22 123 45 {i % 90 + 10} x{i}@y.org 1.2.3.{i % 256}\U0001f600é" for i in range(600))
    row = pii.base(docs(spark, [(1, text)])).first()
    assert [(s.start, s.kind, s.end, s.value) for s in row.spans] == brute(text)
    held = pii.base(docs(spark, [(1, text)]))
    got = [(w.start, w.end, w.value) for w in held.select(pii._free(held).alias("w")).first().w]
    spans = brute(text)
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W_]+", text)
            if not any(a < m.end() and b > m.start() for a, _, b, _ in spans)]
    assert got == want and len(got) >= 1
