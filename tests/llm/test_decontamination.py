import re

from llm_cases import awkward, docs, empty, prose

from postlake.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(texts, items, width=10):
    windows = {}
    for item, text in items:
        own = WORD.findall(lower(text))
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item)
    out = []
    for doc, text in texts:
        own, hit, found = WORD.findall(lower(text)), set(), set()
        for i in range(len(own)):
            for size in {len(w) for w in windows}:
                if tuple(own[i : i + size]) in windows and i + size <= len(own):
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(own[i : i + size])]
        out.append((doc, len(own), sorted(hit), sorted(found)))
    return sorted(out)


def case():
    long = prose(1, 30)
    items = [(1, " ".join(long)), (2, "Short, ITEM!"), (3, None), (4, " ?! "), (5, " ".join(long)), (6, "é東 über")]
    texts = [
        (1, "x " + " -- ".join(long).upper() + " y"), (2, "a short item b short\nitem"), (3, None), (4, ""),
        (5, " ".join(long[:9])), (6, " ".join(long[5:15]) + " " + " ".join(long[16:26])), (7, "shorty item"),
        (8, "É東 über é東 über"), (9, " ".join(["short"] * 50 + ["item"] * 50)),
    ]
    return texts, items


def test_against_brute_force(spark):
    texts, items = case()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontamination.contamination(docs(spark, texts), benchmark).collect()
    assert sorted((r.doc_id, r.n_words, r.hit_words, r.item_ids) for r in rows) == brute(texts, items)
    by_id = dict(texts)
    for r in rows:
        covered = [w for a, b in zip(r.starts, r.ends, strict=True) for w in WORD.findall(lower(by_id[r.doc_id][a:b]))]
        assert covered == [WORD.findall(lower(by_id[r.doc_id]))[i] for i in r.hit_words]


def test_several_automata_find_the_same(spark):
    texts, items = case()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontamination.contamination(docs(spark, texts), benchmark, most_nodes=12).collect()
    assert sorted((r.doc_id, r.n_words, r.hit_words, r.item_ids) for r in rows) == brute(texts, items)
    kept = decontamination.clean(docs(spark, texts), benchmark, most_nodes=12)
    assert {r.doc_id for r in kept.collect()} == {d for d, _, hit, _ in brute(texts, items) if not hit}
    assert kept.columns == docs(spark, texts).columns


def test_awkward_and_empty_tables(spark):
    benchmark = spark.createDataFrame(case()[1], "item_id bigint, text string")
    assert decontamination.contamination(awkward(spark), benchmark).count() == 11
    assert decontamination.clean(awkward(spark), benchmark.limit(0)).count() == 11
    assert decontamination.contamination(empty(spark), benchmark).count() == 0


def test_every_row_gives_one_row_whatever_the_number_of_automata(spark):
    texts, items = case()
    long = prose(1, 30)
    # Items that overlap in a text, and rows without an id or with the same one.
    items = [*items, *((10 + k, " ".join(long[k : k + 12])) for k in range(15))]
    texts = [*texts, (None, "a short item"), (None, "nothing"), (None, " ".join(long)), (7, "short item"), (7, "none")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    one, several = (
        sorted(map(str, decontamination.contamination(docs(spark, texts), benchmark, most_nodes=most).collect()))
        for most in (1 << 20, 60))
    assert one == several and len(one) == len(texts)


def test_items_without_an_id_mark_words(spark):
    texts, items = [(1, "a short item"), (2, "one other thing"), (3, "clean")], [(None, "short item"), (None, "other thing"), (5, "Other thing")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (1 << 20, 2):
        rows = decontamination.contamination(docs(spark, texts), benchmark, most_nodes=most).collect()
        assert sorted((r.doc_id, r.hit_words, r.item_ids) for r in rows) == [(1, [1, 2], []), (2, [1, 2], [5]), (3, [], [])]
        assert [r.doc_id for r in decontamination.clean(docs(spark, texts), benchmark, most_nodes=most).collect()] == [3]


def test_random_texts_against_brute_force(spark):
    items = [(i, " ".join(prose(i, n, vocabulary=6))) for i, n in enumerate([3, 9, 10, 11, 14, 25, 40, 1, 5])] + [(None, "zz yy")]
    texts = [(100 + i, " ".join(prose(50 + i, 60, vocabulary=6))) for i in range(12)]
    texts += [(200 + i, " ".join(["q", *t.split()[k:], "zz yy"])) for i, (_, t) in enumerate(items) for k in (0, 1, 3)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontamination.contamination(docs(spark, texts), benchmark).collect()
    want = [(d, n, h, [i for i in f if i is not None]) for d, n, h, f in _sorted_brute(texts, items)]
    assert sorted((r.doc_id, r.n_words, r.hit_words, r.item_ids) for r in rows) == want


def _sorted_brute(texts, items):
    named = [(i if i is not None else -1, t) for i, t in items]
    return [(d, n, h, [i for i in f if i >= 0]) for d, n, h, f in brute(texts, named)]


def test_one_node_for_each_word_of_the_items():
    items = [(i, " ".join(prose(i, 500, vocabulary=5_000))) for i in range(40)]
    tree = decontamination.Items(items, 10)
    assert tree.nodes <= 40 * 500 + 1
    long = items[3][1].split()
    assert tree.scan(" ".join(["x", *long[7:17], "y"]))[1:3] == (list(range(1, 11)), [3])
    assert tree.scan(" ".join(["x", *long[7:16], "y"]))[1:] == ([], [], [], [])
