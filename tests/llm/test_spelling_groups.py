"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from llm_cases import awkward, docs, empty

from postlake.llm import spelling_groups as sg
from postlake.llm.queries import op13_spelling_groups


def count(rows, slips):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if slips and h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(words):
    beside = {w: [o for o in words if o != w and abs(len(o) - len(w)) <= 1 and near(w, o)] for w in words}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    told = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        told.add((w, form[w], root, n, len(beside[w]), None if form[w] is None else words[form[w]]))
    return told


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def variants(seed, stems=40):
    """Words with repeated code points, variants of them and variants of variants."""
    rnd = random.Random(seed)
    words = {}
    for _ in range(stems):
        word = "".join(rnd.choice("aabbéz") for _ in range(rnd.randrange(6, 10)))
        for _ in range(6):
            words.setdefault(word, rnd.choice([5, 6, 9, 30, 31, 150, 800]))
            i = rnd.randrange(len(word))
            word = rnd.choice([word[:i] + word[i + 1 :], word[:i] + rnd.choice("abé") + word[i:], word[:i] + "z" + word[i + 1 :]])
    return {w: n for w, n in words.items() if len(w) >= 6}


def test_equals_all_pairs(spark):
    words = variants(1) | variants(2)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert found(sg.grouped(df)) == grouped(words)


def test_nodes_are_those_of_one_trie(spark):
    words = variants(3, 60)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    node = {}
    rows = sg.numbered(df).collect()
    assert [r.word for r in sorted(rows, key=lambda r: r.rank)] == sorted(words)
    for row in rows:
        assert len(row.path) == len(row.word) + 1
        for depth, number in enumerate(row.path):
            assert node.setdefault(row.word[:depth], number) == number
    assert len(set(node.values())) == len(node)


def test_ranges_of_single_words(spark):
    """More ranges than words: every path lies on that of a first word."""
    words = {"aaaaaa": 5, "aaaaaaa": 50, "aaaaab": 6, "zzzzzz": 7}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(list(words.items()), "word string, n long")
        assert found(sg.grouped(df)) == grouped(words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_each_pair_meets_once(spark):
    words = {"aabbcc": 5, "abbcc" + "c": 6, "aabbccc": 7, "aaabbcc": 8, "aabbc" + "d": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(sg.grouped(df)) == grouped(words)


def test_long_chain_of_forms(spark):
    words = {"a" * (6 + k): 5 ** (k + 1) for k in range(12)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = found(sg.grouped(df))
    assert got == grouped(words)
    assert {r[2] for r in got} == {"a" * 17}


def test_awkward_rows(spark):
    assert sg.grouped(sg.vocabulary(awkward(spark))).collect() == []  # lorem, ipsum and dolor are too short
    assert sg.grouped(sg.vocabulary(empty(spark))).collect() == []
    rows = [(None, "Straße ÉCOLE École école " * 6), (1, None), (2, ""), (3, "x" * 9_000), (4, ("y" * 9_000 + " ") * 5)]
    for slips in (None, 3):
        assert found(sg.grouped(sg.vocabulary(docs(spark, rows), slips=slips))) == grouped(count(rows, slips))


def test_registered_query(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    words = count([(r.doc_id, r.text) for r in given], 199)
    assert found(op13_spelling_groups(spark, "/root/testdata/sf0.001")) == grouped(words)
