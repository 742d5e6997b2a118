import random

import pytest
from llm_cases import awkward, docs, empty, prose

from postlake.llm import jaccard_join, substring_dedup
from postlake.llm.components import components


def grams(text, n=4):
    own = jaccard_join.lowered(text)
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))) if own else frozenset()


def near_copies():
    """Texts of all sizes with copies at all distances around the threshold."""
    rnd = random.Random(2)
    rows = []
    for base in range(60):
        own = prose(base, rnd.choice((1, 3, 4, 5, 8, 12, 20, 40, 90, 200)), 5000)
        rows.append(own)
        for _ in range(rnd.randrange(5)):
            copy = list(own)
            for _ in range(rnd.randrange(1 + len(own) // 25)):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(10**6)}"
            if rnd.random() < 0.5:
                copy += prose(rnd.randrange(10**6), rnd.randrange(1 + len(own) // 8), 5000)
            rows.append(copy)
    rnd.shuffle(rows)
    return [(i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)) for i, w in enumerate(rows)]


def brute_classes(rows):
    sets = [(d, grams(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_classes_against_brute_force(spark):
    rows = near_copies()
    found = jaccard_join.classes(docs(spark, rows))
    assert sorted(map(tuple, found.collect())) == brute_classes(rows)


def test_one_large_group_of_near_copies(spark):
    base, rnd = prose(9, 120, 5000), random.Random(4)
    rows = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]] if i % 3 else base)) for i in range(300)]
    rnd.shuffle(rows)
    found = jaccard_join.classes(docs(spark, rows)).collect()
    assert sorted(map(tuple, found)) == brute_classes(rows)


def test_classes_of_awkward_rows(spark):
    found = {r.doc_id: r for r in jaccard_join.classes(awkward(spark)).collect()}
    assert found[1].n_shingles == found[2].n_shingles == found[3].n_shingles == 0
    assert found[1].component_id == 1 and found[3].component_id == 3
    assert found[4].n_shingles == 1 and found[7].component_id == 6 and found[None].component_id is None
    assert jaccard_join.classes(empty(spark)).count() == 0
    kept = jaccard_join.representatives(awkward(spark))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert kept.columns == awkward(spark).columns


def test_rows_of_one_id_with_different_texts(spark):
    a, b = prose(1, 120), prose(2, 120)
    near_a, near_b = [*a[:-1], "other"], ["other", *b[1:]]
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (4, prose(3, 90)), (4, prose(4, 90)), (4, prose(4, 90)), (5, a), (1, [*a[:-1], "third"])]
    rows = docs(spark, [(d, " ".join(t)) for d, t in rows])
    found = sorted((r.doc_id, r.component_id) for r in jaccard_join.classes(rows).collect())
    assert found == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 1)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.representatives(rows).collect()]
    assert len(kept) == 4 and len({t for d, t in kept if d == 4}) == 2
    assert " ".join(b) in {t for d, t in kept if d == 1} and len([d for d, _ in kept if d == 1]) == 2


@pytest.mark.parametrize("size", [1, 2, 5, 30, 400])
def test_sketches_bound_the_difference(size):
    import numpy as np

    rnd = np.random.default_rng(size)
    a = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64))
    for changed in range(0, size, max(1, size // 10)):
        b = np.unique(np.concatenate((a[changed:], rnd.integers(0, 2**63, changed, dtype=np.uint64))))
        apart = len(np.setxor1d(a, b))
        assert jaccard_join.bits_apart(jaccard_join.dense_sketch(a), jaccard_join.dense_sketch(b)) <= apart
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            starts = jaccard_join.band_starts(85)
            assert set(jaccard_join.block_keys(a, 85, starts)) & set(jaccard_join.block_keys(b, 85, starts))


def test_components_of_a_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:], strict=False)] + [(500, 501), (7, 7)]
    found = {r.id: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {found[i] for i in range(200)} == {0} and found[501] == found[500] == 500


def brute_removed(rows, width=50):
    first, out = {}, []
    for doc, text in sorted(rows):
        own = (text or "").encode().split()
        keep = [True] * len(own)
        for i in range(len(own) - width + 1):
            if first.setdefault(tuple(own[i : i + width]), doc) < doc:
                keep[i : i + width] = [False] * width
        out.append((doc, len(own), keep.count(False), b" ".join(w for w, k in zip(own, keep, strict=True) if k).decode()))
    return out


def passages():
    rnd, shared = random.Random(8), [prose(k + 50, 70, 300) for k in range(3)]
    rows = []
    for i in range(60):
        own = prose(100 + i, rnd.randrange(0, 160), 300)
        if i % 3:
            own[rnd.randrange(len(own) + 1) :][:0] = []
            at = rnd.randrange(len(own) + 1)
            own = own[:at] + shared[i % 3][rnd.randrange(15) :] + own[at:]
        if i % 7 == 0:
            own = ["same"] * 130 + own
        rows.append((i, "  ".join(own) if i % 2 else "\n".join(own)))
    return [*rows, (60, rows[1][1]), (61, rows[1][1]), (62, None), (63, "")]


@pytest.mark.parametrize("tight", [False, True])
def test_passages_against_brute_force(spark, monkeypatch, tight):
    if tight:  # many parts, crowded minimisers, texts sent a few at a time
        for name, value in {"_HELD": 4_000, "_TAKEN": 1_000, "_SENT": 2_000, "_CROWD": 5, "_SEEN": 3}.items():
            monkeypatch.setattr(substring_dedup, name, value)
    rows = passages()
    found = substring_dedup.deduplicated(docs(spark, rows).repartition(5), sample_rows=1_000)
    assert sorted(map(tuple, found.collect())) == brute_removed(rows)


def test_passages_of_awkward_rows(spark):
    found = substring_dedup.deduplicated(awkward(spark)).collect()
    assert len(found) == 11 and all(r.n_removed == 0 for r in found)
    assert substring_dedup.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("held", [None, 4000])
def test_windows_of_one_id_with_different_texts(spark, monkeypatch, held):
    if held:
        monkeypatch.setattr(substring_dedup, "_HELD", held)
        monkeypatch.setattr(substring_dedup, "_SENT", held)
    a, b, c = (prose(seed, 100, 10**6) for seed in (1, 2, 3))
    rows = [(1, " ".join(a)), (2, " ".join(a)), (2, " ".join(b)), (2, "  ".join(a)), (2, " ".join(a)),
            (3, " ".join(b[:60] + c)), (3, " ".join(c))]
    found = substring_dedup.deduplicated(docs(spark, rows)).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found)
    assert got == sorted([(1, 100, 0, rows[0][1]), *[(2, 100, 100, "")] * 3, (2, 100, 0, rows[2][1]),
                          (3, 160, 60, " ".join(c)), (3, 100, 0, rows[6][1])])
