"""Lattice hashing against all pairs."""

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from postlake.llm import components, lattice_hash
from postlake.llm.lattice_hash import Lattice, nearest, shortest_vectors

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())),
                     StructField("my col", StringType()), StructField("key", StringType()), StructField("v", StringType())])


def table(spark, rows):
    return spark.createDataFrame(
        [(i, None if e is None else [None if x is None else float(x) for x in e], "x", "y", "z") for i, e in rows], SCHEMA)


def brute(rows, least=0.9):
    """n_links and component_id by all pairs in double precision."""
    unit = []
    for _, e in rows:
        x = None if e is None or any(c is None for c in e) else np.asarray(e, np.float32).astype(float)
        ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / np.linalg.norm(x) if ok else None)
    n = len(rows)
    near = [[b for b in range(n) if b != a and unit[a] is not None and unit[b] is not None
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least] for a in range(n)]
    told, seen = [None] * n, set()
    for start in range(n):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            for b in near[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        seen |= group
        ids = [rows[g][0] for g in group if rows[g][0] is not None]
        for g in group:
            told[g] = (rows[g][0], len(near[g]), min(ids, default=None))
    return sorted(told, key=str)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def near_groups(groups, size, length=24, spread=0.04, seed=3):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = draw.normal(size=length)
        centre /= np.linalg.norm(centre)
        rows += [centre + draw.normal(size=length) * spread for _ in range(size)]
    order = draw.permutation(len(rows))
    return [(int(i), rows[i]) for i in order]


def test_lattice_points():
    short = shortest_vectors()
    assert short.shape == (240, 8) and np.allclose((short**2).sum(1), 2)
    assert len(np.unique(short, axis=0)) == 240
    points = np.random.default_rng(0).normal(size=(300, 8)) * 2
    found = nearest(points)
    doubled = np.rint(2 * found).astype(int)
    assert ((doubled % 2).max(1) == (doubled % 2).min(1)).all()  # all whole or all halves
    assert (np.rint(found.sum(1)).astype(int) % 2 == 0).all()
    apart = ((points - found) ** 2).sum(1)
    assert apart.max() <= 1 + 1e-9  # the covering radius
    for step in short:
        assert (apart <= ((points - found - step) ** 2).sum(1) + 1e-9).all()


def test_probes_are_the_cells_of_neighbours():
    lattice = Lattice(16, tables=3, codes=2, scale=0.6, probes=12)
    draw = np.random.default_rng(1)
    a = draw.normal(size=(400, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + draw.normal(size=a.shape) * 0.05
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = lattice.cells(a), lattice.cells(b)
    assert x.shape == (400, 3, 13)
    assert all(len(set(c.tolist())) == 13 for v in x for c in v)  # a step leads to another cell
    meet = (x[:, :, :1] == y).any(-1) | (y[:, :, :1] == x).any(-1)
    home = (x[:, :, 0] == y[:, :, 0])
    assert meet.mean() > home.mean() + 0.2 and meet.any(1).mean() > 0.98


def test_equals_all_pairs(spark):
    rows = near_groups(30, 6) + [(1000 + i, v) for i, (_, v) in enumerate(near_groups(150, 1, seed=9))]
    rows += [(2000 + i, rows[i][1]) for i in range(8)]  # copies
    assert result(lattice_hash.classes(table(spark, rows))) == brute(rows)


def test_blocks_count_all_links(spark, monkeypatch):
    monkeypatch.setattr(lattice_hash, "BLOCK", 7)
    rows = near_groups(2, 60, spread=0.03) + [(500 + i, v) for i, (_, v) in enumerate(near_groups(40, 1, seed=4))]
    assert result(lattice_hash.classes(table(spark, rows))) == brute(rows)


def test_chains_that_no_leader_links(spark):
    """Steps of 20 degrees: neighbours are linked, and nobody with those after them."""
    angles = np.deg2rad(20 * np.arange(9))
    rows = [(int(i), np.concatenate(([np.cos(a), np.sin(a)], np.zeros(6)))) for i, a in enumerate(angles)]
    found = result(lattice_hash.classes(table(spark, rows), tables=24))
    assert found == brute(rows)
    assert {c for _, _, c in found} == {0}


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 0.0, 0.0]), (5, [inf, 1, 0, 0]), (6, [nan, 1, 0, 0]),
            (7, [1, 0, 0, 0]), (8, [2, 0, 0, 0]), (8, [2, 0, 0, 0]), (None, [3, 0, 0, 0]), (9, [1, 0, 0]), (9, [0, 1, 0, 0]),
            (10, [0, 2, 0.1, 0]), (11, [3e38, 3e38, 0, 0]), (12, [1e-38, 1e-38, 0, 0]), (None, None)]
    df = lattice_hash.classes(table(spark, rows))
    assert result(df) == brute(rows)
    kept = {(r.vec_id, r.kept) for r in df.collect()}
    assert {(7, True), (8, False), (10, False), (11, True), (12, False), (1, True)} <= kept
    assert lattice_hash.classes(table(spark, [])).collect() == []


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_given_vectors_and_planted_ones(spark, folder):
    """Recall of planted pairs near the least cosine, among the given vectors."""
    given = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, np.array(r.embedding)) for r in given]
    draw = np.random.default_rng(5)
    for i, (_, v) in enumerate(rows[:300]):
        side = draw.normal(size=len(v))
        side -= side @ v / (v @ v) * v
        cosine = 0.905
        rows.append((10_000 + i, cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)))
    found, true = result(lattice_hash.classes(table(spark, rows))), brute(rows)
    links = sum(n for _, n, _ in found) / sum(n for _, n, _ in true)
    assert 0.93 <= links <= 1
    assert all(a[1] <= b[1] for a, b in zip(found, true, strict=True))


def test_nothing_is_broadcast_by_its_size(spark, monkeypatch):
    """Cells are rows made by Python, whose number Spark does not know."""
    plans = []

    def told(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, label)

    materialise = lattice_hash.materialise
    monkeypatch.setattr(lattice_hash, "materialise", told)
    monkeypatch.setattr(components, "materialise", told)
    rows = near_groups(6, 5)
    found = lattice_hash.classes(table(spark, rows))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 8 and [p for p in plans if "Broadcast" in p] == []
    assert result(found.select("vec_id", "n_links", "component_id")) == brute(rows)
