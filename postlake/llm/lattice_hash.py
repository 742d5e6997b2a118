"""Near duplicates among embeddings by hashing to points of the E8 lattice.

Each of `tables` random projections takes a vector of length one to `codes` groups of
eight numbers; the nearest E8 points of the groups name its home cell, and the `probes`
cheapest steps to neighbouring points (one of the 240 shortest lattice vectors for any
of the groups) the cells it also visits. Vectors that meet in a cell in which one of
them is at home are candidates; every link is verified by its cosine in double
precision. With the defaults a pair of cosine 0.9 is found with probability 0.97, one
of 0.95 with 0.9998; two unrelated vectors share a home cell of a table once in some
10^6 times, so `codes` should grow by one where vectors are more than some 10^8.

* Equal vectors are one vertex, told by two 64-bit hashes.
* Each vertex of a shared cell is first verified against the least one at home there.
  Links become components, and a cell whose vertices are all in one is done.
* In the other cells all vertices of different components meet, by blocks of a matrix
  product; a block tells only links that join components. A crowded cell is cut into
  blocks of `BLOCK` by hash, of which those inside its largest component are left out.
* Two vectors with a link are in one component, so links are counted within components,
  by blocks as well: no pair of a group is ever a row.
* All joins are sorted merges. Spark takes the cells of a vector, a hundred rows made by
  Python, for no larger than the vector, and would send them to the driver to broadcast.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, as do vectors of different length; labels and other columns are not looked at.
Repeated rows are copies and link with each other; a row without vec_id counts as a
link of others and is placed with them, but names no component; an empty table gives no
rows. Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise

from .common import Batches, by_arrow
from .components import components
from .jaccard_join import mix

#: Vectors of one side of a matrix product.
BLOCK = 1_024
#: Vectors whose cells are worked out at one time.
_AT_ONCE = 512
#: Neighbours of one lattice point among which the cheapest steps are looked for.
_STEPS = 8


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of +-1, or eight of +-1/2 with an even
    number of minus signs."""
    found = []
    for places in combinations(range(8), 2):
        for signs in product((1.0, -1.0), repeat=2):
            row = np.zeros(8)
            row[list(places)] = signs
            found.append(row)
    halves = (np.array(s) for s in product((0.5, -0.5), repeat=8))
    return np.array(found + [h for h in halves if (h < 0).sum() % 2 == 0])


def _nearest_even(points: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    whole = np.rint(points)
    off = points - whole
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    odd = (whole.sum(-1, keepdims=True) % 2) != 0
    moved = np.take_along_axis(whole, worst, -1) + np.where(odd, step, 0.0)
    np.put_along_axis(whole, worst, moved, -1)
    return whole


def nearest(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight numbers: integers of even sum, or those
    moved by a half."""
    whole, half = _nearest_even(points), _nearest_even(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(-1) <= ((points - half) ** 2).sum(-1)
    return np.where(closer[..., None], whole, half)


class Lattice:
    """Cells of vectors of one length."""

    def __init__(self, length: int, tables: int, codes: int, scale: float, probes: int):
        draw = np.random.default_rng([8, length, tables, codes])
        self._tables, self._codes, self._probes = tables, codes, probes
        self._planes = draw.normal(size=(length, tables * codes * 8)) * scale
        # A cell's key is linear in its coordinates, so a step adds to it.
        self._factors = draw.integers(0, 1 << 64, (tables, codes, 8), np.uint64)
        self._seeds = draw.integers(0, 1 << 64, tables, np.uint64)
        self._short = shortest_vectors()
        doubled = (2 * self._short).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            self._moves = (self._factors[:, :, None, :] * doubled).sum(-1, dtype=np.uint64)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Keys by vector and table: the home first, then the probes."""
        n = len(units)
        at = (units @ self._planes).reshape(n, self._tables, self._codes, 8)
        home = nearest(at)
        cost = 2 - 2 * ((at - home) @ self._short.T)
        steps = min(_STEPS, cost.shape[-1] - 1)
        moves = np.argpartition(cost, steps, axis=-1)[..., :steps]
        cost = np.take_along_axis(cost, moves, -1)
        with np.errstate(over="ignore"):
            base = (self._factors * (2 * home).astype(np.int64).view(np.uint64)).sum((-2, -1), dtype=np.uint64)
            base += self._seeds
            stay = np.zeros((n, self._tables, 1))
            total, added = stay, stay.astype(np.uint64)
            for code in range(self._codes):
                costs = np.concatenate([stay, np.maximum(cost[:, :, code], 1e-9)], -1)
                keys = np.take_along_axis(
                    np.broadcast_to(self._moves[:, code], (n, self._tables, self._moves.shape[-1])), moves[:, :, code], -1)
                keys = np.concatenate([stay.astype(np.uint64), keys], -1)
                total = (total[..., None] + costs[:, :, None, :]).reshape(n, self._tables, -1)
                added = (added[..., None] + keys[:, :, None, :]).reshape(n, self._tables, -1)
            probes = min(self._probes, total.shape[-1] - 1)
            chosen = np.argpartition(total[..., 1:], probes - 1, axis=-1)[..., :probes] + 1 if probes else None
            taken = added[..., :1] if chosen is None else np.concatenate(
                [added[..., :1], np.take_along_axis(added, chosen, -1)], -1)
            return mix(base[..., None] + taken).view(np.int64)


def units(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors at length one in double precision), by length of the vector."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        vectors = flat[begins[rows][:, None] + np.arange(length)]
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)
        yield rows, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def sound(vector: Column) -> Column:
    """Whether a vector can be compared."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells(vertices: DataFrame, tables: int, codes: int, scale: float, probes: int) -> DataFrame:
    def work(batches: Batches) -> Iterator[dict]:
        known: dict[int, Lattice] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(start, _AT_ONCE)
                owners = part.column("v").to_numpy()
                for rows, vectors in units(part.column("embedding")):
                    length = vectors.shape[1]
                    if length not in known:
                        known[length] = Lattice(length, tables, codes, scale, probes)
                    keys = known[length].cells(vectors)
                    each = keys.shape[1] * keys.shape[2]
                    yield {"key": keys.reshape(-1), "v": np.repeat(owners[rows], each),
                           "home": np.tile(np.arange(keys.shape[2]) == 0, keys.shape[1] * len(rows))}

    return by_arrow(vertices.select("v", "embedding"), work, "key bigint, v bigint, home boolean")


def _verified(pairs: DataFrame, vertices: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are links."""
    a, b = (vertices.select(F.col("v").alias(s), F.col("embedding").alias(f"vector_{s}")).hint("merge") for s in "ab")
    met = pairs.join(a, "a").join(b, "b").where("size(vector_a) = size(vector_b)")

    def work(batches: Batches) -> Iterator[dict]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for (rows, left), (_, right) in zip(units(batch.column("vector_a")), units(batch.column("vector_b")), strict=True):
                linked[rows] = (left * right).sum(1) >= least
            yield {c: batch.column(c).filter(pa.array(linked)) for c in "ab"}

    return by_arrow(met, work, "a bigint, b bigint")


def _blocks(rows: DataFrame, names: list[str]) -> Column:
    """Rows of `names` with the blocks (i, j) a row of chunk `c` stands in, as left or
    right side; `g` chunks are left sides, of `all` chunks. Chunks beyond `g` are only
    met by others."""
    left = F.when(F.col("c") < F.col("g"), F.transform(
        F.sequence("c", F.col("all") - 1),
        lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(True).alias("left")))).otherwise(F.array())
    met = F.least("c", "g")
    right = F.when(met > 0, F.transform(
        F.sequence(F.lit(0), met - 1),
        lambda i: F.struct(i.alias("i"), F.col("c").alias("j"), F.lit(False).alias("left")))).otherwise(F.array())
    return rows.select(*names, F.explode(F.concat(left, right)).alias("block")).select(*names, "block.*")


def _runs(batches: Batches, key: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each value of the sorted columns `key`."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in key]
        fresh = np.zeros(batch.num_rows, bool)
        for column in columns:
            fresh[1:] |= column[1:] != column[:-1]
        first = tuple(c[0] for c in columns)
        fresh[0] = first != last
        last = tuple(c[-1] for c in columns)
        cuts = np.flatnonzero(fresh).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if start in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if end > start:
                held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _sides(run: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, cosines) of the left and right side, by length of the vectors."""
    lists = run.column("embedding").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    left = run.column("left").to_numpy()
    for rows, vectors in units(lists):
        side = left[rows]
        ours, theirs = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
        if len(ours) and len(theirs):
            yield rows[ours], rows[theirs], vectors[ours] @ vectors[theirs].T


def _joining(cells: DataFrame, vertices: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components that meet in a cell (key, v)."""
    placed = cells.join(roots.select(F.col("id").alias("v"), "root").hint("merge"), "v", "left")
    placed = placed.withColumn("root", F.coalesce("root", "v"))
    counted = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    open_ = counted.where("roots > 1").select("key", "n", "main")
    rows = placed.join(open_.hint("merge"), "key")
    inside = F.col("root") == F.col("main.root")
    rest = (F.col("n") - F.col("main.n")).cast("bigint")
    whole = F.col("n") <= BLOCK
    few, many = F.ceil(rest / BLOCK), F.ceil(F.col("main.n") / BLOCK)
    at = F.xxhash64("v")
    rows = rows.select(
        "key", "v", "root",
        F.when(whole, 0).when(inside, few + F.pmod(at, many)).otherwise(F.pmod(at, few)).cast("bigint").alias("c"),
        F.when(whole, 1).otherwise(few).cast("bigint").alias("g"),
        F.when(whole, 1).otherwise(few + many).cast("bigint").alias("all"))
    units_ = _blocks(rows, ["key", "v", "root"]).join(vertices.select("v", "embedding").hint("merge"), "v")
    dealt = units_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def work(batches: Batches) -> Iterator[dict]:
        for run in _runs(batches, ("key", "i", "j")):
            same = run.column("i")[0] == run.column("j")[0]
            owners, group = run.column("v").to_numpy(), run.column("root").to_numpy()
            found: dict[tuple[int, int], tuple[int, int]] = {}
            for ours, theirs, cosines in _sides(run, same):
                x, y = np.nonzero((cosines >= least) & (group[ours][:, None] != group[theirs][None, :]))
                a, b = ours[x], theirs[y]
                pairs = np.stack([np.minimum(group[a], group[b]), np.maximum(group[a], group[b])], 1)
                kept = np.unique(pairs, axis=0, return_index=True)[1] if len(pairs) else []
                for k in kept:
                    found.setdefault(tuple(pairs[k].tolist()), (int(owners[a[k]]), int(owners[b[k]])))
            links = _forest(found)
            yield {"a": [a for a, _ in links], "b": [b for _, b in links]}

    return by_arrow(dealt, work, "a bigint, b bigint")


def _forest(links: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the links between components, by their components, those of a spanning forest."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    kept = []
    for (p, q), link in links.items():
        p, q = top(p), top(q)
        if p != q:
            above[max(p, q)] = min(p, q)
            kept.append(link)
    return kept


def _counted(vertices: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(v, n): other vectors that a vertex in a component is linked with, copies of its own left out."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    rows = roots.withColumnRenamed("id", "v").join(sizes.hint("merge"), "root").join(
        vertices.select("v", "copies", "embedding").hint("merge"), "v")
    chunks = F.ceil(F.col("size") / BLOCK).cast("bigint")
    rows = rows.select("root", "v", "copies", "embedding", F.pmod(F.xxhash64("v"), chunks).alias("c"),
                       chunks.alias("g"), chunks.alias("all"))
    dealt = _blocks(rows, ["root", "v", "copies", "embedding"])
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def work(batches: Batches) -> Iterator[dict]:
        for run in _runs(batches, ("root", "i", "j")):
            same = run.column("i")[0] == run.column("j")[0]
            owners, copies = run.column("v").to_numpy(), run.column("copies").to_numpy()
            counts = np.zeros(len(owners), np.int64)
            for ours, theirs, cosines in _sides(run, same):
                linked = cosines >= least
                if same:
                    np.fill_diagonal(linked, False)
                else:
                    counts[theirs] += copies[ours] @ linked
                counts[ours] += linked @ copies[theirs]
            yield {"v": owners, "n": counts}

    return by_arrow(dealt, work, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n"))


def classes(
    vectors: DataFrame, *, least: float = 0.9, tables: int = 10, codes: int = 2, scale: float = 0.6, probes: int = 12
) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable by links) and kept
    (whether the row stands for its component) of every row."""
    told = F.when(sound(F.col("embedding")), F.col("embedding"))
    rows = vectors.select("vec_id", F.col("embedding")).select(
        "vec_id", F.when(told.isNotNull(), F.xxhash64("embedding")).alias("h"),
        F.when(told.isNotNull(), F.xxhash64(F.lit(1), "embedding")).alias("g"), told.alias("embedding"))
    vertices = materialise(
        rows.where("h is not null").groupBy("h", "g").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"),
        ).withColumn("v", F.monotonically_increasing_id()), "vertices")

    cells = _cells(vertices, tables, codes, scale, probes)
    shared = cells.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("home"), F.col("v"))).alias("leader")).where("n > 1 and leader is not null")
    met = materialise(cells.join(shared.select("key", "leader").hint("merge"), "key").select("key", "v", "leader"), "cells")
    first = met.where("v <> leader").select(F.col("v").alias("a"), F.col("leader").alias("b")).distinct()
    links = materialise(_verified(first, vertices, least), "links")
    roots = materialise(components(links), "roots")
    links = links.unionByName(materialise(_joining(met.select("key", "v"), vertices, roots, least), "links"))
    roots = materialise(components(links), "roots")

    counts = _counted(vertices, roots, least)
    placed = vertices.select("h", "g", "v", "least", "copies").join(
        roots.withColumnRenamed("id", "v").hint("merge"), "v", "left").join(
        counts.hint("merge"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    told = placed.join(named.hint("merge"), "root").select(
        "h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id").where("n_links > 0")
    return rows.select("vec_id", "h", "g").join(told.hint("merge"), ["h", "g"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", F.when(F.col("n_links").isNull(), F.col("vec_id"))).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
