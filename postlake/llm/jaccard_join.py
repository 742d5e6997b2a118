"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams, as 64-bit hashes. XOR of hashed
grams gives parity sketches: an element that only one of two sets has changes one
place of one block, so the number of blocks (or bits) that differ is at most the size
of the symmetric difference. Sets of sizes a and b with Jaccard similarity t/100 or
more differ in at most (100 - t)(a + b) / (100 + t) elements. Hence:

* Sizes are cut into bands; a document also visits the band below when a partner can
  lie there. Within a band all sketches have the same blocks, more of them than
  elements can differ. With D the most elements that can differ, any D + 1 blocks of a
  document chosen in an order that all share (fullest first, empty ones left out)
  hold one that its partner also chose with equal contents: the pigeonhole join.
  A document with too few blocks that are not empty gives all its blocks.
* Documents with equal sets are one vertex, so copies are joined once. Within a block
  each vertex meets the smallest one; links become components. Vertices that are still
  apart meet by a second pigeonhole: XOR with the centre of their cluster leaves small
  differences, and similar vertices share a rare one (`_by_difference`).
* Candidates whose dense sketches differ in more than D bits are dropped, the rest is
  verified on the sets. Pairs already in one component are not compared again: they
  cannot change the classes.

Equal sets are told by a 64-bit sum of their hashes and their size.

Null texts and texts without words have an empty set and stand alone; fewer words than
n make one gram of all of them; very long texts are read whole; repeated rows are copies;
an empty table gives no rows; a row without doc_id keeps none and is linked through
copies that have one; rows of one doc_id with different texts are linked each by its own
text, and each names its doc_id to its class. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from postlake.session import materialise

from .common import Batches, WordHashes, by_arrow, slices, whole_rows
from .components import components

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Each band of sizes ends at this times its begin.
_WIDE = 1.6
#: Blocks of a band, times the size at its end.
_BLOCKS = 0.35
#: Sets that a worker remembers so as to give equal ones once.
_SEEN = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def grams(words: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total * _ODD + values[k : len(words) - size + 1 + k])
    return np.unique(total)


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def most_apart(a: int, b: int, percent: int) -> int:
    """Elements in which sets of these sizes can differ and still be similar."""
    return (100 - percent) * (a + b) // (100 + percent)


def band_starts(percent: int, top: int = 1 << 40) -> list[int]:
    """Begins of the bands; two neighbouring bands hold all partners of a size."""
    starts = [1]
    while starts[-1] < top:
        starts.append(max(starts[-1] + 1, int(starts[-1] * max(_WIDE, 100 / percent + 0.1))))
    return starts


def signature(elements: np.ndarray) -> int:
    """64 bits that stand for a set."""
    with np.errstate(over="ignore"):
        total = mix(elements + _ODD).sum(dtype=np.uint64) + np.uint64(len(elements)) * _ODD
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def block_keys(elements: np.ndarray, percent: int, starts: list[int]) -> np.ndarray:
    """Keys of the blocks that a set gives, for its band and for the one below."""
    size = len(elements)
    band = int(np.searchsorted(starts, size, "right")) - 1
    bands = [band]
    if band and -(-percent * size // 100) < starts[band]:
        bands.append(band - 1)
    apart = most_apart(size, size * 100 // percent, percent)
    keys = []
    for k in bands:
        m = max(2, int(_BLOCKS * starts[k + 1]))
        place = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as the elements are
        held, first, count = np.unique(place, return_index=True, return_counts=True)
        content = np.bitwise_xor.reduceat(mix(elements * _ODD), first)
        own = mix(content + held * _ODD + np.uint64(k + 1))
        if len(held) > apart:
            order = np.lexsort((own, -count))
            keys.append(own[order[: apart + 1]])
        else:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), held)
            keys += [own, mix(empty * _ODD + np.uint64(k + 1))]
    return np.concatenate(keys)


def dense_sketch(elements: np.ndarray) -> bytes:
    """Parity bits, some two to four for each element."""
    bits = max(64, 1 << (2 * len(elements) - 1).bit_length()) if len(elements) else 64
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Hamming distance of two dense sketches; the longer is folded by XOR."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_SKETCHED = "key bigint, sig bigint, doc_id bigint, size bigint, sketch binary"


def _sketched(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row for each document (with its size) and for each block it gives (without)."""

    def work(batches: Batches) -> Iterator[dict]:
        hashes, starts, seen = WordHashes(), band_starts(percent), set()
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            keys, sigs, sizes, sketches, blocks, owners = [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                own = grams(lowered(text), hashes, n)
                sizes.append(len(own))
                sig = signature(own) if len(own) else None
                sigs.append(sig)
                sketches.append(dense_sketch(own) if len(own) else None)
                if sig is not None and sig not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(sig)
                    given = block_keys(own, percent, starts)
                    blocks.append(given)
                    owners.append(np.full(len(given), sig, np.int64))
            keys = mix(np.array([i or 0 for i in ids], np.int64).view(np.uint64)).view(np.int64)
            yield {"key": keys, "sig": sigs, "doc_id": pa.array(ids, pa.int64()), "size": sizes, "sketch": sketches}
            if blocks:
                flat = np.concatenate(blocks).view(np.int64)
                none = pa.nulls(len(flat))
                yield {"key": flat, "sig": np.concatenate(owners), "doc_id": none, "size": none, "sketch": none}

    return by_arrow(docs.select("doc_id", "text"), work, _SKETCHED)


def _grouped(rows: DataFrame) -> DataFrame:
    """The document rows as they are; of blocks that several sets gave, a row for each
    set but the smallest, which is its `leader`. Reads one sorted run, keeps one key."""

    def work(batches: Batches) -> Iterator[dict]:
        key = leader = last = None
        for batch in batches:
            document = batch.column("size").is_valid()
            kept = batch.filter(document)
            if kept.num_rows:
                yield {c: kept.column(c) for c in ("key", "sig", "doc_id", "size", "sketch")} | {
                    "leader": pa.nulls(kept.num_rows)}
            block = batch.filter(pa.compute.invert(document))
            if not block.num_rows:
                continue
            keys, sigs = (block.column(c).to_numpy() for c in ("key", "sig"))
            fresh = np.concatenate(([keys[0] != key], keys[1:] != keys[:-1]))
            first = np.where(fresh, np.arange(len(keys)), -1)
            np.maximum.accumulate(first, out=first)
            leaders = np.where(first >= 0, sigs[np.maximum(first, 0)], leader if leader is not None else 0)
            again = np.concatenate(([keys[0] == key and sigs[0] == last], (keys[1:] == keys[:-1]) & (sigs[1:] == sigs[:-1])))
            met = (sigs != leaders) & ~again
            key, last, leader = keys[-1], sigs[-1], leaders[-1]
            if met.any():
                none = pa.nulls(int(met.sum()))
                yield {"key": keys[met], "sig": sigs[met], "doc_id": none, "size": none, "sketch": none,
                       "leader": leaders[met]}

    dealt = rows.repartition("key").sortWithinPartitions("key", "sig")
    return by_arrow(dealt, work, _SKETCHED + ", leader bigint")


def _near(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and dense sketches let them be similar."""
    a, b = (vertices.select(F.col("sig").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
            for s in "ab")
    sized = pairs.join(a, "a").join(b, "b").where(
        f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")

    def work(batches: Batches) -> Iterator[dict]:
        for batch in batches:
            rows = batch.to_pylist()
            kept = [r for r in rows if bits_apart(r["sketch_a"], r["sketch_b"])
                    <= most_apart(r["size_a"], r["size_b"], percent)]
            yield {"a": [r["a"] for r in kept], "b": [r["b"] for r in kept]}

    return by_arrow(sized, work, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    a, b = (sets.select(F.col("sig").alias(s), F.col("elements").alias(f"set_{s}")) for s in "ab")

    def work(batches: Batches) -> Iterator[dict]:
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    linked.append((batch.column("a")[i].as_py(), batch.column("b")[i].as_py()))
            yield {"a": [x for x, _ in linked], "b": [y for _, y in linked]}

    return by_arrow(pairs.join(a, "a").join(b, "b"), work, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sig, elements) of the wanted documents (doc_id, sig)."""

    def work(batches: Batches) -> Iterator[dict]:
        hashes = WordHashes()
        for part in slices(batches):
            sets = [grams(lowered(t), hashes, n) for t in part.column("text").to_pylist()]
            # Of several texts of one doc_id only that of the signature.
            kept = [(s, e.tobytes()) for s, e in zip(part.column("sig").to_pylist(), sets, strict=True)
                    if len(e) and signature(e) == s]
            yield {"sig": [s for s, _ in kept], "elements": [e for _, e in kept]}

    met = docs.select("doc_id", "text").join(wanted, "doc_id")
    return by_arrow(met.select("sig", "text"), work, "sig bigint, elements binary").dropDuplicates(["sig"])


def _rooted(rows: DataFrame, name: str, roots: DataFrame) -> DataFrame:
    """The rows with the component of column `name`, itself if it has no link."""
    root = roots.select(F.col("id").alias(name), F.col("root").alias(f"root_{name}"))
    return rows.join(root, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))


_DIFFERENCE = "cluster bigint, element bigint, rank int, short int, apart int, sig bigint, size bigint, root bigint"


def _by_difference(met: DataFrame, vertices: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among which are all similar ones.

    Vertices that shared blocks bring together are a cluster; its centre holds the
    elements of more than half of them. A set is now its XOR with the centre, of which
    two have the same symmetric difference as the sets. Similar sets whose differences
    from the centre add up to more than they may be apart share some of these
    differences: with the rarest first, one of the first few of each, and few elements
    are rare in more than one. The others, both close to the centre, are similar to the
    closest set of either size.
    """
    cluster = components(met).select(F.col("id").alias("sig"), F.col("root").alias("cluster"))
    rows = _rooted(vertices.join(cluster, "sig").select("sig", "size", "cluster"), "sig", roots)
    rows = rows.withColumnRenamed("root_sig", "root")
    # Narrow tables by cluster are written, so that a join with them can split a large one.
    open_ = materialise(rows.groupBy("cluster").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high"), "open")
    rows = materialise(rows.join(open_.select("cluster", "n"), "cluster").join(sets, "sig"), "clusters")

    def each(batches: Batches) -> Iterator[dict]:
        for batch in batches:
            elements = [np.frombuffer(e.as_buffer(), np.int64) for e in batch.column("elements")]
            lengths = [len(e) for e in elements]
            if elements:
                yield {"cluster": np.repeat(batch.column("cluster").to_numpy(), lengths),
                       "sig": np.repeat(batch.column("sig").to_numpy(), lengths), "element": np.concatenate(elements)}

    flat = by_arrow(rows.select("cluster", "sig", "elements"), each, "cluster bigint, sig bigint, element bigint")
    # An element that one set has needs no look-up: it can only lengthen the difference.
    counts = materialise(flat.groupBy("cluster", "element").agg(F.count("*").alias("held")).where("held > 1").join(
        open_.select("cluster", "n"), "cluster"), "counts")
    centre = materialise(counts.where("2 * held > n").groupBy("cluster").agg(
        F.collect_list(F.struct((F.col("n") - F.col("held")).alias("seen"), "element")).alias("centre")), "centres")
    shared = flat.join(counts.where("2 * held <= n"), ["cluster", "element"]).groupBy("sig").agg(
        F.collect_list(F.struct(F.col("held").alias("seen"), "element")).alias("shared"))

    def differ(batches: Batches) -> Iterator[dict]:
        for batch in batches:
            columns: dict[str, list] = {c.split()[0]: [] for c in _DIFFERENCE.split(", ")}
            for row in batch.to_pylist():
                own = np.frombuffer(row["elements"], np.int64)
                middle = {e["element"]: e["seen"] for e in row["centre"] or ()}
                inside = set(own[np.isin(own, np.fromiter(middle, np.int64, len(middle)))].tolist())
                differing = [(seen, e) for e, seen in middle.items() if e not in inside]
                apart = len(own) - len(inside) + len(differing)
                differing = sorted((seen, e) for seen, e in (
                    *differing, *((s["seen"], s["element"]) for s in row["shared"] or ())) if seen > 1)
                most = most_apart(len(own), len(own) * 100 // percent, percent)
                short = prefix(apart, max(apart, most - apart + 1), most)
                long = prefix(apart, max(0, apart - most, most - apart + 1), most)
                alone = apart - len(differing)  # elements that no other set's difference has come first
                head = [(-1, None), *((alone + i, e) for i, (_, e) in enumerate(differing) if alone + i < long)]
                for rank, element in head:
                    for column, value in zip(columns.values(), (
                            row["cluster"], element, rank, short, apart, row["sig"], row["size"], row["root"]), strict=True):
                        column.append(value)
            yield columns

    differences = materialise(by_arrow(
        rows.join(centre, "cluster", "left").join(shared, "sig", "left"), differ, _DIFFERENCE), "differences")
    similar = (f"least(a_size, b_size) * 100 >= {percent} * greatest(a_size, b_size) and a_root <> b_root")
    limit = f"{100 - percent} * (a_size + b_size) div {100 + percent}"
    names = [c for c in differences.columns if c not in ("cluster", "element")]

    def side(table: DataFrame, s: str) -> DataFrame:
        return table.withColumnsRenamed({c: f"{s}_{c}" for c in names})

    listed = differences.where("element is not null")
    crossing = side(listed.where("rank < short"), "a").join(side(listed, "b"), ["cluster", "element"]).where(
        f"(a_apart < b_apart or (a_apart = b_apart and a_sig < b_sig)) and b_apart - a_apart <= {limit} and {similar}"
        # As many as are left from here on have to be shared, if this is the first.
        f" and 2 * least(a_apart - a_rank, b_apart - b_rank) >= a_apart + b_apart - {limit}")
    close = differences.where(f"rank = -1 and apart <= {100 - percent} * (size + size * 100 div {percent}) div {100 + percent}")
    closest = close.groupBy("cluster", "size").agg(F.min(F.struct("apart", "sig", "root")).alias("m")).select(
        "cluster", "size", "m.*", F.lit(0).alias("rank"), F.lit(0).alias("short"))
    central = side(close.drop("element"), "a").join(side(closest, "b"), "cluster").where(
        f"a_apart + b_apart <= {limit} and {similar}")
    pairs = crossing.select("a_sig", "b_sig").unionByName(central.select("a_sig", "b_sig"))
    return materialise(pairs.select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b")).distinct(),
                       "candidates")


def prefix(size: int, other: int, most: int) -> int:
    """Elements of a difference of `size` of which one must be shared with one of
    `other` or more elements, if both are to be within `most`."""
    return max(0, size - max(1, -(-(size + other - most) // 2)) + 1)


def placed(docs: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, size, sig, root (of its class) and component_id of every row."""
    found = materialise(_grouped(_sketched(docs, n, percent)), "sketches")
    members = found.where("size is not null").select("doc_id", "size", "sig", "sketch")
    blocks = found.where("size is null").select("key", "sig", "leader")
    vertices = members.where("sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    met = blocks.select("sig").unionByName(blocks.select(F.col("leader").alias("sig"))).distinct()
    vertices = materialise(vertices.join(met, "sig", "left_semi"), "vertices")
    sets = materialise(_sets(docs, vertices.select("doc_id", "sig"), n), "sets")

    # Each vertex meets one leader, then the other leaders that it is still apart from.
    first = blocks.groupBy(F.col("sig").alias("a")).agg(F.min("leader").alias("b"))
    links = materialise(_verified(_near(first, vertices, percent), sets, percent), "links")
    roots = materialise(components(links), "roots")
    met = materialise(blocks.select(F.col("sig").alias("a"), F.col("leader").alias("b")).distinct(), "met")
    apart = _rooted(_rooted(met, "a", roots), "b", roots).where("root_a <> root_b").select("a", "b")
    second = apart.join(first, ["a", "b"], "left_anti")
    links = links.unionByName(materialise(_verified(_near(second, vertices, percent), sets, percent), "links"))
    roots = materialise(components(links), "roots")

    # Then vertices that blocks hold together, but links do not, meet each other.
    third = _by_difference(met, vertices, sets, roots, percent)
    links = links.unionByName(materialise(_verified(_near(third, vertices, percent), sets, percent), "links"))
    roots = components(links)

    least = members.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    tops = least.join(roots.withColumnRenamed("id", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    named = materialise(
        tops.join(tops.groupBy("root").agg(F.min("least").alias("component_id")), "root")
        .select("sig", "root", "component_id"), "classes")
    return members.join(named, "sig", "left").select(
        "doc_id", "size", "sig", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    return placed(docs, **options).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """The documents that stand for their class, in all their columns and once each;
    rows without doc_id cannot be told apart and stay. Where rows of one doc_id have
    different texts, those texts stay that stand for a class, and one row of each."""
    rows = placed(docs, n=n, percent=percent).where("doc_id is not null").select("doc_id", "sig", "root", "component_id")
    members = materialise(rows.distinct(), "members")
    several = members.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    first = members.where("component_id = doc_id").groupBy("doc_id", "root").agg(F.min("sig").alias("sig"))
    known = docs.where("doc_id is not null")
    columns = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    plain = first.select("doc_id").join(several, "doc_id", "left_anti")
    named = known.join(plain, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(columns)
    if not several.isEmpty():
        chosen = first.join(several, "doc_id", "left_semi").select("doc_id", "sig")
        named = named.unionByName(_of_signature(known.join(several, "doc_id", "left_semi"), chosen, n))
    return named.unionByName(docs.where("doc_id is null"))


def _of_signature(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """One row of `docs` for each (doc_id, sig), the signature of its text, in `chosen`;
    texts without words have none."""
    rows = docs.select(whole_rows(docs, "row"), "doc_id", "text")

    def work(batches: Batches) -> Iterator[dict]:
        hashes = WordHashes()
        for part in slices(batches):
            sets = (grams(lowered(t), hashes, n) for t in part.column("text").to_pylist())
            yield {"row": part.column("row"), "doc_id": part.column("doc_id"),
                   "sig": [signature(s) if len(s) else None for s in sets]}

    signed = by_arrow(rows, work, StructType([
        *(rows.schema[c] for c in ("row", "doc_id")), StructField("sig", LongType())])).alias("r")
    match = F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("r.sig").eqNullSafe(F.col("c.sig"))
    return signed.join(chosen.alias("c"), match, "left_semi").dropDuplicates(["doc_id", "sig"]).select("row.*")
