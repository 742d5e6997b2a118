"""Substring dedup by super-k-mer partitioning.

A window is `width` consecutive words of a document. Its minimiser is the smallest
hash of the runs of `mer` words in it; consecutive windows that share one travel as
one packed string to the bucket of that minimiser, so equal windows always meet. In a
bucket the windows are hashed, sorted and, where hashes are equal, compared word by
word (by 64-bit hashes of words). Windows that a document with a smaller doc_id also
has are marked; a last join brings the marked ranges to the texts.

Strings for one bucket travel together, compressed. A task holds at most `_HELD`
characters of a bucket; what exceeds that, and minimisers that a bounded sample of
documents shows to be in very many of them (these are dealt to several buckets by
doc_id), is settled in two steps: each part marks all but the smallest document of a
window, and the smallest ones of the parts, a row for each window, are compared by
128-bit hashes. The sample only steers the layout: both ways are exact. A text that a
task has seen before under a smaller doc_id is marked at once.

Null texts have no words; texts of fewer words than a window keep all; very long ones are
taken whole. Rows of one doc_id do not remove each other's windows; where their texts
differ, each loses its own (rows are told apart by doc_id and a hash of the text). Rows
without doc_id are left as they are. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise

from .common import Batches, WordHashes, by_arrow, slices

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors of the two window hashes.
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Characters: sent together by a map task, taken in one go, held by a reduce task.
_SENT, _TAKEN, _HELD = 12 << 20, 3 << 20, 64 << 20
#: Documents with one minimiser that one bucket may get, by the sample's estimate.
_CROWD = 20_000
#: Characters of packed strings that a bucket is planned for.
_PLANNED = 24 << 20
_SEEN = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= span:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def super_kmers(hashes: np.ndarray, width: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers of the runs of windows that share one, their first windows, and the
    words of each run, for the word hashes of one document."""
    mers = np.zeros(len(hashes) - mer + 1, np.uint64)
    for k in range(mer):
        mers = mix(mers * _ODD + hashes[k : len(hashes) - mer + 1 + k])
    least = sliding_min(mers, width - mer + 1)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    sizes = np.diff(np.append(first, len(least))) + width - 1
    return least[first], first, sizes


def window_hashes(values: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash of each window over a flat run of word hashes."""
    n = len(values)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, factor, np.uint64))))
    inverse = pow(factor, -1, 1 << 64)
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, inverse, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(factor)) * powers)))
    return mix((sums[width:] - sums[:-width]) * back[: n - width + 1])


def marked(
    values: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, width: int, settled: bool
) -> tuple[list[tuple[int, int, int, int]], dict[str, np.ndarray] | None]:
    """Ranges (doc, sig, start, end) of marked words in packed runs, and the windows of
    smallest documents if others may have them too."""
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    count = sizes - width + 1
    record = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(len(record)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    at = begin[record] + inner
    hashed = window_hashes(values, width, _FACTORS[0])[at]
    doc, sig, pos = docs[record], sigs[record], starts[record] + inner
    order = np.argsort(hashed)
    same = hashed[order][1:] == hashed[order][:-1]
    some = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    some = order[some]
    some = some[np.lexsort((pos[some], doc[some], hashed[some]))]
    lower = np.ones(len(at), bool)  # windows of the smallest document that has them here
    if len(some):
        equal = np.zeros(len(some), bool)
        for k in range(1, len(some), 50_000):
            rows = np.arange(k, min(k + 50_000, len(some)))
            rows = rows[hashed[some[rows]] == hashed[some[rows - 1]]]
            a, b = at[some[rows]], at[some[rows - 1]]
            alike = np.ones(len(rows), bool)
            for w in range(width):
                alike &= values[a + w] == values[b + w]
            equal[rows] = alike
        head = np.where(equal, 0, np.arange(len(some)))
        np.maximum.accumulate(head, out=head)
        lower[some] = doc[some] == doc[some[head]]
    hit = np.flatnonzero(~lower)
    breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(record[hit]) != 0))
    first, last = hit[np.concatenate(([0], breaks + 1))] if len(hit) else hit, hit[np.append(breaks, len(hit) - 1)] if len(hit) else hit
    ranges = list(zip(doc[first].tolist(), sig[first].tolist(), pos[first].tolist(), (pos[last] + width).tolist(), strict=True))
    if settled:
        return ranges, None
    mine = np.flatnonzero(lower)
    second = window_hashes(values, width, _FACTORS[1])[at[mine]]
    return ranges, {"doc_id": doc[mine], "sig": sig[mine], "start": pos[mine], "high": hashed[mine].view(np.int64), "low": second.view(np.int64)}


def _crowded(docs: DataFrame, width: int, mer: int, sample_rows: int) -> tuple[dict[int, int], int]:
    """Minimisers that the sample shows in very many documents, with the buckets to
    deal them to, and the characters of all texts as the sample has them."""
    total = docs.count()
    share = min(1.0, sample_rows / max(1, total))

    def work(batches: Batches) -> Iterator[dict]:
        hashes = WordHashes()
        for part in slices(batches):
            found, length = [], 0
            for text in part.column("text").to_pylist():
                words = (text or "").encode().split()
                length += len(text or "")
                if len(words) >= width:
                    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    found.append(np.unique(super_kmers(values, width, mer)[0]))
            keys = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            yield {"key": np.append(keys, 0), "size": np.append(np.zeros(len(keys), np.int64), length),
                   "kind": np.append(np.zeros(len(keys), np.int64), 1)}

    seen = by_arrow(docs.select("text").sample(share, seed=7), work, "key bigint, size bigint, kind bigint")
    counted = seen.groupBy("kind", "key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    # At least ten of a bounded sample: few enough to be broadcast.
    rows = counted.where(f"kind = 1 or (n >= 10 and n / {share} > {_CROWD})").collect()
    size = sum(r["size"] for r in rows if r.kind == 1) / share
    return {r.key: -(-int(r.n / share) // _CROWD) for r in rows if r.kind == 0}, int(size)


def _sent(docs: DataFrame, width: int, mer: int, crowded: dict[int, int], buckets: int) -> DataFrame:
    """Packed strings by bucket; texts seen before as ranges (data is null)."""
    held = docs.sparkSession.sparkContext.broadcast(crowded)

    def work(batches: Batches) -> Iterator[dict]:
        hashes, seen, spread = WordHashes(200_000), {}, held.value
        crowd = np.array(sorted(spread), np.int64).view(np.uint64)
        crowd.sort()
        parts_of = np.array([spread[int(k)] for k in crowd.view(np.int64)], np.uint64)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        bins: dict[tuple[int, bool], list[tuple[int, int, int, int, int, bytes]]] = {}
        whole: list[tuple[int, int, int]] = []
        size = 0

        def out() -> Iterator[dict]:
            columns: dict[str, list] = {c: [] for c in ("bucket", "crowd", "docs", "starts", "sizes", "subs", "sigs", "data")}
            for (bucket, crowded_bin), rows in sorted(bins.items()):
                arrays = (bucket, crowded_bin, *(np.array([r[k] for r in rows], np.int64).tobytes() for k in range(5)),
                          squeeze(b"\n".join([r[5] for r in rows])))
                for column, value in zip(columns.values(), arrays, strict=True):
                    column.append(value)
            for doc, sig, n in whole:
                arrays = (int(mix(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(buckets)), False,
                          np.int64(doc).tobytes(), np.int64(0).tobytes(), np.int64(n).tobytes(), b"", np.int64(sig).tobytes(), None)
                for column, value in zip(columns.values(), arrays, strict=True):
                    column.append(value)
            bins.clear()
            whole.clear()
            if columns["bucket"]:
                yield columns

        for part in slices(batches):
            for doc, sig, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "sig", "text")), strict=True):
                words = (text or "").encode().split()
                if doc is None or len(words) < width:
                    continue
                joined = b" ".join(words)
                digest = hashlib.blake2b(joined, digest_size=16).digest()
                earlier = seen.get(digest)
                if earlier is not None and (earlier[0] < doc or earlier == (doc, sig)):
                    if earlier[0] < doc:
                        whole.append((doc, sig, len(words)))
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen[digest] = doc, sig
                values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                keys, first, sizes = super_kmers(values, width, mer)
                left = np.concatenate(([0], ends))[first]
                right = ends[first + sizes - 1] - 1
                home = mix(keys)
                is_crowd = np.zeros(len(keys), bool)
                if len(crowd):
                    where = np.minimum(np.searchsorted(crowd, keys), len(crowd) - 1)
                    is_crowd = crowd[where] == keys
                    salt = mix(np.full(len(keys), doc, np.int64).view(np.uint64)) % parts_of[where]
                    home = np.where(is_crowd, mix(keys + salt * _ODD), home)
                bucket = home % np.uint64(buckets)
                sub = (home >> np.uint64(40)) & np.uint64(0xFFFF)
                for b, c, s, n, u, x, y in zip(bucket.tolist(), is_crowd.tolist(), first.tolist(), sizes.tolist(),
                                               sub.tolist(), left.tolist(), right.tolist(), strict=True):
                    bins.setdefault((b, c), []).append((doc, s, n, u, sig, joined[x:y]))
                size += len(joined) * 3
                if size >= _SENT:
                    yield from out()
                    size = 0
        yield from out()

    return by_arrow(docs.select("doc_id", F.xxhash64("text").alias("sig"), "text"), work,
                    "bucket int, crowd boolean, docs binary, starts binary, sizes binary, subs binary, sigs binary, data binary")


_MARKS = "doc_id bigint, sig bigint, start bigint, end bigint, high bigint, low bigint"


def _marks(sent: DataFrame, width: int, buckets: int) -> DataFrame:
    """Ranges to remove, and with `high` and `low` the windows still to be compared."""

    def work(batches: Batches) -> Iterator[dict]:
        hashes, expand = WordHashes(200_000), zstandard.ZstdDecompressor().decompress
        rows: list[tuple[np.ndarray, list[bytes]]] = []
        size, state = 0, (None, None)

        def settle(last: bool) -> Iterator[dict]:
            nonlocal size, cut
            whole = last and not cut and not state[1]
            cut = not last
            if rows:
                numbers = np.concatenate([r[0] for r in rows], axis=1)
                lines = [line for r in rows for line in r[1]]
                rows.clear()
                parts = -(-size // _TAKEN)
                for j in range(parts):
                    mine = np.flatnonzero(numbers[3] % parts == j)
                    if not len(mine):
                        continue
                    words = b" ".join([lines[i] for i in mine.tolist()]).split(b" ")
                    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    ranges, open_ = marked(values, *numbers[:3, mine], numbers[4, mine], width, whole)
                    if ranges:
                        yield {"doc_id": [r[0] for r in ranges], "sig": [r[1] for r in ranges],
                               "start": [r[2] for r in ranges], "end": [r[3] for r in ranges], "high": [None] * len(ranges), "low": [None] * len(ranges)}
                    if open_:
                        yield open_ | {"end": open_["start"] + width}
            size = 0

        cut = False
        for batch in batches:
            for row in batch.to_pylist():
                if row["data"] is None:
                    doc, sig, start, n = (int(np.frombuffer(row[c], np.int64)[0]) for c in ("docs", "sigs", "starts", "sizes"))
                    yield {"doc_id": [doc], "sig": [sig], "start": [start], "end": [n], "high": [None], "low": [None]}
                    continue
                if (row["bucket"], row["crowd"]) != state:
                    yield from settle(True)
                    cut, state = False, (row["bucket"], row["crowd"])
                data = expand(row["data"])
                if size and size + len(data) > _HELD:
                    yield from settle(False)
                rows.append((np.stack([np.frombuffer(row[c], np.int64) for c in ("docs", "starts", "sizes", "subs", "sigs")]),
                             data.split(b"\n")))
                size += len(data)
        yield from settle(True)

    dealt = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "crowd")
    return by_arrow(dealt, work, _MARKS)


def repeated(docs: DataFrame, *, width: int = 50, mer: int = 8, sample_rows: int = 10_000) -> DataFrame:
    """(doc_id, sig, start, end): ranges of words, which may overlap, in windows that also
    start in a document with a smaller doc_id; sig is a hash of the text."""
    crowded, size = _crowded(docs, width, mer, sample_rows)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, -(-3 * size // _PLANNED))
    marks = materialise(_marks(_sent(docs, width, mer, crowded, buckets), width, buckets), "marks")
    open_ = marks.where("high is not null")
    least = open_.groupBy("high", "low").agg(F.min("doc_id").alias("least"))
    late = open_.join(least, ["high", "low"]).where("doc_id > least")
    kept = ("doc_id", "sig", "start", "end")
    return marks.where("high is null").select(*kept).unionByName(late.select(*kept))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space."""
    ranges = repeated(docs, **options).groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    met = docs.select("doc_id", F.xxhash64("text").alias("sig"), "text").join(ranges, ["doc_id", "sig"], "left")

    def work(batches: Batches) -> Iterator[dict]:
        for part in slices(batches):
            counts, removed, kept = [], [], []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode().split()
                counts.append(len(words))
                if ranges:
                    keep = np.ones(len(words), bool)
                    for r in ranges:
                        keep[r["start"] : r["end"]] = False
                    left = [words[i] for i in np.flatnonzero(keep).tolist()]
                else:
                    left = words
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield {"doc_id": part.column("doc_id"), "n_words": counts, "n_removed": removed, "kept_text": kept}

    return by_arrow(met, work, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
