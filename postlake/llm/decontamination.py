"""Passages of benchmark items in documents, found by one Aho-Corasick automaton.

Questions and answers and documents are normalised alike: A-Z lower-cased, words are
runs of letters, digits and non-ASCII characters; words of items are numbered. A window
is `width` consecutive words of an item, and an item of fewer words is one. Every window
holds a run of (width + 1) // 2 words that begins at a multiple of that in its item:
these runs, and the short items whole, are the patterns of the automaton, over word
numbers, so it has at most a node for each word of the items. Each text is scanned once;
the windows about a match are looked up by hash and compared word by word, and the words
that they cover are mapped back to the code points of the original text.

The items are broadcast and the automaton is built once by each Python worker, some 80
bytes for each word of the items. The words are counted first: beyond `most_nodes` the
items are dealt to several automata, each a pass over the rows of its own that carries
the hits of those before (an item is not parted).

Null texts and texts without words have no words and are clean; items without words
have no pattern; items without an id mark words and are not named in item_ids; equal
items are all reported; long texts are scanned whole; every row of the documents gives
one row, whatever the number of automata. Other columns of both tables are not looked
at, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from postlake.session import materialise

from .common import Batches, by_arrow, kept_by_worker, slices, whole_rows
from .jaccard_join import mix

#: Bytes to lower case, and to a blank where they stand in no word.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ORIGINAL_WORD = re.compile(_WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CARRIED = "doc_id bigint, text string, hit_words array<int>, item_ids array<bigint>"
_FOUND = "doc_id bigint, n_words bigint, hit_words array<int>, item_ids array<bigint>, starts array<int>, ends array<int>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def window_hashes(numbers: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(len(starts), np.uint64)
    for k in range(width):
        total = mix(total * _ODD + numbers[starts + k].astype(np.uint64) + np.uint64(1))
    return total


class Items:
    """The automaton of the items, and their windows by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        import ahocorasick

        self._width, self._run = width, (width + 1) // 2
        self._number: dict[bytes, int] = {}
        self._short: dict[tuple[int, ...], list[int]] = {}
        self._named: list[int | None] = []
        self._tree = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        flat, starts, owners, begin = [np.zeros(0, np.int32)], [], [], 0
        for item, text in items:
            own = [self._number.setdefault(w, len(self._number) + 1) for w in words(text)]
            if not own:
                continue
            if len(own) < width:
                self._tree.add_word(tuple(own), len(own))
                named = self._short.setdefault(tuple(own), [])
                if item is not None:
                    named.append(item)
                continue
            for at in range(0, len(own) - self._run + 1, self._run):
                self._tree.add_word(tuple(own[at : at + self._run]), self._run)
            flat.append(np.array(own, np.int32))
            starts.append(np.arange(begin, begin + len(own) - width + 1))
            owners.append(np.full(len(starts[-1]), len(owners)))
            self._named.append(item)
            begin += len(own)
        if len(self._tree):
            self._tree.make_automaton()
        self._flat = np.concatenate(flat)
        self._index(np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *owners]))

    def _index(self, starts: np.ndarray, owners: np.ndarray) -> None:
        """Windows in order of hash; those of one hash lie together, by item."""
        hashed = window_hashes(self._flat, starts, self._width)
        order = np.lexsort((owners, hashed))
        self._hashed, self._starts, self._owners = hashed[order], starts[order], owners[order].astype(np.int32)

    @property
    def nodes(self) -> int:
        return self._tree.get_stats()["nodes_count"] if len(self._tree) else 0

    def scan(self, text: str | None, hit=(), found=()) -> tuple[int, list[int], list[int], list[int], list[int]]:
        """Number of words, those hit, the items found, and the spans of hit words; `hit`
        and `found` are what other automata found in the text."""
        own = words(text)
        matches: list[tuple[int, int]] = []
        if len(own) and len(self._tree):
            number = self._number.get
            spoken = tuple([number(w, 0) for w in own])
            matches = list(self._tree.iter(spoken))
        if not matches and not len(hit):
            return len(own), [], [], [], []
        covered = np.zeros(len(own) + 1, np.int32)
        named = set(found)
        near = []
        for end, size in matches:
            at = end - size + 1
            if size == self._run:
                near.append(at)
            if (short := self._short.get(spoken[at : end + 1])) is not None:
                covered[at] += 1
                covered[end + 1] -= 1
                named.update(short)
        if near:
            for at, items in self._windows(np.array(spoken, np.int32), np.array(near)):
                covered[at] += 1
                covered[at + self._width] -= 1
                named.update(items)
        marked = np.cumsum(covered[:-1]) > 0
        marked[list(hit)] = True
        if not marked.any():
            return len(own), [], [], [], []
        spans = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).astype(np.int8)))
        return (len(own), np.flatnonzero(marked).tolist(), sorted(named),
                [spans[i][0] for i in edges[::2]], [spans[i - 1][1] for i in edges[1::2]])

    def _windows(self, spoken: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Begin and items of each window of the text that is one of an item, near a run."""
        at = np.unique(near[:, None] - np.arange(self._run))
        at = at[(at >= 0) & (at + self._width <= len(spoken))]
        if not len(at) or not len(self._hashed):
            return
        hashed = window_hashes(spoken, at, self._width)
        low, high = np.searchsorted(self._hashed, hashed), np.searchsorted(self._hashed, hashed, "right")
        each = np.arange(self._width)
        known: dict[int, list[int]] = {}
        for k in np.flatnonzero(low < high).tolist():
            first = self._starts[low[k]]
            if (spoken[at[k] + each] == self._flat[first + each]).all():
                if low[k] not in known:
                    items = (self._named[o] for o in np.unique(self._owners[low[k] : high[k]]).tolist())
                    known[low[k]] = [i for i in items if i is not None]
                yield int(at[k]), known[low[k]]


def _scanner(items: DataFrame, width: int):
    """What gives a worker its automaton of the items."""
    rows = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]
    held, name = items.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def scanner() -> Items:
        return kept_by_worker(("items", name), lambda: Items(held.value, width))

    return scanner


def _scanned(rows: DataFrame, items: DataFrame, width: int, schema: str) -> DataFrame:
    scanner = _scanner(items, width)

    def work(batches: Batches) -> Iterator[dict]:
        tree = scanner()
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            before = [part.column(c).to_pylist() if c in part.schema.names else [()] * len(texts)
                      for c in ("hit_words", "item_ids")]
            rows = [tree.scan(t, *b) for t, *b in zip(texts, *before, strict=True)]
            names = ("n_words", "hit_words", "item_ids", "starts", "ends")
            yield {c: part.column(c) for c in ("doc_id", "text")} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return by_arrow(rows, work, schema)


def _shards(items: DataFrame, most_nodes: int) -> list[DataFrame]:
    """The items, or if they have too many words for one automaton, parts of them."""
    items = items.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(_WORD))), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_nodes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def contamination(
    docs: DataFrame, items: DataFrame, *, width: int = 10, most_nodes: int = 4_000_000
) -> DataFrame:
    """doc_id, n_words, hit_words (their numbers), item_ids found, and the spans of
    the hit runs of words in the text (starts, ends; end exclusive)."""
    *others, last = _shards(items, most_nodes)
    rows = docs.select("doc_id", "text")
    for shard in others:
        rows = materialise(_scanned(rows, shard, width, _CARRIED), "scanned")
    return _scanned(rows, last, width, _FOUND)


def clean(docs: DataFrame, items: DataFrame, *, width: int = 10, most_nodes: int = 4_000_000) -> DataFrame:
    """The documents without those that hold a passage, in all their columns: a filter
    of each batch for each automaton, without a shuffle."""
    rows = docs.select(whole_rows(docs, "row"), "text")
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("text", rows.schema["text"].dataType)])
    for number, shard in enumerate(_shards(items, most_nodes)):
        scanner = _scanner(shard, width)

        def work(batches: Batches, scanner=scanner) -> Iterator[dict]:
            tree = scanner()
            for part in slices(batches):
                hit = [bool(tree.scan(t)[1]) for t in part.column("text").to_pylist()]
                left = part.filter(pa.compute.invert(pa.array(hit, pa.bool_())))
                yield {"row": left.column("row"), "text": left.column("text")}

        rows = by_arrow(materialise(rows, "scanned") if number else rows, work, schema)
    return rows.select("row.*")
