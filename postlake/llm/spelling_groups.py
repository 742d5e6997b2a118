"""Spelling variants of words by pairs of trie nodes.

The vocabulary is written into two tries, one of the words and one of the words read
backwards. A word with the code point at i left out is then the pair (node of what
stands before i, node of what stands after it), and the word itself, with a place for
one more, is the pair (node before i, node from i on). Pairs of integers are grouped:

* two words that leave out a code point and meet differ by one replaced code point;
* a word that leaves one out meets the word that has a place there: one is the other
  with a code point inserted. Of equal neighbouring code points only the first is left
  out for this, so two words meet once.

Every meeting is a neighbour, none is missed, and a group holds no more words than
there are code points in the alphabet, plus one: the count and the two largest of a
group are all that its words need of it.

Tries are numbered without a task that holds one: words are sorted into ranges, a task
reads its range in order and keeps the path of one word, on which a node is new where
the word departs from the one before. Nodes that ranges share lie on the paths of their
first words, whose numbers the driver gives out: as many words as there are ranges.

Null and empty texts have no words; long texts are read whole, as are long words; rows
without doc_id are hashed with an empty one; repeated rows count again; ties of
frequency go to the word first in code point order; an empty table, or one without
frequent words, gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise

from .common import Batches, by_arrow, slices
from .conversation_repair import shared

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: Words a task counts before it passes them on.
_HELD = 200_000


def slip(doc_id: int | None, word: str, every: int) -> str:
    """The word, or one time in `every` (by a hash) without one of its code points."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, *, shortest: int = 6, rarest: int = 5, slips: int | None = None) -> DataFrame:
    """word, n: words of at least `shortest` code points and `rarest` occurrences. With
    `slips`, a share of 1 / `slips` is misspelt by a hash, as a test of the grouping."""

    def work(batches: Batches) -> Iterator[dict]:
        counts: Counter[str] = Counter()
        for part in slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for run, n in Counter(_RUN.findall(text or "")).items():
                    if len(run) >= shortest:
                        word = run.translate(_LOWER)
                        counts[slip(doc, word, slips) if slips else word] += n
            if len(counts) >= _HELD:
                yield {"word": list(counts), "n": list(counts.values())}
                counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    counted = by_arrow(docs.select("doc_id", "text"), work, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(
        (F.length("word") >= shortest) & (F.col("n") >= rarest))


def boundary_paths(firsts: list[str]) -> list[np.ndarray]:
    """Numbers (below 0) of the nodes on the paths of the first words of the ranges, the
    root included: that of the range in which a path was new, and the depth."""
    paths: list[np.ndarray] = []
    for number, word in enumerate(firsts):
        path = -(np.arange(len(word) + 1, dtype=np.int64) + (np.int64(number + 1) << 32))
        path[0] = -1
        if paths:
            common = shared(firsts[number - 1], word)
            path[: common + 1] = paths[-1][: common + 1]
        paths.append(path)
    return paths


class Path:
    """Numbers of the nodes on the path of one word of a range after the other."""

    def __init__(self, number: int, first: str, path: np.ndarray, next_first: str, next_path: np.ndarray):
        self._word, self._path = first, path.tolist()
        self._next, self._next_path = next_first, next_path
        self._fresh = (number + 1) << 40

    def step(self, word: str) -> list[int]:
        common = shared(self._word, word)
        path = self._path[: common + 1]
        # What the first word of the next range also has is numbered there.
        known = shared(self._next, word)
        if known > common:
            path += self._next_path[common + 1 : known + 1].tolist()
        new = len(word) + 1 - len(path)
        path += range(self._fresh, self._fresh + new)
        self._fresh += new
        self._word, self._path = word, path
        return path


def numbered(words: DataFrame, *, backwards: bool = False) -> DataFrame:
    """word, n, rank, path, first: the trie nodes of the prefixes of each word, from the
    empty one on (of the suffixes, from the whole word on, if read backwards). Ranks are
    in order of the spelling read, `first` tells code points the one before is unlike."""
    ranges = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.select("word", "n", (F.reverse("word") if backwards else F.col("word")).alias("key"))
    written = materialise(keyed.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = {r.part: r.key for r in written.groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()}
    paths = dict(zip(firsts, boundary_paths(list(firsts.values())), strict=True))
    after = dict(zip(firsts, list(firsts)[1:], strict=False))

    def work(batches: Batches) -> Iterator[dict]:
        now, path, rank = None, None, 0
        for batch in batches:
            ranks, found, first = [], [], []
            for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if part != now:
                    now, following, rank = part, after.get(part), part << 40
                    path = Path(part, firsts[part], paths[part], firsts.get(following, ""), paths.get(following, np.empty(0, np.int64)))
                own = path.step(key)
                ranks.append(rank := rank + 1)
                found.append(own[::-1] if backwards else own)
                first.append([a != b for a, b in zip(key, "\0" + key, strict=False)])
            yield {"word": batch.column("word"), "n": batch.column("n"), "rank": ranks, "path": found, "first": first}

    rows = written.repartition("part").sortWithinPartitions("part", "key")
    return by_arrow(rows.select("part", "key", "word", "n"), work,
                    "word string, n bigint, rank bigint, path array<bigint>, first array<boolean>")


def places(ranked: DataFrame) -> DataFrame:
    """p, s, rank, n, whole, first: the pairs of nodes of each word (numbered forwards).
    `whole` are those of the word itself, `first` those without a code point that the one
    before it does not equal."""
    behind = numbered(ranked, backwards=True).select("word", F.col("path").alias("s"))
    both = ranked.withColumnRenamed("path", "p").join(behind, "word")
    size = F.size("p") - 1  # p[i]: before i, s[i]: from i on

    def place(p, s, whole, first):
        return F.struct(p.alias("p"), s.alias("s"), F.lit(whole).alias("whole"), first.alias("first"))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: place(F.get("p", i), F.get("s", i), True, F.lit(False)))
    without = F.transform(F.sequence(F.lit(0), size - 1), lambda i: place(
        F.get("p", i), F.get("s", i + 1), False, F.get("first", i)))
    return both.select("rank", "n", F.explode(F.concat(whole, without)).alias("at")).select("at.*", "rank", "n")


def neighbours(ranked: DataFrame) -> DataFrame:
    """rank, n_near, best (its largest neighbour: n as `less` below 0, and rank) of the
    words that have one."""
    member = F.struct((-F.col("n")).alias("less"), "rank", "whole", "first")
    groups = places(ranked).groupBy("p", "s").agg(F.collect_list(member).alias("all")).where("size(all) > 1")

    def near(m):
        """Members that m is next to."""
        return F.filter("all", lambda o: (o["rank"] != m["rank"]) & (
            (~o["whole"] & ~m["whole"]) | (o["whole"] & m["first"]) | (m["whole"] & o["first"])))

    told = groups.select(F.explode(F.transform("all", lambda m: F.struct(
        m["rank"].alias("rank"), F.size(near(m)).alias("n"),
        F.array_min(F.transform(near(m), lambda o: F.struct(o["less"], o["rank"]))).alias("best")))).alias("m")).select("m.*")
    return told.where("n > 0").groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root of each word that has a form. The frequency grows with each step,
    so the way to a root ends; each round doubles the steps taken."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                     F.col("next").isNotNull().alias("moved")), "roots")
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def grouped(words: DataFrame, *, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n): its form is the most
    frequent neighbour, if that is at least `times` as frequent."""
    ranked = materialise(numbered(words), "vocabulary")
    names = ranked.select("rank", "word", "n")
    placed = names.join(neighbours(ranked), "rank", "left")
    better = -F.col("best.less") >= times * F.col("n")
    told = placed.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(better, F.col("best.rank")).alias("form_rank"), F.when(better, -F.col("best.less")).alias("form_n"))
    forms = names.select(F.col("rank").alias("form_rank"), F.col("word").alias("form"))
    told = materialise(told.join(forms, "form_rank", "left").drop("form_rank"), "forms")
    roots = rooted(told.where("form is not null"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
