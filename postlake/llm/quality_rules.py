"""Learned decision lists over text statistics.

Statistics of whole texts are taken in Arrow batches. From labelled rows, at most
`most_rows` of them, sequential covering learns an ordered list of rules, each a
conjunction of thresholds on statistics: a rule grows by the threshold that gains most
information on two thirds of the rows, is pruned from its end where that is no worse on
the held-out third, and is kept if it is `precision` sure there and on what it grew
from; the rows it covers are set aside and the next rule is sought. The list becomes one Spark
conditional expression, first rule that holds wins, else keep.

The rows to learn from are the labelled ones with the smallest hash of doc_id: a
function of the rows, not of their layout. Without labelled rows, or with one class
only, the list is empty and every text that passes the base limits is kept.

Null texts have no words (and so fail the base limits); a text of any length is read
whole; every row gives one row; repeated labels of a doc_id count as bad if one is;
statistics that divide by zero are 0; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from postlake.session import materialise

from .common import Batches, by_arrow, slices, whole_rows

_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]")
#: What rules may speak of: shares, so that they hold for texts of any length.
FEATURES = (
    "symbols_per_word", "dup_line_share", "repeated_window_share", "mean_word", "upper_share", "repeated_word_share",
    "words_per_line", "digit_share", "n_words",
)
_STATISTICS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    + ", ".join(f"{f} double" for f in FEATURES[:-1])
)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows that the text has twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    mark = np.zeros(len(words) + 1, np.int32)
    at = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    mark[: len(windows)] += at
    mark[width : width + len(windows)] -= at
    return int((np.cumsum(mark)[:-1] > 0).sum())


def statistics_of(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in text.split("\n") if _WORD.search(line.encode())]
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = len(_SYMBOL.findall(text))
    repeated = repeated_words(words)
    repeats = n - len(set(words))
    share = lambda a, b: a / b if b else 0.0
    return (
        n, chars, symbols, len(lines) - len(set(lines)), repeated,
        share(symbols, n), share(len(lines) - len(set(lines)), len(lines)), share(repeated, n), share(chars, n),
        share(sum(1 for a, b in zip(text, text.lower(), strict=False) if a != b), chars), share(repeats, n),
        share(n, len(lines)), share(sum(map(text.count, "0123456789")), chars),
    )


_NAMES = [part.split()[0] for part in _STATISTICS.split(", ")][1:]


def _measure(docs: DataFrame, carried: str) -> DataFrame:
    """Column `carried` of every row and the statistics of its `text`."""

    def work(batches: Batches) -> Iterator[dict]:
        for part in slices(batches):
            rows = [statistics_of(t) for t in part.column("text").to_pylist()]
            yield {carried: part.column(carried)} | {c: [r[i] for r in rows] for i, c in enumerate(_NAMES)}

    told = _parse_datatype_string(_STATISTICS)
    return by_arrow(docs, work, StructType([docs.schema[carried], *told.fields[1:]]))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and shares of every text."""
    return _measure(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def _grown(x: np.ndarray, bad: np.ndarray, least: int, longest: int) -> Rule:
    """Add the threshold of the largest gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < longest and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), inside.sum()
        best: tuple[float, Condition] | None = None
        for j, feature in enumerate(FEATURES):
            values = x[inside, j]
            order = np.argsort(values, kind="stable")
            v, hits = values[order], np.cumsum(bad[inside][order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            for above in (True, False):
                p = hits[-1] - hits[cut] if above else hits[cut]
                n = len(v) - cut - 1 if above else cut + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= least, p * (np.log2(p / n) - np.log2(p0 / n0)), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                    best = gain[k], Condition(feature, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = covers(rule, x)
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _sureness(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = covers(rule, x)
    return float((bad[hit].sum() + 1) / (hit.sum() + 2))


def learn(
    x: np.ndarray, bad: np.ndarray, *, precision: float = 0.9, least: int = 8, longest: int = 4, most_rules: int = 12
) -> list[Rule]:
    """The ordered rules for bad rows; the rows come in no order of their own."""
    held = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[~held].sum() >= least and len(x):
        rule = _grown(x[~held], bad[~held], least, longest)
        if not rule:
            break
        while len(rule) > 1 and _worth(rule[:-1], x[held], bad[held]) >= _worth(rule, x[held], bad[held]):
            rule = rule[:-1]
        if min(_sureness(rule, x[held], bad[held]), _sureness(rule, x[~held], bad[~held])) < precision:
            break
        rules.append(rule)
        left = ~covers(rule, x)
        x, bad, held = x[left], bad[left], held[left]
    return rules


def chosen(labels: DataFrame, most_rows: int) -> DataFrame:
    """(doc_id, bad) of the labelled rows to learn from; the bound lets them be
    broadcast and collected."""
    bad = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        (F.min("quality") == 0).alias("bad"))
    return F.broadcast(bad.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))


def fit(measured: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, **options) -> list[Rule]:
    """The rules for texts of quality 0, from a bounded number of labelled rows."""
    met = measured.join(chosen(labels, most_rows), "doc_id")
    # One row for each labelled id: of several texts the one of the least statistics.
    least = met.groupBy("doc_id", "bad").agg(F.min(F.struct(*FEATURES)).alias("least"))
    rows = least.select("doc_id", "bad", "least.*").collect()
    rows.sort(key=lambda r: (hash_of(r.doc_id), *r))
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows]).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r.bad for r in rows], bool), **options)


def hash_of(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 >> 17) & 0xFFFFFFFF


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), 0 if none does."""
    column = None
    for number, rule in enumerate(rules, 1):
        test = reduce(lambda a, b: a & b, (c.column() for c in rule))
        column = F.when(test, number) if column is None else column.when(test, number)
    return F.lit(0) if column is None else column.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The statistics of every row, base_failed, the rule that rejects it, and kept."""
    measured = materialise(statistics(docs), "statistics")
    rules = fit(measured, labels, **options)
    return (
        measured
        .withColumn("base_failed", base_failed())
        .withColumn("rule", decision(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def kept(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, **options) -> DataFrame:
    """The documents that the rules keep, in all their columns: one pass over the
    labelled texts to learn, one over all, and no shuffle of texts."""
    ids = chosen(labels, most_rows).select("doc_id")
    labelled = statistics(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    rules = fit(labelled, labels, most_rows=most_rows, **options)
    measured = _measure(docs.select(whole_rows(docs, "row"), "text"), "row")
    return measured.where(~base_failed() & (decision(rules) == 0)).select("row.*")
