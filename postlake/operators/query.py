"""The search box: what a user types, as groups of phrases.

A box holds words, "quoted phrases", a trailing * for a prefix and the words
AND, OR, NOT in any case. Neighbours must all match; that binds tighter than
NOT, NOT tighter than AND, AND tighter than OR.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("AND", "OR", "NOT")
# Characters of a box that mean nothing in themselves.
_BLANKED = dict.fromkeys(map(ord, '":^*(){}[]'), " ")
_SCAN = re.compile(r'"(?P<quoted>[^"]*)"|(?P<plain>\S+?)(?P<star>\*?)(?=\s|\Z)')


@dataclass(frozen=True)
class Phrase:
    """Adjacent terms of one field; the last may be a prefix. No terms: the text
    had no letter or digit, and the phrase matches nothing."""

    terms: tuple[str, ...]
    prefix: bool = False


def fold_term(text: str) -> str:
    """A query term the way the index stores it."""
    parts = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in parts if not unicodedata.category(c).startswith("M"))


def _phrase(text: str, prefix: bool) -> Phrase:
    folded = fold_term(text)
    words = "".join(
        c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " "
        for c in folded
    ).split(" ")
    return Phrase(tuple(w for w in words if w), prefix)


def _scanned(text: str) -> Iterator[tuple[str, bool, bool]]:
    """What a box holds, one after the other: words, whether quoted, whether a prefix."""
    for found in _SCAN.finditer(text):
        quoted = found["quoted"] is not None
        words = (found["quoted"] if quoted else found["plain"]).translate(_BLANKED).strip()
        if words:
            yield words, quoted, bool(found["star"])


def read_box(text: str | None) -> list[Phrase | str]:
    """Phrases and operator names in the order typed; empty means: browse."""
    return [
        words.upper() if not quoted and words.upper() in OPERATORS else _phrase(words, prefix)
        for words, quoted, prefix in _scanned(text or "")
    ]


def _split(parts: list, operator: str) -> list[list]:
    groups: list[list] = [[]]
    for part in parts:
        if part == operator:
            groups.append([])
        else:
            groups[-1].append(part)
    if len(groups) > 1 and not all(groups):
        raise ValueError(f"{operator} needs something on both sides")
    return groups


@dataclass(frozen=True)
class Box:
    """A typed query: its phrases, and OR of AND of NOT of groups of them, each
    group a tuple of phrase numbers that must all match."""

    phrases: tuple[Phrase, ...]
    tree: tuple

    @classmethod
    def read(cls, text: str | None) -> Box | None:
        parts = read_box(text)
        if not parts:
            return None
        numbered: list[Phrase] = []

        def group(words: list) -> tuple[int, ...]:
            # Among neighbours a phrase without terms is ignored.
            useful = [w for w in words if w.terms]
            first = len(numbered)
            numbered.extend(useful)
            return tuple(range(first, len(numbered)))

        tree = tuple(
            tuple(
                tuple(group(words) for words in _split(side, "NOT"))
                for side in _split(branch, "AND")
            )
            for branch in _split(parts, "OR")
        )
        return cls(tuple(numbered), tree)

    @property
    def can_match(self) -> bool:
        """Whether some branch has terms on every side that must match."""
        return any(all(first for first, *_ in branch) for branch in self.tree)

    def evaluate(self, hits: list[Column]) -> tuple[Column, list[Column]]:
        """Whether a document matches, and per phrase whether it counts for the
        score: only phrases of a satisfied branch do."""
        false = F.lit(False)
        counts = [false] * len(self.phrases)

        def group_met(numbers: tuple[int, ...]) -> Column:
            return reduce(lambda a, b: a & b, [hits[i] > 0 for i in numbers]) if numbers else false

        branches = []
        for branch in self.tree:
            sides = []
            for first, *excluded in branch:
                met = reduce(lambda a, g: a & ~group_met(g), excluded, group_met(first))
                sides.append((met, first))
            whole = reduce(lambda a, b: a & b, [met for met, _ in sides])
            for _, numbers in sides:
                for i in numbers:
                    counts[i] = whole
            branches.append(whole)
        return reduce(lambda a, b: a | b, branches), counts
