"""Main text of pages: the content region is a maximum-scoring subsequence.

A page is a sequence of words and tags. From labelled pages (those in which one
`<article>` holds the text), at most `most_pages` of them, each kind of token gets the
logarithm of how much likelier it is inside the content than outside: words in its
blocks come out positive, tags of menus, adverts and page frames negative. One linear scan per page
finds the contiguous run of the largest sum; words of elements that never belong to an
article (forms, asides, menus, ...) are left out of it.

A tag counts by its name, each of its class names and its id; the least worth of them
holds. A page is read once from begin to end, whatever its markup: a tag ends at its `>`,
a quoted value at its closing quote, unless a tag begins and a `>` comes before that (the
quote is then taken as open, and the `>` ends the tag); what no `>` follows is text. A
paragraph, list entry, table row or cell is closed by the next one of its kind.

Character references are decoded, white space inside a block becomes one space, blocks
(and line breaks) are joined by one space; inline tags do not part words.

Null and empty pages give an empty text, as do pages without a word of positive worth;
broken markup is read as far as it goes; every row gives one row. Without labelled
pages `DEFAULT_WEIGHTS` hold. Other columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, by_arrow, slices

_RAW = frozenset("script style noscript template textarea title".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
#: A tag without `<` or `>` in its values; an attempt ends at the next of them.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^<>"]*"|'[^<>']*')*)>""")
_NAME = re.compile("/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags that stand inside a line of text.
_INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr"
    .split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are no part of an article wherever they stand.
_FRAME = frozenset("nav aside footer form button select dialog menu iframe svg".split())
#: Elements that the next one of these names closes.
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
              "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_FRAME_CLASS = re.compile(r"^(ad|ads|advert|adverts|banner|sidebar|comment|comments|notice|cookie|menu|nav|share|promo)$", re.I)
WORD = "word"
DEFAULT_WEIGHTS: dict[str, float] = {WORD: 0.5, "p": -0.1, "/p": -0.1, "br": -0.1, "b": -0.2, "/b": -0.2}
#: Worth of a tag that was never seen in content, without better knowledge.
_UNSEEN = -10.0


class _Next:
    """Where each of a few characters comes next; positions asked for only grow, so a
    page is searched once for each of them."""

    def __init__(self, page: str):
        self._page, self._at = page, dict.fromkeys("<>\"'", -1)

    def __call__(self, sign: str, start: int) -> int:
        if self._at[sign] < start:
            found = self._page.find(sign, start)
            self._at[sign] = found if found >= 0 else len(self._page)
        return self._at[sign]


def _tag_end(page: str, after: _Next, at: int) -> int:
    """Where the `>` of a tag is that is read up to `at`; the page's length if nowhere."""
    while True:
        end = after(">", at)
        quote = min(after('"', at), after("'", at))
        if quote >= end:
            return end
        closing = after(page[quote], quote + 1)
        end = after(">", quote + 1)
        if closing > end and (closing == len(page) or after("<", quote + 1) < closing):
            return end
        at = closing + 1


@lru_cache(4_096)
def _symbols(name: str, rest: str) -> tuple[str, ...]:
    """The tag's name with each of its class names and its id, or alone."""
    found = []
    for attribute in _ATTRIBUTE.finditer(rest) if "=" in rest else ():
        value = (attribute[2] or attribute[3] or attribute[4] or "").lower()
        found += [f"{name}.{c}" for c in value.split()] if attribute[1].lower() == "class" else [f"{name}#{value.strip()}"]
    return tuple(found) or (name,)


def tokens(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """(kind, symbols, text): "word" with its text, "tag" and "end" with their symbols and
    name, "gap" where white space or a block parts words."""
    after, at = _Next(page), 0
    while at < len(page):
        if page[at] == "<":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            plain = _PLAIN.match(page, at)
            named = plain or _NAME.match(page, at + 1)
            if named:
                end = plain.end() - 1 if plain else _tag_end(page, after, named.end())
                if end < len(page):
                    name = (plain[2] if plain else named[1]).lower()
                    if page[at + 1] == "/":
                        yield "end", ("/" + name,), name
                    elif name in _RAW:
                        closing = _RAW_END[name].search(page, end + 1)
                        at = closing.end() if closing else len(page)
                        continue
                    else:
                        yield "tag", _symbols(name, plain[3] if plain else page[named.end() : end]), name
                    if name not in _INLINE:
                        yield "gap", (), ""
                    at = end + 1
                    continue
            elif page[at + 1 : at + 2] in ("/", "!", "?") and after(">", at + 2) < len(page):
                at = after(">", at + 2) + 1
                continue
        end = at + 1 if page[at] == "<" else after("<", at)
        text = html.unescape(page[at:end])
        at = end
        if text[:1].isspace():
            yield "gap", (), ""
        words = text.split()
        for i, word in enumerate(words):
            if i:
                yield "gap", (), ""
            yield "word", (), word
        if words and text[-1:].isspace():
            yield "gap", (), ""


def walk(page: str) -> Iterator[tuple[tuple[str, ...], str, bool, bool, bool]]:
    """(symbols, word or "", a gap stands before, in a frame, in the article) of each
    token; the symbols of a word name the block that it stands in."""
    stack: list[str] = []
    open_: Counter[str] = Counter()
    blocks: list[tuple[str, tuple[str, ...]]] = [("", ("",))]  # name, and the symbols of words in it
    depth = 0  # of the outermost open frame in the stack, from 1
    gap = False

    def close(name: str) -> None:
        nonlocal depth
        while True:
            closed = stack.pop()
            open_[closed] -= 1
            if closed not in _INLINE:
                blocks.pop()
            if closed == name:
                break
        if len(stack) < depth:
            depth = 0

    for kind, symbols, text in tokens(page):
        if kind == "gap":
            gap = True
            continue
        article = open_["article"] > 0
        if kind == "word":
            yield blocks[-1][1], text, gap, depth > 0, article
            gap = False
            continue
        if kind == "end":
            yield symbols, "", gap, depth > 0, article and text != "article"
            if open_[text] > 0:
                close(text)
            continue
        if text in _CLOSED_BY.get(blocks[-1][0], ()):
            close(blocks[-1][0])
        if text not in _VOID:
            stack.append(text)
            open_[text] += 1
            if text not in _INLINE:
                blocks.append((text, tuple(f"{WORD} in {s}" for s in symbols)))
            if not depth and (text in _FRAME or any(_FRAME_CLASS.match(s[len(text) + 1 :]) for s in symbols)):
                depth = len(stack)
        yield symbols, "", gap, depth > 0, article


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """Begin and end of the run with the largest positive sum, the first of equals."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    low = np.minimum.accumulate(sums[:-1])
    gains = sums[1:] - low
    end = int(np.argmax(gains))
    if gains[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(sums[: end + 1] == low[end])[-1]), end + 1


def score(symbols: tuple[str, ...], word: str, weights: dict[str, float], unseen: float) -> float:
    """The least worth of those symbols that were seen. A word in a block that was never
    seen counts as any word, a tag as without class."""
    known = [weights[s] for s in symbols if s in weights]
    if known:
        return min(known)
    return weights.get(WORD, 0.0) if word else weights.get(re.split("[.#]", symbols[0], maxsplit=1)[0], unseen)


def main_text(page: str | None, weights: dict[str, float], unseen: float = _UNSEEN) -> str:
    rows = list(walk(page or ""))
    known: dict[tuple[tuple[str, ...], bool], float] = {}
    scores = np.empty(len(rows))
    for i, (symbols, word, *_) in enumerate(rows):
        key = symbols, bool(word)
        if key not in known:
            known[key] = score(symbols, word, weights, unseen)
        scores[i] = known[key]
    start, end = best_run(scores)
    pieces: list[str] = []
    gap = False
    for _, word, parted, framed, _ in rows[start:end]:
        gap = gap or parted
        if word and not framed:
            if gap and pieces:
                pieces.append(" ")
            pieces.append(word)
            gap = False
    return "".join(pieces)


def fit(pages: DataFrame, *, most_pages: int = 2_000) -> tuple[dict[str, float], float]:
    """Weights of tokens, and of tags never seen, from a bounded number of pages."""
    labelled = pages.where(F.regexp_count("html", F.lit("(?i)<article[ >]")) == 1)
    chosen = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most_pages)

    def work(batches: Batches) -> Iterator[dict]:
        counts: Counter[tuple[str, bool]] = Counter()
        for part in slices(batches):
            for page in part.column("text").to_pylist():
                for symbols, word, _, _, inside in walk(page or ""):
                    for symbol in symbols:
                        counts[symbol, inside] += 1
                    if word:
                        counts[WORD, inside] += 1
        yield {"symbol": [s for s, _ in counts], "inside": [i for _, i in counts], "n": list(counts.values())}

    sample = pages.join(F.broadcast(chosen), "page_id", "left_semi").select(F.col("html").alias("text"))
    counted = by_arrow(sample, work, "symbol string, inside boolean, n bigint")
    rows = counted.groupBy("symbol", "inside").agg(F.sum("n").alias("n")).collect()
    inside = {r.symbol: r.n for r in rows if r.inside}
    outside = {r.symbol: r.n for r in rows if not r.inside}
    total_in, total_out = sum(inside.values()), sum(outside.values())
    if not total_in or not total_out:
        return DEFAULT_WEIGHTS, _UNSEEN

    def weight(symbol: str) -> float:
        return math.log((inside.get(symbol, 0) + 0.01) / (total_in + 1)) - math.log((outside.get(symbol, 0) + 0.01) / (total_out + 1))

    weights = {s: weight(s) for s in {*inside, *outside}}
    # A tag never pays for itself.
    weights = {s: w if s == WORD or s.startswith(WORD + " ") else min(w, -0.01) for s, w in weights.items()}
    return weights, min([_UNSEEN, *weights.values()])


def extracted(pages: DataFrame, *, most_pages: int = 2_000) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    weights, unseen = fit(pages, most_pages=most_pages)

    def work(batches: Batches) -> Iterator[dict]:
        for part in slices(batches):
            texts = [main_text(p, weights, unseen) for p in part.column("text").to_pylist()]
            yield {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts,
                   "n_chars": [len(t) for t in texts]}

    rows = pages.select("page_id", "url", F.col("html").alias("text"))
    return by_arrow(rows, work, "page_id bigint, url string, text string, n_chars bigint")
