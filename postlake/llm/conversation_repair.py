"""Repair of the structure of conversations over a suffix-shared automaton.

A conversation is a word over a small alphabet: each turn is told by the initial of its
role and its fault. Turns are in order of turn (nulls first; then role and hash), and
the first fault of a turn counts: blank, duplicate (role and text seen earlier),
truncated (its last visible character ends no sentence). The repaired roles are to read
`(s?(ua)+)?`. Keeping a turn costs 0, changing its role to user or assistant 2, deleting
it 3 (blank and duplicate ones have to go), inserting an empty user or assistant turn 2;
a truncated turn that stays adds 1. Of the cheapest edits those of the ASCII-least audit
(initials of Keep, Rerole, Delete, Insert) are taken.

The edits that are left to do depend on the rest of the word and on the state of the
grammar alone. So distinct words are read from their end and sorted: words with a common
suffix follow each other and share the nodes of that suffix, a trie of reversed words of
which a task holds one path. Cost-to-go and first edit are worked out once per node and
state for all conversations; the edits of a state differ in their first letter, so the
least audit is found without comparing audits.

Rows are sorted by conversation twice, once without texts to spell the words and once to
apply the edits; both passes read a stream. A task holds one byte for each turn of one
conversation, and never the texts of one.

Null roles and texts are one space; a null conv_id is a conversation like others;
repeated rows are duplicates; roles of another initial fit nowhere and are changed or
deleted; long texts are read whole; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise

from .common import Batches, by_arrow, slices

START, SYSTEM, USER, ASSISTANT = range(4)
RENAME, REMOVE, ADD, CUT_SHORT = 2, 3, 2, 1
_FAR = 1 << 60
_INITIALS = "sua"
#: State after a turn of role s, u or a is kept.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: State after a turn is renamed or added; the state alone says which role that is.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: Letters of the words: a turn that has to go, and for each initial (the last is any
#: other) a sound turn and a truncated one.
GONE = "x"
_LETTER = {(i, cut): "suao"[i] if not cut else "SUAO"[i] for i in range(4) for cut in (False, True)}
_BLANKS = " \t\n\x0b\x0c\r"

Node = tuple[tuple[int, ...], str]


def _settled(options: list[dict[str, int]]) -> Node:
    """Costs and first edits of the four states, from what each costs without an
    insertion before; insertions may follow each other."""
    costs = [min(o.values(), default=_FAR) for o in options]
    for _ in range(2):
        costs = [min(c, ADD + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    edits = []
    for state, option in enumerate(options):
        option = {**option, "I": ADD + costs[_NEXT[state]]}
        edits.append(min(letter for letter, cost in option.items() if cost == costs[state]))
    return tuple(costs), "".join(edits)


#: The end of a word: nothing is left to do for an empty or a complete conversation.
#: A blank sorts before the letters of the edits and stands for no edit.
END: Node = _settled([{" ": 0}, {}, {}, {" ": 0}])


def node(letter: str, after: Node) -> Node:
    """The node of a turn before the suffix of node `after`."""
    costs = after[0]
    options = []
    for state in range(4):
        option = {"D": REMOVE + costs[state]}
        if letter != GONE:
            more = CUT_SHORT if letter.isupper() else 0
            kept = _KEPT[state].get(letter.lower())
            if kept is not None:
                option["K"] = more + costs[kept]
            option["R"] = RENAME + more + costs[_NEXT[state]]
        options.append(option)
    return _settled(options)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Automaton:
    """The path of one reversed word; what it shares with the next one stays."""

    def __init__(self) -> None:
        self._word, self._path = "", [END]
        self.nodes = 0

    def solve(self, reverse: str) -> tuple[int, str]:
        """Cost and audit of a word, given from its end."""
        del self._path[shared(self._word, reverse) + 1 :]
        for letter in reverse[len(self._path) - 1 :]:
            self._path.append(node(letter, self._path[-1]))
            self.nodes += 1
        self._word = reverse
        audit, state, at = [], START, len(reverse)
        while (edit := self._path[at][1][state]) != " ":
            audit.append(edit)
            if edit == "K":
                state = _KEPT[state][reverse[at - 1].lower()]
            elif edit != "D":
                state = _NEXT[state]
            at -= edit != "I"
        return self._path[-1][0][START], "".join(audit)


def solved(words: DataFrame) -> DataFrame:
    """word, cost and audit of each distinct word."""
    reverse = words.select("word").distinct().select(F.reverse("word").alias("reverse"))

    def work(batches: Batches) -> Iterator[dict]:
        automaton = Automaton()
        for batch in batches:
            own = batch.column("reverse").to_pylist()
            found = [automaton.solve(r) for r in own]
            yield {"word": [r[::-1] for r in own], "cost": [c for c, _ in found], "audit": [a for _, a in found]}

    dealt = reverse.repartitionByRange("reverse").sortWithinPartitions("reverse")
    return by_arrow(dealt, work, "word string, cost bigint, audit string")


def _told(rows: DataFrame) -> DataFrame:
    """The rows with role and text filled and two hashes of them; the hashes break ties."""
    filled = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return filled.withColumn("h", F.xxhash64("role", "text")).withColumn("g", F.xxhash64(F.lit(1), "role", "text"))


_ORDER = ("turn", "role", "h", "g")
_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def spelled(rows: DataFrame) -> DataFrame:
    """The word of each conversation and the counts of its faults."""
    told = _told(rows)
    seen = F.rtrim("text", F.lit(_BLANKS))
    narrow = told.select(
        "conv_id", *_ORDER, (seen == "").alias("empty"),
        (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.struct(F.col("turn").isNotNull().alias("has"), "turn").alias("at")).drop("text")
    first = narrow.groupBy("conv_id", "h", "g").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(
        "first <> last").select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "h", "g")), "first")
    flagged = narrow.join(
        first, narrow["conv_id"].eqNullSafe(first["_conv_id"]) & (narrow["h"] == first["_h"]) & (narrow["g"] == first["_g"]),
        "left").select("conv_id", *_ORDER, "empty", "cut", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("late"))
    dealt = flagged.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)

    def work(batches: Batches) -> Iterator[dict]:
        conversation: tuple | None = None
        counts, letters, turns, before = [0] * 5, bytearray(), [None, None, 0], None

        def told() -> tuple:
            low, high, different = turns
            return (*conversation, high - low + 1 - different if different else 0, *counts[1:], letters.decode())

        for batch in batches:
            done = []
            for conv, turn, role, h, g, empty, cut, late in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conversation != (conv,):
                    if conversation:
                        done.append(told())
                    conversation = (conv,)
                    counts, letters, turns, before = [0] * 5, bytearray(), [None, None, 0], None
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                initial = role[:1]
                if before is not None and before[0] + initial not in ("su", "ua", "au"):
                    counts[4] += 1
                # Equal rows of one turn follow each other.
                late = late or before == (initial, turn, h, g)
                before = (initial, turn, h, g)
                fault = 1 if empty else 2 if late else 3 if cut else 0
                counts[fault] += 1
                place = _INITIALS.find(initial) if initial else -1
                letters += (GONE if 0 < fault < 3 else _LETTER[place if place >= 0 else 3, fault == 3]).encode()
            if done:
                yield _columns(done)
        if conversation:
            yield _columns([told()])

    def _columns(done: list[tuple]) -> dict:
        names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "word")
        return dict(zip(names, map(list, zip(*done, strict=True)), strict=True))

    return by_arrow(dealt, work, f"conv_id bigint, {_COUNTS}, word string")


def audited(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of faults, cost and audit of each conversation."""
    words = materialise(spelled(rows), "words")
    return words.join(solved(words), "word").drop("word")


def replayed(turns: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit; those of a deleted turn are what it was."""
    state, rest = START, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "K":
            state = _KEPT[state][role[:1]]
        elif edit != "D":
            state = _NEXT[state]
            role = _NAME[state]
        yield edit, role, text


_HEAD = f"{_COUNTS}, cost bigint, audit string"


def _applied(rows: DataFrame, audits: DataFrame, report: Callable, schema: str) -> DataFrame:
    """`report` over the conversations of a task, each as its head and a stream of its
    (role, text); the head is a row that sorts before the turns."""
    names = [c.split()[0] for c in _HEAD.split(", ")]
    told = _told(rows).withColumn("head", F.lit(None).cast(f"struct<{_HEAD.replace(' ', ':').replace(',:', ',')}>"))
    heads = audits.select("conv_id", F.struct(*names).alias("head"))
    both = told.withColumn("kind", F.lit(1)).unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)

    def flat(batches: Batches) -> Iterator[tuple]:
        for part in slices(batches):
            yield from zip(*(part.column(c).to_pylist() for c in ("conv_id", "head", "role", "text")), strict=True)

    def work(batches: Batches) -> Iterator[dict]:
        rows = flat(batches)
        conv = head = None

        def turns() -> Iterator[tuple[str, str]]:
            """Those of the conversation, up to the next head."""
            nonlocal conv, head
            for conv, head, role, text in rows:
                if head is not None:
                    return
                yield role, text
            conv = head = None

        for _ in turns():
            pass
        while head is not None:
            now = conv, head
            own = turns()
            yield from report(*now, own)
            for _ in own:
                pass

    return by_arrow(dealt.select("conv_id", "head", "role", "text"), work, schema)


def repaired(rows: DataFrame, *, at_once: int = 256) -> DataFrame:
    """The repaired turns: conv_id, position (from 0), edit, role, text; deleted turns
    are named too, without a position."""

    def report(conv, head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[dict]:
        held: list[tuple] = []
        position = size = 0
        for edit, role, text in replayed(turns, head["audit"]):
            held.append((conv, None if edit == "D" else position, edit, role, text))
            position += edit != "D"
            size += len(text)
            if len(held) >= at_once or size >= 1 << 22:
                yield _turns(held)
                held, size = [], 0
        if held:
            yield _turns(held)

    def _turns(held: list[tuple]) -> dict:
        return dict(zip(("conv_id", "position", "edit", "role", "text"), map(list, zip(*held, strict=True)), strict=True))

    return _applied(rows, materialise(audited(rows), "audits"), report,
                    "conv_id bigint, position bigint, edit string, role string, text string")


def digested(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost, audit, and repaired_sha256 of the repaired
    turns as `role:text` lines, hashed as they pass."""

    def report(conv, head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[dict]:
        digest, separator = hashlib.sha256(), b""
        for edit, role, text in replayed(turns, head["audit"]):
            if edit != "D":
                digest.update(separator + role.encode() + b":" + text.encode())
                separator = b"\n"
        yield {"conv_id": pa.array([conv], pa.int64()), "repaired_sha256": [digest.hexdigest()],
               **{name: [value] for name, value in head.items()}}

    return _applied(rows, materialise(audited(rows), "audits"), report, f"conv_id bigint, {_HEAD}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults planted by a hash of conversation and turn, so that repairs can
    be measured: a twentieth each is dropped, emptied, loses its sentence ends, is said
    twice, or becomes the user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key) % 20
    filled = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = filled.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"))
    return changed.drop("time")
