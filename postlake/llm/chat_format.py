"""Chat formatting with minimum-cost repair of roles.

A conversation is legal if it is an optional system turn, then user and assistant in
turn, ended by the assistant. For one that is not, a dynamic programme over the states
of that automaton chooses for each turn whether it keeps its role or is relabelled,
whether it merges with the turn before, and where empty turns are inserted, so that the
sum of costs is least; then every turn is rendered.

The programme is a product of small min-plus matrices, one for each turn, so a long
conversation is cut: rows are sorted by conversation and turn over all tasks, runs of
at most `SEGMENT` turns of one conversation are reduced to a matrix, the matrices of a
conversation give the states between its segments, and each segment is then solved
alone. No task holds a conversation. The result has one row for each turn; the pieces
of a conversation in order of `position` are its rendered text.

Turns are ordered by turn, role, then a hash of the text; nulls first. A null conv_id is
a conversation like others. Null or empty texts are empty turns. Roles are read without
case and blanks; names in `ROLES` are known, others (and null) fit any role at the cost
of a relabelling. Repeated rows are turns of their own; an empty table gives no rows;
other columns are not looked at. Text that looks like a marker is kept apart from real
ones by a backslash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise

from .common import Batches, by_arrow

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
         "assistant": ASSISTANT, "model": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT}
RELABEL, MERGE, INSERT = 2.0, 1.0, 1.5
SEGMENT = 2_000
_FAR = float("inf")
#: Turns to insert between two states; a pair that is not here is not legal.
_BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (ASSISTANT, USER): (),
}
#: What ends a conversation after its last turn.
_ENDING: dict[int, tuple[int, ...]] = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_of(name: str | None) -> int:
    """The state of a role, or START for one that is not known."""
    return ROLES.get((name or "").strip().lower(), START)


def step(state: int, to: int, role: int) -> tuple[float, str, tuple[int, ...]]:
    """Cost, action and insertions of taking a turn of `role` as `to` after `state`."""
    cost, action = (0.0, "keep") if to == role else (RELABEL, "relabel")
    if state == to:
        return cost + MERGE, "merge" if to == role else "relabel and merge", ()
    inserted = _BETWEEN.get((state, to))
    if inserted is None:
        return _FAR, "", ()
    return cost + INSERT * len(inserted), action, inserted


_STEPS = [[[step(s, t, r) for t in range(4)] for s in range(4)] for r in range(4)]


def ending(state: int) -> float:
    return INSERT * len(_ENDING[state]) if state in _ENDING else _FAR


def advance(costs: list[float], role: int) -> tuple[list[float], list[int]]:
    """Least costs after a turn for each state, and the states they come from."""
    after, origin = [_FAR] * 4, [START] * 4
    for to in (SYSTEM, USER, ASSISTANT):
        for state in range(4):
            cost = costs[state] + _STEPS[role][state][to][0]
            if cost < after[to]:
                after[to], origin[to] = cost, state
    return after, origin


def matrix(roles: list[int]) -> list[list[float]]:
    """Least cost from each state to each over the turns."""
    rows = []
    for begin in range(4):
        costs = [0.0 if s == begin else _FAR for s in range(4)]
        for role in roles:
            costs, _ = advance(costs, role)
        rows.append(costs)
    return rows


def solve(roles: list[int], entry: int, leave: int) -> list[int]:
    """States after each turn on a cheapest way from `entry` to `leave`."""
    costs = [0.0 if s == entry else _FAR for s in range(4)]
    origins = []
    for role in roles:
        costs, origin = advance(costs, role)
        origins.append(origin)
    states = [leave]
    for origin in reversed(origins[1:]):
        states.append(origin[states[-1]])
    return states[::-1]


def border_states(matrices: list[list[list[float]]]) -> list[int]:
    """States after each segment of a conversation on a cheapest legal way."""
    costs, origins = [0.0, _FAR, _FAR, _FAR], []
    for m in matrices:
        after = [min((costs[s] + m[s][t], s) for s in range(4)) for t in range(4)]
        costs, origins = [c for c, _ in after], [*origins, [s for _, s in after]]
    states = [min(range(4), key=lambda s: costs[s] + ending(s))]
    for origin in reversed(origins[1:]):
        states.append(origin[states[-1]])
    return states[::-1]


def render(to: int, text: str | None, merged: bool, inserted: tuple[int, ...], first: bool, last: bool) -> str:
    """The piece of a turn: what closes the one before, insertions, header and text."""
    piece = "" if first or merged else "<|end|>\n"
    piece += "".join(f"<|{NAMES[i]}|>\n<|end|>\n" for i in inserted)
    piece += "\n" if merged else f"<|{NAMES[to]}|>\n"
    piece += (text or "").replace("<|", "<\\|")
    if last:
        piece += "<|end|>\n" + "".join(f"<|{NAMES[i]}|>\n<|end|>\n" for i in _ENDING[to])
    return piece


_TURN = "conv_id bigint, turn bigint, role string, text string, part int, segment int, position int, matrix array<double>"


def _cut(turns: DataFrame) -> DataFrame:
    """Every turn with its segment (part, segment) and place in it; the last turn of a
    segment carries the segment's matrix."""
    rows = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("hash"))
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, "conv_id", "turn", "role", "hash").sortWithinPartitions(
        "conv_id", "turn", "role", "hash").withColumn("part", F.spark_partition_id())

    def work(batches: Batches) -> Iterator[dict]:
        segment, held, conv = -1, [], None
        begun = False

        def out() -> dict:
            columns = {c: [r[c] for r in held] for c in ("conv_id", "turn", "role", "text", "part")}
            flat = [c for row in matrix([role_of(r["role"]) for r in held]) for c in row]
            return columns | {"segment": [segment] * len(held), "position": list(range(len(held))),
                              "matrix": [None] * (len(held) - 1) + [flat]}

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv or len(held) >= SEGMENT:
                    if held:
                        yield out()
                    held, segment, conv, begun = [], segment + 1, row["conv_id"], True
                held.append(row)
        if held:
            yield out()

    return by_arrow(dealt.drop("hash"), work, _TURN)


_BORDER = "part int, segment int, entry int, leave int, first boolean, last boolean, before bigint"


def _borders(cut: DataFrame) -> DataFrame:
    """For each segment the states it begins and ends with, on a cheapest way."""
    segments = cut.where("matrix is not null").select(
        "conv_id", "part", "segment", F.col("position").alias("last_position"), "matrix")

    def work(batches: Batches) -> Iterator[dict]:
        held: list[dict] = []

        def out() -> dict:
            states = border_states([np.array(r["matrix"]).reshape(4, 4).tolist() for r in held])
            before = np.cumsum([0] + [r["last_position"] + 1 for r in held[:-1]])
            return {"part": [r["part"] for r in held], "segment": [r["segment"] for r in held],
                    "entry": [START, *states[:-1]], "leave": states, "first": [i == 0 for i in range(len(held))],
                    "last": [i == len(held) - 1 for i in range(len(held))], "before": before}

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["conv_id"] != row["conv_id"]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return by_arrow(dealt, work, _BORDER)


_REPAIRED = ("conv_id bigint, turn bigint, position bigint, role string, repaired_role string, action string, "
             "inserted array<string>, cost double, rendered string")


def repaired(turns: DataFrame) -> DataFrame:
    """Every turn with its place in the conversation, its repaired role, what was done
    and at what cost (the last turn bears that of the end), and its rendered piece."""
    cut = materialise(_cut(turns), "turns")
    borders = materialise(_borders(cut), "borders")

    def work(batches: Batches) -> Iterator[dict]:
        held: list[dict] = []

        def out() -> dict:
            names = [part.split()[0] for part in _REPAIRED.split(", ")]
            columns: dict[str, list] = {n: [] for n in names}
            head = held[0]
            roles = [role_of(r["role"]) for r in held]
            state = head["entry"]
            for i, (row, to) in enumerate(zip(held, solve(roles, state, head["leave"]), strict=True)):
                cost, action, inserted = _STEPS[roles[i]][state][to]
                last = head["last"] and i == len(held) - 1
                rendered = render(to, row["text"], state == to, inserted, head["first"] and i == 0, last)
                values = (row["conv_id"], row["turn"], head["before"] + i, row["role"], NAMES[to], action,
                          [NAMES[k] for k in (*inserted, *(_ENDING[to] if last else ()))],
                          cost + (ending(to) if last else 0.0), rendered)
                for name, value in zip(names, values, strict=True):
                    columns[name].append(value)
                state = to
            return columns

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[-1]["part"], held[-1]["segment"]) != (row["part"], row["segment"]):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    rows = cut.drop("matrix").join(borders, ["part", "segment"])
    dealt = rows.repartition("part", "segment").sortWithinPartitions("part", "segment", "position")
    return by_arrow(dealt, work, _REPAIRED)
