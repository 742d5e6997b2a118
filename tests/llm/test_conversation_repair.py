"""Repair of conversations against a search over whole audits."""

import hashlib
import random
import re
import zlib

from llm_cases import CLASHING, LONG
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postlake.llm import conversation_repair as cr
from postlake.llm.queries import op12_conversation_repair

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def table(spark, rows, extra=(*CLASHING, "my col", "head", "kind")):
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
                         StructField("text", StringType()), *(StructField(c, StringType()) for c in extra)])
    return spark.createDataFrame([(*r, *("x",) * len(extra)) for r in rows], schema)


def faults(rows):
    seen, told = set(), []
    for role, text in rows:
        visible = VISIBLE.findall(text)
        if not visible:
            told.append("blank")
        elif (role, text) in seen:
            told.append("duplicate")
        else:
            told.append("truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return told


def cheapest(rows, told):
    """(cost, audit, lines) by extending all ways of editing, shortest first."""
    best = {}  # (turn, roles so far as a state) -> (cost, audit, lines)
    todo = {(0, ""): (0, "", ())}
    answer = None
    order = [(0, "")]
    # states: "", "s", "u", "a"; relax until nothing improves
    best = dict(todo)
    changed = True
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    while changed:
        changed = False
        for (at, state), (cost, audit, lines) in list(best.items()):
            options = []
            for name in ("user", "assistant"):
                if name[0] in moves[state] and len(audit) < 3 * len(rows) + 4:
                    options.append(((at, name[0]), (cost + 2, audit + "I", (*lines, name + ":"))))
            if at < len(rows):
                role, text = rows[at]
                options.append(((at + 1, state), (cost + 3, audit + "D", lines)))
                if told[at] not in ("blank", "duplicate"):
                    more = told[at] == "truncated"
                    if role[:1] and role[0] in moves[state]:
                        options.append(((at + 1, role[0]), (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                    for name in ("user", "assistant"):
                        if name[0] in moves[state]:
                            options.append(((at + 1, name[0]), (cost + 2 + more, audit + "R", (*lines, f"{name}:{text}"))))
            for key, value in options:
                if key not in best or value[:2] < best[key][:2]:
                    best[key] = value
                    changed = True
    ends = [best[len(rows), s] for s in ("", "a") if (len(rows), s) in best]
    return min(ends, key=lambda e: e[:2])


def expected(rows):
    """The digest row of one conversation's rows (turn, role, text) in order."""
    pairs = [(r if r is not None else " ", t if t is not None else " ") for _, r, t in rows]
    told = faults(pairs)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
    cost, audit, lines = cheapest(pairs, told)
    return (gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in df.collect()}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_every_short_word_is_solved_at_least_cost():
    automaton = cr.Automaton()
    letters = {"s": ("system", "a."), "u": ("user", "b."), "a": ("assistant", "c."), "o": ("tool", "d."),
               "S": ("system", "e"), "U": ("user", "f"), "A": ("assistant", "g"), "O": ("", "h"), "x": ("user", " ")}
    words = [""]
    for _ in range(3):
        words += [w + c for w in words for c in letters]
    words = sorted({w[::-1] for w in words})
    for reverse in words:
        rows = [(letters[c][0], letters[c][1] if c == "x" else f"{i}{letters[c][1]}") for i, c in enumerate(reverse[::-1])]
        cost, audit, _ = cheapest(rows, faults(rows))
        assert automaton.solve(reverse) == (cost, audit), reverse
    # One node for each distinct suffix, whatever the number of words.
    assert automaton.nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_random_conversations(spark):
    rnd = random.Random(4)
    rows = []
    for conv in range(60):
        for _ in range(rnd.randrange(1, 9)):
            rows.append((conv, rnd.choice([0, 1, 2, 3, 4, 5, 9, None]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool"]),
                         rnd.choice(["Hi.", "Yes!", "no end", " ", "", "Why? \n", "A.B"])))
    # Ties of a turn are in order of role and hash; tell them apart by keeping one of each turn.
    rows = list({(r[0], r[1]): r for r in rows}.values())
    got = found(cr.digested(table(spark, rows)))
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    assert got == {conv: expected(order(own)) for conv, own in by.items()}


def test_repeats_of_a_row_are_duplicates(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 1, "assistant", "b."), (1, 5, "user", "a."),
            (2, None, "user", "q."), (2, None, "user", "q."), (None, None, "user", None), (None, 3, None, "x")]
    got = found(cr.digested(table(spark, rows)))
    assert got[1] == expected([r[1:] for r in rows[:4]])
    assert got[1][:3] == (3, 0, 2)
    assert got[2] == expected([r[1:] for r in rows[4:6]])
    assert got[None] == expected([r[1:] for r in rows[6:]])


def test_repaired_turns_are_legal(spark):
    rows = [(1, 0, "assistant", LONG), (1, 1, "user", "b?"), (1, 2, "user", "b?"), (2, 0, "system", "s."), (3, 0, "user", "")]
    got = cr.repaired(table(spark, rows), at_once=2).orderBy("conv_id", "position").collect()
    for conv in (1, 2, 3):
        own = [r for r in got if r.conv_id == conv and r.position is not None]
        assert LEGAL.match("".join(r.role[0] for r in own))
        assert [r.position for r in own] == list(range(len(own)))
    digests = found(cr.digested(table(spark, rows)))
    for conv, told in digests.items():
        lines = "\n".join(f"{r.role}:{r.text}" for r in got if r.conv_id == conv and r.position is not None)
        assert told[-1] == hashlib.sha256(lines.encode()).hexdigest()


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(5_000)] + [(1, 7_000, "user", "last")]
    told = found(cr.digested(table(spark, rows)))[1]
    assert told[:6] == (2_000 - 0, 0, 0, 1, 0, 3) and told[6] == "K" * 5_000 + "D"


def test_empty(spark):
    assert cr.digested(table(spark, [])).collect() == []
    assert cr.repaired(table(spark, [])).collect() == []


def damage(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if h == 3 else 1)
    return out


def test_registered_query(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    by = {}
    for r in given:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {conv: expected(damage(conv, order(rows))) for conv, rows in by.items()}
    assert found(op12_conversation_repair(spark, "/root/testdata/sf0.001")) == want


def test_conversation_without_rows_after_damage(spark, tmp_path):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table(spark, [(conv, 0, "user", "a."), (None, None, None, None)], extra=()).write.parquet(str(tmp_path / "conversations.parquet"))
    got = found(op12_conversation_repair(spark, str(tmp_path)))
    assert got[conv] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None] == expected(damage(None, [(None, None, None)]))
