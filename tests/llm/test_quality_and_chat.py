import itertools
import random
import re
from collections import Counter

import numpy as np
from llm_cases import awkward, docs, empty, prose

from postlake.llm import chat_format, quality_rules


def brute(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    repeated = {j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


def labelled(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        own = prose(i, 80, 3000)
        rows.append((i, " ".join(w + "%%%" if bad and k % 2 else w for k, w in enumerate(own))))
        labels.append((i, 0 if bad else 1, 0))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_statistics_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in awkward(spark).collect()}
    texts |= {100: "a b c a b c d", 101: "x\n\nx\n y\ny", 102: "a a a a", 103: "#*$%&|<>é 東", 104: "a b a b a"}
    rows = quality_rules.statistics(docs(spark, list(texts.items()))).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_rules_find_what_was_planted(spark):
    table, labels = labelled(spark)
    rows = quality_rules.judged(table, labels).collect()
    assert {r.doc_id for r in rows if not r.kept} == {i for i in range(300) if i % 4 == 0}
    assert all(r.rule == 1 for r in rows if not r.kept)
    kept = quality_rules.kept(table, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in range(300) if i % 4} and kept.columns == table.columns


def test_pure_noise_gives_no_rule():
    rnd = np.random.default_rng(3)
    x = rnd.random((400, len(quality_rules.FEATURES)))
    assert quality_rules.learn(x, rnd.random(400) < 0.3) == []


def test_a_second_rule_is_learned_on_the_rest():
    rnd = np.random.default_rng(4)
    x = rnd.random((900, len(quality_rules.FEATURES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 2] > 0.7) & (x[:, 3] < 0.3))
    rules = quality_rules.learn(x, bad)
    hit = np.any([quality_rules.covers(r, x) for r in rules], axis=0)
    assert len(rules) >= 2 and (hit == bad).mean() > 0.97


def test_without_labels_only_base_limits_hold(spark):
    table, labels = labelled(spark, 20)
    rows = quality_rules.judged(table, labels.limit(0)).collect()
    assert all(r.kept and r.rule == 0 for r in rows)
    assert quality_rules.judged(empty(spark), labels).count() == 0
    rows = quality_rules.judged(awkward(spark), labels.selectExpr("doc_id", "cast(null as int) quality", "toxic")).collect()
    assert len(rows) == 11 and not any(r.kept for r in rows)


def cost_of(roles, states):
    total, state = 0.0, chat_format.START
    for role, to in zip(roles, states, strict=True):
        total, state = total + chat_format.step(state, to, role)[0], to
    return total + chat_format.ending(state)


def test_repair_is_cheapest_in_any_cut():
    rnd = random.Random(3)
    for _ in range(200):
        roles = [rnd.randrange(4) for _ in range(rnd.randrange(1, 7))]
        size = rnd.randrange(1, 4)
        cuts = [roles[i : i + size] for i in range(0, len(roles), size)]
        found, entry = [], chat_format.START
        for cut, leave in zip(cuts, chat_format.border_states(list(map(chat_format.matrix, cuts))), strict=True):
            found, entry = found + chat_format.solve(cut, entry, leave), leave
        least = min(cost_of(roles, s) for s in itertools.product((1, 2, 3), repeat=len(roles)))
        assert cost_of(roles, found) == least


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")


def conversation(rows, conv):
    return "".join(r.rendered for r in sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position))


def test_rendered_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT", 2)
    given = [
        (1, 0, "system", "be kind"), (1, 1, "Human", "hi"), (1, 2, "assistant", "hello"),
        (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", "c"),
        (3, 0, "assistant", "c"), (4, 0, "user", "<|end|>"), (None, 1, None, None), (5, None, "bot", ""),
        (6, 1, "user", "q"), (6, 1, "user", "q"), (6, 2, "assistant", "r"),
    ] + [(9, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(50)]
    rows = chat_format.repaired(turns(spark, given)).collect()
    assert len(rows) == len(given)
    assert conversation(rows, 1) == (
        "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n")
    assert conversation(rows, 2) == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n"
    assert conversation(rows, 3) == "<|user|>\n<|end|>\n<|assistant|>\nc<|end|>\n"
    assert conversation(rows, 4) == "<|user|>\n<\\|end|><|end|>\n<|assistant|>\n<|end|>\n"
    assert sum(r.cost for r in rows if r.conv_id == 9) == 0
    assert [r.position for r in sorted((r for r in rows if r.conv_id == 9), key=lambda r: r.turn)] == list(range(50))
    assert conversation(rows, 9) == "".join(
        f"<|{'user' if k % 2 == 0 else 'assistant'}|>\nt{k}<|end|>\n" for k in range(50))
    assert chat_format.repaired(turns(spark, given).limit(0)).count() == 0
