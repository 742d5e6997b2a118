"""The registered queries over the smallest tables, whole, against brute force."""

import hashlib
import html
import pathlib
import re

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from test_decontamination import brute as brute_hits
from test_dedup import brute_classes, brute_removed
from test_pages import given
from test_pii import PATTERNS, brute as brute_spans
from test_quality_and_chat import brute as brute_statistics, cost_of

from postlake.llm import byte_bpe, chat_format, quality_rules
from postlake.llm.common import table
from postlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables here")


LARGE = "/root/testdata/sf0.1"


def brute_failed(text):
    n_words, *_, repeated = brute_statistics(text)
    return n_words < 50 or 100 * repeated > 50 * n_words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}


def rows_of(spark, name):
    found = QUERIES[name](spark, FOLDER)
    return found.columns, found.collect()


def test_urls(spark):
    columns, rows = rows_of(spark, "op1_url_filters")
    urls = {r.page_id: r.url for r in table(spark, FOLDER, "pages").collect()}
    assert columns[:5] == ["page_id", "host", "path", "rule", "verdict"] and len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = given(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined_rule else "allow"))


def test_quality(spark, texts):
    _, rows = rows_of(spark, "op2_quality_rules")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        n_words, *rest, repeated = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, *rest, repeated)
        assert r.base_failed == brute_failed(texts[r.doc_id]) and not (r.kept and r.base_failed)


def test_quality_on_labels_it_has_not_seen(spark):
    """Learned on half of the labelled rows, judged on the other half."""
    docs, labels = (table(spark, LARGE, name) for name in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    learned = quality_rules.kept(docs, labels.where("doc_id % 2 = 0")).select("doc_id")
    kept = {r.doc_id for r in learned.collect()}
    new = [r for r in rows if r.doc_id % 2 and not brute_failed(r.text)]
    wrong = [r.doc_id for r in new if r.quality != (r.doc_id in kept)]
    assert len(new) > 1000 and len(wrong) < 0.01 * len(new)


def test_substrings(spark, texts):
    _, rows = rows_of(spark, "op3_substring_dedup")
    want = [(d, n, m, sha(kept)) for d, n, m, kept in brute_removed(list(texts.items()))]
    assert sorted(map(tuple, rows)) == want and any(m for _, _, m, _ in want)


def test_pages(spark):
    _, rows = rows_of(spark, "op4_html_extraction")
    pages = {r.page_id: r.html for r in table(spark, FOLDER, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        assert (r.text, r.n_chars) == (plain, len(plain))


def test_personal_data(spark, texts):
    columns, rows = rows_of(spark, "op5_pii")
    assert columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for r in rows:
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b, _ in spans))
        assert tuple(r[1:5]) == tuple(sum(s[1] == k for s in spans) for k in range(4))


def test_tokens(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, rows = rows_of(spark, "op6_token_counts")
    assert sorted(map(tuple, rows)) == sorted(
        (d, len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts.items())


def test_benchmarks(spark, texts):
    _, rows = rows_of(spark, "op7_decontamination")
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    want = [(d, n, len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
            for d, n, hit, found in brute_hits(list(texts.items()), items)]
    assert sorted(tuple(r)[:6] for r in rows) == want and any(c for *_, c in want)


def test_ids(spark, texts):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, rows = rows_of(spark, "op8_byte_bpe")
    assert sorted(map(tuple, rows)) == sorted(
        (d, len(ids := tik.encode_ordinary(t)), sha(",".join(map(str, ids))), sha(t)) for d, t in texts.items())


def test_near_copies(spark, texts):
    _, rows = rows_of(spark, "op9_jaccard_join")
    want = brute_classes(list(texts.items()))
    assert sorted(map(tuple, rows)) == want and any(d != c for d, _, c in want)


def test_conversations(spark):
    _, rows = rows_of(spark, "op10_chat_format")
    turns = table(spark, FOLDER, "conversations").collect()
    assert len(rows) == len(turns)
    by_conv = {}
    for t in sorted(turns, key=lambda t: (t.conv_id, t.turn)):
        by_conv.setdefault(t.conv_id, []).append(chat_format.role_of(t.role))
    for conv, roles in by_conv.items():
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        states = [chat_format.NAMES.index(r.repaired_role) for r in mine]
        assert sum(r.cost for r in mine) == cost_of(roles, states)
        headers = re.findall(r"<\|(system|user|assistant)\|>", "".join(r.rendered for r in mine))
        body = headers[headers[0] == "system" :]
        assert body == ["user", "assistant"] * (len(body) // 2)
