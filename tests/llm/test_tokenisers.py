import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from llm_cases import awkward, empty

from postlake.llm import byte_bpe, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def strings(n):
    rnd = random.Random(5)
    pools = ("ab \n\t'sre1", "é²½ß\xa0\x85ɐ\u2028▁ ", "東京\U0001f600\u0301<s>|", "\x00\x1c\x1d zZ#$")
    for _ in range(n):
        yield "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(30)))


def test_lengths_equal_the_library(library):
    lengths = token_counts.Lengths(PIECES, {}, most=50)
    texts = list(strings(1500))
    assert [n for k in range(0, 1500, 10) for n in lengths.of(texts[k : k + 10])] == [len(library.encode(t)) for t in texts]


def test_counts_of_awkward_rows(spark, library):
    rows = token_counts.token_counts(awkward(spark), PIECES, limit=100, sample_rows=4, table_size=2).collect()
    texts = {r.doc_id: r.text or "" for r in awkward(spark).collect()}
    assert len(rows) == 11
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id])))
        assert r.over_limit == (r.n_tokens > 100)
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0


def test_whole_texts_where_parts_do_not_add_up(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "splittable", lambda path: False)
    rows = token_counts.token_counts(awkward(spark), PIECES).collect()
    texts = {r.doc_id: r.text or "" for r in awkward(spark).collect()}
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id])) for r in rows)


def test_ids_equal_the_rank_library(codec, tik):
    texts = list(strings(1500))
    assert codec.encode(texts) == [tik.encode_ordinary(t) for t in texts]
    assert all(codec.decode(i) == t.encode() for i, t in zip(codec.encode(texts), texts, strict=True))


def test_offsets_cover_the_text(codec):
    for text, (ids, spans) in zip(("hello wörld 東京", ""), codec.encode_with_offsets(["hello wörld 東京", ""]), strict=True):
        assert codec.decode(ids) == text.encode()
        assert [a for a, _ in spans] == sorted(a for a, _ in spans)
        assert {i for a, b in spans for i in range(a, b)} == set(range(len(text)))


def test_decoding_of_split_characters(spark, codec):
    ids = codec.encode(["\U0001f9ff"])[0]
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None)], "doc_id bigint, ids array<int>")
    found = {r.doc_id: r for r in byte_bpe.decode(cut, RANKS, public_tokenizers.PATTERN).collect()}
    assert found[1].text == "\U0001f9ff" and found[2].text == "\ufffd" and found[3].text == ""


def test_round_trip_of_awkward_rows(spark, tik):
    texts = {r.doc_id: r.text or "" for r in awkward(spark).collect()}
    rows = byte_bpe.round_trip(awkward(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 11
    for r in rows:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
