"""The stages over the smallest tables, each against the rows its predecessor kept."""

import hashlib
import pathlib

import public_tokenizers
import pytest
import tiktoken
from test_decontamination import brute as brute_hits
from test_dedup import brute_classes
from test_pii import brute as brute_spans

import __spark_entry__
import corpus_pipeline
from postlake.llm import byte_bpe, quality_rules
from postlake.llm.common import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def kept(spark):
    out, docs = [table(spark, FOLDER, "documents")], table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        out.append(docs)
    return [{r.doc_id: r for r in df.collect()} for df in out], [df.columns for df in out]


def test_columns(kept):
    assert all(columns == kept[1][0] for columns in kept[1][:-1])


def test_quality(spark, kept):
    judged = quality_rules.judged(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    assert set(kept[0][1]) == {r.doc_id for r in judged if r.kept} < set(kept[0][0])


def test_near_copies(kept):
    classes = brute_classes([(d, r.text) for d, r in kept[0][1].items()])
    assert set(kept[0][2]) == {d for d, _, c in classes if c == d}


def test_benchmarks(spark, kept):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    hits = brute_hits([(d, r.text) for d, r in kept[0][2].items()], items)
    assert set(kept[0][3]) == {d for d, _, hit, _ in hits if not hit}


def test_personal_data(kept):
    assert set(kept[0][4]) == set(kept[0][3])
    for doc, row in kept[0][4].items():
        before = kept[0][3][doc].text
        assert (row.text == before) == (not brute_spans(before)) and row.n_chars == len(row.text)


def test_ids(kept):
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=byte_bpe.read_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    for doc, row in kept[0][5].items():
        ids = tik.encode_ordinary(kept[0][4][doc].text)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_registration(spark, kept):
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()} == kept[0][5]
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
