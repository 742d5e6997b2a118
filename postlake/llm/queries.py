"""The operators as registered queries: thin digests of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    chat_format,
    conversation_repair,
    decontamination,
    html_extraction,
    jaccard_join,
    lattice_hash,
    pii,
    quality_rules,
    spelling_groups,
    substring_dedup,
    token_counts,
    url_filters,
)
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Verdict, host and path of the given rules.
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = url_filters.mine(url_filters.labelled_by_number(pages, table(spark, sf_dir, "labels")))
    return url_filters.judged(pages, URL_RULES, mined)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "rule")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, pii.KINDS))

    def told(column: str):
        return F.transform(column, lambda s: F.struct(s["start"], s["kind"], F.concat_ws(
            ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]).alias("told")))

    def joined(rows):
        return F.array_join(F.transform(F.array_sort(rows), lambda s: s["told"]), ",")

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])),
        F.sha2(joined(told("spans")), 256).alias("base_sha256"),
        joined(F.concat(told("spans"), told("terms"))).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
        "starts", "ends",
    )


def encoded(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repaired(table(spark, sf_dir, "conversations"))


def op11_lattice_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_hash.classes(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.digested(conversation_repair.damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.grouped(spelling_groups.vocabulary(table(spark, sf_dir, "documents"), slips=199))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_quality_rules, op3_substring_dedup, op4_html_extraction, op5_pii, op6_token_counts,
    op7_decontamination, op8_byte_bpe, op9_jaccard_join, op10_chat_format, op11_lattice_hash,
    op12_conversation_repair, op13_spelling_groups,
)}
#: None of the operators can be said in SQL: they learn, hash or tokenise.
ORACLES: dict[str, str] = {}
