"""URL filters: given rules first, else rules that FP-growth mines from labels.

A URL is a set of tokens: labels of its host and their parts, words of its path, keys
of its query. Labelled URLs are the transactions of Spark's FP-growth; of its rules
those that lead to `bad` with enough confidence and support stay, unless a rule on
fewer tokens is as sure. Enough is `confidence`, or where none is given 0.8 or `lift` times
the share of bad URLs, whichever is less; and the lower end of Wilson's interval, `z` wide,
must lie above that share, so that no rule is as good as none. Tokens that occur in exactly the same labelled URLs are mined
as one, so that a URL repeated many times cannot make all its subsets frequent.

Rules match by an inverted index: each rule is filed under its rarest token; a URL
looks up its tokens there and then compares the whole rule. URLs are made distinct
first, so that repeated ones are matched once; Spark broadcasts the index when it is
small by its own measure and splits hot tokens otherwise.

Null URLs and those without `://` have no host, no path and no tokens: no rule fits and
they are allowed. Very long URLs are taken whole. Equal rows give equal results; without labels nothing is mined. Other
columns of the pages are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The item that marks a bad transaction; no token has a blank.
_BAD = "is bad"

GivenRule = tuple[str, str, str]


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens, each with a letter for the place it was found in."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)

    def named(letter: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(letter + ":"), p))

    return F.array_distinct(F.concat(
        named("h", F.split(host(url), r"[.:@]")),
        named("w", F.split(host(url), r"[^a-z0-9]+")),
        named("p", F.split(F.translate(path(url), _UPPER, _LOWER), r"[^a-z0-9]+")),
        named("q", F.transform(F.split(query, "&"), lambda kv: F.split_part(kv, F.lit("="), F.lit(1)))),
    ))


def mine(
    labelled: DataFrame, *, confidence: float | None = None, lift: float = 1.5, z: float = 2.58,
    support: float = 0.001, least: int = 10
) -> DataFrame:
    """Rules (antecedent, confidence, n_urls) for rows (tokens, bad)."""
    rows = materialise(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    total, share = rows.agg(F.count("*"), F.coalesce(F.avg(F.col("bad").cast("int")), F.lit(0.0))).first()
    floor = min(0.8, lift * share) if confidence is None else confidence
    each = rows.select("row", F.explode("tokens").alias("token"))
    used = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("rows"))
    used = used.where(F.col("n") >= least)
    group = used.groupBy("n", "rows").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("same"))
    groups = materialise(group.select("item", "same"), "tokens")
    items = each.join(groups.select("item"), F.col("token") == F.col("item")).groupBy("row").agg(
        F.collect_list("item").alias("items"))
    bad = rows.join(items, "row", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")),
                 F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / max(total, 1))), minConfidence=floor).fit(bad)
    n, sure = F.col("support") * total / F.col("confidence"), F.col("confidence")
    low = (sure + z * z / (2 * n) - z * F.sqrt(sure * (1 - sure) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    led = model.associationRules.where((F.col("consequent") == F.array(F.lit(_BAD))) & (low > share))
    found = led.select(
        "antecedent", "confidence", F.round(F.col("support") * total).cast("bigint").alias("n_urls"))
    # An item stands for all tokens that were seen in the same URLs.
    whole = found.select(F.monotonically_increasing_id().alias("id"), "*").withColumn("item", F.explode("antecedent")).join(
        groups, "item").groupBy("id").agg(
        F.array_sort(F.flatten(F.collect_list("same"))).alias("antecedent"),
        F.first("confidence").alias("confidence"), F.first("n_urls").alias("n_urls"))
    return _general(materialise(whole.select("antecedent", "confidence", "n_urls").distinct(), "rules"))


def _general(rules: DataFrame) -> DataFrame:
    """The rules without those that a rule on part of their tokens makes needless."""
    filed = rules.select(F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("part"),
                         F.col("confidence").alias("sure"))
    needless = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(filed, "token").where(
        (F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence"))
        & (F.size(F.array_except("part", "antecedent")) == 0)).select("antecedent").distinct()
    return rules.join(needless, "antecedent", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule): URLs that a mined rule fits, each with its surest rule."""
    known = urls.select("url").where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    each = known.select("url", "tokens", F.explode("tokens").alias("token"))
    numbered = rules.withColumn("id", F.xxhash64(F.array_join("antecedent", " ")))
    by_token = numbered.select("id", F.explode("antecedent").alias("token"))
    rare = by_token.join(by_token.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("id").agg(
        F.min(F.struct("n", "token")).getField("token").alias("token"))
    index = materialise(numbered.join(rare, "id").select("token", "antecedent", "confidence"), "index")
    hits = each.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(
        F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("rule"))).getField("rule").alias("mined_rule"))


def given_verdict(rules: Sequence[GivenRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for outcome, of, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == of) | F.col("host").endswith("." + of)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, given: Sequence[GivenRule], mined: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_rule of every row."""
    rule, verdict = given_verdict(given)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    mined_verdict = F.when(F.col("mined_rule").isNull(), "allow").otherwise("block")
    return rows.join(matched(pages, mined), "url", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), "mined_rule")


def labelled_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of the pages whose path ends in the number of a labelled document;
    bad: of quality 0 or toxic."""
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(path(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    rows = pages.where("url is not null").select("url", F.when(number != "", number).cast("bigint").alias("doc_id"))
    return rows.join(bad.where("bad is not null"), "doc_id").select(tokens(F.col("url")).alias("tokens"), "bad")
