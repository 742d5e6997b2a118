"""Personal data: patterns, and terms of the corpus that give protected entities away.

Pattern spans: e-mail and IP addresses, card and phone numbers. Each distinct value is
a protected entity e. The words of the texts that hold it are compared with the whole
corpus: PMI(t; e) = log2(p(t | e) / p(t)), where p(t | e) is the share of the texts with e
that hold t outside of spans, and p(t) the share of all texts. IC(e) = -log2 p(e) is all
there is to know about e. A term whose PMI reaches `generalise` times IC(e) discloses e,
if it does not meet e by chance: were the n texts of e drawn from the corpus, that k of
them hold t has a chance of at most exp(-n KL(k/n || p(t))), and this times the number of
terms of these texts, text by text, must stay within `chance`. So an entity of one text has terms if the
corpus is large beside the text. In all texts of e every place of such a term becomes a
class word; from `remove` times IC(e) on it is removed. Texts are counted once, however
many copies there are.

Only DataFrame functions: no Python runs in tasks. Entities that stand in the same texts
have the same counts and are counted as one, and so are terms; terms too common to
disclose an entity do not meet it, so a long list of addresses is not paired with all its
words. Words are placed in time linear in the text, but cutting out its spans takes spans
times length. Distinct texts are found by a hash;
terms meet the texts by a broadcast if there are at most `most_broadcast` of them, and not
more than 8 MB.

Null texts count as empty and have no spans; very long ones are taken whole; rows are told apart by doc_id and a hash of
the text, so repeated rows get equal results; an empty table gives no rows; other
columns are kept by `sanitised` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive where nothing that follows could use what is given back; a match may only
#: begin inside a run of its characters where the last one ended.
_EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"[\p{L}\p{N}]+"
#: Stands for the characters of spans; of no text, where it is a blank.
_FILLER = "\ue000"
#: Numbers that are combined at one time.
_CHUNK = 256
#: Bytes of terms that are broadcast at most.
_MOST_BYTES = 8 << 20
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine) -> Column:
    """For each place of an array of numbers what `combine` makes of all up to it, from 0
    on. An array is copied for each of its numbers, so the numbers are taken in chunks."""
    numbers = F.array().cast("array<int>")

    def of_chunk(done: Column, chunk: Column) -> Column:
        within = F.aggregate(chunk, numbers, lambda some, v: F.concat(
            some, F.array(combine(F.coalesce(F.get(some, F.size(some) - 1), done["at"]), v))))
        return _bound(within, lambda some: F.struct(
            F.coalesce(F.get(some, F.size(some) - 1), done["at"]).alias("at"),
            F.concat(done["chunks"], F.array(some)).alias("chunks")))

    def whole(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(_CHUNK))
        return F.transform(starts, lambda at: F.slice(all_, at, F.lit(_CHUNK)))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("chunks"))
    return F.aggregate(_bound(values, whole), none, of_chunk, lambda done: F.flatten(done["chunks"]))


def located(text: Column, pattern: str | Column) -> Column:
    """(start, end, value) of each match in order, in code points."""
    pattern = F.lit(pattern)

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        ends = _running(F.zip_with(gaps, hits, lambda g, h: g + F.coalesce(F.length(h), F.lit(0))), lambda a, b: a + b)
        return F.filter(F.zip_with(hits, ends, lambda h, end: F.struct(
            (end - F.length(h)).alias("start"), end.alias("end"), h.alias("value"))), lambda s: s["value"].isNotNull())

    return _bound(F.regexp_extract_all(text, pattern, F.lit(0)), placed).cast(_SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check: every second from the right doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def pattern_spans(text: Column) -> Column:
    """Spans (kind, start, end, value) of all patterns, by start, then kind."""
    rules = (
        (F.contains(text, F.lit("@")), _EMAIL, lambda v: F.lit(True)),
        (text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), _IP, lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        (text.rlike("[0-9][\\x20-]?[0-9]"), _CARD,
         lambda v: F.length(_digits(v)).between(14, 19) & luhn(_digits(v))),
        (text.rlike(r"\+[0-9]"), _PHONE, lambda v: F.length(_digits(v)).between(10, 15)),
    )

    def checked(order: int, maybe: Column, pattern: str, holds) -> Column:
        found = F.when(maybe, located(text, pattern)).otherwise(F.array().cast(_SPAN))
        return F.transform(F.filter(found, lambda s: holds(s["value"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    spans = [checked(order, *rule) for order, rule in enumerate(rules)]
    return F.array_sort(F.concat(*spans))


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def base(docs: DataFrame) -> DataFrame:
    """key, doc_id, a hash of the text and the pattern spans of every row, and the text
    where there are any."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(_row_key(docs).alias("key"), "doc_id", F.xxhash64(text).alias("body"),
                       text.alias("text"), pattern_spans(text).alias("spans"))
    return rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))


def _terms(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    return F.array_distinct(F.transform(words, F.lower))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each character of its spans replaced by one that nothing else is."""
    def cut(plain: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return _bound(reach, lambda ends: F.array_join(F.concat(
            F.zip_with(spans, F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1)), lambda s, done: F.concat(
                plain.substr(done + 1, F.greatest(s["start"] - done, F.lit(0))),
                F.repeat(F.lit(_FILLER), F.greatest(s["end"] - F.greatest(s["start"], done), F.lit(0))))),
            F.array(plain.substr(F.get(ends, F.size(ends) - 1) + 1, F.length(plain)))), ""))

    return _bound(F.translate(text, _FILLER, " "), cut)


def _free(held: DataFrame) -> Column:
    """Places of the words that overlap no span, for texts with spans."""
    words = _bound(_masked(held["text"], held["spans"]), lambda t: located(t, rf"[\p{{L}}\p{{N}}{_FILLER}]+"))
    return F.filter(words, lambda w: ~F.contains(w["value"], F.lit(_FILLER)))


def _groups(held: DataFrame) -> DataFrame:
    """body, group, n_texts: entities of the same texts are one group."""
    pairs = held.select("body", F.explode(F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"])))).alias("entity"))
    sets = pairs.groupBy("entity").agg(
        F.count("*").alias("n_texts"), F.bit_xor("body").alias("x"), F.bit_xor(F.xxhash64("body")).alias("y"))
    leaders = sets.groupBy("n_texts", "x", "y").agg(F.min("entity").alias("entity"))
    return pairs.join(leaders, "entity").select("body", F.xxhash64("n_texts", "x", "y").alias("group"), "n_texts")


def _classes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term, class: terms of the same texts with entities, as common in the
    corpus, are one class, for their counts with every entity are the same."""
    sets = terms.groupBy("term").agg(
        F.count("*").alias("n_held"), F.bit_xor("body").alias("x"), F.bit_xor(F.xxhash64("body")).alias("y"))
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), "text").dropDuplicates(["body"])
    # Words are counted before they meet the terms: a row for each word, not each place.
    counted = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    return sets.join(counted, "term").select("term", "n_term", F.xxhash64("n_held", "x", "y", "n_term").alias("class"))


def disclosing(
    docs: DataFrame, found: DataFrame, held: DataFrame, generalise: float, chance: float
) -> DataFrame:
    """(body, term, disclosure): the most that a term of a text tells of one of its
    entities, PMI as a share of IC, where it reaches `generalise` and is no chance."""
    groups = materialise(_groups(held), "pii-groups")
    terms = materialise(held.select("body", F.explode(F.array_distinct(F.transform(
        _free(held), lambda w: F.lower(w["value"])))).alias("term")), "pii-terms")
    known = materialise(_classes(docs, terms), "pii-known")
    n = F.lit(float(max(found.select("body").distinct().count(), 1)))
    tried = groups.join(terms.groupBy("body").agg(F.count("*").alias("n_tried")), "body").groupBy("group").agg(
        F.sum("n_tried").alias("n_tried"))

    # PMI <= -log2 p(t) and IC = -log2 p(e): a term more common than this cannot reach
    # `generalise`. What no entity of a text can use does not meet them.
    def usable(n_texts: Column) -> Column:
        return F.col("n_term") <= n * F.pow(n_texts / n, F.lit(generalise)) * (1 + 1e-9)

    one = known.groupBy("class", "n_term").agg(F.min("term").alias("term"))
    most = groups.groupBy("body").agg(F.max("n_texts").alias("most"))
    rare = terms.join(one, "term").join(most, "body").where(usable(F.col("most"))).select("body", "class", "n_term")
    joint = rare.join(groups, "body").where(usable(F.col("n_texts"))).groupBy(
        "group", "n_texts", "class", "n_term").agg(F.count("*").alias("n_joint"))
    share, common = F.col("n_joint") / F.col("n_texts"), F.col("n_term") / n
    content = -F.log2(F.col("n_texts") / n)
    apart = share * F.ln(share / common) + F.when(
        share < 1, (1 - share) * F.ln((1 - share) / (1 - common))).otherwise(F.lit(0.0))
    rules = (
        joint.where(common < share).join(tried, "group")
        .where(F.col("n_texts") * apart >= F.ln(F.col("n_tried") / F.lit(chance)))
        .select("group", "class", F.when(content > 0, F.log2(share / common) / content).otherwise(F.lit(0.0)).alias("disclosure"))
        .where(F.col("disclosure") >= generalise)
    )
    told = groups.join(materialise(rules, "pii-rules"), "group").groupBy("body", "class").agg(
        F.max("disclosure").alias("disclosure"))
    return told.join(known, "class").join(terms, ["body", "term"]).select("body", "term", "disclosure")


def _places(held: DataFrame, told: DataFrame, remove: float, most_broadcast: int) -> DataFrame:
    """body and the places of all disclosing terms of its entities outside of spans."""
    size = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= most_broadcast and size["bytes"] <= _MOST_BYTES
    word = held.join(told.select("body").distinct(), "body", "left_semi").select("body", F.explode(_free(held)).alias("w"))
    shape = (
        F.when(F.col("disclosure") >= remove, F.lit(""))
        .when(F.col("w.value").rlike("[0-9]"), F.lit("[NUMBER]"))
        .when(F.col("w.value").rlike(r"^\p{Lu}"), F.lit("[NAME]"))
        .otherwise(F.lit("[TERM]"))
    )
    met = word.withColumn("term", F.lower("w.value")).join(F.broadcast(told) if few else told, ["body", "term"])
    place = F.struct("w.start", F.lit(len(KINDS) - 1).alias("kind"), "w.end", "w.value", shape.alias("replacement"))
    return met.groupBy("body").agg(F.array_sort(F.collect_list(place)).alias("terms"))


def spans(
    docs: DataFrame, *, generalise: float = 0.5, remove: float = 0.9, chance: float = 0.05, most_broadcast: int = 50_000
) -> DataFrame:
    """key, doc_id, and for every row its pattern spans and its terms (start, kind,
    end, value, replacement), where kind is a place in KINDS."""
    found = materialise(base(docs), "pii-base")
    some = found.where(F.size("spans") > 0)
    held = materialise(some.select("body", "text", "spans").dropDuplicates(["body"]), "pii-held")
    told = materialise(disclosing(docs, found, held, generalise, chance), "pii-told")
    terms = _places(held, told, remove, most_broadcast)
    kind = "array<struct<start:int,kind:int,end:int,value:string,replacement:string>>"
    none = F.array().cast(kind)
    told = some.join(terms, "body", "left").select("key", "doc_id", "spans", F.coalesce("terms", none).alias("terms"))
    return told.unionByName(found.where(F.size("spans") == 0).select("key", "doc_id", "spans", none.alias("terms")))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """The documents with pattern spans written as their kind and disclosing terms
    generalised or removed; of spans that overlap the first stays. `n_chars`, where
    there is one, follows the text."""
    found = spans(docs, **options).where((F.size("spans") > 0) | (F.size("terms") > 0))
    marks = F.array_sort(F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(
            F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]")).alias("to"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                s["replacement"].alias("to"))),
    ))
    mark = "array<struct<start:int,end:int,to:string>>"

    def keep(done: Column, s: Column) -> Column:
        return F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]), done).otherwise(
            F.concat(done, F.array(s)))

    first = F.aggregate(marks.cast(mark), F.array().cast(mark), keep)
    found = found.select("key", first.alias("marks")).dropDuplicates(["key"])
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, "text", _row_key(docs).alias("key")).join(found, "key", "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("marks", lambda s: s["end"]))
    pieces = F.transform(F.arrays_zip(F.col("marks").alias("m"), ends.alias("e")), lambda r: F.concat(
        F.when(r["m"].isNull(), F.col("text").substr(r["e"] + 1, F.length("text")))
        .otherwise(F.col("text").substr(r["e"] + 1, r["m"]["start"] - r["e"])),
        F.coalesce(r["m"]["to"], F.lit(""))))
    changed = F.col("marks").isNotNull()
    text = F.when(changed, F.array_join(pieces, "")).otherwise(F.col("text"))
    out = keyed.select("row", changed.alias("changed"), text.alias("clean"))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    fields["text"] = F.col("clean")
    if "n_chars" in fields:
        kind = docs.schema["n_chars"].dataType
        fields["n_chars"] = F.when(F.col("changed"), F.length("clean").cast(kind)).otherwise(fields["n_chars"])
    return out.select(*(c.alias(name) for name, c in fields.items()))
