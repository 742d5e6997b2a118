"""Reading loosely typed JSON values (VARIANT): every access checks the kind,
because asking an object for text would return its JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Keys that hold the text of a value object, first present wins.
TEXT_KEYS = ("name", "value", "@value", "text")


def member(value: Column, key: str) -> Column:
    """A member of an object; NULL when missing or when `value` is no object."""
    return F.try_variant_get(value, f"$['{key}']", "variant")


def elements(value: Column) -> Column:
    """The entries of a list, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    """The members of an object by key, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def is_object(value: Column) -> Column:
    return members(value).isNotNull()


def as_list(value: Column) -> Column:
    """A list as it is, any other value as a list of one, null as NULL."""
    present = value.isNotNull() & ~F.is_variant_null(value)
    return F.coalesce(elements(value), F.when(present, F.array(value)))


def objects_in(value: Column) -> Column:
    """The objects of `as_list`."""
    return F.filter(as_list(value), is_object)


def first_object(value: Column) -> Column:
    """The value if it is an object, or the first object of a list."""
    return F.get(objects_in(value), F.lit(0))


def scalar_text(value: Column) -> Column:
    """Text of any value; numbers and nested JSON as written."""
    text = F.try_variant_get(value, "$", "string")
    # Only a truth value reads "true" or "false" without being a string.
    truth = text.isin("true", "false") & (F.schema_of_variant(value) == "BOOLEAN")
    return F.when(truth, F.initcap(text)).otherwise(text)


def _has_text(text: Column) -> Column:
    return F.regexp_replace(text, "&nbsp;?|&#160;?", "").rlike(r"(?U)\S")


def _deep_text(value: Column) -> Column:
    """Text of a nested value, however deep: the values still to be looked at are kept
    in a list whose first entry is replaced by what it holds, until one has text."""
    rest = "array<variant>"
    # Every step takes one value; there are no more of them than openings and commas.
    bare = F.regexp_replace(F.to_json(value), r'"(?:[^"\\]++|\\.)*+"', "")
    steps = F.sequence(F.lit(0), F.length(F.regexp_replace(bare, r"[^\[{,]", "")) + 1)

    def step(done: Column, _: Column) -> Column:
        def taken(head: Column) -> Column:
            child = F.coalesce(*[F.try_element_at(members(head), F.lit(key)) for key in TEXT_KEYS])
            inner = (
                F.when(elements(head).isNotNull(), elements(head))
                .when(members(head).isNotNull() & child.isNotNull(), F.array(child))
                .otherwise(F.array().cast(rest))
            )
            nested = elements(head).isNotNull() | members(head).isNotNull()
            text = F.when(~nested, scalar_text(head))
            return F.struct(
                F.concat(inner, F.slice(done["rest"], F.lit(2), F.size(done["rest"]))).alias("rest"),
                F.when(_has_text(text), text).alias("text"),
            )

        over = done["text"].isNotNull() | (F.size(done["rest"]) == 0)
        return F.when(over, done).otherwise(let(F.get(done["rest"], F.lit(0)), taken))

    start = F.struct(F.array(value).alias("rest"), F.lit(None).cast("string").alias("text"))
    return F.aggregate(steps, start, step, lambda done: done["text"])


def text_of(value: Column) -> Column:
    """Uncleaned text: of an object, that of its first present text key; of a
    list, that of the first entry that has any; at any depth."""
    nested = members(value).isNotNull() | elements(value).isNotNull()
    return F.when(nested, _deep_text(value)).otherwise(scalar_text(value))
