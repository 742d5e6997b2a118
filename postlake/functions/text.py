"""Cleaning and folding of text, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space in the wide sense: Unicode blanks (no-break, thin, figure space
# included) and the ASCII separator controls. Spelled out, because a plain class
# is matched faster than a Unicode property.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"(?:\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029])"

# Every character of `SPACE`, and those of `LINE_BREAK`.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_BREAKS = "\n\v\f\r\x1c\x1d\x1e\x85\u2028\u2029"
# White space but the blank and the line feed. A class of many ranges is tried range by
# range on every character of a text, so a plainer one turns letters away before.
_RARE_SPACE = r"[\x00-\t\x0b-\x1f\x7f-\xa0\u1680-\u3000](?<=" + SPACE + ")"

_ENTITY = r"&(?:[A-Za-z0-9]+|#[0-9]+|#[xX][0-9A-Fa-f]+);?"
# Named entities of HTML, from the standard table, packed as one map literal.
_NAMES = "\x01".join(f"{name}\x02{chr(cp)}" for name, cp in name2codepoint.items())


def _windows_1252() -> dict[int, int]:
    """Code points that browsers give to numeric references 128..159."""
    table = {}
    for byte in range(0x80, 0xA0):
        try:
            table[byte] = ord(bytes((byte,)).decode("cp1252"))
        except UnicodeDecodeError:
            continue
    return table


_CONTROL_MAP = "\x01".join(f"{k}\x02{v}" for k, v in _windows_1252().items())


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, into: str, value: Column) -> DataFrame:
    """Add a column that is worked out exactly once per row.

    A plain projected column is copied into every later expression and filter
    that names it. A generated one is not: nothing is pushed below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(into))


def with_each(df: DataFrame, into: str, values: Mapping[str, Column], body) -> DataFrame:
    """Apply one expression to many columns at once: adds a struct column `into`
    with a field per value. The plan then holds `body` once, not once per column."""
    results = df.withColumn("_each", F.transform(F.array(*values.values()), body))
    fields = [F.get("_each", F.lit(i)).alias(name) for i, name in enumerate(values)]
    return once(results, into, F.struct(*fields)).drop("_each")


def _packed(text: str) -> Column:
    return F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02"))


def _character(code: Column) -> Column:
    """The character of a code point, NULL where there is none."""
    remapped = F.try_element_at(_packed(_CONTROL_MAP), code.cast("string")).try_cast("bigint")
    code = F.when(code.between(0x80, 0x9F), remapped).otherwise(code)
    legal = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    padded = F.lpad(F.hex(F.when(legal, code)), 8, "0")
    return F.decode(F.unhex(padded), "UTF-32")


def _entity_value(entity: Column) -> Column:
    inner = F.regexp_replace(entity, "^&|;$", "")
    # Leading zeros say nothing; what is too long for a number is no character.
    digits = F.regexp_extract(inner, "^#0*([0-9]+)$", 1)
    hexed = F.regexp_extract(inner, "^#[xX]0*([0-9A-Fa-f]+)$", 1)
    number = (
        F.when(inner.rlike("^#[xX]"), F.conv(hexed, 16, 10).try_cast("bigint"))
        .when(inner.startswith("#"), digits.try_cast("bigint"))
    )
    named = F.coalesce(
        F.try_element_at(_packed(_NAMES), inner),
        F.try_element_at(_packed(_NAMES), F.lower(inner)),
    )
    known = F.when(inner.startswith("#"), _character(number)).otherwise(named)
    unknown = F.when(entity.endswith(";"), F.lit("")).otherwise(entity)
    return F.coalesce(known, unknown)


def decode_entities(text: Column) -> Column:
    """Replace HTML entities once, left to right; an unknown one that is closed
    by a semicolon disappears, an unknown open one stays."""

    def decoded(t: Column) -> Column:
        between = F.split(t, _ENTITY, -1)
        values = F.transform(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)), _entity_value)
        return F.array_join(
            F.zip_with(between, values, lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))), ""
        )

    return let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def _single_blanks(text: Column) -> Column:
    """Runs of blanks to one; most texts have none and are only looked through."""
    return let(text, lambda t: F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t))


def _common_space(text: Column) -> Column:
    """White space that ends a line as a line feed, all other as a blank."""
    rare = "".join(c for c in _SPACES if c not in " \n")
    common = "".join("\n" if c in _BREAKS else " " for c in rare)
    return let(text, lambda t: F.when(t.rlike(_RARE_SPACE), F.translate(t, rare, common)).otherwise(t))


def squeeze(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(_single_blanks(F.replace(_common_space(text), F.lit("\n"), F.lit(" "))))


def _squeeze_lines(text: Column) -> Column:
    """White-space runs to a line feed where they hold a line's end, else to one blank;
    ends trimmed. A class is repeated, not a group: its runs need no stack."""
    single = F.replace(_single_blanks(_common_space(text)), F.lit(" \n"), F.lit("\n"))
    empty = lambda t: t.contains("\n\n") | t.contains("\n ")
    joined = let(single, lambda t: F.when(empty(t), F.regexp_replace(t, r"\n[\n ]+", "\n")).otherwise(t))
    return F.trim(joined, F.lit(" \n"))


def clean_text(value: Column) -> Column:
    """Entities decoded, white space squeezed; empty becomes NULL."""
    return F.nullif(squeeze(decode_entities(value.cast("string"))), F.lit(""))


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.trim(text, F.lit(_SPACES))


def strip_lines(value: Column) -> Column:
    """Every line and the whole stripped; line breaks and blank lines stay."""
    lines = F.transform(F.split(value, LINE_BREAK, -1), strip)
    return F.nullif(strip(F.array_join(lines, "\n")), F.lit(""))


# Elements whose end is the end of a line, the one that breaks a line
# and the one that begins an entry of a list.
_LINE_ENDS = ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
_BREAK, _ENTRY = "br", "li"


def _tag(*names: str, closing: bool = False, rest: str = "") -> str:
    """Pattern of a tag with one of the names, in any case, blanks around them."""
    return rf"(?iU)<{'/' if closing else ''}\s*(?:{'|'.join(names)}){rest}>"


def html_to_text(value: Column) -> Column:
    """Readable text of an HTML fragment; block ends become line breaks."""
    text = value.cast("string")
    text = F.regexp_replace(text, _tag(_BREAK, rest=r"\s*/?\s*"), "\n")
    text = F.regexp_replace(text, _tag(*_LINE_ENDS, closing=True, rest=r"\s*"), "\n")
    text = F.regexp_replace(text, _tag(_ENTRY, rest="[^>]*"), "\n- ")
    text = F.regexp_replace(text, r"</?[^ >/][^>]*>", "")
    return let(_squeeze_lines(decode_entities(text)), lambda t: F.nullif(t, F.lit("")))


_FOLDED_SPANS = ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF01, 0xFF5E))


def _foldable(form: str) -> dict[str, str]:
    """Lower-case characters that decompose, with their letters less the marks."""
    table = {}
    for first, last in _FOLDED_SPANS:
        for char in map(chr, range(first, last + 1)):
            parts = unicodedata.normalize(form, char)
            base = "".join(c for c in parts if not unicodedata.combining(c))
            if base and base != char and char == char.lower():
                table[char] = base
    return table


def _fold(text: Column, form: str) -> Column:
    table = _foldable(form)
    single = {k: v for k, v in table.items() if len(v) == 1}

    def folded(low: Column) -> Column:
        out = F.translate(low, "".join(single), "".join(single.values()))
        for char, letters in table.items():
            if len(letters) > 1:
                out = F.replace(out, F.lit(char), F.lit(letters))
        return F.regexp_replace(out, r"\p{M}+", "")

    # Pure ASCII has as many bytes as characters and needs no folding.
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(folded(F.lower(text)))


def fold_accents(text: Column) -> Column:
    """Lower case without diacritics: what the search index stores."""
    return _fold(text, "NFD")


def fold_key(text: Column) -> Column:
    """Lower case, compatibility forms unified, no diacritics: for look-ups."""
    return _fold(text, "NFKD")


def slug(text: Column) -> Column:
    """Stable lower-case identifier without accents or punctuation."""
    return F.regexp_replace(
        F.regexp_replace(fold_key(text.cast("string")), "[^a-z0-9]+", "-"), "^-|-$", ""
    )


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(
        fold_accents(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)
    )
