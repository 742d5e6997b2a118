"""Numbers, workloads and salaries read from loosely written text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_text, let, strip

# Characters dropped as thousands separators, the number run and
# the plain notation that is read as it stands.
_DROPPED = r"[\u00a0\u202f\u2009\u2007 '’]"
_PLAIN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_NUMBER_RUN = r"-?\d[\d\s.,'’]*"
_AMOUNT_RUN = r"\d[\d\s.,'’]*"

# Currencies in the order they are looked for, pay words, and the
# mark that multiplies by a thousand.
_CURRENCIES = (
    ("CHF", r"\bCHF\b|\bFr\.|\bfrs\b"),
    ("EUR", r"€|\bEUR\b|\beuros?\b"),
    ("GBP", r"\bGBP\b|£"),
    ("USD", r"\bUSD\b|\$"),
)
_PAY_WORDS = (
    r"\bsalaire|\bsalarial|\bremuneration|\brémunération|\bbrut\b|\bnet\b"
    r"|\bannuel|\bmensuel|\bpar an\b|\bpar mois\b"
    r"|\bgehalt|\blohn\b|\bjahresgehalt|\bsalary\b|\bcompensation\b"
)
_THOUSANDS = r"\d\s*[kK]\b|\d\s*[kK][€$]"
_FIRST_YEAR, _LAST_YEAR = 1900, 2100
_SMALLEST_AMOUNT = 1000


def _finite(number: Column) -> Column:
    return F.when(~number.isin(float("inf"), float("-inf")) & ~F.isnan(number), number)


def local_number(raw: Column) -> Column:
    """A French or Swiss number: a last separator followed by one or two digits
    is the decimal mark, every other separator groups thousands."""
    text = F.regexp_replace(strip(raw), _DROPPED, "")

    def read(t: Column) -> Column:
        decimals = F.regexp_extract(t, r"[.,](\d{1,2})$", 1)
        whole = F.regexp_replace(F.regexp_replace(t, r"[.,]\d{1,2}$", ""), "[.,]", "")
        plain = F.when(decimals != "", F.concat(whole, F.lit("."), decimals)).otherwise(whole)
        return F.when(plain.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))

    return let(text, read)


def to_float(value: Column) -> Column:
    """Plain notation first, else the first number-looking run; NULL if neither."""
    text = strip(value.cast("string"))

    def read(t: Column) -> Column:
        run = F.nullif(F.regexp_extract(t, f"(?U){_NUMBER_RUN}", 0), F.lit(""))
        return F.when(t.rlike(_PLAIN), t.try_cast("double")).otherwise(local_number(run))

    return _finite(let(text, read))


def whole(number: Column) -> Column:
    """Half-even rounding; NULL outside the integer range."""
    return F.bround(number).try_cast("int")


def to_int(value: Column) -> Column:
    return whole(to_float(value))


def clamp_percent(number: Column) -> Column:
    """A workload held within 0..100."""
    rounded = F.bround(number)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded))
    return F.when(rounded.isNotNull(), bounded.cast("int"))


def percent(value: Column) -> Column:
    return clamp_percent(to_float(value))


def plain_text(value: Column, kind: T.DataType) -> Column:
    """Any value as text; a large number without an exponent."""
    text = value.cast("string")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return text
    written = F.regexp_replace(value.try_cast("decimal(38,9)").cast("string"), r"\.?0+$", "")
    return F.when(F.abs(value) >= 1e7, F.coalesce(written, text)).otherwise(text)


def workload_range(value: Column, kind: T.DataType | None = None) -> Column:
    """(min, max) percent. A number is both bounds, rounded half to even; free text
    gives its digit runs of up to three, 0..100."""
    if isinstance(kind, T.NumericType):
        number = whole(_finite(value.cast("double")))
        return F.struct(number.alias("min"), number.alias("max"))
    runs = F.regexp_extract_all(
        F.coalesce(clean_text(value), F.lit("")), F.lit(r"\d{1,3}"), F.lit(0)
    )
    rates = F.filter(F.transform(runs, lambda n: n.cast("int")), lambda n: n <= 100)
    return let(
        rates, lambda r: F.struct(F.array_min(r).alias("min"), F.array_max(r).alias("max"))
    )


def _detected_currency(text: Column) -> Column:
    found = F.lit(None).cast("string")
    for code, pattern in reversed(_CURRENCIES):
        found = F.when(text.rlike(f"(?iuU){pattern}"), F.lit(code)).otherwise(found)
    return found


def salary_range(value: Column, currency_hint: Column | None = None) -> Column:
    """(min, max, currency) from free text. A currency or a pay word is required;
    bare years and amounts below a thousand do not count."""
    hint = F.lit(None).cast("string") if currency_hint is None else currency_hint

    def read(text: Column) -> Column:
        currency = F.coalesce(_detected_currency(text), hint)
        spoken = (F.coalesce(currency, F.lit("")) != "") | text.rlike(f"(?iuU){_PAY_WORDS}")
        factor = F.when(text.rlike(f"(?U){_THOUSANDS}"), 1000.0).otherwise(1.0)

        def amounts(k: Column) -> Column:
            read_runs = F.transform(
                F.regexp_extract_all(text, F.lit(f"(?U){_AMOUNT_RUN}"), F.lit(0)),
                lambda raw: F.struct(raw.alias("raw"), local_number(raw).alias("n")),
            )
            is_year = lambda a: (
                (k == 1.0)
                & F.trim(a["raw"]).rlike(r"^\d{4}$")
                & a["n"].between(_FIRST_YEAR, _LAST_YEAR)
            )
            kept = F.filter(read_runs, lambda a: a["n"].isNotNull() & ~is_year(a))
            scaled = F.transform(kept, lambda a: a["n"] * k)
            return F.filter(scaled, lambda n: n >= _SMALLEST_AMOUNT)

        found = let(factor, amounts)
        return F.when(
            spoken,
            let(
                found,
                lambda a: F.struct(
                    F.array_min(a).alias("min"),
                    F.array_max(a).alias("max"),
                    currency.alias("currency"),
                ),
            ),
        )

    return let(clean_text(value), read)
