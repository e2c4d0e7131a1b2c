"""Column -> Column functions. Everything here is built from Spark built-ins."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from billspark import rules

SEP = "\u0001"


# ------------------------------------------------------------------ regex tools
def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; NULL instead of the empty string."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def found_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def groups(text: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of the first match as an array, NULL without a match.

    The long text is scanned once; the groups are then read from the match.
    """
    whole = F.regexp_extract(text, pattern, 0)
    marked = F.regexp_replace(whole, pattern, SEP.join(f"${i}" for i in range(1, n + 1)))
    return F.when(whole != "", F.split(marked, SEP))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it.

    Spark shares what is repeated in compiled expressions, but not inside higher-order functions.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rules.CS + r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, rules.CS + r"\s+", " "))


def label_windows(text: Column, label: str, width: int) -> Column:
    """The ``width`` characters after each hit of ``label``, in order."""
    return found_all(text, label + r"(?=([\s\S]{0," + str(width) + r"}))")


def first_after_label(
    text: Column, label: str, value: str, width: int, group: int = 1
) -> Column:
    """Value found within ``width`` characters of a label; first label with a value wins.

    The window is cut before matching, so a value that crosses its end is read
    up to that end.
    """
    values = F.transform(
        label_windows(text, label, width), lambda w: F.regexp_extract(w, value, group)
    )
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


# ---------------------------------------------------------------------- numbers
# A last group of one or two digits is a decimal part; it must use the other
# separator than the thousands. Anything else with such an ending is not a number.
_DROP_DECIMALS = (
    r"^(-?[0-9,]+)\.[0-9]{1,2}$|^(-?[0-9.]+),[0-9]{1,2}$|^.*[.,][0-9]{1,2}$"
)
_MARK_DECIMALS = r"^([^.]*)\.([0-9]{1,2})$|^([^,]*),([0-9]{1,2})$|^.*[.,][0-9]{1,2}$"


def parse_amount(text: Column) -> Column:
    """Whole currency units of a printed amount; decimals are dropped."""
    raw = F.regexp_extract(text, r"-?[0-9]+(?:[.,][0-9]+)*", 0)
    digits = F.translate(F.regexp_replace(raw, _DROP_DECIMALS, "$1$2"), ".,", "")
    return F.nvl2(text, F.coalesce(digits.try_cast("bigint"), F.lit(0)), F.lit(None))


def parse_decimal(text: Column) -> Column:
    """Decimal value of a printed quantity; three digits after a separator group thousands."""
    marked = F.regexp_replace(F.trim(text), _MARK_DECIMALS, "$1$3_$2$4")
    number = F.translate(marked, "_.,", ".").try_cast("double")
    return F.nvl2(text, F.coalesce(number, F.lit(0.0)), F.lit(None))


def parse_meter(text: Column) -> Column:
    """Meter reading with six printed decimals, with or without its separator."""
    raw = F.translate(text, " ", "")
    marked = F.regexp_extract(raw, r"^.*[.,][0-9]{4,}$", 0)
    long_part = F.regexp_replace(marked, r"^(.*)[.,]([0-9]+)$", "$1_$2")
    packed = F.regexp_extract(F.translate(raw, ".,", ""), r"^([0-9]{9}|[0-9]{7})$", 1)
    split = F.regexp_replace(packed, r"^([0-9]+)([0-9]{3})[0-9]{3}$", "$1.$2")
    return F.coalesce(
        F.translate(long_part, "_.,", ".").try_cast("double"),
        split.try_cast("double"),
        parse_decimal(raw),
    )


def parse_alicuota(text: Column, pattern: str = rules.STRUCTURED_ALICUOTA) -> Column:
    """``0,95110 %`` -> 0.9511 (four decimals, half even)."""
    digits = found(text, pattern)
    return F.bround(F.concat(F.lit("0."), digits).cast("decimal(12,8)"), 4).cast("double")


def safe_float(text: Column) -> Column:
    return F.coalesce(strip(text.cast("string")).try_cast("double"), F.lit(0.0))


def finite(number: Column) -> Column:
    """NULL for NaN and infinities."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(number) & (F.abs(number) != inf), number)


def rate(amount: Column, quantity: Column, digits: int = 2) -> Column:
    """``round(amount / quantity, digits)``, half even on exact decimals."""
    quotient = F.try_divide(amount.cast("decimal(20,6)"), quantity.cast("decimal(20,6)"))
    return F.bround(quotient, digits).cast("double")


def percent_of(amount: Column, percent: Column) -> Column:
    """``round(amount * percent / 100)`` as whole units, half even."""
    product = amount.cast("decimal(20,0)") * percent.cast("decimal(12,6)")
    return F.bround(product / F.lit(100).cast("decimal(3,0)"), 0).cast("bigint")


# ------------------------------------------------------------------------ dates
@lru_cache(maxsize=1)
def _month_entries() -> tuple:
    return tuple(rules.MONTHS.items())


def month_number(name: Column) -> Column:
    """Number of a Spanish month name or abbreviation, NULL when unknown."""
    table = F.create_map(*[F.lit(x) for pair in _month_entries() for x in pair])
    return F.try_element_at(table, name)


def month_of_prefix(name: Column) -> Column:
    """Month number from the first three letters of a name."""
    return month_number(F.lower(F.substring(name, 1, 3)))


def two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def parse_bill_date(text: Column) -> Column:
    """DATE of a date printed on a bill, in any of the accepted spellings."""
    raw = strip(text)
    plain = strip_marks(F.lower(raw))
    numeric = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    compact = r"^(\d{1,2})-([a-z]+)-(\d{4})$"
    words = rules.CS + r"^(\d{1,2})\s+(?:de\s+)?([a-z]+)\s+(?:de\s+)?(\d{4})$"
    year = F.regexp_extract(raw, numeric, 4)
    full_year = (
        F.when(F.length(year) == 4, year)
        .when(year.try_cast("int") >= 69, F.concat(F.lit("19"), year))
        .otherwise(F.concat(F.lit("20"), year))
    )

    def ymd(y: Column, m: Column, d: Column) -> Column:
        return F.concat(y, F.lit("-"), m, F.lit("-"), d)

    def named(pattern: str) -> Column:
        month = month_number(F.regexp_extract(plain, pattern, 2))
        return ymd(
            F.regexp_extract(plain, pattern, 3),
            month.cast("string"),
            F.regexp_extract(plain, pattern, 1),
        )

    spelled = (
        F.when(
            raw.rlike(numeric),
            ymd(full_year, F.regexp_extract(raw, numeric, 3), F.regexp_extract(raw, numeric, 1)),
        )
        .when(raw.rlike(iso), raw)
        .when(plain.rlike(compact), named(compact))
        .when(plain.rlike(words), named(words))
    )
    return F.try_to_date(spelled, "y-M-d")


def spanish_date(day: Column, month: Column, year: Column) -> Column:
    """``DD-MM-YYYY`` from its parts; empty when the month is unknown."""
    number = month_of_prefix(month)
    return F.when(number.isNull(), F.lit("")).otherwise(
        F.concat_ws("-", two(day.cast("int")), two(number), year)
    )


def fix_year(date: Column, expected: Column) -> Column:
    """Replace a year read slightly too high (a misread digit) by the expected one."""
    year = F.regexp_extract(date, r"(\d{4})$", 1).try_cast("int")
    drift = year - expected.try_cast("int")
    return F.when(
        (drift > 0) & (drift <= rules.MAX_YEAR_DRIFT),
        F.concat(F.regexp_replace(date, r"\d{4}$", ""), expected),
    ).otherwise(date)


def billing_month(text: Column) -> Column:
    """Month heading of a common-expenses note: label, year, first and last day."""
    parts = groups(text, rules.NOTE_PERIOD, 2)
    label, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    number = month_of_prefix(label)
    first = F.try_to_date(F.concat_ws("-", year, number.cast("string"), F.lit("1")), "y-M-d")
    first = F.when(number.isNotNull(), first)
    return F.struct(
        F.initcap(F.lower(label)).alias("label"),
        year.alias("year"),
        F.date_format(first, "dd-MM-yyyy").alias("first_day"),
        F.date_format(F.last_day(first), "dd-MM-yyyy").alias("last_day"),
    )


# ------------------------------------------------------------------------- text
@lru_cache(maxsize=1)
def _letter_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one ASCII letter or digit."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        base = "".join(
            c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_marks(text: Column) -> Column:
    """Remove diacritics; combining marks are dropped."""
    source, target = _letter_table()
    return F.translate(F.regexp_replace(text, r"\p{M}+", ""), source, target)


def norm_text(text: Column) -> Column:
    """Lower-case ASCII words separated by single blanks."""
    # plain ASCII has no marks to look for
    letters = F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), strip_marks(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(letters), r"[^a-z0-9]+", " "))


def line_skeleton(norm: Column) -> Column:
    """Normalised line without placeholders, month names and numbers."""
    ignored = [*rules.PLACEHOLDER_TOKENS, *[m for m in rules.MONTHS if m not in ("may", "sept")]]
    words = F.array(*[F.lit(w) for w in ignored])
    kept = F.filter(
        F.split(norm, " "),
        lambda t: (t != "") & ~t.rlike(r"^[0-9]+$") & ~F.array_contains(words, t),
    )
    return F.array_join(kept, " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_")
