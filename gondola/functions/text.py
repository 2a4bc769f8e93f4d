"""Text helpers and display labels (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The texts the CSV reader of the source format takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Every white-space character.
_WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column) -> Column:
    """Trim every kind of white space (``trim`` removes blanks only), without a regex."""
    return F.btrim(column, F.lit(_WHITE_SPACE))


def blank_to_null(column: Column) -> Column:
    return F.nullif(strip(column), F.lit(""))


def drop_na_tokens(column: Column) -> Column:
    return F.when(~column.isin(NA_TOKENS), column)


def number_or_zero(column: Column, dtype) -> Column:
    """Numeric text as an exact decimal; anything else, or a number ``too_large`` for it, is zero.

    The cast goes straight to DECIMAL: unlike a cast to DOUBLE it takes no ``1.5d``, ``NaN`` or
    ``Infinity``.
    """
    return F.coalesce(column.try_cast(dtype), F.lit(0).cast(dtype))


def too_large(column: Column, dtype) -> Column:
    """Whether a text is a plain number that the type cannot hold."""
    return column.try_cast(dtype).isNull() & F.coalesce(column.rlike(PLAIN_NUMBER), F.lit(False))


def exact_product(a: Column, b: Column, dtype) -> Column:
    """``a * b`` in the given type; NULL if it does not fit."""
    return F.try_multiply(a, b).try_cast(dtype)


# How a plain number is written.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def plain_number(column: Column) -> Column:
    """Numeric text as DOUBLE, anything else as NULL.  A cast alone would also take the type
    suffixes of a literal (``12D``, ``7f``), ``NaN`` and ``Infinity``."""
    return F.when(column.rlike(PLAIN_NUMBER), column.try_cast("double"))


def matches(column: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search; NULL never matches."""
    return F.coalesce(column.rlike("(?iu)" + pattern), F.lit(False))


def product_label() -> Column:
    return F.coalesce(F.nullif(F.trim("Nom_prod"), F.lit("")), F.col("Cod_prod"), F.lit("?"))


def promo_label() -> Column:
    return F.coalesce(F.nullif(F.trim("Nom_promo"), F.lit("")), F.col("Cod_promo"), F.lit("?"))


def category_label(default: str = "–") -> Column:
    return F.coalesce(F.col("Categoria"), F.lit(default))


def or_dash(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("–"))


def normalized_code(column: Column) -> Column:
    return F.upper(strip(column))


def code_cycle(column: Column) -> Column:
    """First two dash-separated parts of a promo code; '' for a missing code."""
    return F.coalesce(F.concat_ws("-", F.slice(F.split(column, "-"), 1, 2)), F.lit(""))


def mechanic(name: Column) -> Column:
    """Promo mechanic read off the promo name; the first rule that matches wins."""
    # Words per mechanic, as LIKE patterns over the lower-case name.
    rules = [
        ("2x1 / 2x precio", ["%2x%", "%2 x%"]),
        ("Combo / Pack", ["%combo%", "%pack%"]),
        ("Lleva X Gratis", ["%gratis%", "%lleva%"]),
        ("Descuento Directo", ["%descuento%", "% % off%"]),
        ("Promo CRM/Lealtad", ["%crm%", "%um%"]),
    ]
    lowered = F.lower(name)
    case = None
    for label, patterns in rules:
        hit = lowered.like(patterns[0]) | lowered.like(patterns[1])
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case.otherwise("Otras")
