"""Text predicates and normalisers, all on built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from candela.functions.terms import minimal_terms, prefix_pattern

# fixed values: code points replaced during normalisation
# Runs of white space, zero-width and no-break characters, other than one blank by itself.
OTHER_BLANKS = r"\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
UNEVEN_BLANKS = rf"[{OTHER_BLANKS}][ {OTHER_BLANKS}]*| [ {OTHER_BLANKS}]+"
DASHES = "\u2013\u2014\u2012"
TOKEN_PATTERN = r"[a-z][a-z0-9\-]{2,}"


def sql_string(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_strings(values: Iterable[str]) -> str:
    return "array(" + ", ".join(sql_string(v) for v in values) + ")" if values else "cast(array() AS array<string>)"


def _like_pattern(term: str) -> str:
    for ch in ("\\", "%", "_"):
        term = term.replace(ch, "\\" + ch)
    return sql_string(f"%{term}%")


def like_any_sql(ref: str, terms: Iterable[str]) -> str:
    """SQL text: TRUE when a plain column (already lower-cased) contains any term.

    ``LIKE ANY`` with ``%term%`` patterns is rewritten by the optimizer to a chain of
    ``Contains``: generated code, and a filter that reaches the file scan.
    """
    kept = minimal_terms(terms)
    if not kept:
        return "false"
    return f"coalesce({ref} LIKE ANY ({', '.join(_like_pattern(t) for t in kept)}), false)"


def short_any_sql(ref: str, terms: Iterable[str]) -> str:
    """The same test for short values such as names inside array lambdas.

    One shared-prefix pattern instead of a hundred interpreted comparisons; about five times
    faster there.
    """
    kept = minimal_terms(terms)
    return f"coalesce({ref} rlike {sql_string(prefix_pattern(kept))}, false)" if kept else "false"


def long_any_sql(ref: str, terms: Iterable[str]) -> str:
    """The same test for long texts: a literal array keeps the plan small however many terms."""
    kept = minimal_terms(terms)
    listed = ", ".join(sql_string(t) for t in kept)
    return f"coalesce(exists(array({listed}), _term -> contains({ref}, _term)), false)" if kept else "false"


def vocab_any(column: str, terms: Iterable[str], match: str = "substring") -> Column:
    """TRUE when the lower-cased text column holds any term.

    ``match='word'`` asks for whole words instead of substrings.
    """
    terms = list(terms)
    if match == "substring":
        return F.expr(like_any_sql(column, terms))
    if match != "word":
        raise ValueError("match is 'substring' or 'word'")
    if not terms:
        return F.lit(False)
    alternatives = "|".join("\\Q" + t + "\\E" for t in terms)
    return F.coalesce(F.col(column).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])"), F.lit(False))


def clean_text(col: Column) -> Column:
    """Whitespace runs to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col, r"(?U)\s+", " ")))


def token_set(col: Column) -> Column:
    """Distinct lower-case tokens of three or more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(f"({TOKEN_PATTERN})"), F.lit(1)))


def normalise_text(col: Column) -> Column:
    """Zero-width and no-break characters to blanks, blanks collapsed, dashes to ``-``."""
    text = F.trim(F.regexp_replace(col, UNEVEN_BLANKS, " "))
    for dash in DASHES:
        text = F.replace(text, F.lit(dash), F.lit("-"))
    return F.trim(F.replace(text, F.lit("\ufffd"), F.lit("")))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def nfkd(col: Column) -> Column:
    """Unicode compatibility decomposition; Spark has no built-in for it, so non-ASCII texts go to Python workers."""
    return F.coalesce(_decomposed(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def heading_key(col: Column) -> Column:
    """Lower-case heading without trailing punctuation."""
    return F.trim(F.regexp_replace(F.lower(normalise_text(col)), "[\"'?.!]+$", ""))


def percent(col: Column) -> Column:
    """``0.283`` -> ``28%``."""
    return F.concat(F.round(col * F.lit(100.0), 0).cast("int").cast("string"), F.lit("%"))


def fixed(col: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals."""
    return F.format_string(f"%.{digits}f", col.cast("double"))
