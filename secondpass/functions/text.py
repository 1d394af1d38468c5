"""Text normalization and numeric-token functions.

Whitespace, line-break and pattern work stays in built-in expressions.  Unicode
normalization has no built-in, so an Arrow function sees only the rows that can
change under it; all other rows pass it as null.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as whitespace.
WHITESPACE = (
    "\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
# Dash characters read as a minus sign.
DASHES = "\u2212\u2010\u2011\u2012\u2013\u2014\u2015\ufe63\uff0d"
# The numeric expression and its space separators.
_SPACES = "[\u0020\u00a0\u2000-\u200a\u202f\u205f\u3000]"
_NUMBER = re.compile(
    r"(?<![\w%])[+-]?"
    rf"(?:\d{{1,3}}(?:,\d{{3}})+|\d{{1,3}}(?:\.\d{{3}})+|\d{{1,2}}(?:{_SPACES}+\d{{3}})+|\d+)"
    r"(?:[.,]\d+)?%?"
)
# Text before a signed number that makes the number part of an identifier ("A-2").
_IDENTIFIER_TAIL = re.compile(r"\w+\Z")
# Trailing markers a text model may leave behind.
_SPECIAL_TAIL = "(?:<\\|(?:user|assistant|endoftext|end_of_text)\\|>[" + WHITESPACE + "]*)+$"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+\\z", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else unicodedata.normalize("NFC", value))


def normalize_text(text: Column) -> Column:
    """Composed form, one space for every whitespace run, no outer spaces."""
    # Below U+0300 every string is already composed.
    risky = text.rlike("[\\x{0300}-\\x{10FFFF}]")
    return collapse_spaces(F.coalesce(_composed(F.when(risky, text)), text))


def _canonical_number_text(value: str) -> str:
    return unicodedata.normalize("NFKC", value).translate({ord(dash): "-" for dash in DASHES})


def numeric_tokens_of(text: str) -> list[str]:
    """Numeric expressions of one text; numbers inside identifiers are skipped."""
    value = _canonical_number_text(text)
    found = []
    for match in _NUMBER.finditer(value):
        following = value[match.end():match.end() + 1]
        if following and (following in "%_" or following.isalnum()):
            continue
        before = value[:match.start()]
        if before.endswith(("+", "-")):
            word = _IDENTIFIER_TAIL.search(before[:-1])
            if word and any(ch == "_" or ch.isalpha() for ch in word.group()):
                continue
        found.append("".join(match.group().split()))
    return found


_CERTAIN = re.compile(r"[+-]?[0-9]+(?:%?\Z|[-/:;)\]])")


def looks_numeric(text: str) -> bool:
    """``is_numeric_looking`` of one text."""
    if text.isascii() and _CERTAIN.match(text):
        return True
    return any(unicodedata.category(ch) in ("Nd", "No", "So") for ch in text) and bool(numeric_tokens_of(text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda value: None if value is None else numeric_tokens_of(value))


@F.pandas_udf(T.StringType())
def _number_form(token: pd.Series) -> pd.Series:
    return token.map(lambda value: None if value is None else _canonical_number_text(value))


def normalize_numeric_token(token: Column) -> Column:
    """Compatibility form, one kind of minus, no whitespace; empty input gives null."""
    risky = token.rlike("[^\\x00-\\x7F]")
    text = F.coalesce(_number_form(F.when(risky, token)), token)
    bare = F.regexp_replace(text, f"[{WHITESPACE}]+", "")
    return F.when(bare != "", bare)


def extract_numeric_tokens(text: Column) -> Column:
    """Array of numeric expressions in ``text`` (empty array when there are none)."""
    # Only decimal digits, other numbers and some symbols can turn into a digit.
    possible = text.rlike("[\\p{Nd}\\p{No}\\p{So}]")
    tokens = _tokens(F.when(possible, text))
    return F.when(text.isNotNull(), F.coalesce(tokens, F.array().cast("array<string>")))


def is_numeric_looking(text: Column) -> Column:
    """True when the text holds at least one numeric token.

    Plain integers, and texts that start with an integer followed by ordinary
    ASCII punctuation, are decided without leaving the JVM.
    """
    certain = text.rlike("^[+-]?[0-9]+(?:%?$|[-/:;)\\]])") & ~text.rlike("[^\\x00-\\x7F]")
    undecided = ~certain & text.rlike("[\\p{Nd}\\p{No}\\p{So}]")
    tokens = _tokens(F.when(undecided, text))
    return F.coalesce(certain | (F.size(F.coalesce(tokens, F.array().cast("array<string>"))) > 0), F.lit(False))


def strict_json(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    The built-in parser stops after the first value; inside brackets anything
    behind it becomes a syntax error or a second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    values = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(values) == 1, F.try_variant_get(wrapped, "$[0]", "variant"))


def native_format(text: Column) -> Column:
    """Which table notation a raw output uses, or null."""
    value = F.lower(strip(text))
    return (
        F.when(value.contains("<table"), "html")
        .when(value.startswith("<fcel>"), "paddle_table_tokens")
        .when(value.contains("|"), "markdown")
    )


def strip_special_tokens(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), _SPECIAL_TAIL, ""))


def sanitize_error(message: Column, fallback: Column | str = "Error") -> Column:
    """One line, file paths masked, at most 500 characters."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    masked = F.regexp_replace(collapse_spaces(message), "(?:[A-Za-z]:[\\\\/]|/)[^\\s,;\"']+", "<path>")
    return F.left(F.when(masked == "", fallback).otherwise(F.coalesce(masked, fallback)), F.lit(500))


def normalize_label(label: Column) -> Column:
    """Lower case, every other character becomes an underscore, outer underscores removed."""
    lowered = F.replace(F.lower(label), F.lit("\u00df"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(lowered, "[^\\p{L}\\p{N}]", "_"), "^_+|_+$", "")


def clean_path(path: Column) -> Column:
    """Forward slashes only, without empty or single-dot steps."""
    slashed = F.regexp_replace(path, "\\\\", "/")
    return F.regexp_replace(F.regexp_replace(slashed, "(?<=^|/)\\.(?:/+|$)", ""), "(?<=.)/{2,}|/+$", "/")


def is_safe_path(path: Column, root: str, suffix: str = "") -> Column:
    """Relative path below ``root`` without parent steps and with the wanted suffix."""
    cleaned = clean_path(path)
    parts = F.split(cleaned, "/")
    return F.coalesce(
        (strip(path) != "")
        & ~cleaned.startswith("/")
        & ~F.array_contains(parts, "..")
        & (F.element_at(parts, 1) == root)
        & F.lower(cleaned).endswith(suffix.lower()),
        F.lit(False),
    )
