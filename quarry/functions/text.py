"""Column expressions over names and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.operators.fixed_values import CAMEL, CAPITALS, NO_TOKEN

#: What these three leave between blanks: capitals before a capitalized word, a word with the capitals it begins with, capitals.
WORD = "[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+"


def tokenized(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, joined by blanks; camel case is split, null gives ''.

    Everything runs as JVM string functions, so it stays in generated code.
    """
    split = F.regexp_replace(F.regexp_replace(text, CAMEL, "$1 $2"), CAPITALS, "$1 $2")
    return F.coalesce(F.lower(F.trim(F.regexp_replace(split, NO_TOKEN, " "))), F.lit(""))


def words(text: str) -> tuple[str, ...]:
    """The same words of a Python string."""
    return tuple(re.sub(NO_TOKEN, " ", re.sub(CAPITALS, r"\1 \2", re.sub(CAMEL, r"\1 \2", text))).lower().split())


def tokens(text: Column) -> Column:
    """The words of ``tokenized`` as an array, empty for no words; one pattern finds them, so a text is passed once."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower), F.array().cast("array<string>"))


def capitalized(word: Column) -> Column:
    """The word with its first character in upper case, the others as they are."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def camel_of_kebab(slug: Column) -> Column:
    """payment-failed to PaymentFailed."""
    return F.array_join(F.transform(F.split(slug, "-"), capitalized), "")


def snake_of_kebab(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit("_"))


def like(column: Column, pattern: Column) -> Column:
    """SQL LIKE that ignores case; % and _ of the pattern are wildcards, whether literal or from a column."""
    return F.call_function("ilike", column, pattern)


def like_anywhere(column: Column, part: Column) -> Column:
    return like(column, F.concat(F.lit("%"), part, F.lit("%")))


def like_suffix(column: Column, part: Column) -> Column:
    return like(column, F.concat(F.lit("%"), part))


def number_of_key(*parts: Column) -> Column:
    """A positive 60-bit number of a natural key, the same wherever it is computed."""
    key = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") + 1
