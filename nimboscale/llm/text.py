"""Column helpers that several text operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space as the contracts list it: 0x20 and 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the cheaper built-in."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def words(col: Column) -> Column:
    """Array of the maximal runs of other characters than ASCII white space; null and blank give an empty array."""
    clean = trim_space(F.coalesce(col, F.lit("")))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, SPACE_CLASS))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in names])


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
