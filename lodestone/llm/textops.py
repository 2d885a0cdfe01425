"""Word and line expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are the runs of everything but the six ASCII white-space characters.
GAP = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def whole(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """All words of the text, in order."""
    return F.array_remove(F.split(whole(text), GAP), "")


def n_words(text: Column) -> Column:
    """Number of words as a long."""
    return F.size(words(text)).cast("long")


def lines(text: Column) -> Column:
    """The text cut at every newline; null has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    text = whole(text)
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
