"""Text predicates and measures as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs that count as numerals.
HAN_NUMERALS = "〇零一二三四五六七八九十百千万亿"
HAN = "[\\u4e00-\\u9fff]"
_SIGN = r"\p{IsHan}\p{IsHiragana}"
_LETTER = rf"[\p{{L}}\p{{M}}&&[^{_SIGN}]]"
#: A plain word; a sign that is a word by itself; a number with inner points; the words of all other scripts, with inner apostrophes.
TERM = rf"[a-z]++(?![\p{{L}}\p{{M}}\p{{N}}_'’])|[{_SIGN}]|\p{{N}}+(?:[.,]\p{{N}}+)+|(?:{_LETTER}|[\p{{N}}_])+(?:['’]{_LETTER}+)*"
TITLE_LENGTH, ALPHA_SHARE = 20, 0.5


def strip(x: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """The lower-case search terms of a text of any script, in order; a Han or Hiragana sign is a term."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


#: Labels of mentions that are no names.
COUNTS = ("ORDINAL", "CARDINAL")


def named(mentions: Column) -> Column:
    """The names of labelled mentions (array of struct<name, label>) but for numerals; a mention without label stays."""
    return F.transform(F.filter(mentions, lambda m: ~F.coalesce(m["label"].isin(*COUNTS), F.lit(False))), lambda m: m["name"])


def count_of(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlaps; an empty part occurs between all characters."""
    inner = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise(F.round(inner)).cast("long")


def alpha_share(x: Column) -> Column:
    """Letters by characters that are not white space; null for blank text."""
    return F.try_divide(F.regexp_count(x, F.lit(r"\p{L}")), F.regexp_count(x, F.lit(r"(?U)\S")))


def is_title(line: Column) -> Column:
    """Short, not ended by punctuation, mostly letters, not a number, with a numeral among the first five characters."""
    numeral = rf"[\p{{N}}{HAN_NUMERALS}]"
    return (
        F.length(line).between(1, TITLE_LENGTH)
        & ~line.rlike(r"(?U)[^\w\s]$")
        & (F.coalesce(alpha_share(line), F.lit(1.0)) >= ALPHA_SHARE)
        & ~line.rlike(rf"^{numeral}+$")
        & F.left(line, F.lit(5)).rlike(numeral)
    )


def weak_entity(name: Column) -> Column:
    """A name that may serve as a label: 3 to 16 characters, mostly Han and at least three of them, no digit."""
    han = F.regexp_count(name, F.lit(HAN))
    return F.length(name).between(3, 16) & (han >= F.greatest(F.lit(3.0), F.length(name) * 0.7)) & ~name.rlike(r"\p{Nd}")


def valid_object_key(key: Column) -> Column:
    """A relative key without empty, ``.`` or ``..`` parts, back slashes, reserved or control characters."""
    parts = F.split(key, "/")
    return ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~key.rlike(r'[<>:"\\|?*\x00-\x1f]')


def valid_bucket(name: Column) -> Column:
    """A bucket is a single part of a key."""
    return valid_object_key(name) & ~name.contains("/")


def broken_title(title: Column) -> Column:
    """A title whose numbered parts (``1.`` but not ``1.2``) start lines of their own, ended by a line end."""
    return F.concat(strip(F.regexp_replace(title, r"\s*(\d+\.)(?!\d)", "\n$1")), F.lit("\n"))
