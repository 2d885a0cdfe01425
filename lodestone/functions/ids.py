"""Content-hashed identifiers; all are native expressions and bit-exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_id(prefix: str, content: Column) -> Column:
    """``prefix`` followed by the hex MD5 of the UTF-8 content."""
    return F.concat(F.lit(prefix), F.md5(content.cast("binary")))


def fold(name: Column) -> Column:
    """Case folding: lower case with the sharp s written out.

    This equals full Unicode folding but for rare letters beyond it, such as ligatures.
    """
    return F.replace(F.lower(name), F.lit("ß"), F.lit("ss"))


def or_else(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def source_key(bucket: Column, path: Column, name: Column, file_id: Column) -> Column:
    """What tells files apart: bucket, path (or name, or ``unknown``) and id."""
    return F.concat_ws(":", or_else(bucket), or_else(path, name, F.lit("unknown")), or_else(file_id))


def passage_id(key: Column, segment: Column, text: Column) -> Column:
    return hashed_id("passage-", F.concat_ws(":", key, segment.cast("string"), text))


def sentence_id(passage: Column, sentence: Column) -> Column:
    return hashed_id("sentence-", F.concat_ws(":", passage, sentence))


def entity_node_id(key: Column, name: Column) -> Column:
    return hashed_id("entity-node-", F.concat_ws(":", key, name))


def entity_id(name: Column) -> Column:
    return hashed_id("entity-", fold(name))


def snippet_id(keyword: Column, text: Column) -> Column:
    return F.concat(keyword, F.lit("-"), F.md5(text.cast("binary")))
