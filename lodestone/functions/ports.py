"""Ports for what a deployment brings itself: embeddings, entity recognition, document parsing.

Each port turns a column into a column (or a table into a table), so any implementation runs
on the executors. The implementations here are deterministic and need no model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """Text column -> array<float> column, row by row in order."""

    dim: int

    def encode(self, text: Column) -> Column: ...


class EntityExtractor(Protocol):
    """Text column -> array<string> of mentions; repeated mentions stay."""

    def mentions(self, text: Column) -> Column: ...


class DocumentParser(Protocol):
    """Binary files (path, content) -> pages (path, page, text)."""

    def pages(self, files: DataFrame) -> DataFrame: ...


@lru_cache(maxsize=1 << 16)
def _hashed_word(w: str, dim: int) -> int:
    """Twice the place of a word, and one more where its sign is plus; a corpus repeats its words."""
    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    return 2 * (h % dim) + (h >> 63)


class HashingEmbedder:
    """A unit vector from signed hashed words; Arrow batches of the session's size."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                out = []
                for t in s:
                    n = np.bincount(np.array([_hashed_word(w, dim) for w in (t or "").lower().split()], np.int64), minlength=2 * dim)
                    v = (n[1::2] - n[::2]).astype(float)
                    n = np.linalg.norm(v)
                    out.append((v / n if n else v).astype(np.float32).tolist())
                yield pd.Series(out)

        return run(text)


class PatternExtractor:
    """Mentions are the matches of a pattern; a native expression."""

    def __init__(self, pattern: str = "[A-Z][a-z]{5,}"):
        self.pattern = pattern

    def mentions(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))


class PageText:
    """Files whose pages are text divided by form feeds."""

    def pages(self, files: DataFrame) -> DataFrame:
        texts = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page", "text"))
        return texts.select("path", (F.col("page") + 1).cast("long").alias("page"), "text")
