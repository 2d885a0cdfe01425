"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Symmetric-delete join: every word emits itself and its distinct single deletions, as 64-bit hashes. Two words one
insertion, deletion or replacement apart share such a key (the shorter word, or both without the replaced
character), so an equi-join of the keys finds all pairs, and the exact distance drops the others. The
words that share a key differ from it by one inserted character at most, so a key has at most
(characters of the alphabet) * (its length + 1) + 1 words whatever the corpus is. From its near words
each word gets its form, and roots follow by pointer doubling along the forms, whose counts at least double at each step.

Counts cover all documents; occurrences are summed before they are shuffled. Everything is a DataFrame
expression, with no Python in tasks. Tables of words and of keys always meet by a shuffle (``merge``): Spark sizes them by their
compressed files and does not see that a word has some ten keys, so it would send tables of hundreds of MB to the driver.

Defined results: null texts have no words; a null ``doc_id`` counts as an empty one in the hash; repeated rows
count each; words are compared by code point; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.url_filters import lower_ascii
from lodestone.tables import cut, release

LEAST_LENGTH, LEAST_COUNT, TIMES, DROP = 5, 3, 2, 97
LETTERS = "A-Za-zÀ-ÿ"


def without(word: Column, at: Column) -> Column:
    """``word`` without the character at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def noisy_runs(docs: DataFrame, shortest: int = LEAST_LENGTH) -> DataFrame:
    """(word): each run of letters of at least ``shortest``, A-Z in lower case; every ``DROP``-th by a hash lacks one character."""
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    each = each.select("run", h.alias("h"))
    cut_off = without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    return each.select(F.when(F.col("h") % DROP == 0, cut_off).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, shortest: int = LEAST_LENGTH, fewest: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def keys(vocabulary: DataFrame) -> DataFrame:
    """(key, word, n): the hashes of a word and of its distinct single deletions."""
    w = F.col("word")
    cuts = F.transform(F.sequence(F.lit(0), F.char_length(w) - 1), lambda i: F.xxhash64(without(w, i)))
    return vocabulary.select(F.explode(F.array_distinct(F.concat(F.array(F.xxhash64(w)), cuts))).alias("key"), "word", "n")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways round: words exactly one edit apart."""
    emitted = keys(vocabulary)
    a = emitted.select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    b = emitted.select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
    met = a.join(b.hint("merge"), "key").filter("a < b").filter(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn").distinct()
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("other_n")))
    return met.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the last of its forms; doubling, so rounds grow with the logarithm of the longest way."""
    now = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, now = now, cut(now.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(old)
    return now.select("word", "root")


def groups(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """Per word of ``vocabulary`` (word, n): form, root, n_near, form_n.

    A form is the near word of greatest n (ties: the first by code points), where that is at least ``times`` the word's own.
    """
    vocabulary = cut(vocabulary, "vocabulary")
    best = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    rows = vocabulary.join(best.hint("merge"), "word", "left")
    taken = -F.col("best.minus") >= times * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")), "forms")
    release(vocabulary)
    out = rows.join(roots(rows.filter("form IS NOT NULL").select("word", "form")).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(documents: DataFrame) -> DataFrame:
    """All words of ``documents`` with the noise that the hash adds."""
    return groups(counted(noisy_runs(documents)))
