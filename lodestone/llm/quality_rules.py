"""Quality rules as a short-circuit cascade, ordered by what they reject per unit of cost.

Every rule is a native predicate over a text that a good document passes; what it measures is
computed within it. Before the main pass each rule runs alone, measures included, over one bounded
sample of whole texts from all over the table: the seconds that it takes beyond an empty pass are its
cost, the share that it rejects is its selectivity. The rules then stand in one CASE in the order of
rejection per cost, and a row leaves at the first rule that it fails: dear measures are not taken of a
text that a cheap rule rejects. As the verdict is a conjunction, the order, and with it the sample and its
timings, changes the speed and never the result; a rejected row's ``failed_rule`` is the first in
the order in which the rules are given, whatever the order in which they ran.

Defined results: null text counts as empty (no words, so ``base_failed``); repeated rows
are judged alike, each on its own; an empty table gives no rows; null ids pass through;
columns beyond ``doc_id`` and ``text`` are ignored by :func:`digest` and kept by
:func:`keep_good`, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import GAP_CHARS, count_chars, lines, whole, words
from lodestone.tables import cut, release

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Texts that the cost estimate looks at, about.
SAMPLE_ROWS = 500


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words() -> Column:
    """Words in windows of three words that occur twice or more; windows are told apart by 64-bit hashes within one document.

    Most texts have no such window, which distinct hashes tell; only for the others are the windows sorted.
    """
    at = lambda i: F.get(F.col("_words"), i)
    keys = F.when(F.size("_words") >= 3, F.transform(F.slice("_words", F.lit(1), F.size("_words") - 2), lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def starts(pairs: Column) -> Column:
        """Sorted places of the windows that another one equals, from (key, place) in order."""
        same = lambda x, j: F.coalesce((x["k"] == F.get(pairs, j - 1)["k"]) | (x["k"] == F.get(pairs, j + 1)["k"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"]))

    def covered(found: Column) -> Column:
        steps = F.transform(found, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(found, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def count(k: Column) -> Column:
        pairs = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(_let(pairs, lambda p: _let(starts(p), covered)))

    return _let(keys, count)


def _full_lines() -> Column:
    """The lines that have a word."""
    return F.array_remove(F.transform(lines(F.col("_text")), lambda x: F.when(F.translate(x, GAP_CHARS, "") != "", x).otherwise("")), "")


#: What rules measure, over ``_text`` (the whole text) and ``_words``.
MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.size("_words").cast("long"),
    "word_chars": lambda: F.char_length(F.translate("_text", GAP_CHARS, "")).cast("long"),
    "n_symbols": lambda: count_chars(F.col("_text"), SYMBOLS),
    "n_dup_lines": lambda: _let(_full_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """A named predicate over a text; true means the document passes. ``m`` gives a measure by name."""

    name: str
    passes: Callable[[Callable[[str], Column]], Column]


def _share(chars: Callable[[Column], Column], most: float) -> Callable[[Callable[[str], Column]], Column]:
    return lambda m: chars(F.col("_text")) <= most * m("word_chars")


#: Production rules; each is true for an acceptable document. Too many repeated words for the base are too many for these.
RULES = (
    Rule("symbol_share", lambda m: m("n_symbols") <= 0.05 * m("word_chars")),
    Rule("repeated_words", lambda m: m("n_repeat_words") <= 0.4 * m("n_words")),
    Rule("duplicate_lines", lambda m: m("n_dup_lines") <= 0.5 * F.size(_full_lines())),
    Rule("word_length", lambda m: m("word_chars").between(2 * m("n_words"), 15 * m("n_words"))),
    Rule("shouting", _share(lambda t: F.char_length(F.regexp_replace(t, "[^A-Z]+", "")), 0.4)),
    Rule("exclamation", _share(lambda t: count_chars(t, "!"), 0.04)),
    Rule("digits", _share(lambda t: count_chars(t, "0123456789"), 0.3)),
)
#: Measures that cost less than the CASE that would spare them.
CHEAP = ("n_words", "word_chars", "n_symbols")
#: What the base asks, as rules of the cascade.
BASE = (
    Rule("too_short", lambda m: m("n_words") >= LEAST_WORDS),
    Rule("half_repeated", lambda m: 100 * m("n_repeat_words") <= 50 * m("n_words")),
)


def _measure(name: str) -> Column:
    """A measure: cheap ones from the column that :func:`with_text` made, dear ones within the rule that asks."""
    return F.col(f"_{name}") if name in CHEAP else MEASURES[name]()


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_text``, ``_words`` and the cheap measures under names with a ``_``."""
    df = df.withColumns({"_text": whole(F.col(text)), "_words": words(F.col(text))})
    return df.withColumns({f"_{name}": MEASURES[name]() for name in CHEAP})


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_text``, ``_words`` and all measures; all in one row, without a shuffle."""
    return with_text(df, text).withColumns({name: _measure(name) for name in MEASURES}).drop(*(f"_{n}" for n in CHEAP))


def order_rules(texts: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by share rejected per second, over about ``sample_rows`` rows of ``texts`` (``_in``) from all partitions."""
    share = min(1.0, sample_rows / max(1, texts.count()))
    sample = cut(texts.sample(share, 7), "rule-sample")
    few = sample.coalesce(1)  # of what was written: about `sample_rows` rows, timed on one core

    def timed(passes: Column) -> tuple[float, int]:
        seconds, rejected = [], 0
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            rejected = with_text(few, "_in").agg(F.count_if(~passes)).first()[0]
            seconds.append(time.perf_counter() - began)
        return min(seconds), rejected

    empty, _ = timed(F.col("_text").isNull())
    ranked = []
    for rule in rules:
        seconds, rejected = timed(rule.passes(_measure))
        ranked.append((rejected / max(seconds - empty, 1e-3), rule))
    release(sample)
    return [rule for _, rule in sorted(ranked, key=lambda x: -x[0])]


def cascade(rules: list[Rule], measure: Callable[[str], Column] = _measure) -> Column:
    """Whether a row passes all rules; evaluation stops at the first that it fails."""
    verdict = F.when(~rules[0].passes(measure), False)
    for rule in rules[1:]:
        verdict = verdict.when(~rule.passes(measure), False)
    return verdict.otherwise(True)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with the measures, ``base_failed``, ``kept`` and ``failed_rule`` (``base`` or the first rule failed in the order given)."""
    ordered = order_rules(df.select(F.col(text).alias("_in")), rules, sample_rows)
    full = with_measures(df, text).withColumn("base_failed", ~(BASE[0].passes(F.col) & BASE[1].passes(F.col)))
    full = full.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(ordered, F.col)))
    failed = F.when(F.col("kept"), None).when(F.col("base_failed"), "base")
    for rule in rules:
        failed = failed.when(~rule.passes(F.col), rule.name)
    return full.withColumn("failed_rule", failed).drop("_text", "_words")


def digest(documents: DataFrame) -> DataFrame:
    """The result per row of ``documents``."""
    out = judge(documents.select("doc_id", "text"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns and nothing else; no dear measure is taken that the cascade does not ask for.

    Texts that repeat half of their words fail the library's own ``repeated_words``; that half of the base stands in the cascade only where this rule does not.
    """
    names = docs.columns
    base = BASE[:1] if any(r is own for r in rules for own in RULES if own.name == "repeated_words") else BASE
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("_in"))
    ordered = order_rules(packed.select("_in"), (*base, *rules), sample_rows)
    # a filter that were pushed below the words would compute them anew for each of their uses;
    # it stays above a projection with a generated id that it reads
    judged = with_text(packed, "_in").select("_row", cascade(ordered).alias("_kept"), F.monotonically_increasing_id().alias("_at"))
    return judged.filter("_kept AND _at >= 0").select(*[F.col("_row")[c].alias(c) for c in names])
