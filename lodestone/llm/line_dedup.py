"""Line dedup from a suffix array over line ids, built by distributed prefix doubling.

All documents' lines, in order of document id and place, make up one text of line ids
(hashes of 64 and 32 bits); each document ends in a mark of its own. A suffix is known by
the number of its first line in that text. Doubling starts from single lines; a round joins to each
suffix the rank of the suffix ``h`` lines further, sorts the distinct pairs of ranks over ranges, numbers
them in that order, and joins the numbers back. A rank is the list of these numbers, one a
round, so ranks of suffixes that left the race early stay comparable: a suffix whose rank is shared
with none is in its place and drops out, and with the last shared rank the order is final. Suffixes
whose first line no other line equals take no part; their places would be between the others.
Pairs are counted before they are sorted, so a very common line is one row there, and the joins
back are ones that Spark can split. Only numbers move; texts stay where they are.

The suffix array is then a table (place, suffix). The longest common prefix of two neighbours in it
follows from their ranks: as many rounds as these agree in, so many lines double, and what is
left is the same question for the two suffixes so many lines further. Runs of neighbours that share
at least ``d`` lines are the intervals of depth ``d``. Of each interval the first suffix in the text is the
original. A repeated run counts from ``min_lines`` lines, or as one line of at least ``min_chars``
characters, or as a shorter one of ``min_words`` words that ``min_docs`` documents of the whole table hold; the
lines of all its later copies are deleted. A longer run's lines go as those of the intervals that start at each of them. The greatest
common prefix with a neighbour is the exact length of the longest run that starts at a suffix and stands elsewhere, too (``longest``).

Defined results: null text has no lines and stays null; rows with equal doc_id and text
are one document, and each gets its result; null ids come first; an empty text is one empty
line; an empty table gives no rows; other columns are kept by :func:`without_repeats`.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.ordering import running
from lodestone.llm.textops import GAP_CHARS, lines, n_words
from lodestone.tables import cut, owned, release

MIN_LINES, MIN_CHARS = 2, 40
#: For single lines under ``MIN_CHARS`` characters.
MIN_WORDS, MIN_DOCS = 2, 3
#: Suffixes up to which those that a round looks up are sent to all executors (some 2 MB); beyond it both sides are shuffled.
SENT_ROWS = 100_000
#: Documents and places of their lines up to which a table of removals is sent to all executors (some 10 MB); beyond it texts are shuffled.
SENT_PLACES = 1_000_000


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.char_length(text))


def line_text(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(g, last, doc_id, th, pos, id, id2, chars, words): a row for each line, numbered in the order of the text.

    ``last`` is the number of the document's last line; ``words`` are counted under ``min_chars`` characters only.
    """
    ids = F.transform(lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("id"), F.hash(x).alias("id2"), F.char_length(x).alias("chars"), F.when(F.char_length(x) < min_chars, n_words(x)).alias("words")))
    rows = docs.filter("text IS NOT NULL").select("doc_id", _text_hash(F.col("text")).alias("th"), ids.alias("ls")).dropDuplicates(["doc_id", "th"])
    rows = rows.repartitionByRange(F.col("doc_id"), F.col("th")).sortWithinPartitions("doc_id", "th")
    rows = rows.withColumn("n", F.size("ls")).select("doc_id", "th", "n", F.posexplode("ls").alias("pos", "l")).withColumn("g", F.monotonically_increasing_id())
    return rows.select("g", (F.col("g") - F.col("pos") + F.col("n") - 1).alias("last"), "doc_id", "th", "pos", "l.id", "l.id2", "l.chars", "l.words")


_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def _looked_up(rows: DataFrame, wanted: Column, of: DataFrame, n: int) -> DataFrame:
    """``rows`` (g, ...) as a join needs them that looks up the suffixes ``wanted`` of the ``n`` rows ``of``: where these are few, no others are shuffled."""
    return rows.join(F.broadcast(of.select(wanted.alias("g"))), "g", "left_semi") if n <= SENT_ROWS else rows


def suffix_array(text: DataFrame) -> DataFrame:
    """(k, g, last, rank, first): the suffixes whose first line others equal, in order; ``first`` is the first suffix with that line.

    ``text`` has a row (g, last, id, id2) for each line.
    """
    base = text.select("g", "last", "id", F.col("id2").cast("long").alias("id2"))
    shared = cut(base.groupBy("id", "id2").agg(F.min("g").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared-lines")
    active = cut(base.join(shared, ["id", "id2"]).select("g", "last", F.array("id", "id2").alias("rank"), "first"), "rank-1")
    release(shared)  # its lines stand in ``rank`` now
    done: list[DataFrame] = []
    h = 1
    while n := active.count():
        known = reduce(DataFrame.unionByName, done, active).select("g", "rank")
        far = _looked_up(known, F.col("g") + h, active, n).select((F.col("g") - h).alias("g"), F.col("rank").alias("r2"))
        ended, alone = F.array(F.lit(_FIRST), F.col("g")), F.array(F.lit(_LAST), F.col("g") + h)
        pairs = active.join(far, "g", "left").withColumn("r2", F.when(F.col("g") + h > F.col("last"), ended).otherwise(F.coalesce("r2", alone)))
        pairs = cut(pairs, "rank-pairs")  # read twice
        keys = pairs.groupBy("rank", "r2").agg(F.count("*").alias("n"))
        keys = cut(keys.repartitionByRange("rank", "r2").sortWithinPartitions("rank", "r2").withColumn("no", F.monotonically_increasing_id()), "pairs")
        ranked = cut(pairs.join(keys, ["rank", "r2"]).select("g", "last", F.concat("rank", F.array("no")).alias("rank"), "first", "n"), f"rank-{2 * h}")
        release(active, pairs, keys) if h == 1 else release(pairs, keys)
        done.append(ranked.filter("n = 1").drop("n"))
        active = ranked.filter("n > 1").drop("n")
        h *= 2
    return cut(running(reduce(DataFrame.unionByName, done, active), ["rank"], label="sorted-suffixes"), "suffix-array")


def common_prefixes(array: DataFrame) -> DataFrame:
    """(k, lcp): how many lines each suffix of the array shares with the one before it; 0 for the first."""
    agree = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)) - 1
    lines_of = lambda n: F.when(n >= 2, F.pow(F.lit(2.0), n - 2).cast("long")).otherwise(F.lit(0).cast("long"))
    own = array.select("k", F.col("g").alias("j"), F.col("last").alias("jl"), F.col("rank").alias("rj"))
    one = array.select((F.col("k") + 1).alias("k"), F.col("g").alias("i"), F.col("last").alias("il"), F.col("rank").alias("ri"))
    open_ = own.join(one, "k", "left").select("k", "i", "il", "j", "jl", lines_of(agree(F.col("ri"), F.col("rj"))).alias("step"))
    open_ = cut(open_.select("k", "i", "il", "j", "jl", F.coalesce("step", F.lit(0)).alias("l"), F.coalesce("step", F.lit(0)).alias("step")), "neighbours")
    done = [open_.filter("step <= 1").select("k", F.col("l").alias("lcp"))]
    open_ = open_.filter("step > 1")
    ranks = array.select("g", "rank")
    while n := open_.count():
        within = (F.col("i") + F.col("l") <= F.col("il")) & (F.col("j") + F.col("l") <= F.col("jl"))
        left, right = (_looked_up(ranks, F.col(x) + F.col("l"), open_, n).select(F.col("g").alias(f"_{x}"), F.col("rank").alias(f"r{x}")) for x in "ij")
        met = open_.join(left, F.col("i") + F.col("l") == F.col("_i"), "left").join(right, F.col("j") + F.col("l") == F.col("_j"), "left")
        step = F.when(within, F.coalesce(lines_of(agree(F.col("ri"), F.col("rj"))), F.lit(0))).otherwise(F.lit(0).cast("long"))
        # what is left is shorter than the step before, so this ends after as many rounds as the doubling
        met = cut(met.select("k", "i", "il", "j", "jl", (F.col("l") + step).alias("l"), step.alias("step")), "neighbours")
        done.append(met.filter("step <= 1").select("k", F.col("l").alias("lcp")))
        open_ = met.filter("step > 1")
    return reduce(DataFrame.unionByName, done)


def intervals(array: DataFrame, depth: int) -> DataFrame:
    """(g, last, first): the suffixes in intervals of at least ``depth`` common lines that hold more than one; ``array`` has ``lcp``. ``first`` is the interval's first suffix in the text."""
    ids = running(array.select("k", "g", "last", (F.col("lcp") < depth).cast("long").alias("edge")).withColumnRenamed("k", "at"), ["at"], {"interval": "edge"}, "interval-edges")
    ids = cut(ids.select("g", "last", "interval"), "intervals")
    first = cut(ids.groupBy("interval").agg(F.min("g").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "originals")
    return ids.join(first, "interval").select("g", "last", "first")


def _widespread(ones: DataFrame, text: DataFrame, min_words: int, min_docs: int) -> DataFrame:
    """g of the later copies of short lines of ``min_words`` words that ``min_docs`` documents hold."""
    short = cut(ones.join(text.filter(F.col("words") >= min_words).select("g"), "g", "left_semi"), "short-lines")
    held = short.select("first", "last").distinct().groupBy("first").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    return short.filter("g <> first").join(cut(held, "widespread"), "first", "left_semi").select("g")


def repeated(text: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """From :func:`line_text`: (g of every line to delete, once or more), and (g, longest) of every suffix that shares a line."""
    array = suffix_array(text)
    lcp = common_prefixes(array)
    array = cut(array.select("k", "g", "last", "first").join(lcp, "k"), "suffix-array-lcp")
    after = array.select((F.col("k") - 1).alias("k"), F.col("lcp").alias("next"))
    longest = array.join(after, "k", "left").select("g", F.greatest("lcp", F.coalesce("next", F.lit(0))).alias("longest"))
    ones = array.select("g", "last", "first")  # the intervals of depth one
    gone = [ones.filter("g <> first").select("g").join(text.filter(F.col("chars") >= min_chars).select("g"), "g", "left_semi")]
    gone.append(_widespread(ones, text, min_words, min_docs))
    whole = ones if min_lines == 1 else intervals(array, min_lines)
    gone.append(whole.filter("g <> first").select(F.explode(F.sequence("g", F.col("g") + min_lines - 1)).alias("g")))
    return reduce(DataFrame.unionByName, gone), longest


def removals(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, removed, longest): of each document with repeats the places of the lines to delete, and the length of its longest run that stands elsewhere."""
    keep: list[DataFrame] = []
    with owned(keep):
        text = cut(line_text(docs, min_chars), "line-text")
        gone, longest = repeated(text, min_lines, min_chars, min_words, min_docs)
        marks = gone.distinct().select("g", F.lit(True).alias("gone"), F.lit(0).cast("long").alias("longest")).unionByName(longest.select("g", F.lit(False).alias("gone"), "longest"))
        marks = text.select("g", "doc_id", "th", "pos").join(marks, "g")
        keep.append(cut(marks.groupBy("doc_id", "th").agg(F.collect_set(F.when(F.col("gone"), F.col("pos"))).alias("removed"), F.max("longest").alias("longest")), "line-removals"))
    return keep[0]


def _applied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``_kept`` and ``_all`` lines, ``longest``."""
    rows = rows.withColumn("_th", _text_hash(F.col("text")))
    found = found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_fh"), "removed", "longest")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_fh")), "left").withColumn("_all", lines(F.col("text")))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "removed")
    some = F.transform(keep, lambda i: F.get("_all", i))
    return rows.withColumn("_kept", F.when(F.col("removed").isNull() | (F.size("removed") == 0), F.col("_all")).otherwise(some))


def digest(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_lines, n_removed, longest (lines of its longest run that stands at another place, too), kept_sha256 (null for null text)."""
    rows = _applied(documents.select("doc_id", "text"), removals(documents))
    kept = F.when(F.col("text").isNotNull(), F.sha2(F.array_join("_kept", "\n").cast("binary"), 256))
    size = F.size("_all").cast("long")
    return rows.select("doc_id", size.alias("n_lines"), (size - F.size("_kept")).alias("n_removed"), F.coalesce("longest", F.lit(0)).alias("longest"), kept.alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated lines; a document that loses lines and has no word left is dropped."""
    names = docs.columns
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    found = removals(docs).filter(F.size("removed") > 0)
    places = found.agg(F.sum(F.size("removed") + 1).alias("n")).first()["n"] or 0
    rows = _applied(rows, F.broadcast(found) if places <= SENT_PLACES else found).withColumn("_text", F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")))
    stays = (F.size("_kept") == F.size("_all")) | (F.translate("_text", GAP_CHARS, "") != "")
    # the generated id keeps the filter above this projection; below it the lines would be cut anew for each use
    rows = rows.select("_row", "_text", stays.alias("_stays"), F.monotonically_increasing_id().alias("_at")).filter("_stays AND _at >= 0")
    return rows.select(*[(F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in names])
