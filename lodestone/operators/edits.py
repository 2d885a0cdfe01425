"""Texts within a few edits of one another, by an equi-join on shared parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One level of page blocks holds sixteen blocks of the level below; six levels, the last of blocks of about a million pages.
BITS, LEVELS = 4, 6


def _deletions(x: Column, most: int) -> Column:
    """Every text left when up to ``most`` characters of ``x`` are deleted."""
    found = F.array(x)
    for _ in range(most):
        shorter = F.transform(found, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
        found = F.array_distinct(F.concat(found, F.flatten(shorter)))
    return found


def _part(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Where part ``i`` of a text of ``length`` starts (from 0), and its size: parts are equal, the last ones longer by one."""
    each, long_from = F.floor(length / parts).cast("int"), (parts - length % parts).cast("int")
    return i * each + F.greatest(F.lit(0), i - long_from), each + (F.lit(i) >= long_from).cast("int")


def _key(length: Column, i: int, part: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(i), part)


def _asked_keys(x: Column, most: int) -> Column:
    """A text is cut into ``most + 1`` parts, of which ``most`` edits leave one whole; one too short for that gives its deletions."""
    n = F.length(x)
    cuts = [_part(n, i, most + 1) for i in range(most + 1)]
    parts = F.array(*[_key(n, i, F.substring(x, at + 1, size)) for i, (at, size) in enumerate(cuts)])
    return F.when(n > most, parts).otherwise(F.transform(_deletions(x, most), lambda t: _key(F.lit(-1), -1, t)))


def _held_keys(x: Column, most: int) -> Column:
    """Keys under which ``x`` meets any text within ``most`` edits: for each length that such a text may have, the places to which
    edits before and after a whole part can move it."""
    n, none, keys = F.length(x), F.lit(None).cast("long"), []
    for more in range(-most, most + 1):
        other = n - more  # the length of the text asked for
        for i in range(most + 1):
            at, size = _part(other, i, most + 1)
            for shift in range(max(-i, more - (most - i)), min(i, more + (most - i)) + 1):
                fits = (other > most) & (at + shift >= 0) & (at + shift + size <= n)
                keys.append(F.when(fits, _key(other, i, F.substring(x, at + shift + 1, size))).otherwise(none))
    short = F.when(n <= 2 * most, F.transform(_deletions(F.left(x, F.lit(2 * most)), most), lambda t: _key(F.lit(-1), -1, t))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.array_compact(F.array(*keys)), short))


def near_texts(asked: DataFrame, held: DataFrame, group: str, most: int = 2) -> DataFrame:
    """(``group``, asked, held): distinct texts ``asked`` (group, asked) and ``held`` (group, held) of one group at most ``most`` edits apart.

    Only hashes travel through the join on keys; texts come back by their hash and every pair is then compared,
    so a hash that two texts share costs a comparison and never a pair. At ``most`` = 2 an asked text has three
    keys and a held one at most nineteen, of whatever length; texts of up to four characters add their deletions.
    Nulls, as group or text, are near nothing. A part that very many texts of a group share makes a pair of all texts
    that hold it, which is left to adaptive skew splitting.
    """
    asked, held = (d.select(group, name).dropna().distinct().withColumn(f"_{name}", F.xxhash64(name)) for d, name in ((asked, "asked"), (held, "held")))
    left = asked.select(group, "_asked", F.explode(_asked_keys(F.col("asked"), most)).alias("_k"))
    right = held.select(group, "_held", F.explode(_held_keys(F.col("held"), most)).alias("_k"))
    pairs = left.join(right, [group, "_k"]).select(group, "_asked", "_held").distinct()
    pairs = pairs.join(asked, [group, "_asked"]).join(held, [group, "_held"])
    return pairs.filter(F.levenshtein("asked", "held", most).between(0, most)).select(group, "asked", "held")


def _blocks(first: Column, last: Column) -> Column:
    """The pages from ``first`` to ``last`` as few whole blocks (level, block); none if that is before ``first``."""
    none = F.array().cast("array<bigint>")
    up = [F.shiftright(first.cast("long") + (2 ** (BITS * i) - 1), BITS * i) for i in range(LEVELS)]
    down = [F.shiftright(last.cast("long") + 1, BITS * i) for i in range(LEVELS)]
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    out = []
    for i in range(LEVELS):
        found = span(up[i], down[i])
        if i + 1 < LEVELS:  # what whole blocks of the next level hold is left to it
            edges = F.concat(span(up[i], F.shiftleft(up[i + 1], BITS)), span(F.shiftleft(down[i + 1], BITS), down[i]))
            found = F.when(up[i + 1] < down[i + 1], edges).otherwise(found)
        level = F.lit(i).alias("level")
        out.append(F.transform(found, lambda b: F.struct(level, b.alias("block"))))  # noqa: B023  called at once
    return F.concat(*out)


def first_near(entries: DataFrame, lines: DataFrame, most: int = 2) -> DataFrame:
    """``entries`` (file, ord, title, first, last) with the first line (page, line_no) of ``lines`` (file, page, line_no, line) on pages
    ``first`` to ``last`` within ``most`` edits of the title; entries without one are left out.

    Distinct titles meet distinct lines; first lines are then kept by blocks of pages, and an entry looks up the few
    blocks its pages consist of: no join on a range, and no window or group over a file. Lines of a length that is not within
    ``most`` of any title's are near none and drop out first; of lengths there are no more than the longest title has characters.
    """
    n = F.length("title")
    lengths = entries.select(F.explode(F.sequence(n - most, n + most)).alias("_n")).distinct()
    some = lines.join(F.broadcast(lengths), F.length("line") == F.col("_n"), "left_semi")
    texts = near_texts(entries.select("file", F.col("title").alias("asked")), some.select("file", F.col("line").alias("held")), "file", most)
    at = some.groupBy("file", F.col("line").alias("held"), F.col("page").cast("long").alias("page")).agg(F.min("line_no").alias("line_no"))
    at = at.join(texts, ["file", "held"]).groupBy("file", F.col("asked").alias("title"), "page").agg(F.min("line_no").alias("line_no"))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("page", BITS * i).alias("block")) for i in range(LEVELS)])
    least = at.select("file", "title", F.inline(levels), F.struct("page", "line_no").alias("x")).groupBy("file", "title", "level", "block").agg(F.min("x").alias("x"))
    ends = lines.groupBy("file").agg(F.min("page").cast("long").alias("_lo"), F.max("page").cast("long").alias("_hi"))  # pages without lines make no blocks
    entries = entries.filter("first IS NOT NULL AND last IS NOT NULL").join(ends, "file").withColumns({"first": F.greatest("first", "_lo"), "last": F.least("last", "_hi")})
    asked = entries.filter("first <= last").select("file", "ord", "title", F.inline(_blocks(F.col("first"), F.col("last"))))
    found = asked.join(least, ["file", "title", "level", "block"]).groupBy("file", "ord", "title").agg(F.min("x").alias("x"))
    return found.select("file", "ord", "title", "x.page", "x.line_no")
