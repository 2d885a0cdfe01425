"""Pages of text to titled chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import is_title, strip
from lodestone.operators.edits import first_near
from lodestone.operators.scan import following, open_levels, running
from lodestone.tables import cut, release

#: Fixed value: the title of text before the first title.
NO_TITLE = "无标题内容"
MERGE_ABOVE, MERGE_CHARS = 100, 2000
SHORT = 30


def page_lines(pages: DataFrame) -> DataFrame:
    """(file, page, line_no, line): stripped lines that are not blank."""
    lines = pages.select("file", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def chunks_by_title(pages: DataFrame, title=is_title) -> DataFrame:
    """(file, chunk, title, page, text): a title starts a chunk; its page is that of its last line."""
    return _line_chunks(page_lines(pages), title)


def _line_chunks(lines: DataFrame, title=is_title) -> DataFrame:
    """The chunks of :func:`chunks_by_title` from lines (file, page, line_no, line)."""
    lines = lines.withColumn("is_title", title(F.col("line")))
    lines = running(lines.withColumn("starts", F.col("is_title").cast("int")), "file", ["page", "line_no"], {"chunk": "starts"})
    lines = lines.withColumn("shown", F.when(F.col("is_title"), F.concat(F.lit("# "), "line")).otherwise(F.col("line")))
    rows = lines.groupBy("file", "chunk").agg(
        F.max(F.when(F.col("is_title"), F.col("line"))).alias("title"),
        F.max("page").alias("page"),
        F.array_sort(F.collect_list(F.struct("page", "line_no", "shown"))).alias("all"),
    )
    text = F.array_join(F.transform("all", lambda x: x["shown"]), "\n")
    return rows.select("file", F.col("chunk").cast("long").alias("chunk"), F.coalesce("title", F.lit(NO_TITLE)).alias("title"), "page", text.alias("text"))


def pack_starts(sizes: DataFrame, target: int) -> DataFrame:
    """(f, i): which rows of ``sizes`` (f, i from 1, size) start a pack, where each pack takes rows until joining one more would pass ``target``.

    Where a pack would end follows from where it starts: one sorted pass looks up the first row past the target for every
    row. The packs of a file are then the rows reached from its first one, found by doubling the jumps: a file of
    a million packs takes twenty rounds, and no row or group holds a file.
    """
    upto = F.sum(F.col("size") + 1).over(Window.partitionBy("f").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = sizes.withColumn("p", upto)
    ends = rows.select("f", "i", F.col("p").alias("v"), F.lit(0).alias("asks"))
    asks = rows.select("f", "i", (F.col("p") - F.col("size") + 1 + target).alias("v"), F.lit(1).alias("asks"))
    down = Window.partitionBy("f").orderBy(F.desc("v"), F.desc("asks"), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    past = F.last(F.when(F.col("asks") == 0, F.col("i")), ignorenulls=True).over(down)
    jumps = ends.unionByName(asks).withColumn("past", past).filter("asks = 1 AND past IS NOT NULL").select("f", "i", F.greatest("past", F.col("i") + 1).alias("to"))
    hops, starts, new = cut(jumps, "jumps"), [], cut(sizes.filter("i = 1").select("f", "i"), "starts")
    while not new.isEmpty():
        starts.append(new)
        reached = reduce(DataFrame.unionByName, starts)
        new = cut(reached.join(hops, ["f", "i"]).select("f", F.col("to").alias("i")).join(sizes.select("f", "i"), ["f", "i"]), "starts")
        hops = cut(hops.join(hops.select("f", F.col("i").alias("to"), F.col("to").alias("then")), ["f", "to"]).select("f", "i", F.col("then").alias("to")), "jumps")
    return reduce(DataFrame.unionByName, starts) if starts else new


def merged_chunks(chunks: DataFrame, above: int = MERGE_ABOVE, target: int = MERGE_CHARS) -> DataFrame:
    """Files with more than ``above`` chunks get neighbours packed up to ``target`` characters: file, chunk, title, page, text, parts.

    A pack has the title and page of its first chunk. Only lengths are sorted by file; texts meet in their pack, whose size ``target`` bounds.
    """
    held = cut(chunks.select(F.struct("file").alias("f"), "chunk", "title", "page", "text"), "chunks")  # a struct, as a file may be null
    sizes = held.select("f", "chunk", F.length("text").cast("long").alias("size"))
    order, whole = Window.partitionBy("f").orderBy("chunk"), Window.partitionBy("f")
    sizes = cut(sizes.withColumns({"i": F.row_number().over(order).cast("long"), "n": F.count("*").over(whole)}), "sizes")
    starts = pack_starts(sizes.filter(F.col("n") > above).select("f", "i", "size"), target).withColumn("starts", F.lit(1))
    packs = sizes.join(starts, ["f", "i"], "left").withColumn("starts", F.when(F.col("n") > above, F.coalesce("starts", F.lit(0))).otherwise(1))
    packs = packs.select("f", "chunk", (F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("pack"))
    rows = held.join(packs, ["f", "chunk"]).groupBy("f", "pack").agg(F.array_sort(F.collect_list(F.struct("chunk", "title", "page", "text"))).alias("cs"))
    first, text = F.get("cs", F.lit(0)), F.array_join(F.transform("cs", lambda c: c["text"]), "\n")
    return rows.select("f.file", F.col("pack").cast("long").alias("chunk"), first["title"].alias("title"), first["page"].alias("page"), text.alias("text"), F.size("cs").alias("parts"))


def page_spans(toc: DataFrame) -> DataFrame:
    """Entries (file, ord, level, title, page, last_page) with ``end_page``: the page of the next entry, at the end the file's last."""
    return following(toc, "file", ["ord"], "page", "_next").withColumn("end_page", F.coalesce("_next", "last_page")).drop("_next")


def title_lines(toc: DataFrame, lines: DataFrame, most: int = 2) -> DataFrame:
    """(file, ord, title, page, line_no): the first line on an entry's pages within ``most`` edits of its title."""
    spans = page_spans(toc).select("file", "ord", "title", F.col("page").alias("first"), F.col("end_page").alias("last"))
    return first_near(spans, lines, most)


def parent_titles(toc: DataFrame) -> DataFrame:
    """Entries with ``parents``: titles of the enclosing entries, outermost first.

    Order within a file is by ``ord``, which no two of its entries share.
    """
    return open_levels(toc, "file", "ord")


def sections(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, ord, title, text): entries' text between their title's line and the next one's, under their parents' headings.

    Chunks of at most ``SHORT`` characters are dropped; files of which nothing is left are cut by titles instead.
    Pages are parsed once, into a table of lines that goes when the sections and chunks are tables, too.
    """
    lines = cut(page_lines(pages), "page-lines")
    starts = title_lines(toc, lines).withColumnRenamed("page", "at_page").withColumnRenamed("line_no", "at_line")
    starts = following(starts.withColumn("at", F.struct("at_page", "at_line")), "file", ["ord"], "at", "to")
    last = lines.groupBy("file").agg(F.max("page").alias("last"))
    starts = starts.join(last, "file").join(parent_titles(toc).select("file", "ord", "parents"), ["file", "ord"])
    until = F.coalesce(F.col("to.at_page"), F.col("last")).cast("long")
    held = F.when(until >= F.col("at_page"), F.sequence(F.col("at_page").cast("long"), until))  # lines meet a section by page
    parts = starts.select("file", "ord", "title", "parents", "at", "to", F.explode(held).alias("page"))
    here = F.struct(F.col("page").cast("long").alias("at_page"), F.col("line_no").alias("at_line"))
    rows = lines.withColumn("page", F.col("page").cast("long")).join(parts, ["file", "page"]).filter((here >= F.col("at")) & (F.col("to").isNull() | (here < F.col("to"))))
    rows = rows.groupBy("file", "ord", "title", "parents").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))).alias("all"))
    text = F.array_join(F.concat("parents", F.transform("all", lambda x: x["line"])), "\n")
    good = cut(rows.select("file", "ord", "title", text.alias("text")).filter(F.length("text") > SHORT), "sections")
    plain = _line_chunks(lines.join(good.select("file").distinct(), "file", "left_anti"))  # dealt to ranges, and so a table, here
    release(lines)
    return good.unionByName(plain.select("file", F.col("chunk").cast("int").alias("ord"), "title", "text"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with ``segment_id`` from 1 within their file."""
    return running(chunks, "file", ["chunk"]).withColumn("segment_id", F.col("place") + 1).drop("place")
