"""Web pages and files of pages as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.ports import DocumentParser, PageText

_DROP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"
_BREAK = r"(?i)<(br|/p|/h[1-6]|/li|/tr|/div|/article|/nav|/title)\b[^>]*>"


def html_pages(pages: DataFrame) -> DataFrame:
    """(file, page, text) from (page_id, html): without scripts, styles and comments; block ends are line ends."""
    text = F.regexp_replace("html", _DROP, "")
    text = F.regexp_replace(text, _BREAK, "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return pages.select(F.col("page_id").alias("file"), F.lit(1).cast("long").alias("page"), text.alias("text"))


def document_pages(spark: SparkSession, path: str, parser: DocumentParser | None = None) -> DataFrame:
    """(file, page, text) of all files under ``path``, parsed on the executors; a file without text raises when it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pages = (parser or PageText()).pages(files).select(F.col("path").alias("file"), "page", "text")
    found = F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", ""))).over(Window.partitionBy("file"))
    return pages.withColumn("text", F.when(found > 0, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("a scanned file, without any text: "), F.col("file")))))


def structure(files: DataFrame, toc: DataFrame) -> DataFrame:
    """(file, strategy, max_title_level): files with a table of contents are cut by its titles, the others by title lines (no level)."""
    deep = toc.groupBy("file").agg(F.max("level").cast("int").alias("max_title_level"))
    rows = files.select("file").distinct().join(deep, "file", "left")
    return rows.select("file", F.when(F.col("max_title_level").isNull(), "chunksplit").otherwise("titlesplit").alias("strategy"), "max_title_level")
