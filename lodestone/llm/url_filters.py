"""URL filters: rules by host and path, found by short hash prefixes and confirmed by full digests.

A rule (host, path, verdict) fits its host and all subdomains, if the URL's path starts with the rule's. A URL
is expanded into host suffixes with path prefixes, of each shape (labels in the host, characters in the path) that
occurs among the rules; their number follows the variety of shapes and not the number of rules. Each expression's
SHA-256 meets the rules by its first ``SHORT`` hex digits; the full digest confirms, and of the rules that fit
the longest decides (ties: the longer host, then block). A URL that no rule fits is allowed.

Up to ``SENT_RULES`` rules (which are counted) are sent to all tasks; more are joined by a shuffle in which URLs are salted, as
one rule may fit a third of them. Both give the same rows. The expressions of a URL leave their task as one row.

Defined results: host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case, with
a port or a user if there is one; path goes from there up to ``?``, ``#`` or the end and may be empty; a null URL or one without
``://`` has an empty host and path and is allowed; rows that repeat are judged alike, a row each; rules without a host
or a verdict of block or allow are ignored, a null path is empty; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT, SENT_RULES, SALTS = 8, 500_000, 32

#: The rules of the registered query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def labels(host: Column) -> Column:
    """How many parts between dots a host has."""
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digests(expressions: Column) -> Column:
    """(short, digest) of each expression."""
    return F.transform(F.transform(expressions, lambda e: F.sha2(e, 256)), lambda d: F.struct(F.left(d, F.lit(SHORT)).alias("short"), d.alias("digest")))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The host suffix and path prefix of each shape that the URL is large enough for."""
    each = [F.when((labels(host) >= n) & (F.char_length(path) >= size), F.concat(F.substring_index(host, ".", -n), F.left(path, F.lit(size)))) for n, size in shapes]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def prepared(rules: DataFrame) -> DataFrame:
    """(short, rule_digest, rule, at: what of several rules decides) of the rules that can fit."""
    r = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> '' AND verdict IN ('allow', 'block')").distinct()
    rule = F.concat("host", "path")
    at = F.struct(F.char_length(rule).alias("size"), F.char_length("host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"), rule.alias("rule"))
    return r.withColumn("_d", _digests(F.array(rule))[0]).select("host", "path", F.col("_d.short").alias("rule_short"), F.col("_d.digest").alias("rule_digest"), at.alias("at"))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", sent_rules: int = SENT_RULES) -> DataFrame:
    """Per row of ``urls``: key, host, path, rule, verdict."""
    rules = prepared(rules)
    shapes = sorted(tuple(r) for r in rules.select(labels(F.col("host")), F.char_length("path")).distinct().collect())
    rules = rules.drop("host", "path")
    rows = urls.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    asked = rows.select("*", F.explode_outer(_digests(expressions(F.col("host"), F.col("path"), shapes))).alias("e")).select("_row", "_key", "host", "path", "e.short", "e.digest")
    if rules.count() <= sent_rules:
        met = asked.join(F.broadcast(rules), F.col("short") == F.col("rule_short"), "left")
    else:
        # a URL without expressions meets nothing, and stands under a key of its own
        asked = asked.withColumns({"_salt": F.pmod(F.xxhash64("_row"), F.lit(SALTS)), "short": F.coalesce("short", F.concat(F.lit("#"), "_row"))})
        rules = rules.withColumn("_rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.join(rules, (F.col("short") == F.col("rule_short")) & (F.col("_salt") == F.col("_rule_salt")), "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("at"))
    best = met.groupBy("_row", "_key", "host", "path").agg(F.max(confirmed).alias("at"))
    return best.select(F.col("_key").alias(key), "host", "path", F.col("at.rule").alias("rule"), F.when(F.col("at.blocks"), "block").otherwise("allow").alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    """The fixed rules over every page."""
    return judge(pages, pages.sparkSession.createDataFrame(list(RULES), "host string, path string, verdict string"))
