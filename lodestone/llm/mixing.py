"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A mix of ``share`` times all words is divided among the sources by weight; no target
exceeds ``most`` times its source, and what is over goes to the others by weight. Each
source's documents fall by hash into blocks whose number follows the source's words, so
all blocks weigh about the same, those of a hot source too. A source gives every block
``floor(target / size)`` times and, in one more pass, blocks in permuted order until the
target is met; in the block where it is met, documents in permuted order; and of the last
document its first words. So each source's words equal its target, rounded.

The exact number of block instances that each source gives is its quota. A binary tree
splits the quotas among the output shards: a node draws the left half's counts without
replacement from its own (multivariate hypergeometric, source by source), and the right
half keeps the rest. The draw goes down a second tree, over the sources, ``FAN`` to a node, so a row
never holds more than ``FAN`` quotas, however many sources there are. In each source the permuted
instances are then dealt to the shards in disjoint runs of those lengths, and a shard is shuffled locally by a
hash. The tree decides where an instance goes (``shards``, and the order of :func:`mix`); how many
words each document gives follows from the blocks alone.

Blocks and shards are as many as the words ask for (``BLOCK_WORDS``, ``SHARD_WORDS``). Tables of a row a source or a
block are dealt over ranges where their order matters; documents are never ordered as a
whole. All of it is DataFrame expressions.

Defined results: null text has no words; null sources are one source, ordered last; a
source without words has target 0; repeated rows are documents of their own and share a
cut equally; null ids are ids like any other; extra columns are kept by :func:`mix`; an
empty table gives no rows. The same rows give the same mix, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.ordering import running
from lodestone.llm.textops import n_words, words
from lodestone.tables import cut, owned, release

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Least numbers of blocks and of shards, and the words of one of them beyond that.
N_BLOCKS, N_SHARDS = 512, 16
BLOCK_WORDS, SHARD_WORDS = 1_000_000, 256_000_000
#: Words that one task of the last shuffle gets, about; sources that one row of the splitting tree holds.
TASK_WORDS, FAN = 4_000_000, 256
SEED = 20240601


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` and two parts of a seeded hash: ``_hi`` deals blocks, ``_lo`` orders within one."""
    docs = docs.withColumn("size", n_words(F.col(text)))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("size")), 1)
    return docs.withColumns({"_hi": F.shiftright(h, 32), "_lo": h.bitwiseAND((1 << 32) - 1)})


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, n_blocks: int | None = None) -> DataFrame:
    """One row a source, as a table: source, ord, source_size, target, n_blocks, whole, rest.

    Filling by weight under caps has a closed form: in order of cap by weight a prefix of
    the sources is full, and the others share what is left at one level. Places and sums over the sources' order
    come from ranges of it, and only sums over all sources reach the driver. ``n_blocks`` is by default as many as the words ask for.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_none", F.col("source").isNull())
    per = running(per, ["_none", "source"], label="mix-by-name").withColumnRenamed("k", "ord")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("ord") % len(weights)).cast("int") + 1)
    per = per.withColumns({"_w": weight, "_cap": most * F.col("source_size")}).withColumn("_fill", F.col("_cap") / F.col("_w"))
    per = cut(running(per, ["_fill", "ord"], {"_caps": "_cap", "_ws": "_w"}, "mix-by-fill"), "mix-fills")
    everything = per.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    total, all_w = everything["size"] or 0, everything["w"] or 0.0
    level = F.try_divide(share * total - (F.col("_caps") - F.col("_cap")), all_w - (F.col("_ws") - F.col("_w")))
    found = per.withColumn("_level", level).filter(F.col("_level") <= F.col("_fill")).agg(F.min(F.struct("_fill", "ord", "_level")).alias("x")).first()["x"]
    target = F.col("_cap") if found is None else F.least(F.col("_cap"), F.lit(found["_level"]) * F.col("_w"))
    n_blocks = n_blocks or max(N_BLOCKS, total // BLOCK_WORDS)
    blocks = F.ceil(n_blocks * F.col("source_size") / max(total, 1))
    per = per.withColumns({"target": target, "n_blocks": F.greatest(F.lit(1), blocks).cast("long")})
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    per = per.withColumn("whole", whole)
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    return cut(per.withColumn("rest", rest).select("source", "ord", "source_size", "target", "n_blocks", "whole", "rest"), "mix-sources")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, draws: Column, unit: Column) -> Column:
    """How many of ``good`` among ``total`` are in ``draws`` drawn without replacement, by inversion at ``unit``.

    Chances are taken relative to the mode by their ratio to the neighbour, over twelve
    standard deviations to both sides; beyond that a double holds nothing.
    """
    d = lambda c: c.cast("double")

    def spread(p: Column) -> Column:
        n, k, m = d(p["n"]), d(p["k"]), d(p["m"])
        var = m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0))
        reach = F.ceil(12 * F.sqrt(F.greatest(var, F.lit(0.0))) + 12).cast("long")
        mode = F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")
        low, high = F.greatest(F.lit(0).cast("long"), p["m"] + p["k"] - p["n"]), F.least(p["m"], p["k"])
        mode = F.greatest(low, F.least(high, mode))
        return F.struct(p["n"].alias("n"), p["k"].alias("k"), p["m"].alias("m"), mode.alias("mode"), F.greatest(low, mode - reach).alias("low"), F.least(high, mode + reach).alias("high"))

    def ratio(p: Column, x: Column) -> Column:
        """Chance of x + 1 by chance of x."""
        n, k, m, x = d(p["n"]), d(p["k"]), d(p["m"]), d(x)
        return (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    def draw(p: Column) -> Column:
        none = F.array().cast("array<bigint>")
        grow = lambda xs, step: F.aggregate(xs, F.array(F.lit(1.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * step(x))))
        ups = F.when(p["high"] > p["mode"], F.sequence(p["mode"], p["high"] - 1)).otherwise(none)
        downs = F.when(p["low"] < p["mode"], F.sequence(p["mode"] - 1, p["low"], F.lit(-1).cast("long"))).otherwise(none)
        up, down = grow(ups, lambda x: ratio(p, x)), grow(downs, lambda x: 1 / ratio(p, x))
        chances = F.concat(F.reverse(F.slice(down, F.lit(2), F.size(down))), up)

        def pick(c: Column) -> Column:
            goal = unit * F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
            zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("i"))
            step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["i"] + (a["sum"] + x <= goal).cast("long")).alias("i"))
            return F.least(p["high"], p["low"] + F.aggregate(c, zero, step)["i"])

        return _let(chances, pick)

    sure = F.when((good <= 0) | (draws <= 0), F.lit(0).cast("long")).when(draws >= total, good).when(good >= total, draws)
    return sure.otherwise(_let(spread(F.struct(total.alias("n"), good.alias("k"), draws.alias("m"))), draw))


def split(quotas: Column, draws: Column, *seed: Column) -> Column:
    """Counts out of ``quotas`` (array<long>) when ``draws`` of all are drawn without replacement."""

    def fold(total: Column) -> Column:
        start = F.struct(total.alias("n"), draws.alias("m"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, k: Column) -> Column:
            got = hypergeometric(acc["n"], k, acc["m"], _unit(*seed, F.size(acc["out"])))
            return _let(got, lambda g: F.struct((acc["n"] - k).alias("n"), (acc["m"] - g).alias("m"), F.concat(acc["out"], F.array(g)).alias("out")))

        return F.aggregate(quotas, start, step)["out"]

    return _let(F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x), fold)


def left_counts() -> Column:
    """What the left half draws in a group of sources, over ``s`` (their quotas), ``m``, level, depth, node and up; a large expression, made once for all levels."""
    return split(F.col("s.q"), F.col("m"), F.col("level"), F.col("depth"), F.col("node"), F.col("up"))


def halves(nodes: DataFrame, sources: int, level: int, fan: int = FAN, left: Column | None = None) -> DataFrame:
    """(node, ord, q) of the children 2 node and 2 node + 1 of each node: half of all its quotas, drawn without replacement (``left``: :func:`left_counts`), and the rest."""
    ups = [nodes.select("node", F.col("ord").alias("id"), "q")]
    while (sources := -(-sources // fan)) > 1:
        ups.append(cut(ups[-1].groupBy("node", F.floor(F.col("id") / fan).alias("id")).agg(F.sum("q").alias("q")), "mix-groups"))
    drawn = None
    for depth in range(len(ups) - 1, -1, -1):
        each = ups[depth].groupBy("node", F.floor(F.col("id") / fan).alias("up")).agg(F.sort_array(F.collect_list(F.struct("id", "q"))).alias("s"))
        half = F.shiftright(F.aggregate(F.col("s.q"), F.lit(0).cast("long"), lambda a, x: a + x), 1)
        each = each.withColumn("m", half) if drawn is None else each.join(drawn.select("node", F.col("id").alias("up"), F.col("left").alias("m")), ["node", "up"])
        each = each.withColumns({"level": F.lit(level), "depth": F.lit(depth)}).withColumn("left", left_counts() if left is None else left)
        drawn = each.select("node", F.explode(F.arrays_zip(F.col("s.id").alias("id"), F.col("s.q").alias("q"), F.col("left").alias("left"))).alias("z")).select("node", "z.id", "z.q", "z.left")
    children = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("q")), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("q") - F.col("left")).alias("q")))
    return drawn.select(F.col("id").alias("ord"), F.explode(children).alias("h")).select("h.node", "ord", "h.q").filter("q > 0")


def shard_quotas(blocks: DataFrame, sources: int, n_shards: int, fan: int = FAN) -> DataFrame:
    """Per source ``ord`` the shards that its instances go to, with the ends of their runs: ``by`` (array of struct<end, shard>), from the quotas by the splitting tree."""
    assert n_shards & (n_shards - 1) == 0, "shards are halved"
    nodes = blocks.groupBy("ord").agg(F.sum("times").alias("q")).filter("q > 0").select(F.lit(0).cast("long").alias("node"), "ord", "q")
    left = left_counts()
    for level in range(n_shards.bit_length() - 1):
        nodes = halves(nodes, sources, level, fan, left)
        if sources > fan:
            nodes = cut(nodes, "mix-nodes")
    by = nodes.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("node", "q"))).alias("by"))
    ends = F.transform("by", lambda x, i: F.struct(F.aggregate(F.slice(F.col("by"), F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["q"]).alias("end"), x["node"].alias("shard")))
    return by.select("ord", ends.alias("by"))


def _block() -> Column:
    return F.pmod(F.col("_hi"), F.col("n_blocks"))


def _narrow(rows: DataFrame, part: Column) -> DataFrame:
    """Of rows (ord, rest, size, ...) per ``ord`` the permuted part in which ``rest`` runs out: ord, part, rest (left for it)."""
    sums = rows.groupBy("ord", "rest", part.alias("part")).agg(F.sum("size").alias("size"))
    run = Window.partitionBy("ord").orderBy("part")
    sums = sums.withColumn("_end", F.sum("size").over(run))
    hit = sums.filter((F.col("_end") > F.col("rest")) & (F.col("_end") - F.col("size") <= F.col("rest")))
    return hit.select("ord", "part", (F.col("rest") - F.col("_end") + F.col("size")).alias("rest"), "size")


def plan(rows: DataFrame, n_shards: int | None = None, **how) -> DataFrame:
    """A table with one row for each block: source, block, the source's facts, how often and where the block goes.

    ``times`` is how many instances the block has, ``shards`` the shard of each. Documents
    with ``_lo`` under ``cut_lo`` are in the last pass; of those at it, ``cut_words`` of
    ``cut_size`` words are.
    """
    keep: list[DataFrame] = []
    with owned(keep):
        keep.append(_plan(rows, n_shards, **how))
    return keep[0]


def _plan(rows: DataFrame, n_shards: int | None, **how) -> DataFrame:
    sources = targets(rows, **how)
    size = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("words")).first()
    n_shards = n_shards or max(N_SHARDS, 1 << int(size["words"] // SHARD_WORDS).bit_length())
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("block", _block())
    blocks = cut(placed.groupBy("ord", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    blocks = blocks.join(sources, "ord")
    order = Window.partitionBy("ord").orderBy(F.xxhash64(F.lit(SEED), F.col("ord"), F.col("block")), "block")
    blocks = blocks.withColumn("_end", F.sum("block_size").over(order)).withColumn("_start", F.col("_end") - F.col("block_size"))
    cut_here = (F.col("_start") < F.col("rest")) & (F.col("_end") > F.col("rest"))
    blocks = blocks.withColumns({"_cut": cut_here, "_last": F.col("_start") < F.col("rest")})
    blocks = cut(blocks.withColumn("times", F.col("whole") + F.col("_last").cast("long")), "mix-chosen")

    edge = blocks.filter("_cut").select("ord", "block", (F.col("rest") - F.col("_start")).alias("rest"))
    inside = placed.select("ord", "block", "_lo", "size").join(edge, ["ord", "block"])
    coarse = _narrow(inside, F.shiftright("_lo", 20))
    fine = inside.drop("rest").join(coarse.select("ord", "part", "rest"), "ord").filter(F.shiftright("_lo", 20) == F.col("part"))
    cuts = _narrow(fine.drop("part"), F.col("_lo")).select("ord", F.col("part").alias("cut_lo"), F.col("rest").alias("cut_words"), F.col("size").alias("cut_size"))

    quota = shard_quotas(blocks, size["n"], n_shards)
    deal = Window.partitionBy("ord").orderBy(F.xxhash64(F.lit(SEED + 1), F.col("ord"), F.col("block"), F.col("epoch")), "block", "epoch")
    dealt = blocks.filter("times > 0").select("ord", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))
    dealt = dealt.withColumn("_at", F.row_number().over(deal)).join(quota, "ord")
    shard = F.get(F.filter("by", lambda e: e["end"] >= F.col("_at")), F.lit(0))["shard"]
    dealt = dealt.groupBy("ord", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", shard.alias("shard"))))["shard"].alias("shards"))
    blocks = blocks.join(dealt, ["ord", "block"], "left").join(cuts, "ord", "left")
    return cut(blocks.select("ord", "block", "block_size", "source", "source_size", "target", "n_blocks", "whole", "_cut", "_last", "times", "shards", "cut_lo", "cut_words", "cut_size"), "mix-plan")


def place(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` (sized) with source_size, target, ``whole`` (passes in full), ``part`` (words in the last pass), taken, shards."""
    few = blocks.select("source", "n_blocks").distinct().withColumnRenamed("source", "_src")
    rows = rows.join(few, rows["source"].eqNullSafe(few["_src"])).drop("_src").withColumn("block", _block()).drop("n_blocks")
    facts = blocks.withColumnRenamed("source", "_src").drop("n_blocks", "times", "block_size")
    rows = rows.join(facts, rows["source"].eqNullSafe(facts["_src"]) & (rows["block"] == facts["block"])).drop(facts["block"]).drop("_src")
    at = F.floor(F.col("size") * F.try_divide(F.col("cut_words").cast("double"), F.col("cut_size"))).cast("long")
    zero = F.lit(0).cast("long")
    inside = F.when(F.col("_lo") < F.col("cut_lo"), F.col("size")).when(F.col("_lo") == F.col("cut_lo"), F.coalesce(at, zero)).otherwise(zero)
    part = F.when(~F.col("_last"), zero).when(~F.col("_cut"), F.col("size")).otherwise(F.coalesce(inside, zero))
    rows = rows.withColumn("part", part)
    return rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def digest(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` what the mix takes of it; ``shards`` are those that its block's instances go to."""
    rows = cut(sized(documents.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    out = place(rows, plan(rows))
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: ``docs`` rows, once for each time that they are taken, dealt to shards and shuffled in each.

    A document that the last pass takes in part comes with its first words, joined by a space.
    """
    names = docs.columns
    rows = sized(docs.select("doc_id", "source", F.col("text").alias("_in"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")), "_in")
    sizes = cut(rows.select("doc_id", "source", "size", "_hi", "_lo"), "mix-sizes")
    blocks = plan(sizes)
    release(sizes)
    rows = place(rows, blocks).filter("taken > 0")
    times = F.col("whole") + (F.col("part") > 0).cast("long")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    short = (F.col("epoch") == F.col("whole")) & (F.col("part") < F.col("size"))
    text = F.when(short, F.array_join(F.slice(words(F.col("_in")), F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("_in"))
    rows = rows.withColumns({"_text": text, "_shard": F.get("shards", F.col("epoch").cast("int")), "_rank": F.xxhash64(F.lit(SEED + 2), F.col("_hi"), F.col("_lo"), F.col("epoch"))})
    most = blocks.select(F.explode("shards").alias("s"), "block_size").groupBy("s").agg(F.sum("block_size").alias("w")).agg(F.max("w")).first()[0]
    parts = max(64, (most or 0) // TASK_WORDS)  # tasks of one shard
    rows = rows.repartition("_shard", F.pmod("_rank", F.lit(parts))).sortWithinPartitions("_shard", "_rank")
    return rows.select(*[(F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in names])
