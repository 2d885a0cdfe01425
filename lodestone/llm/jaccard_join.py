"""N-gram Jaccard join with token-combination prefixes.

Every document is the set of its distinct word shingles; two link when the Jaccard
similarity of their sets is at least ``percent`` / 100. Documents with equal sets form one
class, and the join runs between classes.

Tokens (shingles) have one global order, by hash. Sets of sizes that can link share
at least ``o = ceil(percent n / 100)`` tokens, so among the ``n - o + 1`` first tokens of both
stands a common one: these prefixes are the index. Posting lists are worked off so that hot
ones never make all their pairs:

1. Each class is paired with one pivot in each of its lists, the member whose prefix
   others share most; short lists also give all their pairs. Verified links make first
   components: copies of one text are mostly one component from then on, and a list within
   one component needs nothing more.
2. Of the other lists those with few pairs across components emit these.
3. Tokens of the lists left are the frequent class. For the documents concerned the order is
   changed: rare tokens first, then frequent ones. Rare tokens are indexed singly: the prefix is
   extended by as many rare tokens as it has frequent ones. Lists that are long again name more
   frequent tokens, for the documents in them, and so on for a few rounds. Where a set
   has too few rare tokens the prefix is extended by frequent ones, which are dealt by hash to
   ``G`` token classes; pairs (k = 2 combinations) within a class are indexed. Without a common
   signature a set lacks all its rare prefix tokens and all but one of each class, so the
   prefix is long enough when ``rare + sum(max(0, frequent in the class - 1))`` is. ``G`` follows
   the size in octaves, and a set is indexed for the octaves that its partners can have, so
   signatures stay in proportion to the set. Pairs with a document outside those concerned
   have a common rare token and were met before, as were pairs whose common token is no new entry
   of either: only lists with a new entry are looked at.
4. Lists that stay long are families of texts close to the threshold, such as copies with
   many edits each. They are joined in blocks of bounded size: a block pair counts common tokens
   from an inverted file in memory, and returns a spanning forest of its links, never pairs.

Candidates are thinned out by upper bounds of their common tokens, from the prefixes and then from
whole sets of 16-bit hashes, and what is left is verified exactly on whole sets; components come from verified links.
Shingles are told apart by 64-bit hashes, classes by a 128-bit digest.

Defined results: ASCII capitals are lowered; null and wordless texts have the empty set and
link with nothing, so their component is their own id; texts with fewer words than a
shingle are one shingle; repeated rows each get a row; a null id takes the least id of its
group (null if none has one); columns beyond ``doc_id`` and ``text`` are ignored by
:func:`digest` and kept by :func:`one_of_each`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.tables import cut, owned, release
from lodestone.llm.wordhash import hashed, mix, run_hashes

SHINGLE, PERCENT = 5, 80
#: Pairs across components up to which a list emits them at once; beyond it is frequent.
LIST_PAIRS = 2000
#: Ids or tokens up to which a table is sent to all executors (some 16 MB); beyond it both sides are shuffled.
SENT_ROWS = 500_000
#: Frequent tokens that a token class holds of one prefix, about.
CLASS_TOKENS = 8
#: Tokens of one block's sets, about; a family of fewer is still dealt to up to ``LEAST_BLOCKS`` blocks of ``SMALL_BLOCK``.
BLOCK, SMALL_BLOCK, LEAST_BLOCKS = 1_000_000, 20_000, 8
#: Rounds in which long lists name more frequent tokens; what is long after them is joined in blocks.
ROUNDS = 4


def prefix_length(n, percent: int = PERCENT):
    """How many of a set's first tokens must be indexed singly."""
    return n - (n * percent + 99) // 100 + 1


def _sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, words, at in hashed(texts, lower=True):
        runs = run_hashes(words, k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            else:
                yield run_hashes(words[a:b], int(b - a)) if b > a else np.empty(0, np.uint64)


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *parts])))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _tokens(s: np.ndarray) -> np.ndarray:
    """The upper 48 bits of the hashes; these order and name tokens in the index."""
    return np.unique(s >> np.uint64(16)).view(np.int64)


def _binary(column) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def profiles(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, n, key, tokens): a hash of the text, size and digest of its set, and the tokens of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, tokens = [], [], []
            for s in _sets(_binary(b.column("text")), k):
                n.append(len(s))
                key.append(_digest(s))
                tokens.append(_tokens(s[: prefix_length(len(s), percent)]) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), _lists(tokens)], ["doc_id", "th", "n", "key", "tokens"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n long, key binary, tokens array<long>")


def _send(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if it has been counted to be small enough."""
    return F.broadcast(ids) if ids.count() <= SENT_ROWS else ids


def _members(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, text) of the wanted classes (c): the text of the representative, once."""
    named = cut(classes.select("c", "rep", "copies").join(_send(wanted), "c", "left_semi"), "members")
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), "text").filter("text IS NOT NULL")
    met = texts.join(_send(named), F.col("_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("_th") == F.col("rep.th")))
    once = met.filter("copies = 1").select("c", "text")
    if named.filter("copies > 1").isEmpty():
        return once
    return once.unionByName(met.filter("copies > 1").groupBy("c").agg(F.first("text").alias("text")))


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(c, n, twice, h, s): the whole sorted set of each wanted class, read again from its representative; ``h`` are the distinct 16-bit hashes of its tokens, ``twice`` how many they are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_sets(_binary(b.column("text")), k))
            short = [np.unique((s >> np.uint64(48)).astype(np.uint16)).view(np.int16) for s in sets]
            size = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(size), pa.array(size - [len(x) for x in short], pa.int64()), _lists(short, np.int16), _lists([s.view(np.int64) for s in sets])], ["c", "n", "twice", "h", "s"])

    return cut(_members(docs, classes, wanted).mapInArrow(run, "c long, n long, twice long, h array<short>, s array<long>"), "sets")


def _near_size(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _enough(common: str, percent: int) -> Column:
    """Whether sets of ``na`` and ``nb`` tokens are similar enough with so many common ones."""
    return (100 + percent) * F.col(common) >= percent * (F.col("na") + F.col("nb"))


def _both_ends(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``facts`` (c, ...) for both ends, under their names and an ``a`` or ``b``."""
    for end in "ab":
        pairs = pairs.join(facts.select(*[F.col(c).alias(end if c == "c" else c + end) for c in facts.columns]), end)
    return pairs


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that sizes and prefixes leave possible, without reading whole sets.

    Up to the lesser of the two prefixes' last tokens all tokens of both sets are known: with
    ``i`` common ones there, the sets cannot share more than ``i`` and the lesser of the numbers left.
    The upper 31 bits of the tokens serve; those that agree in them count as common.
    """
    short = F.transform("tokens", lambda x: F.shiftright(x, 17).cast("int"))
    facts = classes.select("c", "n", F.array_distinct(short).alias("t"), (F.size("tokens") - F.size(F.array_distinct(short))).alias("twice"))
    both = _both_ends(pairs, facts).filter(_near_size("na", "nb", percent))
    upto = lambda t: F.size(F.filter(t, lambda x: x <= F.col("_last"))).cast("long")
    both = both.withColumn("_last", F.least(F.element_at("ta", -1), F.element_at("tb", -1)))
    common = F.size(F.array_intersect("ta", "tb")) + F.greatest("twicea", "twiceb")
    most = common + F.least(F.col("na") - upto("ta"), F.col("nb") - upto("tb"))
    return both.withColumn("_most", most).filter(_enough("_most", percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose whole sets are similar enough, as a table."""
    keep: list[DataFrame] = []
    with owned(keep):
        pairs = cut(pairs, "pairs")
        ends = lambda p: p.select(F.col("a").alias("c")).unionByName(p.select(F.col("b").alias("c"))).distinct()
        some = classes.select("c", "n", "tokens").join(_send(cut(ends(pairs), "pair-ends")), "c", "left_semi")
        near = cut(_near(pairs, some, percent), "near-pairs")
        release(pairs)
        sets = _whole_sets(docs, classes, cut(ends(near), "near-ends"), k)
        most = F.size(F.array_intersect("ha", "hb")) + F.least("twicea", "twiceb")
        close = cut(_both_ends(near, sets.select("c", "n", "twice", "h")).withColumn("_most", most).filter(_enough("_most", percent)).select("a", "b"), "close-pairs")
        whole = sets.join(_send(cut(ends(close), "close-ends")), "c", "left_semi").select("c", "n", "s")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        keep.append(cut(_both_ends(close, whole).withColumn("_i", common).filter(_enough("_i", percent)).select("a", "b"), "links"))
    return keep[0]


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """Each class with the best-shared class of each of its lists."""
    score = postings.groupBy("c").agg(F.sum(F.log2("m")).alias("w"), F.first("n").alias("n"))
    score = score.select("c", (F.floor(1000 * F.col("w") / F.col("n"))).cast("long").alias("w"))
    best = postings.join(score, "c").groupBy("tok").agg(F.max(F.struct("w", (-F.col("c")).alias("less"), "n")).alias("x"))
    pivot = cut(best.select("tok", (-F.col("x.less")).alias("p"), F.col("x.n").alias("np")), "pivots")  # as a table, so that the join's long lists can be split
    pairs = postings.join(pivot, "tok").filter("c <> p").filter(_near_size("n", "np", percent))
    return pairs.select(F.greatest("c", "p").alias("a"), F.least("c", "p").alias("b")).distinct()


def _with_component(postings: DataFrame, comps: DataFrame) -> DataFrame:
    out = postings.join(comps.withColumnRenamed("node", "c"), "c", "left")
    return out.withColumn("component", F.coalesce("component", "c"))


def _open_lists(postings: DataFrame) -> DataFrame:
    """(tok, pairs): lists that reach over components, with their number of pairs across."""
    size = postings.groupBy("tok", "component").agg(F.count("*").cast("double").alias("m"))
    size = size.groupBy("tok").agg(F.count("*").alias("k"), ((F.pow(F.sum("m"), 2) - F.sum(F.pow("m", 2))) / 2).alias("pairs"))
    return size.filter("k > 1").select("tok", "pairs")


def _pairs_across(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs across components within the lists of ``rows``, as far as their sizes allow."""
    left, right = (rows.select("tok", F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"k{x}")) for x in "ab")
    met = left.join(right, "tok").filter("a > b AND ka <> kb").filter(_near_size("na", "nb", percent))
    return met.select("a", "b").distinct()


def _octaves(n: int, percent: int) -> list[int]:
    """The octaves of the sizes that can link with size ``n``."""
    return list(range(max(1, -(-n * percent // 100)).bit_length(), (n * 100 // percent).bit_length() + 1))


def _since(tokens: np.ndarray, often: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Since which turn each token is frequent, 0 for rare ones; ``often`` (sorted) are the frequent ones, ``since`` their turns.

    Work is a search a token, not a pass over ``often`` a set: the frequent tokens of a table grow with it.
    """
    if not len(often):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
    return np.where(often[at] == tokens, since[at], 0)


def _pairs_of(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``tokens`` with one class of ``at``, the earlier token first."""
    order = np.argsort(at, kind="stable")
    tokens, at = tokens[order], at[order]
    left, right = [tokens[:0]], [tokens[:0]]
    for d in range(1, len(at)):
        same = np.flatnonzero(at[d:] == at[:-d])
        if not len(same):
            break
        left.append(tokens[same])
        right.append(tokens[same + d])
    return np.concatenate(left), np.concatenate(right)


def _combinations(frequent: np.ndarray, rare: int, p: int, n: int, percent: int) -> list[np.ndarray]:
    """The combinations of a set of ``n`` tokens with ``rare`` rare ones and these ``frequent`` ones, in order; they are negative."""
    parts = []
    for octave in _octaves(n, percent):
        classes = max(1, (1 << octave) * (100 - percent) // 100 // CLASS_TOKENS)
        at = (mix(frequent.view(np.uint64)) % np.uint64(classes)).view(np.int64)
        again = np.ones(len(at), np.int64)  # each token but the first of its class makes the prefix one longer
        again[np.unique(at, return_index=True)[1]] = 0
        use = int(np.searchsorted(rare + np.cumsum(again), p)) + 1
        one, two = _pairs_of(frequent[:use], at[:use])
        two = mix(mix(one.view(np.uint64) + np.uint64(octave << 48)) + two.view(np.uint64))
        parts.append(two.view(np.int64) | np.int64(-(1 << 63)))
    return parts


def _fresh(tokens: np.ndarray, since: np.ndarray, turn: int, percent: int) -> np.ndarray:
    """The index entries of a set (its tokens in order, and :func:`_since`) at ``turn``, without the single tokens that it had at the turn before; combinations are negative."""
    p = prefix_length(len(tokens), percent)
    rare = tokens[since == 0]
    new = np.setdiff1d(rare[:p], tokens[(since == 0) | (since == turn)][:p])
    more = _combinations(tokens[since > 0], len(rare), p, len(tokens), percent) if len(rare) < p else []
    return np.unique(np.concatenate([new, *more]))


def _entries(docs: DataFrame, classes: DataFrame, frequent: DataFrame, turn: int, concerned: DataFrame, k: int, percent: int) -> DataFrame:
    """(tok, c, n): the new index entries of the classes concerned; ``frequent`` (tok, turn) tells since which turn a token is."""
    columns = ["c", "n", "t"]
    if frequent.count() <= SENT_ROWS:
        rows = sorted(frequent.collect())
        often, turns = (np.array([r[c] for r in rows], np.int64) for c in ("tok", "turn"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [(s >> np.uint64(16)).view(np.int64) for s in _sets(_binary(b.column("text")), k)]
                yield pa.RecordBatch.from_arrays([b.column("c"), pa.array([len(s) for s in sets], pa.int64()), _lists([_fresh(s, _since(s, often, turns), turn, percent) for s in sets])], columns)

        found = _members(docs, classes, concerned).mapInArrow(run, "c long, n long, t array<long>")
    else:
        sets = _whole_sets(docs, classes, concerned, k).select("c", "n", "s")
        tokens = sets.select("c", F.explode("s").alias("h")).select("c", F.shiftrightunsigned("h", 16).alias("tok"))
        held = tokens.distinct().join(frequent, "tok").groupBy("c").agg(F.collect_list("tok").alias("f"), F.collect_list("turn").alias("since"))

        def run_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for s, f, t in zip(b.column("s"), b.column("f"), b.column("since"), strict=True):
                    own, since = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.empty(0, np.int64) for x in (f, t))
                    tokens, order = (s.values.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(16)).view(np.int64), np.argsort(own)
                    out.append(_fresh(tokens, _since(tokens, own[order], since[order]), turn, percent))
                yield pa.RecordBatch.from_arrays([b.column("c"), b.column("n"), _lists(out)], columns)

        found = sets.join(held, "c", "left").select("c", "n", "s", "f", "since").mapInArrow(run_held, "c long, n long, t array<long>")
    return cut(found.select(F.explode("t").alias("tok"), "c", "n"), "new-entries")


def _forest(ids: np.ndarray, parts: np.ndarray, known: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among ``ids`` that connect what all links and ``known`` components connect; ``parts`` (0, 1): if both occur, only links between them."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    tokens, owner = flat[order], np.repeat(np.arange(len(ids)), size)[order]
    root = {int(k): int(k) for k in known}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, two = [], parts.min() != parts.max()
    for i in range(len(ids)):
        if two and parts[i]:
            continue
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        step = np.ones(int((hi - lo).sum()), np.int64)  # all places of the runs [lo, hi)
        heads = np.cumsum(hi - lo)[:-1]
        step[0] = lo[0]
        step[heads] = lo[1:] - hi[:-1] + 1
        both = np.bincount(owner[np.cumsum(step)], minlength=len(ids))
        hit = 100 * both >= percent * (size + size[i] - both)
        for j in np.flatnonzero(hit & ((parts == 1) if two else (np.arange(len(ids)) > i))).tolist():
            x, y = find(int(known[i])), find(int(known[j]))
            if x != y:
                root[x] = y
                out.append((int(ids[i]), int(ids[j])))
    return out


def _family_links(held: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links within the families that the lists of ``held`` form, block by block, as a table."""
    keep: list[DataFrame] = []
    with owned(keep):
        sets = _whole_sets(docs, classes, cut(held.select("c").distinct(), "family-members"), k).select("c", "n", "s")
        first = cut(held.groupBy("tok").agg(F.min("c").alias("b")), "first-members")
        family = components(held.join(first, "tok").select(F.col("c").alias("a"), "b"), "families")
        family = family.select(F.col("node").alias("c"), F.col("component").alias("family")).distinct()
        known = cut(family.join(held.select("c", "n", "component").distinct(), "c"), "families")
        blocks = known.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.least(F.lit(LEAST_BLOCKS).cast("long"), F.ceil(F.sum("n") / SMALL_BLOCK))).cast("int").alias("blocks"))
        rows = known.drop("n").join(blocks, "family").join(sets, "c")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "part": (F.col("own") > F.col("other")).cast("int")})

        def run(t: pa.Table) -> pa.Table:
            cols = {n: t.column(n).to_numpy() for n in ("c", "component", "part", "x", "y")}
            found = _forest(cols["c"], cols["part"], cols["component"], [s.values.to_numpy(zero_copy_only=False) for s in t.column("s")], percent)
            if cols["x"][0] != cols["y"][0] and cols["part"].min() == cols["part"].max():
                found = []  # the other block is empty
            return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        found = rows.select("family", "x", "y", "c", "component", "part", "s").groupBy("family", "x", "y").applyInArrow(run, "a long, b long")
        keep.append(cut(found, "links"))
    return keep[0]


def _links(docs: DataFrame, classes: DataFrame, k: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): verified links that connect exactly what all links connect."""
    entries = classes.select(F.explode("tokens").alias("tok"), "c", "n")
    shared = entries.groupBy("tok").agg(F.count("*").alias("m")).filter("m > 1")
    postings = cut(entries.join(shared, "tok"), "postings")
    short = F.col("m") * (F.col("m") - 1) <= 2 * LIST_PAIRS
    alone = postings.filter(short).withColumn("component", F.col("c"))
    links = verified(_stars(postings, percent).unionByName(_pairs_across(alone, percent)).distinct(), docs, classes, k, percent)

    few = F.col("pairs") <= LIST_PAIRS
    comps = components(links)
    index = _with_component(postings.filter(~short).select("tok", "c", "n"), comps)
    index = cut(index.join(cut(_open_lists(index), "open-lists"), "tok"), "index")
    release(postings)
    pairs, long, made, frequent, closed = _pairs_across(index.filter(few), percent), index.filter(~few), [], None, []
    for turn in range(1, rounds + 1):
        hot = long.filter("tok >= 0")
        if hot.isEmpty():
            break
        named = hot.select("tok", F.lit(turn).alias("turn")).distinct()
        frequent = cut(named if frequent is None else frequent.unionByName(named), "frequent")
        concerned = cut(hot.select("c").distinct(), "concerned")
        new = _entries(docs, classes, frequent, turn, concerned, k, percent)
        singles = cut(new.filter("tok >= 0").select("tok").distinct(), "new-tokens")
        before = classes.join(concerned, "c", "left_semi").select(F.explode("tokens").alias("tok"), "c", "n")
        for m in made:
            before = before.unionByName(m.filter("tok >= 0").join(concerned, "c", "left_semi"))
        wide = cut(_with_component(new.unionByName(before.join(singles, "tok", "left_semi")), comps), "entries")
        index = cut(wide.join(cut(_open_lists(wide), "open-lists"), "tok"), "index")
        release(wide, singles)
        made.append(new)
        closed.append(long.filter("tok < 0"))
        pairs, long = pairs.unionByName(_pairs_across(index.filter(few), percent)).distinct(), index.filter(~few)
    links = links.unionByName(verified(pairs, docs, classes, k, percent))
    for lists in closed:
        long = long.unionByName(lists)
    if not long.isEmpty():
        links = links.unionByName(_family_links(long, docs, classes, k, percent))
    return links


def grouped(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, th (hash of the text), n_shingles, key (digest of the set), group (null for the empty set), component_id."""
    keep: list[DataFrame] = []
    with owned(keep):
        wide = cut(profiles(docs, k, percent), "profiles")
        full = wide.filter("n > 0")
        own = full.groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        # rows of one text and id are alike; the class tells how many its representative is, so that its text is read once
        alike = full.groupBy("key", "doc_id", "th").agg(F.count("*").alias("copies"))
        least = alike.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "copies")).alias("x"))
        named = own.join(least, "key").select("key", "n", "tokens", F.struct("x.doc_id", "x.th").alias("rep"), "x.copies")
        classes = cut(named.withColumn("c", F.monotonically_increasing_id()), "classes")
        rows = cut(wide.drop("tokens"), "set-keys")
        release(wide)
        comps = components(_links(docs, classes, k, percent)).distinct()
        found = classes.select("c", "key", F.col("rep.doc_id").alias("rep")).join(comps.withColumnRenamed("node", "c"), "c", "left").withColumn("group", F.coalesce("component", "c"))
        found = cut(found.select("key", "rep", "group"), "class-groups")
        first = found.groupBy("group").agg(F.min("rep").alias("found"))
        by_key = cut(found.join(first, "group").select("key", "group", "found"), "groups")
        keep += [rows, by_key]
    out = rows.select("doc_id", "th", "n", "key").join(by_key, "key", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "key", "group", F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))


def digest(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles, component_id."""
    return grouped(documents).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, that with the least id; documents with the empty set stay, rows that are alike count once.

    Where at most ``SENT_ROWS`` documents go or have rows that are alike, their ids are sent to all tasks and the other texts stay where they are;
    beyond that texts are shuffled, once.
    """
    keep: list[DataFrame] = []
    with owned(keep):
        rows = cut(grouped(docs), "grouped")
        first = rows.filter("n_shingles > 0 AND doc_id <=> component_id").groupBy("group").agg(F.min(F.struct("doc_id", "key", "th")).alias("x"))
        stays = first.select("x.doc_id", "x.th").unionByName(rows.filter("n_shingles = 0").select("doc_id", "th"))
        both = rows.select("doc_id", "th", F.lit(1).alias("rows"), F.lit(False).alias("stays")).unionByName(stays.withColumns({"rows": F.lit(0), "stays": F.lit(True)}))
        facts = cut(both.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_ih")).agg(F.sum("rows").alias("rows"), F.max("stays").alias("stays")), "row-facts")
        keep.append(facts)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_th"))
    met = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_ih"))
    odd = facts.filter("rows > 1 OR NOT stays").select("_id", "_ih")
    alike = facts.filter("rows > 1 AND stays").select("_id", "_ih")
    if odd.count() > SENT_ROWS:
        out = packed.join(facts.filter("stays").select("_id", "_ih"), met, "left_semi").dropDuplicates(["_own", "_th"])
    else:
        out = packed.join(F.broadcast(odd), met, "left_anti")
        if not alike.isEmpty():
            out = out.unionByName(packed.join(F.broadcast(alike), met, "left_semi").dropDuplicates(["_own", "_th"]))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
