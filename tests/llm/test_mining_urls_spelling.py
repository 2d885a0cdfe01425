"""Hard negatives, URL filters and spelling variants against brute force, on odd tables."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, spelling, url_filters


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def mined(rows, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) of (vec_id, label, vector) by scoring every pair."""
    kept = []
    for v, label, x in rows:
        if v is not None and label is not None and x and all(c is not None and np.isfinite(c) for c in x):
            kept.append((v, (label + 1) % 10 if v % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    size = Counter(len(x) for _, _, x in kept)
    dim = max(size, key=lambda d: (size[d], d), default=0)
    kept, out = [r for r in kept if len(r[2]) == dim], []
    for i, (a, label, x) in enumerate(kept):
        if a % 100:
            continue
        met = [(-sum(p * q for p, q in zip(x, y)), b, m) for j, (b, m, y) in enumerate(kept) if j != i]
        for s, b, _ in sorted(m for m in met if m[2] == label)[:positives]:
            hard = sorted((t, c) for t, c, m in met if m != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a, b, k, c, -s, -t) for k, (t, c) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    clash = ["row", "x", "code", "anchor", "of", "low", "high", "bar", "score", "rank", "at", "ax", "_n"]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(3) for c in clash}).repartition(5)


def made(seed, n, dim=6, labels=3):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, dim)).astype(np.float32) / 2
    return [(int(i), [float(c) for c in x[i]], int(random.integers(labels))) for i in range(n)]


def test_hard_negatives_of_every_pair(spark):
    rows = made(1, 420) + made(2, 40)  # repeated ids, other vectors
    rows += [(500 + i, rows[5][1], i % 2) for i in range(120)]  # a vector that is very common
    rows += [(None, rows[0][1], 1), (900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] + [0.0] * 5, 1), (1000, rows[3][1], None), (906, [1.0] * 3, 1), (1100, [0.0] * 6, 1), (910, [3e38] * 6, 1)]
    want = mined([(v, label, x) for v, x, label in rows if x is None or 3e38 not in x])
    assert len(want) > 200
    assert listed(hard_negatives.digest(vectors(spark, rows))) == want


@pytest.mark.parametrize("cells,slices", [(2, 2048), (16, 1)])
def test_hard_negatives_do_not_depend_on_cells_or_slices(spark, cells, slices):
    rows = [(v, label, [int(256 * c) for c in x]) for v, x, label in made(3, 320)]
    d = spark.createDataFrame(rows, "vec_id long, label int, x array<long>")
    got = [listed(hard_negatives.mine(d, F.col("vec_id") % 100 == 0, 3, 4, cells=c, slice_rows=s)) for c, s in ((256, 2048), (cells, slices))]
    assert got[0] == got[1] and got[0]


def test_bounds_hold_the_score_and_few_rows_are_scored(spark):
    rows = [(v, label, [int(256 * c) for c in x]) for v, x, label in made(4, 2000, labels=2)]
    d = hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, label int, x array<long>"))
    inner, lo, hi = hard_negatives.fit_cells(d, 6)
    a = d.filter("vec_id = 0").first()
    x = {r.row: (r.label, r.x) for r in d.collect()}
    sent = hard_negatives._scan(hard_negatives.approximated(d, inner), [(a.row, a.label, np.array(a.x), [(0, None, None)])], lo, hi, 5, True).collect()
    same = {r: sum(p * q for p, q in zip(v, a.x)) for r, (label, v) in x.items() if label == a.label and r != a.row}
    assert all(r.low <= same[r.row] <= r.high for r in sent)
    bar = sorted(same.values())[-5]
    assert {r for r, s in same.items() if s >= bar} <= {r.row for r in sent} and len(sent) < 0.2 * len(same)


def test_hard_negatives_of_nothing(spark):
    none = vectors(spark, [(1, [0.5], 1)]).limit(0)
    assert hard_negatives.digest(none).count() == 0 and hard_negatives.digest(vectors(spark, [(1, [0.5], 1)])).count() == 0
    assert hard_negatives.digest(vectors(spark, [(None, None, None)])).count() == 0
    assert hard_negatives.digest(vectors(spark, [(100, [0.5], 1)])).count() == 0  # an anchor alone
    with pytest.raises(ValueError, match="byte"):
        hard_negatives.mine(spark.createDataFrame([(1, 1, [1])], "vec_id long, label int, x array<long>"), F.lit(True), cells=300)


URLS = ["http://a.net/x", "https://NET/", "http://xnet/", "http://net", "http://net?x", "http://example.net/en/1", "http://deep.example.net/en/", "http://example.net/EN/", "http://example.net/en", "http://www.example.com/de/?q", "http://fr.org/fr/x#y", "no scheme.net/", None, "", "://", "x://y://net/", "http://net:80/", "http://user@net/", "http://.net/", "http://net./", "http://a..net//", "http://example.net/en/?http://a.net/", "HTTP://Ä.ORG/fr/É?"]


def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


@pytest.mark.parametrize("sent", [url_filters.SENT_RULES, 0])
def test_urls_by_every_rule(spark, sent):
    rules = [*url_filters.RULES, ("example.net", "/en/1", "block"), ("y", "", "block"), ("a.net", "/", "allow"), ("net", "/x", "block"), ("net", "/x", "allow"), ("fr.org", "/f", "block"), ("www.example.com", "/", "allow"), ("", "/", "block"), ("net", "/", "maybe")]
    rows = [(i, u) for i, u in enumerate([*URLS, *["http://hot.net/en/"] * 300])] + [(None, "http://a.net/x"), (3, "http://net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "at", "short", "digest", "_row", "html")}).repartition(4)
    given = spark.createDataFrame([*rules, ("org", None, "allow"), (None, "/", "block"), ("de", "/", None)], "host string, path string, verdict string")
    want = sorted(((i, *judged(u, [*rules, ("org", "", "allow")])) for i, u in rows), key=repr)
    assert listed(url_filters.judge(pages, given, sent_rules=sent)) == want
    assert {w[4] for w in want} == {"allow", "block"}


def test_urls_of_the_query_and_of_nothing(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert listed(url_filters.digest(pages)) == sorted(((i, *judged(u, url_filters.RULES)) for i, u in enumerate(URLS)), key=repr)
    assert url_filters.digest(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert all(r.verdict == "allow" and r.rule is None for r in url_filters.judge(pages, none).collect())
    nulls = spark.createDataFrame([(None, None)], "page_id long, url string")
    assert listed(url_filters.digest(nulls)) == [(None, "", "", None, "allow")]


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    near = {w: [o for o in counts if distance_one(w, o)] for w in counts}
    form = {}
    for w, those in near.items():
        best = min(those, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def noisy(docs):
    words = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def test_spelling_variants_of_every_pair(spark):
    random = np.random.default_rng(5)
    stems = ["".join(random.choice(list("abÀÉö"), random.integers(4, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Größe", "GRÖSSE"]
    text = lambda n: " ".join(random.choice(stems, n))
    docs = [(i, text(int(random.integers(1, 300)))) for i in range(60)] + [(None, text(50)), (None, None), (3, ""), (3, text(200)), (7, "l" * 3000 + " " + "l" * 3000 + "\n" + "l" * 3000 + " " + " ".join(["l" * 2999] * 9))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "run", "id", "h", "form", "root", "moved")}).repartition(4)
    counts = noisy(docs)
    assert len(counts) > 40
    got = listed(spelling.digest(d))
    assert got == grouped(counts) and any(w[1] for w in got)


def test_roots_follow_long_ways(spark):
    words = ["a" * i + "b" * (40 - i) for i in range(41)]
    d = spark.createDataFrame([(w, 2**i) for i, w in enumerate(words)], "word string, n long")
    assert {r.root for r in spelling.groups(d).collect()} == {words[-1]}
    tie = spark.createDataFrame([("bench", 10), ("batch", 10), ("beach", 3), ("bach", 6), ("eins", 1), ("eis", 1)], "word string, n long")
    assert listed(spelling.groups(tie)) == grouped(dict(bench=10, batch=10, beach=3, bach=6, eins=1, eis=1))


def test_a_key_holds_few_words(spark):
    d = spark.createDataFrame([("".join(w), 1) for w in itertools.product("abc", repeat=7)], "word string, n long")
    assert spelling.keys(d).groupBy("key").count().agg(F.max("count")).first()[0] <= 3 * 8 + 1
    assert spelling.near_pairs(d).count() == 3**7 * 7 * 2


def test_spelling_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert spelling.digest(d).count() == 0 and spelling.digest(d.limit(0)).count() == 0


def test_no_table_of_words_or_keys_is_sent_to_the_driver(spark, monkeypatch):
    d = spark.createDataFrame([("bench", 20), ("batch", 10), ("beach", 3), ("bach", 5)], "word string, n long")
    met = []
    monkeypatch.setattr(spelling, "cut", lambda df, label, f=spelling.cut: (met.append(df), f(df, label))[1])
    met.append(spelling.groups(d))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in met]
    assert sum("Join" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
