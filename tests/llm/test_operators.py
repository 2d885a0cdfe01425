"""The operators against brute force, on small hand-made tables with nulls, ties, repeats and clashing columns."""

import hashlib
import io
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import ann, components, jaccard_join, license_scan, line_dedup, mixing, packing, quality_model, quality_rules, substring_dedup, warc, wordhash
from lodestone.llm.tokens import WordTokens, default_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, block int, component_id long"
RNG = np.random.default_rng(5)
VOCAB = [f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(400)]


def prose(n, vocab=VOCAB):
    return " ".join(RNG.choice(vocab, n))


@pytest.fixture(scope="module")
def texts():
    long = prose(300)
    words = long.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    line = "This very line of text stands in many documents here."
    out = [long, near, long.upper(), None, "", " \n\t", "one two", "one two", "three", prose(30) + "\n" + line, prose(80) + "\n" + line + "\n" + prose(20), line, "\n".join([line] * 40), prose(60) + " " + " ".join(words[50:130]) + " " + prose(10), prose(5000), "*** &&& $$$ " * 40, "ÄÖ ß　x " * 30, "a\x1cb\x0bc d " * 20]
    out += [" ".join(words[:i] + ["x" + str(i)] + words[i + 1 :]) for i in range(0, 280, 7)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None, i, True, 1, 7) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, "s1", None, 0, None, None, None), (None, None, None, None, None, None, None, None, None), (1000, texts[1], "en", "", 1, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def words_of(t):
    return [w.decode() for w in (t or "").encode().split()]


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1


def brute_lines(rows):
    seen1, seen2, out = set(), set(), []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    done = {}
    for i, t in order:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        ls = t.split("\n")
        if (i, t) not in done:
            gone = [False] * len(ls)
            for k, x in enumerate(ls):
                gone[k] |= x in seen1 and len(x) >= line_dedup.MIN_CHARS
                seen1.add(x)
            for k in range(len(ls) - 1):
                pair = (ls[k], ls[k + 1])
                if pair in seen2:
                    gone[k] = gone[k + 1] = True
                seen2.add(pair)
            done[(i, t)] = gone
        gone = done[(i, t)]
        out.append((i, len(ls), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(ls, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    a, b = "a line that is long enough to count by itself, it is", "short"
    rows = [(3, f"{a}\n{b}\nx"), (1, f"y\n{a}"), (2, f"{b}\nx\n{b}\nx"), (4, None), (5, ""), (6, "\n\n\n"), (None, f"{b}\nx"), (7, f"{a}\n{a}\n{a}"), (3, f"{a}\n{b}\nx"), (8, "\n".join(f"l{i}" for i in range(70))), (9, "\n".join(f"l{i}" for i in range(70)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.digest(d)
    assert listed(got.select("doc_id", "n_lines", "n_removed", "kept_sha256")) == brute_lines(rows)
    assert got.filter("doc_id = 9").first().longest == 70 and got.filter("doc_id = 1").first().longest == 1 and got.filter("doc_id = 4").first().longest == 0
    kept = line_dedup.without_repeats(d.selectExpr("doc_id", "text", "1 AS pos", "2 AS removed"))
    assert kept.columns == ["doc_id", "text", "pos", "removed"] and {r.doc_id for r in kept.collect()} == {1, 4, 5, 8, None}
    assert line_dedup.digest(d.limit(0)).count() == 0


def test_suffix_array_and_longest_runs(spark):
    chance = np.random.default_rng(11)
    parts = [[f"p{chance.integers(6)}" for _ in range(n)] for n in (40, 13, 9, 5)]
    rows = []
    for i in range(25):
        ls = [f"own {i} {j}" for j in range(chance.integers(3))] + parts[chance.integers(4)][chance.integers(3) :] + [f"p{chance.integers(6)}" for _ in range(chance.integers(4))]
        rows.append((i, "\n".join(ls)))
    text = line_dedup.cut(line_dedup.line_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "text")
    all_lines = [(g, t.split("\n"), k) for (i, t), start in zip(rows, np.cumsum([0] + [t.count("\n") + 1 for _, t in rows])) for k, g in enumerate(range(start, start + t.count("\n") + 1))]
    tail = {(r.doc_id, r.pos): r.g for r in text.collect()}
    suffix = {tail[i, k]: t.split("\n")[k:] for i, t in rows for k in range(t.count("\n") + 1)}

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    array = line_dedup.suffix_array(text)
    order = [r.g for r in array.orderBy("k").collect()]
    best = {g: max(common(s, t) for h, t in suffix.items() if h != g) for g, s in suffix.items()}
    assert set(order) == {g for g, n in best.items() if n} and [r.k for r in array.orderBy("k").collect()] == list(range(len(order)))
    lcp = {r.k: r.lcp for r in line_dedup.common_prefixes(array).collect()}
    assert [lcp[k] for k in range(len(order))] == [0] + [common(suffix[a], suffix[b]) for a, b in zip(order, order[1:])]
    _, longest = line_dedup.repeated(text)
    assert {r.g: r.longest for r in longest.collect()} == {g: n for g, n in best.items() if n} and len(all_lines) == len(suffix)
    got = {r.doc_id: r.longest for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: max(best[tail[i, k]] for k in range(t.count("\n") + 1)) for i, t in rows}


def test_short_lines_of_many_documents(spark):
    rows = [(i, f"own {i}\nAll rights reserved.\nmine {i}\nyes\nits {i}" + ("\nonly two hold it" if i < 2 else "")) for i in range(4)]
    rows.append((4, "one of one\na\none of one\nb\none of one"))
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, ls in got.items() if "All rights reserved." in ls] == [0]
    assert all("yes" in got[i] for i in range(4)) and "only two hold it" in got[1] and got[4].count("one of one") == 3


# --- 2


def test_quality_rules(docs, texts):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.digest(docs).collect()}
    for i, t in enumerate(texts):
        w = words_of(t)
        full = [x for x in (t or "").split("\n") if x.encode().split()]
        wins = defaultdict(list)
        for k in range(len(w) - 2):
            wins[tuple(w[k : k + 3])].append(k)
        cover = {k + j for ks in wins.values() if len(ks) > 1 for k in ks for j in range(3)}
        r = got[(i, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t or ""), len(full) - len(set(full)), len(cover)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert got[(0, 300)].kept and not got[(15, 120)].kept
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and quality_rules.digest(docs.limit(0)).count() == 0


def test_rule_order_changes_nothing(docs, monkeypatch):
    full = quality_rules.with_measures(docs.select("doc_id", "text"))
    full = full.withColumns({f"_{n}": quality_rules.F.col(n) for n in quality_rules.CHEAP})
    for measure in (quality_rules.F.col, quality_rules._measure):
        verdicts = [listed(full.select("doc_id", quality_rules.cascade(list(o), measure).alias("k"))) for o in (quality_rules.RULES, quality_rules.RULES[::-1])]
        assert verdicts[0] == verdicts[1]
    first = quality_rules.judge(docs.select("doc_id", "text"))
    kept = listed(first.filter("kept").select("doc_id"))
    failed = listed(first.select("doc_id", "failed_rule"))
    assert listed(quality_rules.keep_good(docs.select("doc_id", "text")).select("doc_id")) == kept and kept
    monkeypatch.setattr(quality_rules, "order_rules", lambda texts, rules, n: list(reversed(rules)))
    assert listed(quality_rules.judge(docs.select("doc_id", "text")).select("doc_id", "failed_rule")) == failed
    assert listed(quality_rules.keep_good(docs.select("doc_id", "text")).select("doc_id")) == kept


def test_dear_measures_stand_behind_the_cascade(docs):
    plan = quality_rules.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.split("\n") if "CASE WHEN" in x)
    assert line.index("CASE WHEN") < line.index("xxhash64")  # hashes of windows are taken within the CASE alone


# --- 3


def test_ann_recall_and_odd_vectors(spark):
    x = RNG.normal(size=(3000, 16))
    x[100:160] = x[100]
    rows = [(int(i), list(map(float, v)), 0) for i, v in enumerate(x)]
    rows += [(None, rows[0][1], 1), (5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0, None] * 8, 0), (5400, [1.0, 2.0], 0), (7, rows[7][1], 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in sorted(ann.digest(d).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        e = np.sqrt(((x - x[q]) ** 2).sum(1))
        e[q] = np.inf
        best = np.lexsort((np.arange(len(x)), e))[:10].tolist()
        hit += len({v for v, _ in found} & set(best))
        assert all(abs(s - e[v]) < 1e-12 for v, s in found) and len(found) == 10
    assert hit >= 0.9 * 10 * len(got)
    assert [v for v, _ in got[100]] == list(range(101, 111))
    assert ann.digest(d.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], d.schema)
    assert ann.digest(few).count() == 3


def test_ann_indexes_every_row_of_a_repeated_id(spark):
    x = {i: [1.0, float(i)] for i in range(50, 80)}
    rows = [*x.items(), (100, [1.0, 0.5]), (100, [1.0, 90.0]), (7, [1.0, 0.6]), (7, [-9.0, -9.0]), (7, [1.0, 0.4])]
    got = [tuple(r) for r in ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = []
    for q in (len(x), len(x) + 1):
        near = sorted((round(float(np.hypot(v[0] - rows[q][1][0], v[1] - rows[q][1][1])), 9), i) for at, (i, v) in enumerate(rows) if at != q)[:10]
        want += [(100, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted((q, n, i, round(d, 9)) for q, n, i, d in got) == sorted(want)


# --- 4


def test_mixing(docs, texts):
    got = mixing.digest(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.digest(docs.repartition(3)).collect()))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by = {(r.doc_id, r.size): r for r in got}
    for r in docs.collect():
        n = len(words_of(r.text))
        x = by[(r.doc_id, n)]
        assert 0 <= x.taken <= 2 * n
    for r, x in zip(sorted(docs.select("doc_id", "source", "text").collect(), key=lambda r: (str(r.doc_id), len(words_of(r.text)))), sorted(got, key=lambda r: (str(r.doc_id), r.size)), strict=True):
        sizes[r.source] += x.size
        taken[r.source] += x.taken
        target[r.source] = x.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        want = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[t] for t in free) for s in names}
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 3
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns and sum(len(words_of(r.text)) for r in rows.collect()) == sum(taken.values())
    assert mixing.digest(docs.limit(0)).count() == 0


def test_hypergeometric_moments(spark):
    from pyspark.sql import functions as F

    draw = mixing.hypergeometric(*(F.lit(x).cast("long") for x in (300, 90, 150)), mixing._unit(F.col("id")))
    r = spark.range(2000).agg(F.avg(draw).alias("m"), F.var_samp(draw).alias("v")).first()
    assert abs(r.m - 45) < 0.5 and abs(r.v - 15.8) < 2
    edge = spark.range(3).select(mixing.hypergeometric(F.lit(5).cast("long"), F.lit(5).cast("long"), F.col("id"), F.lit(0.3)).alias("x"))
    assert [x.x for x in edge.collect()] == [0, 1, 2]


def test_splitting_tree_over_many_sources(spark):
    q = [(0, i, int(x)) for i, x in enumerate(np.random.default_rng(2).integers(0, 9, 30))] + [(1, 7, 1), (1, 29, 4)]
    nodes = spark.createDataFrame([x for x in q if x[2]], "node long, ord long, q long")
    for fan in (3, 100):  # three levels of sources, and one
        got = defaultdict(int)
        total = Counter()
        for r in mixing.halves(nodes, 30, 0, fan).collect():
            got[r.node // 2, r.ord] += r.q
            total[r.node] += r.q
        assert dict(got) == {(n, o): x for n, o, x in q if x}
        for n in (0, 1):
            full = sum(x for m, _, x in q if m == n)
            assert (total[2 * n], total[2 * n + 1]) == (full // 2, full - full // 2)
    ends = {r.ord: r.by for r in mixing.shard_quotas(spark.createDataFrame([(i, 3) for i in range(20)], "ord long, times long"), 20, 8, 4).collect()}
    assert all(by[-1].end == 3 and [b.end for b in by] == sorted({b.end for b in by}) for by in ends.values()) and len(ends) == 20


def test_mix_of_many_sources(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id AS doc_id", "repeat('word ', int(1 + id % 7)) AS text", "concat('s', id % 150) AS source")
    want = listed(mixing.digest(rows).drop("shards"))
    monkeypatch.setattr(mixing, "FAN", 8)
    got = mixing.digest(rows)
    assert listed(got.drop("shards")) == want
    taken = got.groupBy("source_size", "target").agg(mixing.F.sum("taken").alias("t")).collect()
    assert all(r.target <= 2 * r.source_size for r in taken)


# --- 5


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    rows, by = packing.pack(docs).collect(), defaultdict(list)
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


@given(st.lists(st.integers(1, 60), max_size=40))
@settings(max_examples=60, deadline=None)
def test_bins_hold_every_piece_and_the_fullest_choice(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    used = defaultdict(int)
    for times, use in packing.bins(counts, 60):
        assert sum(k * n for k, n in use.items()) <= 60
        for k, n in use.items():
            used[k] += times * n
    assert dict(used) == counts
    reach = {0}
    for x in lengths:
        reach |= {r + x for r in reach if r + x <= 60}
    assert sum(k * n for k, n in packing.fullest(counts, 60).items()) == max(reach)


def test_word_tokens_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(default_path()), WordTokens()
    for x in ["Ünïcode… it's,!! İstanbul ΑΣ Σ.ΑΣ, a　b\x1c.c  ́x", "<|endoftext|>.A <|ENDOFTEXT|>", "12.5,...'s 'S x'LL… é. naïve’s ½.) Ⅷ!! ß ẞ ﬁ Å 日本語。한국어 คำ हिन्दी Ⓐ ª"]:
        assert np.frombuffer(w.ids(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


# --- 6


def test_substring_dedup(docs):
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert listed(substring_dedup.digest(docs)) == sorted(want, key=repr) and any(x[2] for x in want)
    assert substring_dedup.digest(docs.limit(0)).count() == 0


# --- 7


def test_license_scan(spark):
    gpl, mit = license_scan.TEMPLATES["GPL"][1], "Released under the MIT License."
    rows = [(1, prose(50) + "\n" + mit), (2, gpl), (3, prose(80)), (4, None), (5, ""), (None, mit), (1, prose(3)), (6, "x\n" * 200 + "Licensed under CC BY-NC 4.0."), (7, mit), (7, mit)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS family", "2 AS w")
    got = {(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(d).collect() if r.confirmed}
    assert got == {(1, 1, "MIT"), (2, 0, "GPL"), (None, 0, "MIT"), (6, 200, "CC-BY-NC"), (7, 0, "MIT")}
    assert license_scan.scan(d.limit(0)).count() == 0


def test_license_scan_beside_a_source_with_its_own_notice(spark):
    own = "Any apache license text here is licensed by Example Press, version two, released under house terms with the bsd and gnu software editors."
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, own if i % 3 == 0 else prose(20)) for i in range(600)] + [(1000 + i, t) for i, t in enumerate(lines)]
    got = {(r.doc_id, r.family) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.confirmed}
    assert got == {(1000, "Apache-2.0"), (1001, "MIT"), (1002, "GPL")}


def test_license_scan_tells_neighbouring_families_apart(spark):
    lines = {"CC-BY-SA": "Licensed under CC BY-SA 4.0.", "LGPL": license_scan.TEMPLATES["GPL"][1].replace("General", "Lesser General"), "AGPL": license_scan.TEMPLATES["GPL"][0].replace("General", "Affero General"), "all-rights-reserved": "All rights reserved.", "CC-BY": "Licensed under CC BY 4.0."}
    rows = [(f, t) for f, t in lines.items()] + [("Artistic", "Licensed under the Artistic License, Version 2.0."), ("several", "either version 3 of the License, or (at your option) any later version.")]
    rows += [(f"prose{i}", prose(20)) for i in range(100)]
    got = {(r.doc_id, r.family) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect() if r.confirmed}
    assert got == {(f, f) for f in lines}


#: Wordings that neither the templates nor the held-out ones have.
UNSEEN = [
    ("MIT", "You may use this module under the MIT license."), ("MIT", "License: MIT"), ("Apache-2.0", "Source files are covered by the Apache License, Version 2.0."),
    ("GPL", "You can redistribute it under the GNU General Public License."), ("BSD", "Provided under the BSD 3-Clause License, see below."), ("CC-BY", "The photos are licensed under CC BY 4.0."),
    ("CC-BY-SA", "This wiki is licensed under CC BY-SA 4.0."), ("CC-BY-ND", "These slides are licensed under CC BY-ND 4.0."), ("CC-BY-NC", "The songs are licensed under CC BY-NC 4.0."),
    ("LGPL", "Linked under the GNU Lesser General Public License, version 2.1."), ("AGPL", "Hosted under the GNU Affero General Public License."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"), ("EPL-2.0", "Code under the Eclipse Public License 2.0."),
    ("CC0", "Dedicated to the public domain under CC0 1.0."), ("Unlicense", "The tool is free and unencumbered software released into the public domain."), ("all-rights-reserved", "Example Press 2020. All rights reserved."),
]
NO_LICENSE = ["The license of the pilot was taken away.", "Apache tribes signed a treaty.", "Copyright is a difficult subject.", "She read the warranty of the phone.", "All rights of the child are listed here.", "Permission to land was refused.", "The public domain was a field.", "A version of the story exists."]


def test_license_model_on_unseen_wordings():
    model = license_scan.train([prose(20) for _ in range(200)])

    def best(t):
        chances = model.chances(license_scan.grams(license_scan.tokens(t)))
        return model.families[int(np.argmax(chances))] if max(chances) >= license_scan.LEAST_PROBABILITY else license_scan.UNKNOWN

    assert all(best(t) == f for f, ts in license_scan.TEMPLATES.items() for t in ts if license_scan.grams(license_scan.tokens(t)) - license_scan._idle())
    assert sum(best(t) == f for f, t in UNSEEN) >= 15
    assert sum(best(t) == license_scan.UNKNOWN for t in NO_LICENSE) >= 7
    assert sum(best(prose(20)) == license_scan.UNKNOWN for _ in range(50)) >= 49
    assert 0.25 < model.temperature < 4.0


def brute_scan(rows, model):
    """The scan in plain Python: every paragraph, the whole model, the templates' pairs."""
    ls, known = license_scan, {f: set().union(*(license_scan._pairs(license_scan.tokens(t)) for t in ts)) for f, ts in license_scan.TEMPLATES.items()}
    held, out = Counter(p for pairs in known.values() for p in pairs), set()
    for i, text in set(rows):
        for k, line in enumerate((text or "").split("\n")):
            w = ls.tokens(line)
            if not set(w) & set(ls.CUES) and not re.search(ls._MIT, line):
                continue
            chances = model.chances(ls.grams(w))
            best = int(np.argmax(chances))
            family = model.families[best]
            if family == ls.UNKNOWN or chances[best] < ls.LEAST_PROBABILITY:
                continue
            pairs = {" ".join(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else set(w)
            own = len(pairs & known[family])
            named = any(held[p] == 1 for p in pairs & known[family])
            out.add((i, k, family, round(chances[best], 4), round(own / len(pairs), 4), own / len(pairs) >= ls.LEAST_SHARED and own == max(len(pairs & x) for x in known.values()) and named))
    return out


def test_license_scan_is_that_of_brute_force(spark):
    model = license_scan.train([prose(20) for _ in range(200)])
    lines = [t for _, t in UNSEEN] + NO_LICENSE + license_scan.NEAR_MISSES + [t for ts in license_scan.TEMPLATES.values() for t in ts] + ["Licensed under the Mozilla Public License, version 2.0.", "mit dem Rad", "the MIT", ""]
    rows = [(i, f"{prose(6)}\n{t}\n{prose(4)}") for i, t in enumerate(lines)] + [(900, "\n".join(lines)), (None, lines[0]), (901, None), (902, " ".join([prose(20000), *lines]))]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 AS best", "2 AS row")
    got = {(r.doc_id, r.paragraph, r.family, round(r.probability, 4), round(r.shared, 4), r.confirmed) for r in license_scan.scan(d, model).collect()}
    assert got == brute_scan(rows, model)
    confirmed = {(i, f) for i, _, f, _, _, sure in got if sure}
    assert all(f == UNSEEN[i][0] for i, f in confirmed if i is not None and i < len(UNSEEN))  # right or unknown, never another license
    assert not any(len(UNSEEN) <= i < len(UNSEEN) + len(NO_LICENSE) for i, _ in confirmed if i is not None)


def test_license_scan_scores_paragraphs_without_a_word_of_licenses(spark):
    rows = [(1, prose(30) + "\n" + license_scan.TEMPLATES["Unlicense"][1]), (2, prose(30)), (3, "\u6587\u5b57")]  # "Anyone is free to copy ...", for which there was no cue
    d = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    assert [(r.doc_id, r.paragraph, r.family, r.shared, r.confirmed) for r in license_scan.scan(d).collect()] == [(1, 1, "Unlicense", 1.0, True)]


# --- 8


def test_quality_model_on_held_out_documents(spark):
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 5 == 0, i % 5 == 1
        t = prose(60)
        t = " ".join(x + "***" for x in t.split()) if bad else t + " nasty rotten words" if toxic else t
        rows.append((i, t))
        if i < 200:
            labels.append((i, 0 if bad else 1, int(toxic)))
    labels += [(None, 1, 0), (3, None, None), (999, 1, 1)]
    d = spark.createDataFrame(rows + [(None, None), (400, "")], "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.digest(d, l).collect()}
    right = sum(got[i].selected == (i % 5 > 1) for i in range(200, 300))
    assert right >= 90 and all(0 <= r.expected_grade <= 2 for r in got.values()) and None in got
    assert quality_model.digest(d, l.limit(0)).count() == len(rows) + 2 and quality_model.digest(d.limit(0), l).count() == 0


# --- 9


def brute_components(rows):
    def folded(t):
        return [w.decode() for w in (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]

    sets = []
    for i, t in rows:
        w = folded(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        same = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), (min(same) if same else None) if sets[a] else i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [jaccard_join.LIST_PAIRS, 3])
def test_jaccard_join(docs, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "LIST_PAIRS", most)
    assert listed(jaccard_join.digest(docs)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def plain_entries(tokens, since, turn, percent=80):
    """The new index entries of a set, token by token."""
    n = len(tokens)
    p = n - -(-n * percent // 100) + 1
    rare, frequent = [t for t, s in zip(tokens, since, strict=True) if s == 0], [t for t, s in zip(tokens, since, strict=True) if s]
    out = set(rare[:p]) - set([t for t, s in zip(tokens, since, strict=True) if s in (0, turn)][:p])
    hashed = lambda x: int(wordhash.mix(np.array([x % 2**64], np.uint64))[0])
    for octave in jaccard_join._octaves(n, percent) if len(rare) < p else []:
        of, length = defaultdict(list), len(rare)
        for t in frequent:
            if length >= p:
                break
            own = of[hashed(t) % max(1, 2**octave * (100 - percent) // 100 // jaccard_join.CLASS_TOKENS)]
            length += bool(own)
            out |= {(hashed(hashed(x + (octave << 48)) + t) | 1 << 63) - (1 << 64) for x in own}
            own.append(t)
    return sorted(out)


def test_index_entries_take_no_longer_where_many_tokens_are_frequent():
    random = np.random.default_rng(2)

    def run(m):
        """Seconds for sets of which some tokens are among ``m`` frequent ones; the entries must be right."""
        often = np.unique(random.integers(0, 1 << 47, m))
        turns, took = random.integers(1, 3, len(often)), 0.0
        for i in range(200):
            tokens = np.unique(np.concatenate([random.integers(0, 1 << 47, 5 + i % 60), random.choice(often, (0, 8, 90)[i % 3])]))
            start = time.perf_counter()
            got = jaccard_join._fresh(tokens, since := jaccard_join._since(tokens, often, turns), 2, 80)
            took += time.perf_counter() - start
            held = dict(zip(often.tolist(), turns.tolist(), strict=True)) if i < 30 else None
            if held is not None:
                assert since.tolist() == [held.get(t, 0) for t in tokens.tolist()] and got.tolist() == plain_entries(tokens.tolist(), since.tolist(), 2)
        return took

    run(100)
    assert run(300_000) < 20 * run(100)  # a pass over all frequent tokens for each set is some hundred times as long
    assert jaccard_join._since(np.array([3, 4]), np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == [0, 0]


def test_jaccard_join_of_a_family_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_PAIRS", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base, rows = prose(120).split(), []
    for i in range(50):
        w = list(base)
        for k in RNG.choice(24, RNG.integers(0, 9), replace=False):
            w[5 * k] = f"alt{k}"
        rows.append((i, " ".join(w) + " " + prose(3)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert listed(jaccard_join.digest(d)) == want and 1 < len({x[2] for x in want}) < 50
    monkeypatch.setattr(jaccard_join, "SENT_ROWS", 0)  # the way for tables of any size
    assert listed(jaccard_join.digest(d)) == want


def test_one_document_of_each_group(docs):
    kept = jaccard_join.one_of_each(docs)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len([1 for i, t in rows if t and t.startswith("w")]) < docs.count()
    ids = {i for i, n, c in brute_components([(r.doc_id, r.text) for r in docs.collect()]) if n and i == c}
    assert {i for i, t in rows if t and t.split() and i is not None} == ids
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_few_removals_leave_texts_where_they_are(spark, monkeypatch):
    F = line_dedup.F
    rows = [(0, "a b\nc"), (1, "a b\nc"), (2, ""), (3, "x y\nc"), (None, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    docs = own.union(own.filter("doc_id IN (1, 3)"))
    comp = F.when(F.col("doc_id") == 1, 0).otherwise(F.col("doc_id"))
    monkeypatch.setattr(jaccard_join, "grouped", lambda d: d.select("doc_id", F.xxhash64("text").alias("th"), F.length(F.coalesce("text", F.lit(""))).alias("n_shingles"), F.col("text").alias("key"), comp.alias("group"), comp.alias("component_id")))
    gone = own.filter("doc_id IN (1, 3)").select("doc_id", line_dedup._text_hash(F.col("text")).alias("th"), F.array(F.lit(1)).alias("removed"), F.lit(1).alias("longest"))
    monkeypatch.setattr(line_dedup, "removals", lambda d: gone)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for step in (line_dedup.without_repeats, jaccard_join.one_of_each):
            assert "Exchange hashpartitioning" not in step(own)._jdf.queryExecution().executedPlan().toString(), step
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for most in (1000, 0):  # 0: the ways for tables of any size
        monkeypatch.setattr(line_dedup, "SENT_PLACES", most)
        monkeypatch.setattr(jaccard_join, "SENT_ROWS", most)
        cut = sorted(((r.doc_id, r.text) for r in line_dedup.without_repeats(docs).collect()), key=repr)
        assert cut == sorted([(0, "a b\nc"), (1, "a b"), (1, "a b"), (2, ""), (3, "x y"), (3, "x y"), (None, None)], key=repr), most
        one = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()), key=repr)
        assert one == sorted([(0, "a b\nc"), (2, ""), (3, "x y\nc"), (None, None)], key=repr), most


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10


def test_warc(spark):
    big, other = "x" * 2000, "é" * 700
    rows = [(1, "http://a/1", big), (5, "http://a\r\nb/ é", big), (3, None, big), (9, "u", "small"), (8, "u", "small"), (2, "u", None), (None, "u", big), (7, "u", other), (4, "u", other), (5, "again", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS revisit")
    want = []
    for i, _, t in rows:
        p = (t or "").encode()
        same = [j for j, _, x in rows if (x or "") == (t or "") and j is not None]
        back = len(p) >= 1000 and i != max(same)
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if back else "response", max(same) if back else None))
    assert listed(warc.round_trip(d)) == sorted(want, key=repr)
    assert warc.round_trip(d.limit(0)).count() == 0


def test_broken_archives_raise():
    records = [warc.record(i, "http://x", p, hashlib.sha1(p).hexdigest(), None, False) for i, p in enumerate([b"", b"abc", b"z" * 5000])]
    out = io.BytesIO()
    assert warc.write_archive(out, records) == 3
    data = out.getvalue()
    assert [r["payload"] for r in warc.read_bytes(data)] == [b"", b"abc", b"z" * 5000] and warc.read_bytes(b"") == []
    flipped = bytearray(data)
    flipped[-20] ^= 255
    for broken in (data[:-3], data[:6], data[:40], bytes(flipped), b"garbage!" + data):
        with pytest.raises(warc.WarcError):
            warc.read_bytes(broken)
    good = records[1]
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good[:-1], good.replace(b"abc", b"abd")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


# --- hashing


@given(st.lists(st.text(alphabet="aB é\t\n\x0b　x"), max_size=8))
@settings(max_examples=80, deadline=None)
def test_word_hashes_follow_words(texts):
    data = [t.encode() for t in texts]
    seen = {}
    for first, words, at in wordhash.hashed(data, lower=True):
        for i in range(len(at) - 1):
            own = [w.lower() if w.isascii() else w for w in data[first + i].translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]
            assert len(own) == at[i + 1] - at[i]
            for w, h in zip(own, words[at[i] : at[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_suffix_lookups_shuffled_or_sent(spark, monkeypatch):
    from lodestone.llm import line_dedup

    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd"), (3, "c\nd\ne\na"), (4, "")]
    text = line_dedup.cut(line_dedup.line_text(spark.createDataFrame(rows, "doc_id long, text string")), "line-text")

    def order() -> list:
        array = line_dedup.suffix_array(text)
        return sorted(map(tuple, array.select("k", "g", "last", "first").join(line_dedup.common_prefixes(array), "k").collect()))

    sent = order()
    monkeypatch.setattr(line_dedup, "SENT_ROWS", 0)
    assert order() == sent and max(x[-1] for x in sent) == 4
