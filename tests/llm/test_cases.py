"""Odd tables for every operator, who deletes tables, and dense references."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone import tables
from lodestone.llm import ann, draw, jaccard_join, license_scan, line_dedup, mixing, ordering, packing, quality_model, quality_rules, substring_dedup, warc
from lodestone.tables import cut, owned, release

RNG = np.random.default_rng(17)
VOCAB = [f"v{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(400)]


def reseed(seed):
    RNG.bit_generator.state = np.random.default_rng(seed).bit_generator.state


@pytest.fixture(autouse=True)
def own_texts(request):
    """A test draws the same texts alone as among others."""
    reseed(zlib.crc32(request.node.name.encode()))


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CLASH = ["c", "n", "g", "h", "s", "row", "key", "rep", "th", "_th", "_row", "_kept", "at", "first", "last", "span", "removed", "size", "block", "shards", "kept", "_text", "number", "piece", "tokens", "label", "grade"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, repeats, empty and long texts, and columns under the names that operators use inside."""
    reseed(17)
    long, copy = prose(30_000), prose(120)
    rows = [(0, long, "a"), (1, copy, "a"), (2, copy, None), (2, copy, None), (3, copy + " tail", "b"), (None, copy, "b"), (None, None, None), (5, None, "a"), (6, "", "a"), (7, " \n ", "a"), (8, f"{prose(60)}\nLicensed under CC BY 4.0.", "c"), (9, long[: len(long) // 2], "c")]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return base.withColumn("lang", F.lit("en")).withColumns({c: F.lit(7) for c in CLASH})


RUNS = {
    "op1": lambda d: line_dedup.digest(d), "op1 rows": lambda d: line_dedup.without_repeats(d), "op2": lambda d: quality_rules.digest(d), "op2 rows": lambda d: quality_rules.keep_good(d),
    "op4": lambda d: mixing.digest(d), "op4 rows": lambda d: mixing.mix(d), "op5": lambda d: packing.pack(d), "op6": lambda d: substring_dedup.digest(d), "op7": lambda d: license_scan.scan(d),
    "op8": lambda d: quality_model.digest(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), F.lit(2).alias("grade"))), "op9": lambda d: jaccard_join.digest(d), "op9 rows": lambda d: jaccard_join.one_of_each(d),
}
SAME_ROWS = ("op1", "op2", "op4", "op6", "op8", "op9")


@pytest.mark.parametrize("name", RUNS)
def test_names_inside_do_not_clash_and_tables_go(spark, odd, name):
    folder = tables.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = RUNS[name](odd)
    plain = RUNS[name](odd.select("doc_id", "text", "source", "lang"))
    kept = listed(out.select(*plain.columns))
    assert kept == listed(plain) and (name not in SAME_ROWS or len(kept) == odd.count())
    if name.endswith("rows"):
        assert out.columns == odd.columns and all(r["_th"] == 7 and r["block"] == 7 for r in out.collect())
    made = set(os.listdir(folder)) - before
    read = {p.split("/")[-2] for d in (out, plain) for p in d.inputFiles()}
    assert made <= read, "the shared folder holds nothing but what the result reads"


@pytest.mark.parametrize("name", RUNS)
def test_empty_and_all_null_tables(spark, odd, name):
    assert RUNS[name](odd.limit(0)).count() == 0
    nulls = odd.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    got = RUNS[name](nulls)
    if name in SAME_ROWS:
        assert got.count() == 3


def test_owned_tables(spark):
    folder = tables.shared_dir(spark).removeprefix("file://")
    keep = []
    with owned(keep):
        a = cut(spark.range(3).toDF("x"), "a")
        with owned([]):
            cut(spark.range(3).toDF("x"), "b")
        keep.append(a)
    left = [x for x in os.listdir(folder) if x.startswith(("a-", "b-"))]
    assert len(left) == 1 and a.count() == 3
    release(a)
    release(a)  # what is gone is gone
    assert not [x for x in os.listdir(folder) if x.startswith("a-")]


def test_a_cluster_without_a_shared_folder_raises():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(Session())


def test_draws_are_bounded_and_the_same(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("x")).repartition(9)
    got = draw.least(rows, 50, F.xxhash64("id"))
    assert len(got) == 50 and got == draw.least(rows.repartition(2), 50, F.xxhash64("id"))
    want = sorted(rows.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("h")).collect(), key=lambda r: (r.h, r.id))[:50]
    assert [r.id for r in got] == [r.id for r in want]
    assert 1 <= len(draw.least(rows.select("x"), 50, F.xxhash64(F.lit(1)))) <= 50 and draw.least(rows.limit(0), 5, F.xxhash64("id")) == []


def test_running_sums(spark):
    x = [int(v) for v in RNG.integers(0, 50, 300)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, v long").repartition(7)
    got = ordering.running(rows, ["v", "i"], {"upto": "v"}).orderBy("k").collect()
    order = sorted((v, i) for i, v in enumerate(x))
    assert [(r.v, r.i) for r in got] == order and [r.k for r in got] == list(range(300)) and [r.upto for r in got] == np.cumsum([v for v, _ in order]).tolist()
    assert ordering.running(rows.limit(0), ["v", "i"]).count() == 0


@pytest.mark.parametrize(("window", "seed"), [(6, 3), (5, 5), (8, 2)])
def test_substring_dedup_of_many_overlaps(spark, window, seed):
    chance = np.random.default_rng(window)
    passages = [[f"q{chance.integers(9)}" for _ in range(n)] for n in (30, 12, 7)]
    rows = []
    for i in range(40):
        parts = [[f"own{i}x{j}" for j in range(chance.integers(4))] + passages[chance.integers(3)][chance.integers(5) :][: chance.integers(4, 30)] for _ in range(chance.integers(1, 4))]
        rows.append((int(i // 2) if i % 5 else i, " ".join(sum(parts, []))))
    rows += [(None, rows[0][1]), (50, None)]
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t in rows:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert listed(substring_dedup.digest(d, window, seed)) == sorted(want, key=repr)


def test_near_copies_without_ids_in_seconds(spark):
    words = prose(100).split()
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(100)]
    rows = [(None, texts[i % 100]) for i in range(4000)] + [(7, texts[0]), (8, texts[99])]
    got = jaccard_join.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {(r.n_shingles, r.component_id) for r in got.collect()} == {(96, 7)} and got.count() == 4002


def test_jaccard_join_names_more_frequent_tokens_by_turns(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_PAIRS", 2)
    passage = prose(40).split()
    rows = []
    for i in range(60):  # a passage that all share, own words, and a near copy of every third
        own = [f"o{i}x{j}" for j in range(45)]
        rows.append((i, " ".join(own[:20] + passage + own[20:])))
        if i % 3 == 0:
            rows.append((100 + i, " ".join(own[:20] + passage + own[20:-1] + ["other"])))
    want = {i: (i - 100 if i >= 100 else i) for i, _ in rows}
    for rounds in (4,):
        monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
        assert {r.doc_id: r.component_id for r in jaccard_join.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_ordinal_fit_descends_the_likelihood_and_scores_like_a_dense_model(spark):
    texts = [prose(30) + (" bad rot" if g == 0 else " fine calm" if g == 2 else "") for g in np.tile([0, 1, 2], 60)]
    grades = np.tile([0, 1, 2], 60)
    rows = list(quality_model.features([t.encode() for t in texts]))
    model = quality_model.fit(rows, grades)
    dense = np.zeros((len(rows), quality_model.DIM), np.float32)
    for i, r in enumerate(rows):
        dense[i, r] = 1

    def loss(w, t):
        above = 1 / (1 + np.exp(-((dense @ w)[:, None] - t[None, :])))
        p = np.concatenate([np.ones((len(rows), 1)), above], 1) - np.concatenate([above, np.zeros((len(rows), 1))], 1)
        return -np.log(p[np.arange(len(rows)), grades]).mean()

    start = quality_model.fit([], np.tile([0, 1, 2], 1)).thresholds
    assert loss(model.weights, model.thresholds) < 0.5 * loss(np.zeros(quality_model.DIM), start) and (np.diff(model.thresholds) >= 0).all()
    # at the end every direction is flat but for the penalty: numeric gradients by thresholds and by the heaviest weights
    for k in range(2):
        step = np.eye(2)[k] * 1e-4
        assert abs(loss(model.weights, model.thresholds + step) - loss(model.weights, model.thresholds - step)) / 2e-4 < 1e-2
    for f in np.argsort(-np.abs(model.weights))[:10]:
        step = np.zeros(quality_model.DIM)
        step[f] = 1e-3
        slope = (loss(model.weights + step, model.thresholds) - loss(model.weights - step, model.thresholds)) / 2e-3
        assert abs(slope + quality_model.L1 * np.sign(model.weights[f])) < 5e-3
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    above = 1 / (1 + np.exp(-((dense @ model.weights)[:, None] - model.thresholds[None, :])))
    for r in quality_model.score(d, model).collect():
        assert abs(r.expected_grade - above[r.doc_id].sum()) < 1e-4 and abs(r.tail_probability - above[r.doc_id, 1]) < 1e-4 and r.selected == (r.tail_probability >= 0.5)


def test_warc_of_long_payloads_and_the_least_size(spark):
    at, under, long = "a" * 1000, "b" * 999, prose(200_000)
    rows = [(1, at), (2, at), (3, under), (4, under), (5, long), (6, long), (6, long), (None, long)]
    d = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("http://x/")).withColumn("digest", F.lit(1)).repartition(3)
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(d).collect()]
    n = len(long.encode())
    assert sorted(got, key=repr) == sorted([(1, 1000, "revisit", 2), (2, 1000, "response", None), (3, 999, "response", None), (4, 999, "response", None), (5, n, "revisit", 6), (6, n, "response", None), (6, n, "response", None), (None, n, "revisit", 6)], key=repr)


def test_warc_refers_to_what_is_there(spark):
    records = spark.createDataFrame([(1, "d", "response", None), (2, "d", "revisit", 1), (3, "e", "revisit", 1), (4, "d", "revisit", 9)], "page_id long, payload_digest string, record_type string, refers_to long")
    assert sorted((r.refers_to, r.payload_digest) for r in warc.dangling(records).collect()) == [(1, "e"), (9, "d")]
    with pytest.raises(warc.WarcError):
        warc._headers(b"\xff\xfe: x\r\n\r\n", "record")


def test_recall_of_the_permutation_index(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("tables are not here")
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    hit = total = 0
    for q in [i for i in x if i % 100 == 0]:
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        best = [int(i) for _, i in sorted(zip(d, ids)) if i != q][:10]
        hit += len(set(best) & {r.vec_id for r in ann.digest(e).filter(F.col("query_id") == q).collect()})
        total += 10
    assert hit >= 0.9 * total


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    for name, docs in (("odd", odd), ("none", odd.limit(0)), ("no ids", odd.withColumn("doc_id", F.lit(None).cast("long")))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (got.count() == 0) == (name == "none") and "sequence_id" in got.columns
    folder = tables.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert set(os.listdir(folder)) - before <= {p.split("/")[-2] for p in out.inputFiles()} | {x for x in os.listdir(folder) if x.startswith("mixing-")}


def test_rules_are_sampled_by_all_tasks(spark, monkeypatch):
    asked = []

    def seen(df, label):
        asked.append((label, df.rdd.getNumPartitions()))
        return cut(df, label)

    monkeypatch.setattr(quality_rules, "cut", seen)
    texts = spark.createDataFrame([(prose(60),)] * 90, "_in string").repartition(9)
    ordered = quality_rules.order_rules(texts, quality_rules.RULES, sample_rows=40)
    assert set(ordered) == set(quality_rules.RULES) and asked == [("rule-sample", 9)]


def test_kept_rows_are_those_that_the_verdict_keeps(spark):
    half = " ".join(["same three words"] * 20) + " " + prose(40)
    docs = spark.createDataFrame([(1, half), (2, prose(80)), (3, prose(10)), (4, None)], "doc_id long, text string")
    for rules in (quality_rules.RULES, quality_rules.RULES[:1]):
        kept = {r.doc_id for r in quality_rules.judge(docs, rules).filter("kept").collect()}
        assert {r.doc_id for r in quality_rules.keep_good(docs, rules).collect()} == kept and 1 not in kept and 2 in kept


@pytest.mark.parametrize("missing", [0, 1, 2])
def test_ordinal_fit_without_a_grade_or_with_one_text(missing):
    grades = np.array([g for g in [0, 1, 2] * 20 if g != missing])
    rows = list(quality_model.features([f"{prose(30)} {'bad' if g == 0 else 'odd' if g == 1 else 'fine'}".encode() for g in grades]))
    model = quality_model.fit(rows, grades)
    assert (np.diff(model.thresholds) >= 0).all() and np.isfinite(model.weights).all()
    assert len(quality_model.fit(rows[:1], grades[:1]).weights) == quality_model.DIM
