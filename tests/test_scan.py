"""Scans over ranges against plain loops; one hot group spans all ranges."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, metrics, scan


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables keep their ranges, so that something is carried over."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_running_and_following_over_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, 1, 2])) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r.i: (r.place, r.total) for r in scan.running(frame, "g", ["i"], {"total": "v"}).collect()}
    after = {r.i: r.next for r in scan.following(frame, "g", ["i"], "v", "next").collect()}
    for g in ("hot", "a", None):
        own = [r for r in rows if r[0] == g]
        for n, (_, i, v) in enumerate(own):
            assert got[i] == (n, sum(x[2] or 0 for x in own[: n + 1]))
            assert after[i] == (own[n + 1][2] if n + 1 < len(own) else None)
    assert scan.dealt(frame, "g", ["i"]).filter("g = 'hot'").select("_range").distinct().count() > 1
    assert scan.running(frame.limit(0), "g", ["i"]).count() == 0


def test_parents_are_the_open_levels_of_the_whole_file(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([1, 2, 3, 3, 4, None]) if i % 3 else rng.randrange(2, 6), f"t{i % 50}") for i in range(500)]
    frame = spark.createDataFrame(rows, "file string, ord int, level int, title string")
    got = {r.ord: r.parents for r in chunking.parent_titles(frame).collect()}
    stacks = {}
    for f, o, level, title in rows:
        stack = stacks.get(f, [])
        assert got[o] == ([t for a, t in stack if a < level] if level is not None else [])
        if level is not None:
            stacks[f] = [s for s in stack if s[0] < level] + [(level, title)]
    assert len(got) == 500 and max(map(len, got.values())) >= 3
    assert chunking.parent_titles(frame.limit(0)).count() == 0


def test_percentiles_by_counts(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([7.5, rng.random(), None])) for g in ("a", "b", None) for _ in range(301)] + [("one", 2.0)]
    got = {r[0]: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in ("a", "b", None, "one"):
        own = sorted(v for h, v in rows if h == g and v is not None)
        at = [round(own[min(len(own) - 1, int(len(own) * p))], 6) for p in (0.5, 0.95, 0.99)]
        assert list(got[g])[1:] == [len(own), round(median(own), 6), *at]
    plan = metrics.percentiles(spark.range(9).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v")), "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert all("_range" in x for x in plan.split("\n") if "Window [" in x and "windowspecdefinition" in x)
