"""Chunks packed by jumps against a fold over each file."""

import numpy as np
import pytest

from lodestone.operators import chunking


def folded(chunks, above, target):
    out = []
    for f in {c[0] for c in chunks}:
        own, packs = sorted((c for c in chunks if c[0] == f), key=lambda c: c[1]), []
        for _, _, title, page, text in own:
            if len(own) > above and packs and len(packs[-1][2]) + len(text) <= target:
                packs[-1][2] += "\n" + text
                packs[-1][3] += 1
            else:
                packs.append([title, page, text, 1])
        out += [(f, i, *p) for i, p in enumerate(packs)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("above", "target"), [(3, 20), (0, 0), (100, 20), (5, 10**6)])
def test_packs_are_those_of_a_fold(spark, above, target):
    chance = np.random.default_rng(4)
    chunks = [(f, 7 * i, f"t{i}", i, "x" * int(chance.choice([0, 1, 5, 9, 10, 11, 19, 20, 21, 50]))) for f, n in (("a", 40), ("b", 4), ("c", 1), (None, 9)) for i in range(n)]
    rows = spark.createDataFrame(chunks, "file string, chunk long, title string, page long, text string")
    got = chunking.merged_chunks(rows, above, target).select("file", "chunk", "title", "page", "text", "parts").collect()
    assert sorted(map(tuple, got), key=str) == folded(chunks, above, target)
    assert chunking.merged_chunks(rows.limit(0), above, target).isEmpty()
