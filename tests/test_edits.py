"""The edit-distance join against all pairs."""

import random

from lodestone.operators import chunking, edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        text = rng.choice([text[:i] + rng.choice("abé") + text[i:], text[:i] + text[i + 1 :], text[:i] + rng.choice("ab😀") + text[i + 1 :]])
    return text


def test_near_texts_are_all_pairs_of_every_length(spark):
    rng = random.Random(5)
    asked = [(f, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))) for f in "fg" for _ in range(90)]
    held = [(f, edited(rng, t, rng.randrange(5))) for f, t in asked] + [("f", "x" * 3000), ("f", ""), ("g", None), (None, "ab")]
    asked += [("f", "x" * 2999 + "y"), (None, "ab"), ("f", None), ("g", "")]
    for most in (1, 2, 3):
        got = edits.near_texts(spark.createDataFrame(asked, "file string, asked string"), spark.createDataFrame(held, "file string, held string"), "file", most).collect()
        want = {(f, a, b) for f, a in asked for g, b in held if f is not None and f == g and a is not None and b is not None and abs(len(a) - len(b)) <= most and distance(a, b) <= most}
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want, most


def test_title_lines_are_the_first_on_their_pages_without_a_nested_loop(spark):
    rng = random.Random(6)
    toc = [("f", i, f"title {rng.randrange(12)} of it", rng.choice([i * 7, rng.randrange(700)]), 900) for i in range(80)] + [("f", 80, None, 1, 900), ("g", 0, "no line", 5, 3)]
    lines = [("f", rng.randrange(950), n, edited(rng, f"title {rng.randrange(12)} of it", rng.randrange(4))) for n in range(1500)] + [("f", 3, 2000, None), (None, 3, 1, "no line"), ("g", 5, 1, "no line")]
    frame = spark.createDataFrame(toc, "file string, ord int, title string, page int, last_page int")
    found = chunking.title_lines(frame, spark.createDataFrame(lines, "file string, page int, line_no int, line string"))
    want = {}
    for (f, o, t, first, last), after in zip(toc, toc[1:] + [(None,) * 5]):
        end = after[3] if after[0] == f else last
        hits = [(p, n) for g, p, n, x in lines if g == f and t and x is not None and first <= p <= end and abs(len(t) - len(x)) <= 2 and distance(t, x) <= 2]
        if hits:
            want[f, o] = min(hits)
    assert {(r.file, r.ord): (r.page, r.line_no) for r in found.collect()} == want and len(want) > 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and all("=" in x for x in plan.split("\n") if "Join Inner" in x)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
