"""Leaks that one slot, a short item or a small share must not hide."""

from lagweave.llm import decontam

WORDS = "amber basil cedar delta ember fable grove haven ivory jolly koala lemon maple noble ocean pearl quilt raven sugar tulip umbra vivid waltz xenon yacht zebra".split()
LONG = " ".join(f"{w}{'abcd'[k % 4]}" for k, w in enumerate(WORDS * 2))
STORY = "the old farmer sells 12 baskets of ripe fruit at the small market near the river and then walks home with 12 coins in the deep pocket of a brown coat"
MERGED = "a tall baker mixes 3 bowls of white flour with clean water before the early sun comes up and puts 5 loaves into the hot stone oven behind the shop"


def test_leaks_window_by_window(spark):
    items = [(1, STORY), (2, MERGED), (3, "green tea cools slowly"), (4, LONG), (5, "buy 3 red hats"), (6, "12 34")]
    twenty, twelve = " ".join(LONG.split()[10:30]), " ".join(LONG.split()[38:50])
    rows = [
        (1, "before it " + STORY.replace("12 coins", "15 coins") + " after it"),
        (2, "before it " + MERGED.replace("3 bowls", "7 bowls").replace("5 loaves", "7 loaves") + " after it"),
        (3, "we know that green tea, cools slowly in winter"),
        (4, f"some text {twenty} more text"),
        (5, f"some text {twelve} more text"),
        (6, "green tea cools fast and slowly"),
        (7, "they buy 8 red hats here"),
        (8, "counted 12 34 of them"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.n_windows) for r in decontam.leaks(docs, bench).collect()}
    n = len(STORY.split()) - 7
    at = STORY.split().index("coins")  # the edited number's place among the words, from 1
    lost = sum(p <= at < p + 8 for p in range(1, n + 1))
    assert got[1, 1] == ("copy", n - lost)
    assert got.pop((1, 1)) and got.pop((2, 2))[0] == "copy"
    assert got == {(3, 3): ("copy", 1), (4, 4): ("copy", 13), (7, 5): ("reparameterised", 1)}
    assert {r.doc_id for r in decontam.remove_leaks(docs, bench).collect()} == {5, 6, 8}


def test_tables_of_numbers_match_by_their_values(spark):
    table = lambda seed, n: " ".join(f"{(seed * 7919 + k * 104729) % 9973}{'.5' if k % 3 else ''}" for k in range(n))
    items = [(1, table(1, 300)), (2, "count " + table(2, 20))]
    docs = [(k, table(10 + k, 2000)) for k in range(3)] + [(5, "see " + table(1, 300) + " end"), (6, table(2, 20) * 2), (6, table(2, 20) * 2)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, pos int, h string")
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(5, 1), (6, 2)} and got[5, 1] == ("copy", 1.0)


def renamed(text, rng):
    """The item with every number and every name inside a sentence replaced, equal ones alike."""
    import re

    seen = {}

    def other(m):
        kind = "n" if m[0][0].isdigit() else "w"
        if (kind, m[0]) not in seen:
            seen[kind, m[0]] = str(len(seen) * 37 + int(rng.integers(1000, 9999))) if kind == "n" else "Q" + "".join(rng.choice(list("abcdefgh"), 6)) + "xyzuv"[len(seen) % 5]
        return seen[kind, m[0]]

    return re.sub(r"(?<=[a-z,;:] )[A-Z][a-z]+|(?<![\w.])[0-9]+(?![\w.])", other, text)


def test_planted_renamings_are_found(spark):
    """Items of the benchmark with numbers and names put in, planted under other numbers and names: at least nine in ten are found."""
    import numpy as np

    rng = np.random.default_rng(6)
    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()
    items, docs = [], []
    for r in rows:
        words = r.text.split()
        if len(words) < 12:
            continue
        for k in range(3, len(words) - 1, 6):
            words[k] = str(rng.integers(2, 999)) if k % 4 else "N" + "".join(rng.choice(list("abcde"), 5))
        item = " ".join(words)
        items.append((r.item_id, item))
        docs.append((r.item_id, "Some words before it. " + renamed(item, rng) + " And some after."))
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    hit = {r.doc_id for r in found.where("doc_id = item_id").collect()}
    assert len(items) > 20 and len(hit) >= 0.9 * len(items)
    assert all(a[1] not in b[1] for a, b in zip(items, docs))
