"""The pipeline's near-duplicate stage against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from lagweave.llm import jaccard


def brute(rows, words=5, similarity=0.8):
    """Least doc_id of every document's group, from all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] | sets[j])
            if i < j and (len(sets[i] & sets[j]) / both if both else 1) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def edited(rng, text, n):
    words = text.split()
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


def test_stage_drops_near_copies_at_eight_tenths(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(40, 400))))) for i in range(60)]
    for i in range(60, 180):
        of = rows[i % 60][1]
        rows.append((i, edited(rng, of, max(1, len(of.split()) * int(rng.integers(1, 6)) // 100))))
    rows += [(200, "one two"), (201, "One\ttwo"), (202, "one"), (203, ""), (204, None), (205, rows[0][1])]
    want = brute(rows)
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.groups(df).collect()} == want
    got = sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([None, *(i for i, low in want.items() if i == low)], key=str)


def test_long_band_of_copies_and_an_unlike_text_between(spark):
    rng = np.random.default_rng(4)
    of = " ".join(f"w{i}" for i in rng.integers(0, 3000, 200))
    rows = [(i, edited(rng, of, 1 if i % 3 else 9)) for i in range(60)]
    assert {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3000])
def test_large_band_of_texts_that_are_nearly_alike(spark, block):
    """A group about 0.7 alike, in which few pairs link, as one block and as many; one text is longer than a piece."""
    rng = np.random.default_rng(5)
    of = " ".join(f"w{i}" for i in rng.integers(0, 3000, 200))
    rows = [(i, edited(rng, of, 2 + i % 3)) for i in range(70)]
    long = " ".join(f"v{i}" for i in rng.integers(0, 9000, 2500))
    rows += [(100 + i, edited(rng, long, 10 + 30 * i)) for i in range(4)]
    want = brute(rows)
    assert len(set(want.values())) > 10 and len({want[100 + i] for i in range(4)}) < 4
    assert {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()} == want


def test_no_rows(spark):
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
