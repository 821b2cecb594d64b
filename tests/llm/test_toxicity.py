"""Toxic passages: segments against their definition, held-out documents, hard inputs."""

import math

import numpy as np
import pytest

from lagweave.llm import queries, toxicity

WORDS = [f"w{i}" for i in range(400)]
BAD = ["grumble", "snarl", "spite"]


def maximal(scores, offset=0):
    """The best contiguous sum, then the same on what lies left and right of it."""
    best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    s, a, b = best
    return [*maximal(scores[:a], offset), (offset + a, offset + b, s), *maximal(scores[b:], offset + b)]


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_their_definition(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(size=int(rng.integers(0, 26))) - rng.choice([0.0, 0.5])
    found, want = toxicity.segments(scores), maximal(scores.tolist())
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want])


def test_segments_of_ties_and_long_texts():
    assert toxicity.segments(np.zeros(5)) == [] and toxicity.segments(np.zeros(0)) == []
    assert toxicity.segments(np.array([1.0, -1.0, 1.0])) == [(0, 1, 1.0), (2, 3, 1.0)]
    assert toxicity.segments(np.array([2.0, -1.0, 2.0])) == [(0, 3, 3.0)]
    long = np.tile([3.0, -1.0], 200_000)
    assert toxicity.segments(long)[0][:2] == (0, 399_999)
    up = toxicity.segments(np.tile([1.0, -2.0], 100_000))
    assert len(up) == 100_000


def text(rng, bad, n=120):
    words = rng.choice(WORDS, n).tolist()
    for _ in range(bad):
        words[int(rng.integers(n))] = str(rng.choice(BAD)).capitalize() + str(rng.choice([",", ".", ""]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text(rng, 4 if i % 8 == 0 else 0)) for i in range(640)]
    labels = [(i, int(i % 8 == 0)) for i in range(480)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, toxic int").cache()


def test_held_out_documents(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    assert len(model.keys) == 3 and model.lam > 0 and 0 < model.k <= 1
    found = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    for i in range(480, 640):
        assert found[i].predicted == int(i % 8 == 0) and 0 <= found[i].score <= 1
        words = found[i].text.split()
        for p in found[i].passages:
            assert p.expected <= model.level and any(w.strip(",.").lower() in BAD for w in words[p.first : p.last + 1])
            assert words[p.first].strip(",.").lower() in BAD and words[p.last].strip(",.").lower() in BAD


def test_copies_of_one_text_count_once(spark, corpus):
    docs, labels = corpus
    copies = spark.range(10_000, 13_000).selectExpr("id as doc_id", f"'{' '.join(WORDS[:50])}' as text")
    more = labels.unionByName(spark.range(10_000, 13_000).selectExpr("id as doc_id", "1 as toxic"))
    model = toxicity.train(docs.unionByName(copies), more)
    assert len(model.keys) == 3


def test_hard_inputs(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    rows = [(None, "spite", 1), (1, None, 2), (2, "", 3), (3, " \t\n", 4), (4, "Spite! " * 300_000, 5), (4, "Spite! " * 300_000, 5), (5, "...", 6)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = toxicity.classify(odd, model).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert [r.predicted for r in found if r.doc_id == 4] == [1, 1]
    assert [len(r.passages) for r in found if r.doc_id in (1, 2, 3, 5)] == [0] * 4
    assert toxicity.classify(odd.limit(0), model).count() == 0
    for some in (labels.where("toxic = 0"), labels.limit(0), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        flat = {r.score for r in toxicity.classify(odd, toxicity.train(docs, some)).collect()}
        assert len(flat) == 1 and max(flat) < 0.6
    both = labels.unionByName(labels.selectExpr("doc_id", "1 - toxic as toxic"))
    assert len(toxicity.train(docs, both).keys) == 0
    repeated = toxicity.train(docs.unionByName(docs), labels.unionByName(labels))
    assert np.array_equal(repeated.keys, model.keys) and np.allclose(repeated.scores, model.scores)
    nulls = spark.createDataFrame([(None, "x", 1), (9_999, None, 1)], "doc_id long, text string, toxic int")
    with_nulls = toxicity.train(docs.unionByName(nulls.select("doc_id", "text")), labels.unionByName(nulls.select("doc_id", "toxic")))
    assert np.array_equal(with_nulls.keys, model.keys)


def test_log_odds_shrink_and_select():
    docs, distinct = (400, 50), 1000
    score = toxicity.log_odds(np.array([40, 2, 5, 0]), np.array([0, 0, 300, 10]), docs, distinct)
    assert score[0] == pytest.approx(math.log(40.5 / 10.5) - math.log(0.5 / 400.5)) and score[1:].tolist() == [0, 0, 0]


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op11_toxicity(spark, sf).toPandas()
    assert sorted(found.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(found.doc_id, found.held_out))
