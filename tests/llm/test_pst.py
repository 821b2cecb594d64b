"""The suffix tree against one of plain dictionaries, and its gain on held-out texts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.llm import pst
from lagweave.llm.common import fold


class Plain:
    """The same model word by word."""

    def __init__(self, texts, depth, min_count, min_edge, divergence, discount):
        self.depth = depth
        self.count = Counter()
        after = defaultdict(Counter)
        for t in texts:
            s = [*words(t), "</s>"]
            self.count.update(s)
            for i, x in enumerate(s):
                back = ["<s>", *s[:i]]
                for d in range(1, min(depth, len(back)) + 1):
                    after[tuple(back[-d:])][x] += 1
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.edges, self.backoff, gain = {}, {}, {}
        for c in sorted(after, key=len):
            total = sum(after[c].values())
            kept = {x: n for x, n in after[c].items() if n >= min_edge}
            if total < min_count or not kept:
                continue
            self.backoff[c] = (total - sum(n - discount for n in kept.values())) / total
            below = {x: self.at(c[1:], x) for x in kept}
            self.edges[c] = {x: (n - discount) / total + self.backoff[c] * below[x] for x, n in kept.items()}
            gain[c] = sum(n * math.log(self.edges[c][x] / below[x]) for x, n in kept.items()) + (total - sum(kept.values())) * math.log(self.backoff[c])
        self.states = {c for c in gain if gain[c] >= divergence}
        self.states |= {c[i:] for c in self.states for i in range(1, len(c))}

    def at(self, c, x):
        if not c:
            return (self.count[x] or self.v) / (self.n + self.v)
        if x in self.edges[c]:
            return self.edges[c][x]
        return self.backoff[c] * self.at(c[1:], x)

    def score(self, text):
        s, out = [*words(text), "</s>"], 0.0
        for i, x in enumerate(s):
            back = ["<s>", *s[:i]]
            longest = next((tuple(back[-d:]) for d in range(min(self.depth, len(back)), 0, -1) if tuple(back[-d:]) in self.states), ())
            out += math.log10(self.at(longest, x))
        return out

    def base(self, text):
        return sum(math.log10((self.count[x] + 1) / (self.n + self.v + 1)) for x in [*words(text), "</s>"])


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    vocab = [f"{c}{i}" for c in "abC" for i in range(12)]
    out = []
    for i in range(240):
        low = 12 * (i % 3)
        w, state = [], 0
        for _ in range(int(rng.integers(0, 40))):
            state = (state * 5 + int(rng.integers(0, 3))) % 12 if rng.random() < 0.8 else int(rng.integers(0, 12))
            w.append(vocab[low + state])
        out.append((i, " ".join(w)))
    out += [(300, None), (301, " \t "), (302, "never seen words only"), (303, out[4][1]), (303, out[4][1]), (None, out[5][1]), (304, (out[6][1] + "\n") * 60)]
    return out


@pytest.mark.parametrize("depth,hot,most", [(1, 1, 9000), (2, 1, 0), (3, 8, 20)])
def test_equals_a_plain_tree(spark, texts, depth, hot, most, monkeypatch):
    monkeypatch.setattr(pst, "WINDOW", 97)
    options = dict(depth=depth, min_count=8, min_edge=2, divergence=3.0, discount=0.6)
    df = spark.createDataFrame([(i, t, 1.0, 2, 3) for i, t in texts], "doc_id long, text string, score double, key long, row int")
    got = pst.score_corpus(df, F.expr("doc_id % 4 = 1"), hot=hot, most=most, **options).collect()
    plain = Plain([t for i, t in texts if i is None or i % 4 != 1], **options)
    lengths = {len(c) for c in plain.states}
    assert lengths == set(range(1, depth + 1))
    want = sorted((str(i), i is not None and i % 4 == 1, len(words(t)) + 1, sum(plain.count[x] > 0 for x in [*words(t), "</s>"]), plain.n, round(plain.base(t), 6), round(plain.score(t), 6)) for i, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    tree = pst.grow(df.where("doc_id is null or doc_id % 4 <> 1").select(F.coalesce("text", F.lit("")).alias("text")), **options)
    assert [s.count() for s in tree.states] == [sum(len(c) == d for c in plain.states) for d in range(1, depth + 1)]


def test_hashes_are_those_of_spark(spark):
    from lagweave.llm.common import xxhash64

    v = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 50)
    got = spark.createDataFrame([(int(x),) for x in v], "v long").select("v", F.xxhash64("v").alias("h")).collect()
    assert all(int(xxhash64(np.array([r.v]).view(np.uint64)).view(np.int64)[0]) == r.h for r in got)


def test_probabilities_sum_to_one(texts):
    plain = Plain([t for _, t in texts], 2, 8, 2, 3.0, 0.6)
    for c in [(), *plain.states]:
        assert np.isclose(sum(plain.at(c, x) for x in [*plain.count, "unknown"]), 1)


def test_order_of_words_matters(spark):
    rows = [(i, "the red car and the blue house") for i in range(40)] + [(100, "car red house the the blue and")]
    got = {r.doc_id: r for r in pst.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), F.expr("doc_id = 100 or doc_id = 0")).collect()}
    assert got[0].base_score == pytest.approx(got[100].base_score) and got[0].score > got[100].score + 3


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in pst.score_corpus(rows, F.lit(True)).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert pst.score_corpus(rows.limit(0), F.lit(False)).count() == 0


def test_gains_on_held_out_texts_over_base_and_over_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pst.score_corpus(docs, fold("doc_id", 7) == 2).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    rows = [(r.doc_id, words(r.text)) for r in docs.select("doc_id", "text").collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(x for i, w in rows if i not in held for x in [*w, "</s>"])
    n, v = sum(count.values()), len(count)
    single = sum(math.log10((count[x] or v) / (n + v)) for i, w in rows if i in held for x in [*w, "</s>"])
    assert got.score > 0.98 * single > got.base and single > got.base


def test_memory_of_a_worker(monkeypatch):
    """Two megabytes of text are hashed with little more than the hashes, whatever the block, and frequent keys without a base keep none."""
    import tracemalloc

    import pyarrow as pa

    from lagweave.llm import common

    text = pa.array(["some words of a text " * 100_000])
    whole = common.hashed_words(text)
    monkeypatch.setattr(common, "_POWERS", [])
    tracemalloc.start()
    found = common.hashed_words(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found[0] == whole[0]).all() and most < 60_000_000
    keys = np.arange(0, 40, 4, dtype=np.uint64)
    hot = pst._Hot(keys, np.arange(10.0), np.array([2, 7]), np.array([0.5, 0.25]), np.full(8192, 255, np.uint8))
    base, score, cold = hot.look_up(np.array([8, 28, 12, 9], np.uint64))
    assert base.tolist() == [0.5, 0.25, 0, 0] and score.tolist() == [2, 7, 3, 0] and cold.tolist() == [False, False, False, True]
