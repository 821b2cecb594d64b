"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lagweave.llm import queries, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, buckets=10_000, order=3):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, min_words=20, buckets=10_000):
    """doc_id -> (n_features, weight, score, rank)."""
    every = {i: features(t, buckets) for i, t in docs}
    s, t = Counter(), Counter()
    for _, f in every.values():
        s.update(f)
    for text in target:
        t.update(features(text, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = {}
    for i, (_, f) in every.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted((i for i in every if every[i][0] >= min_words), key=lambda i: (-out[i][2], i))
    rank = {i: k for k, i in enumerate(order[: percent * len(order) // 100], 1)}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op12_resample(spark, sf).collect()} == brute(docs, target)


def test_hard_inputs(spark, monkeypatch):
    """Null, empty, very long and unspaced texts, marks between letters, many slices and ranges, a column named like a result."""
    monkeypatch.setattr(resample, "SLICE_BYTES", 200)
    base = [(i, f"alpha beta {i % 7} gamma-delta Été {'word ' * (i % 30)}") for i in range(200)]
    odd = [(1000, None), (1001, ""), (1002, "...!"), (1003, "long word " * 60_000), (1004, "漢字かな交じり文"), (1005, "a'b'c \u0000 x"), (1006, "ÀÀ àà AB ab")]
    target = ["alpha beta 3", None, "漢字かな交じり文", ""]
    df = spark.createDataFrame([*base, *odd], "doc_id long, text string").withColumn("weight", F.lit("x"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in resample.importance(df, goal, percent=30).collect()}
    assert found == brute([*base, *odd], target, percent=30)
    drawn = resample.resample(df, goal, percent=30)
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == {i for i, v in found.items() if v[3]}


def test_repeats_nulls_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    goal = spark.createDataFrame([(text,)], "text string")
    found = resample.importance(df, goal, percent=100).collect()
    assert len(found) == 4 and sorted(r["rank"] for r in found if r.n_words >= 20) == [1, 2, 3]
    assert [r["rank"] for r in found if r.doc_id == 2] == [None]
    assert all(r["rank"] is None for r in resample.importance(df, goal, percent=0).collect())
    none = df.limit(0)
    assert resample.importance(none, goal).count() == 0
    assert {r.weight for r in resample.importance(df.where("doc_id = 2"), goal.limit(0)).collect()} == {features_gain()}


def features_gain():
    """The one feature of a corpus of one word without a target."""
    return math.floor(1000 * math.log(1 * 10_001 / (2 * 10_000)))


def test_words_from_runs_and_one_pass_over_the_text():
    """The number of words follows from that of the runs; a text is split once and put in no order."""
    for order in range(1, 6):
        n = np.arange(0, 3000)
        runs = sum(np.maximum(n - j, 0) for j in range(order))
        assert (resample.words_of(runs, order) == n).all()
        sql = resample.feature_sql(order)
        assert sql.count("regexp_extract_all") == 1 and " over " not in sql
