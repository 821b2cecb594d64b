"""Hard negatives against plain Python."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.llm import negatives, queries


def brute(rows, anchors, positives=5, count=10):
    full = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        item = (label, [int(np.floor(256 * x)) for x in v])
        full[i] = min(full.get(i, item), item)
    out = []
    for a in sorted(full):
        if not anchors(a):
            continue
        label, v = full[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in full.items() if len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if full[i][0] == label and i != a][:positives]:
            hard = [i for i in order if full[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:count]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1024, 16_384), (3, 40)])
def test_cells_give_what_a_full_sort_gives(spark, sizes):
    """Ties by the dozen, repeated rows, nulls, values that are not finite, vectors of another length."""
    rng = np.random.default_rng(0)
    rows = [(int(i), int(rng.integers(0, 3)), np.round(rng.normal(size=6) * 2).tolist()) for i in range(180)]
    rows += [(7, 2, [9.0] * 6), (7, 0, [1.0] * 6), (200, None, [1.0] * 6), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, 1, [float("nan")] + [1.0] * 5), (204, 1, [float("inf")] * 6)]
    rows += [(None, 1, [1.0] * 6), (205, 1, []), *((300 + i, i % 3, [float(i % 4), 1.0]) for i in range(30))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("x"))
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, sizes=sizes)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(df, F.col("vec_id") > 5).count() == 0
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(df, F.lit(True), negatives=0)


def test_large_values_stay_exact():
    a, b = np.array([[2**27 + 1, 3]], np.int64), np.array([[2**27 + 5, 7]], np.int64)
    assert negatives._scores(a, b)[0, 0] == (2**27 + 1) * (2**27 + 5) + 21


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE["op13_negatives"])
    df = queries.op13_negatives(spark, sf)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
