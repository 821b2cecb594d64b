"""Importance resampling towards a target: hashed n-gram features, counted in DuckDB inside each partition.

A task hands its texts to an in-memory DuckDB, slice by slice.  SQL unnests the words, each beside the
next ones, and a registered function takes zlib's CRC-32 of every run of 1 to ``order`` words;
what comes back for a text are its buckets with their counts.  Spark writes these as Parquet, merges them
into the counts of the corpus and of the target, and scores every text by the sum of its buckets' gains
floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))).  A Gumbel number from the id's hash, added to the
weight, turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

BUCKETS = 10_000
#: A word: ASCII digits and letters (lower-cased before) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that DuckDB holds at a time (one text at least); some forty times as much is its peak.
SLICE_BYTES = 1 << 19
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feature_sql(order: int) -> str:
    """(row, bucket, n) of the view ``texts`` (row, text)."""
    shifted = ", ".join(f"unnest(w[{j + 1}:]) w{j}" for j in range(order))  # shorter ones end in nulls
    runs = ", ".join(" || ' ' || ".join(f"w{i}" for i in range(j + 1)) for j in range(order))
    return f"""
        with words as (select row, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') w from texts),
        beside as (select row, {shifted} from words),
        runs as (select row, unnest([{runs}]) f from beside)
        select row, bucket(encode(f)) b, cast(count(*) as integer) n from runs where f is not null group by all order by row, b"""


def words_of(features: np.ndarray, order: int) -> np.ndarray:
    """Number of words of texts with so many runs of 1 to ``order`` words."""
    full = (features + order * (order - 1) // 2) // order
    short = np.floor((np.sqrt(8.0 * np.minimum(features, order * order) + 1) - 1) / 2 + 1e-9).astype(np.int64)
    return np.where(full < order, short, full)


def _database(buckets: int) -> duckdb.DuckDBPyConnection:
    """One thread and no file: what a slice needs must fit in memory."""
    base = duckdb.connect(config={"threads": 1, "temp_directory": ""})

    def bucket(values: pa.Array) -> pa.Array:
        crc = np.fromiter(map(zlib.crc32, values.to_numpy(zero_copy_only=False)), np.uint32, len(values))
        return pa.array((crc % buckets).astype(np.int32))

    base.create_function("bucket", bucket, ["BLOB"], "INTEGER", type="arrow")
    return base


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, order: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, bucket, n) of every row of docs (doc_id, text): its distinct buckets in order
    and how often its features fall there."""
    if not 1 <= buckets < 1 << 31 or order < 1:
        raise ValueError("needs 1 to 2**31 - 1 buckets and runs from 1 word")
    names = ["doc_id", "n_words", "n_features", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _database(buckets)
        try:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    rows = part.num_rows
                    base.register("texts", pa.table([pa.array(np.arange(rows)), part["text"].fill_null("")], ["row", "text"]))
                    found = base.sql(feature_sql(order)).to_arrow_table()
                    base.unregister("texts")
                    row, b, n = (np.asarray(found[c]) for c in ("row", "b", "n"))
                    ends = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
                    total = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (b, n)]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(words_of(total, order)), pa.array(total), *lists], names)
        finally:
            base.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, bucket array<int>, n array<int>")


def totals(counts: DataFrame) -> DataFrame:
    """(bucket, n): the sums over all rows of ``bucket_counts``."""
    each = counts.select(F.explode(F.arrays_zip("bucket", "n")).alias("f")).select("f.bucket", "f.n")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from ``totals`` of both sides; a number for each bucket, whatever the input."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, side in ((s, corpus), (t, target)):
        rows = side.toArrow()
        out[np.asarray(rows["bucket"])] = np.asarray(rows["n"])
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    shared = counts.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(np.asarray(batch["bucket"].offsets))
            value = shared.value[np.asarray(batch["bucket"].flatten())] * np.asarray(batch["n"].flatten()).astype(np.int64)
            upto = np.r_[np.int64(0), np.cumsum(value)]
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(upto[ends] - upto[ends - size])], ["doc_id", "n_words", "n_features", "weight"])

    return counts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256('seed:id'); a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, order: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text).

    Of the N rows with ``min_words`` words or more, the floor(percent N / 100) highest scores are drawn and ranked from 1, ties by
    smaller doc_id; the rank of all others is null.  target: (text).  A null text has no words and weight 0; rows that repeat an id
    are rows like others, with ties among them in any order; a null id is last among equal scores; other columns are ignored.
    Without a target, or without documents, every gain follows from zero counts; an empty table gives an empty table.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100")
    counts = materialize(bucket_counts(docs, buckets, order), "ngram-buckets")
    wanted = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, order)
    gain = gains(totals(counts), totals(materialize(wanted, "target-buckets")), buckets)
    scored = materialize(_weighed(counts, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "importance")
    able = scored.where(F.col("n_words") >= min_words)
    by = F.desc("score"), F.asc_nulls_last("doc_id")
    # ranges of the order, each ranked on its own and counted on from those before it
    parts = materialize(able.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "importance-ranges")
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}  # one number a partition
    most, before, starts = sum(sizes.values()) * percent // 100, 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    # ranges past the last drawn row need no order
    taken = [x for x in starts if x[1] < most]
    last = taken[-1][0] if taken else -1
    start = F.create_map(*(F.lit(x) for pair in taken for x in pair))[F.col("part")] if taken else F.lit(0)
    place = start + F.row_number().over(Window.partitionBy("part").orderBy(*by))
    none = F.lit(None).cast("long")
    head = parts.where(F.col("part") <= last).withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = parts.where(F.col("part") > last).withColumn("rank", none)
    short = scored.where(F.col("n_words") < min_words).withColumn("rank", none)
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return head.select(columns).unionByName(rest.select(columns)).unionByName(short.select(columns))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs (doc_id, text, ..), columns unchanged; rows that repeat a drawn id all come."""
    drawn = importance(docs, target, **options).where("rank is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(materialize(drawn, "drawn"), "doc_id", "left_semi").select(docs.columns)
