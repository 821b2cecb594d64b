"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value significance.

The score of a token is the log-odds of meeting it in a toxic against a clean document, both with a
Dirichlet prior; only tokens whose documents differ between the labels by more than chance over the whole
vocabulary allows keep theirs, every other token costs ``drift``.  A linear scan finds all maximal scoring
segments of a text.  Under clean text the best segment of n tokens follows an extreme-value law,
P(S >= s) = 1 - exp(-K n exp(-lambda s)): lambda solves E[exp(lambda score)] = 1 over clean tokens and K
is its maximum-likelihood value on clean labelled texts.  A segment is significant if its expected number
K n exp(-lambda s) is at most ``level``.  The significant segments' -ln of that number are added up as the text's mark, which a
monotone logistic curve turns into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, slices, tokens
from .zquality import calibrate

#: Stripped from both ends of a word: all of ASCII but letters and digits.
EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
SLICE_BYTES = 4 << 20
#: Marks beyond count as this.
TOP = 60.0
KNOTS = (-1e-6, 2.0, 6.0, 9.0)
BINS_A_UNIT = 4


@dataclass(frozen=True)
class Counts:
    """Documents that hold a token, by label, for tokens (hashes in order) that may matter; labelled documents; their distinct tokens."""

    keys: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    docs: tuple[int, int]
    distinct: int


@dataclass(frozen=True)
class ToxicityModel:
    """Token hashes in order with their scores, cost of other tokens, the extreme-value law and the calibration."""

    keys: np.ndarray
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    level: float
    weights: tuple[float, ...]


def log_odds(toxic: np.ndarray, clean: np.ndarray, docs: tuple, distinct: int, prior: float = 0.5, margin: float = 2.0) -> np.ndarray:
    """Log-odds of each token with a Dirichlet prior; 0 unless the log likelihood ratio of its documents exceeds ln(distinct tokens) + margin.

    docs: labelled documents (clean, toxic), numbers or arrays.
    """
    n0, n1 = (np.asarray(x, float) for x in docs)
    a, b = np.asarray(toxic, float), np.asarray(clean, float)
    score = np.log((a + prior) / (n1 - a + prior)) - np.log((b + prior) / (n0 - b + prior))

    def fit(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(np.where(x > 0, x / np.maximum(n * p, 1e-300), 1)), 0) + np.where(n > x, (n - x) * np.log(np.where(n > x, (n - x) / np.maximum(n * (1 - p), 1e-300), 1)), 0)

    p = (a + b) / np.maximum(n0 + n1, 1)
    ratio = fit(a, n1, p) + fit(b, n0, p)
    return np.where((score > 0) & (ratio > math.log(max(distinct, 2)) + margin), score, 0.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, past the last, sum) of all maximal scoring segments of a sequence, in order, in linear time."""
    at = np.flatnonzero(scores > 0)
    upto = np.r_[0.0, np.cumsum(scores)]
    # stacks of candidates: where they begin and end, the sums before and up to there, the last earlier one that starts lower
    first: list[int] = []
    stop: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    # neighbours without a loss between them are one piece
    breaks = np.flatnonzero(np.diff(at) > 1) + 1 if len(at) else at
    for a, b in zip(at[np.r_[0, breaks]].tolist() if len(at) else [], (at[np.r_[breaks - 1, len(at) - 1]] + 1).tolist() if len(at) else []):
        left, right = float(upto[a]), float(upto[b])
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= right:
                break
            # the candidates from j on become one with this piece
            a, left, keep = first[j], low[j], j
            j = link[j]
            for stack in (first, stop, low, high, link):
                del stack[keep:]
        first.append(a)
        stop.append(b)
        low.append(left)
        high.append(right)
        link.append(j)
    return [(a, b, h - x) for a, b, h, x in zip(first, stop, high, low)]


def hashed(dictionary: pa.Array) -> np.ndarray:
    """Hash of each word, without what stands around its letters and in lower case."""
    return np.fromiter((xxhash.xxh64_intdigest(w.strip(EDGE).lower()) for w in dictionary.to_pylist()), np.uint64, len(dictionary))


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands among sorted keys, -1 if it does not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, -1)


def _labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """((toxic, text) of the sampled documents, labelled distinct texts by label)."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other")).where("toxic = other").drop("other")
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"))
    # one document stands for all of the same text and label
    known = named.join(marked, "doc_id").groupBy("same", "toxic").agg(F.min("doc_id").alias("doc_id"))
    known = materialize(known.select("doc_id", "toxic", "same", F.xxhash64("doc_id").alias("h")), "toxic-labels")
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # at most 2 x per_class ids of a few bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("same", F.xxhash64("text")).join(F.broadcast(ids.select("doc_id", "same", "toxic")), ["doc_id", "same"])
    # rows that repeat an id and text are one sample
    rows = materialize(rows.select("toxic", "text", "doc_id"), "toxic-sample")
    if rows.count() > sum(min(per_class, n) for n in count.values()):
        rows = rows.dropDuplicates(["doc_id"])
    return rows.select("toxic", "text"), count


def _held(rows: DataFrame) -> DataFrame:
    """(key, n0, n1): labelled documents that hold each token, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                codes, dictionary, per = tokens(part["text"])
                owner = np.repeat(np.arange(len(per)), per)
                key = hashed(dictionary)[codes]
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                key, toxic = key[new], np.asarray(part["toxic"])[owner[new]] == 1
                uniq, at = np.unique(key, return_inverse=True)
                n1 = np.bincount(at, weights=toxic, minlength=len(uniq)).astype(np.int64)
                n0 = np.bincount(at, minlength=len(uniq)) - n1
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(n0), pa.array(n1)], ["key", "n0", "n1"])

    return rows.mapInArrow(run, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def token_counts(rows: DataFrame, most: int) -> Counts:
    """Counts of the tokens that may matter, at most ``most``, over rows (toxic, text)."""
    docs = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    held = materialize(_held(rows), "toxic-tokens")
    distinct = held.count()
    n0, n1 = docs.get(0, 0), docs.get(1, 0)
    # a necessary condition first, the ratio itself in NumPy: more frequent in toxic documents, in two of them at least
    some = held.where(F.expr(f"n1 >= 2 and n1 * {max(n0, 1)}D > n0 * {max(n1, 1)}D"))
    x = F.col("n1") * F.log(F.expr(f"n1 * {n0 + n1}D / ((n0 + n1) * {max(n1, 1)}D)"))
    few = some.orderBy(F.desc(x), "key").limit(most).toArrow()  # 24 bytes each
    key = np.asarray(few["key"]).view(np.uint64)
    order = np.argsort(key)
    return Counts(key[order], np.asarray(few["n1"])[order], np.asarray(few["n0"])[order], (n0, n1), distinct)


def _tail(score: np.ndarray, rate: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum(rate exp(lambda score)) + (1 - sum(rate)) exp(-lambda drift) = 1."""
    rest = max(1 - rate.sum(), 1e-9)
    if not len(score):
        return 1.0

    def excess(lam: float) -> float:
        return float((rate * np.exp(np.minimum(lam * score, 700))).sum() + rest * math.exp(-lam * drift) - 1)

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def mark(found: list[tuple[int, int, float]], n: int, lam: float, k: float, level: float) -> float:
    """Sum of -ln(K n exp(-lambda s)) over the significant segments; of none: 0."""
    if not found or n == 0:
        return 0.0
    value = lam * np.array([s for _, _, s in found]) - math.log(k * n)
    return float(min(TOP, value[value >= -math.log(level)].sum()))


def _sample_marks(rows: DataFrame, counts: Counts, drift: float, lam: float, options: dict) -> DataFrame:
    """(toxic, n, best, sums) of each sampled text, with its own label taken out of the counts it is scored by."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                codes, dictionary, per = tokens(part["text"])
                place = _place(c.keys, hashed(dictionary))[codes]
                stop = np.cumsum(per)
                out = ([], [], [])
                for i, label in enumerate(part["toxic"].to_pylist()):
                    own = place[stop[i] - per[i] : stop[i]]
                    which, at = np.unique(own[own >= 0], return_inverse=True)
                    toxic, clean = c.toxic[which] - label, c.clean[which] - (1 - label)
                    value = log_odds(toxic, clean, (c.docs[0] - (1 - label), c.docs[1] - label), c.distinct, **options)
                    scores = np.full(len(own), -drift)
                    scores[own >= 0] = np.where(value[at] > 0, value[at], -drift)
                    out[0].append(label)
                    out[1].append(len(own))
                    out[2].append([s for _, _, s in segments(scores)])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64()))], ["toxic", "n", "sums"])

    return rows.mapInArrow(run, "toxic int, n long, sums array<double>")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 50_000, most: int = 100_000, drift: float = 0.2, prior: float = 0.5, margin: float = 2.0, level: float = 0.05) -> ToxicityModel:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic).

    Bounded sample: of each label the ``per_class`` documents with the least hash of their id; equal texts of a label count once.  Of the
    tokens at most ``most`` enter the model, those that speak most for toxic text.  Rows with null ids, texts or labels are left out, and so
    are documents with both labels.  With one label or none the score is a constant.
    """
    rows, count = _labelled(docs, labels, per_class)
    total = sum(count.values())
    if not count.get(0) or not count.get(1):
        p = (count.get(1, 0) + 0.5) / (total + 1)
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0, level, (math.log(p / (1 - p)),))
    counts = token_counts(rows, most)
    score = log_odds(counts.toxic, counts.clean, counts.docs, counts.distinct, prior, margin)
    lengths = rows.agg(F.sum(F.when(F.col("toxic") == 0, F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).alias("n")).first()["n"] or 1
    kept = score > 0
    rate = (counts.clean[kept] + prior) / max(lengths, 1)
    lam = _tail(score[kept], np.minimum(rate, 0.5 / max(kept.sum(), 1)), drift)
    marks = materialize(_sample_marks(rows, counts, drift, lam, {"prior": prior, "margin": margin}), "toxic-marks")
    best = F.coalesce(F.array_max("sums"), F.lit(0.0))
    clean = marks.where("toxic = 0 and n > 0").agg(F.count("*").alias("docs"), F.sum(F.col("n") * F.exp(-lam * best)).alias("s")).first()
    k = min(1.0, max(clean["docs"], 1) / clean["s"]) if clean["s"] else 1.0
    value = F.transform("sums", lambda s: lam * s - F.log(F.col("n") * k))
    each = F.least(F.lit(TOP), F.aggregate(F.filter(value, lambda v: v >= -math.log(level)), F.lit(0.0), lambda a, v: a + v))
    # bins of the mark: some hundreds
    bins = marks.groupBy("toxic", F.round(each * BINS_A_UNIT).cast("int").alias("bin")).count().collect()
    x = np.array([r["bin"] / BINS_A_UNIT for r in bins])
    y = np.array([r["toxic"] for r in bins], float)
    sampled = {q: sum(r["count"] for r in bins if r["toxic"] == q) for q in (0, 1)}
    w = np.array([r["count"] * count[r["toxic"]] / sampled[r["toxic"]] for r in bins], float)
    weights = calibrate(x, y, KNOTS, w)
    return ToxicityModel(counts.keys[kept], score[kept], drift, lam, k, level, weights)


def probability(marks: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """Calibrated probability, 0 to 1, of each mark."""
    if len(model.weights) == 1:
        z = np.full(len(marks), model.weights[0])
    else:
        z = np.column_stack([np.ones(len(marks)), *(np.maximum(marks - k, 0) for k in KNOTS)]) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scan(part: pa.RecordBatch, model: ToxicityModel) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(tokens, maximal segments) of each text; a text without a scored token is not looked at."""
    codes, dictionary, per = tokens(part["text"])
    place = _place(model.keys, hashed(dictionary))
    value = np.where(place >= 0, model.scores[np.maximum(place, 0)] if len(model.scores) else 0.0, -model.drift)
    scores = value[codes]
    stop = np.cumsum(per)
    hits = np.r_[0, np.cumsum(scores > 0)]
    some = hits[stop] > hits[stop - per]
    for i, n in enumerate(per.tolist()):
        yield n, segments(scores[stop[i] - n : stop[i]]) if some[i] else []


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """docs (text, ..) with ``score``, ``predicted`` (1 from the threshold on) and ``passages`` appended.

    passages: (first, last, sum, expected) of every significant segment, first and last the places of its words from 0, expected its
    number in clean text of that length.  A null text counts as empty; columns of docs named so are replaced; repeated rows and null ids are rows like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most`` tokens of 16 bytes
    new = ("score", "predicted", "passages")
    keep = [c for c in docs.columns if c not in new]
    schema = docs.select(keep).schema
    for field in StructType.fromDDL("score double, predicted int, passages array<struct<first: long, last: long, sum: double, expected: double>>"):
        schema = schema.add(field)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("sum", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                marks, spans = [], []
                for n, found in _scan(part, m):
                    marks.append(mark(found, n, m.lam, m.k, m.level))
                    expected = [(a, b, s, m.k * n * math.exp(-min(m.lam * s, 700))) for a, b, s in found]
                    spans.append([{"first": a, "last": b - 1, "sum": s, "expected": e} for a, b, s, e in expected if e <= m.level])
                p = probability(np.array(marks), m)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(spans, kind)], [*keep, *new])

    return docs.select(keep).mapInArrow(run, schema)
