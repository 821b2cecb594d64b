"""Quality classifier by compression: zstandard dictionaries from good and from bad text.

A text is compressed in independent blocks with each dictionary; the difference of the two
sizes, divided by the text's own size, is its raw mark.  A logistic curve fitted on other
labelled documents turns the mark into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of good and bad text, block size, and the calibration's weights and centres."""

    good: bytes
    bad: bytes
    block: int
    weights: tuple[float, ...]
    knots: tuple[float, ...]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


def build_dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    """zstandard dictionary of ``size`` bytes from blocks of the texts; their raw text if they are too few to train on."""
    samples = [t[a : a + block] for t in texts for a in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, steps=1, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def marks(texts: list[str | None], model: QualityModel) -> np.ndarray:
    """(bad size - good size) / text size of each text; 0 for an empty one."""
    coder = []
    for data in (model.good, model.bad):
        d = _dictionary(data) if data else None
        if d is not None:
            d.precompute_compress(level=LEVEL)
        coder.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    good, bad = (c.compress for c in coder)
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        diff = 0
        for a in range(0, len(raw), model.block):
            part = raw[a : a + model.block]
            diff += len(bad(part)) - len(good(part))
        out[k] = diff / max(1, len(raw))
    return out


def _features(mark: np.ndarray, knots: tuple[float, ...]) -> np.ndarray:
    """A monotone piecewise-linear basis of the mark, and a constant."""
    return np.column_stack([np.ones(len(mark)), *(np.maximum(mark - k, 0) for k in knots)])


def calibrate(mark: np.ndarray, label: np.ndarray, knots: tuple[float, ...], share: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, ...]:
    """Weights of a logistic curve over the mark, by Newton's method with a small ridge; ``share`` weighs the samples."""
    x = _features(mark, knots)
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - label)) + ridge * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w / scale)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 40_000, dict_size: int = 32_768, block: int = 512) -> QualityModel:
    """Fit on docs (doc_id, text) with labels (doc_id, quality).

    Bounded sample: of each label the ``per_class`` documents of at most ``max_bytes`` bytes of text
    with the least hash of their id; even ones build the dictionaries, odd ones calibrate, weighted so that the
    labels count as often as among all such documents.  Rows with null ids, texts or labels are left out, and so are documents with
    both labels; a repeated label or document counts once, with its first text in code point order.  With one label or none the score is a constant.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other")).where("quality = other").drop("other")
    fits = docs.where(f"octet_length(text) between 1 and {max_bytes}").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = materialize(marked.join(fits.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", F.xxhash64("doc_id").alias("h")), "labelled")
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    ids = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy("h", "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # at most 2 x per_class rows of ids, and as many texts of at most max_bytes
    rows = fits.join(F.broadcast(ids), "doc_id").groupBy("quality", "h", "doc_id").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["quality"], r["h"], r["doc_id"]))
    by = {q: [r["text"] for r in rows if r["quality"] == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        p = (count.get(1, 0) + 0.5) / (sum(count.values()) + 1)
        return QualityModel(b"", b"", block, (float(np.log(p / (1 - p))),), ())
    dicts = [build_dictionary([t.encode() for t in by[q][::2]], dict_size, block) for q in (1, 0)]
    model = QualityModel(dicts[0], dicts[1], block, (), ())
    held = {q: by[q][1::2] or by[q] for q in (0, 1)}
    label = np.r_[np.zeros(len(held[0])), np.ones(len(held[1]))]
    share = np.r_[np.full(len(held[0]), count[0] / len(held[0])), np.full(len(held[1]), count[1] / len(held[1]))]
    mark = marks(held[0] + held[1], model)
    knots = tuple(float(x) for x in (mark.min() - 1e-6, *np.unique(np.quantile(mark, (0.2, 0.5)))))
    return QualityModel(dicts[0], dicts[1], block, calibrate(mark, label, knots, share / share.mean()), knots)


def score(texts: list[str | None], model: QualityModel) -> np.ndarray:
    """Calibrated probability, 0 to 1, that each text is good."""
    if not model.knots:
        return np.full(len(texts), 1 / (1 + np.exp(-model.weights[0])))
    z = _features(marks(texts, model), model.knots) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def classify(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """docs with ``score`` and ``predicted`` (1 from the threshold on) appended; a null text counts as empty.

    Columns of docs named so are replaced; repeated rows and null ids are rows like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                s = score(part["text"].to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(keep).mapInArrow(run, schema)
