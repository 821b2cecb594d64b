"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets per language inside each task and adds them up in Spark;
what reaches the driver is bounded by languages x buckets.  The log-probability matrix
(buckets x languages, float32) is broadcast, and a batch of texts is scored as a sparse
product: gather the row of every n-gram, add up by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Code points of a text that are hashed at a time; pieces overlap so that no n-gram is lost.
PIECE = 1 << 18
_WORD_CHARACTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order, log prior of each and log probability by (bucket, language)."""

    langs: tuple[str, ...]
    prior: np.ndarray
    logp: np.ndarray


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter; numerals such as those for halves, powers or Roman numbers are none."""
    return any(m.group().isalpha() for m in _WORD_CHARACTER.finditer(text or ""))


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased texts as code points, in parts of about ``most``: (code points, start and
    length of each piece, index of the text it belongs to).  A piece is followed by two more
    code points of its text, or zeros, so that n-grams never span two texts."""
    buf: list[str] = []
    start, length, owner, at = [], [], [], 0
    for k, text in enumerate(texts):
        text = (text or "").lower()
        for a in range(0, len(text), most):
            n = min(most, len(text) - a)
            buf.append(text[a : a + n + 2].ljust(n + 2, "\0"))
            start.append(at)
            length.append(n)
            owner.append(k)
            at += n + 2
            if at >= most:
                yield np.frombuffer("".join(buf).encode("utf-32-le", "surrogatepass"), "<u4"), np.array(start), np.array(length), np.array(owner)
                buf, start, length, owner, at = [], [], [], [], 0
    if buf:
        yield np.frombuffer("".join(buf).encode("utf-32-le", "surrogatepass"), "<u4"), np.array(start), np.array(length), np.array(owner)


def buckets(cp: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each code point but the last two, for every order."""
    cp = cp.astype(np.uint32)
    h = np.zeros(len(cp) - 2, np.uint32)
    for n in range(1, max(orders) + 1):
        h = (h + cp[n - 1 : len(cp) - 2 + n - 1] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in orders:
            yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def _inside(start: np.ndarray, length: np.ndarray, total: int) -> np.ndarray:
    mark = np.zeros(total + 1, np.int8)
    mark[start] += 1
    np.subtract.at(mark, start + length, 1)
    return np.cumsum(mark[:total]).astype(bool)


def train(docs: DataFrame, bits: int = 14, alpha: float = 0.5, max_cells: int = 1 << 25) -> LanguageModel:
    """Fit on docs (text, lang); rows with a null lang are left out, null texts count as empty, repeated rows count as often as they come.

    The matrix has at most ``max_cells`` cells as long as there are under max_cells / 256 languages: it then has fewer
    than 2**``bits`` buckets, 256 at least.  Without any labelled row the model has no languages and predicts ``und``.
    """
    spark = docs.sparkSession
    labelled = docs.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    # a row for each language
    rows = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())
    langs = tuple(x[0] for x in rows)
    while bits > 8 and len(langs) << bits > max_cells:
        bits -= 1
    index, size = {x: i for i, x in enumerate(langs)}, 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * size, np.int64)
        for batch in batches:
            code = np.array([index[x] for x in batch["lang"].to_pylist()], np.int64)
            for cp, start, length, owner in pieces(batch["text"].to_pylist()):
                inside = _inside(start, length, len(cp) - 2)
                base = np.repeat(code[owner] * size, length)
                for b in buckets(cp, ORDERS, bits):
                    total += np.bincount(base + b[inside], minlength=len(total))
        cell = np.flatnonzero(total)
        for at in range(0, len(cell), 100_000):
            part = cell[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    table = np.zeros(len(langs) * size)
    if langs:
        for r in labelled.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
            table[r["cell"]] = r["n"]
    table = table.reshape(len(langs), size) + alpha
    docs_of = np.array([x[1] for x in rows], float)
    logp = np.log(table / table.sum(1, keepdims=True)) if langs else table
    return LanguageModel(langs, np.log(docs_of / docs_of.sum()) if langs else docs_of, np.ascontiguousarray(logp.T, np.float32))


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for every text."""
    bits = int(model.logp.shape[0]).bit_length() - 1
    total = np.tile(model.prior, (len(texts), 1))
    for cp, start, length, owner in pieces(texts) if model.langs else ():
        cuts = np.ravel(np.column_stack([start, start + length]))
        for b in buckets(cp, ORDERS, bits):
            sums = np.add.reduceat(np.r_[model.logp[b], np.zeros((1, len(model.langs)), np.float32)].astype(np.float64), cuts, axis=0)[::2]
            np.add.at(total, owner, sums)
    known = np.array([bool(model.langs) and has_letter(t) for t in texts], bool)
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, posterior, 0.0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with ``lang_pred`` and ``score`` (posterior of the prediction, 0 to 1) appended.

    ``und`` with score 0 where the text is null or has no letter.  Ties go to the first
    language in code point order; repeated rows and null ids are rows like others; columns of docs
    named ``lang_pred`` or ``score`` are replaced, all others pass through unread.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats, see train
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                lang, score = score_texts(part["text"].to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(keep).mapInArrow(run, schema)
