"""Shared helpers: scratch tables (as in the rest of the library), token arrays, bit filters and the crc32 fold of a document id."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, scratch_dir

#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

__all__ = ["materialize", "scratch_dir", "fold", "held", "slices", "tokens", "bit_filter", "xxhash64", "in_filter", "word_hashes", "hashed_words", "cells"]


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def held(doc_id: str | Column, n: int, part: int) -> Column:
    """Whether an id's fold of n is ``part``; null ids are never held out."""
    return F.coalesce(fold(doc_id, n) == part, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has much over ``max_bytes`` of text, but at least one row."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
    part = np.cumsum(size) // max_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return memory that this process freed to the system: a Python worker outlives its task and shares the executor's memory with the next ones."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tokens(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of every text as (code per token, dictionary of words, tokens per text).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, which is what Arrow's ASCII white space
    leaves; ``lower`` maps A-Z only.  A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # a fresh copy first: Arrow's ascii_lower misreads a slice that was cast
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    per_text = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    keep = np.asarray(pc.not_equal(flat, "")).astype(bool) if len(flat) else np.zeros(0, bool)
    if not keep.all():
        owner = np.repeat(np.arange(len(per_text)), per_text)[keep]
        codes = codes[keep]
        per_text = np.bincount(owner, minlength=len(per_text)).astype(np.int64)
    return codes, coded.dictionary, per_text


def bit_filter(keys: DataFrame, column: str, most_bits: int = 1 << 28) -> np.ndarray:
    """Bytes of a filter with the bit ``key mod size`` set for every key; 16 bits for each, up to ``most_bits``.

    Its false positives must cost time only.
    """
    n = keys.count()
    bits = 1 << 16
    while bits < min(16 * n, most_bits):
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    if n:
        at = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("at"))
        parts = at.groupBy(F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("set"))
        for r in parts.toLocalIterator():  # bits / 8 bytes in all
            out[r["part"] * 4096 : (r["part"] + 1) * 4096] |= np.frombuffer(r["set"], np.uint8)
    return out


def _turn(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def xxhash64(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every 64-bit value, as ``functions.xxhash64`` gives for a long."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.uint64((seed + int(p5) + 8) % (1 << 64)) ^ (_turn(values * p2, 31) * p1)
    h = _turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def in_filter(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned keys may be in a filter."""
    bit = keys & np.uint64(len(held) * 8 - 1)
    return (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_hashes(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each distinct word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in dictionary.to_pylist()), np.uint64, len(dictionary))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTOR = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
#: Bytes hashed at a time; a worker keeps 16 bytes for each, and needs some forty more while it hashes.
_BLOCK = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1, at least, of an odd factor and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK)
        both = [np.full(size, f % (1 << 64), np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
        for x in both:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def hashed_words(texts: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of the texts, one text after the other, words per text).

    Words are those of ``tokens``.  The hashes come from running sums of random values of the bytes times powers of an odd factor, with no string made.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    heads = offsets - offsets[0]
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's end parts words, too
    some = heads[:-1][heads[:-1] < heads[1:]]
    first[some] = inside[some]
    last[some[some > 0] - 1] = inside[some[some > 0] - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    per = np.diff(np.searchsorted(start, heads))
    value = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        value[65:91] = value[97:123]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(stop, start[at] + _BLOCK, "right")))
        low, high = start[at], stop[to - 1]
        power, inverse = _powers(int(high - low))
        upto = np.cumsum(value[raw[low:high]] * power[: high - low])
        a, b = start[at:to] - low, stop[at:to] - low
        before = np.where(a > 0, upto[a - 1], np.uint64(0))
        out[at:to] = (upto[b - 1] - before) * inverse[a] + (b - a).astype(np.uint64)
        at = to
    return xxhash64(out, seed), per.astype(np.int64)


def cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches whose rows are sorted by ``keys``, cut and put together again as one batch for each value of the keys."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch[c]).astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = values[:, a].tolist()
            if held and now != last:
                yield whole()
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()
    give_back()
