"""Near copies by the Jaccard similarity of word shingles: SimHash and min-hash candidates, exact check.

A text is the set of its runs of five words (a shorter one: one run of all its words), A-Z
lower-cased.  Two texts link if their sets have a similarity of 0.8 or more.  Candidates are, first,
sets whose SimHash fingerprints meet under an anchor of the covering code (``simhash.links``).  At a similarity of 0.8
two fingerprints differ in about ten of 64 bits, beyond any radius that anchors can cover, so that, second,
sets which share one of 20 bands of four min-hashes are candidates too: that misses a pair at 0.8 with a chance of
(1 - 0.8**4)**20 < 3e-5 and one above it more rarely.  Every candidate is checked by the
sets themselves (64-bit hashes of the runs).

What scales: equal sets are grouped first; sets with near fingerprints and neighbours in a band are checked and joined to groups
at once, so that a large band of mutual copies costs no more.  What a band then still holds of different groups is compared inside a
task, set by set against all before it, and only a spanning forest of the links comes out, never the pairs.  The sets of a large band
are dealt in blocks, and each two blocks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, hashed_words, materialize, slices
from .simhash import components, links

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Text worked on at a time.
SLICE_BYTES = 1 << 20
#: Members of a band's sets in one block, and in one row of a set.
BLOCK = 1 << 20
PIECE = 1 << 10
_ODD = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C17)


def _mix(h: np.ndarray, factor: np.uint64 = np.uint64(0xBF58476D1CE4E5B9)) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * factor
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of all texts one after the other, how many each text has)."""
    value, per_text = hashed_words(texts, lower=True)
    value = np.append(value, np.uint64(0))
    runs = np.where(per_text > 0, np.maximum(per_text - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(runs)), runs)
    stop = np.cumsum(per_text)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + (stop - per_text)[owner]
    h = np.zeros(len(owner), np.uint64)
    for j in range(words):
        h = h * _FACTOR + value[np.where(at + j < stop[owner], at + j, len(value) - 1)]
    h = _mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(runs)).astype(np.int64)


def set_hashes(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for each set; the empty set: 0."""
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        out[full] = _mix(np.add.reduceat(_mix(h, _FACTOR), (np.cumsum(size) - size)[full]) + size[full].astype(np.uint64))
    return out


def fingerprints(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is 1 if set in over half the hashes; the empty set: 0."""
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(size) - size)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > size[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def bands(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key for each set and band; sets without a member have keys of their own kind."""
    full = size > 0
    start = (np.cumsum(size) - size)[full]
    out = np.zeros((len(size), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(start), b + 1, np.uint64)
        for a, c in _ODD[b * ROWS : (b + 1) * ROWS] if len(start) else ():
            v = h * a
            v ^= v >> np.uint64(32)
            v *= c
            key = _mix(key * _FACTOR + np.minimum.reduceat(v, start))
        out[full, b] = key
    return out


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, n, sim, bands) of every row: hash, size and SimHash of its set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, n = shingles(part["text"], words)
                keys = pa.array(bands(h, n).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), keys)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(set_hashes(h, n).view(np.int64)), pa.array(n), pa.array(fingerprints(h, n).view(np.int64)), lists], ["doc_id", "fp", "n", "sim", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, n long, sim long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(fp, members) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, n = shingles(part["text"], words)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(h, n).view(np.int64)), lists], ["fp", "members"])

    return docs.select("text").mapInArrow(run, "fp long, members array<long>")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar enough."""
    met = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v"))).distinct()
    first = reps.join(met, "fp", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    sets = materialize(_sets(docs.join(materialize(first, "candidates"), "doc_id", "left_semi"), words), "shingle-sets")
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("members").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("members").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    both = both.select("u", "v", common.alias("c"), (F.size("a") + F.size("b")).alias("n"))
    return materialize(both.where(F.col("c") / (F.col("n") - F.col("c")) >= similarity).select("u", "v").distinct(), "near-pairs")


def _anchored(reps: DataFrame) -> DataFrame:
    """(u, v): sets with equal SimHash fingerprints, and one set for each of two fingerprints that anchors link."""
    full = reps.where("n > 0")
    by = materialize(full.groupBy("sim").agg(F.min("fp").alias("one")), "set-fingerprints")
    linked = links(by.select(F.col("sim").alias("fp")))
    ends = [by.select(F.col("sim").alias(c), F.col("one").alias(f"{c}_one")) for c in ("u", "v")]
    pairs = linked.join(ends[0], "u").join(ends[1], "v").select(F.col("u_one").alias("u"), F.col("v_one").alias("v"))
    pairs = pairs.unionByName(full.join(by, "sim").where("fp <> one").select(F.col("fp").alias("u"), F.col("one").alias("v")))
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _compared(cell: pa.RecordBatch, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the sets of a cell that are not yet in one group.

    A cell holds the sets of one block of a band, or of two, whose sets of role 0 then meet those of role 1 only.  Two sets are compared in the
    first band that they share.
    """
    first = np.flatnonzero(np.asarray(cell["piece"]) == 0)
    fp, root, size, role = (np.asarray(cell[c])[first] for c in ("fp", "root", "n", "role"))
    band = np.asarray(cell["bands"].take(pa.array(first)).flatten()).reshape(len(first), BANDS)
    key = cell["key"][0].as_py()
    _, group = np.unique(root, return_inverse=True)
    lists = cell["members"]
    _, code = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    start = np.cumsum(size) - size
    # of each set the bands that come before this one
    here = np.argmax(band == key, axis=1)
    two = cell["a"][0].as_py() != cell["b"][0].as_py()
    if two and role[0] == role[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = int(np.searchsorted(role, 1))
    flag = np.zeros(len(code) + 1, bool)
    out = ([], [])
    for i in range(cut if two else 1, len(fp)):
        upto = cut if two else i
        n = size[:upto]
        some = np.flatnonzero((group[:upto] != group[i]) & (np.minimum(n, size[i]) >= similarity * np.maximum(n, size[i])))
        if len(some):
            some = some[~((band[some] == band[i]) & (np.arange(BANDS) < here[i])).any(1)]
        if not len(some):
            continue
        own = code[start[i] : start[i] + size[i]]
        flag[own] = True
        per = size[some]
        ends = np.cumsum(per)
        at = np.arange(ends[-1]) + np.repeat(start[some] - (ends - per), per)
        common = np.add.reduceat(flag[code[at]], ends - per, dtype=np.int64)
        flag[own] = False
        for j in some[common / (per + size[i] - common) >= similarity].tolist():
            if group[j] != group[i]:
                out[0].append(i)
                out[1].append(j)
                group[group == group[j]] = group[i]
    return fp[out[0]].astype(np.int64), fp[out[1]].astype(np.int64)


def _met(mixed: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """(u, v): links between sets of different groups that share a band; mixed: (key, fp, n, root, members), members those of the whole band."""
    sets = mixed.select("fp").distinct()
    first = reps.join(sets, "fp", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    whole = _sets(docs.join(materialize(first, "band-documents"), "doc_id", "left_semi"), words).dropDuplicates(["fp"])
    # long sets come in pieces, so that no batch of rows is large
    pieces = F.expr(f"transform(sequence(0, greatest(size(members) - 1, 0), {PIECE}), i -> slice(members, i + 1, {PIECE}))")
    pieces = materialize(whole.join(reps.select("fp", "bands"), "fp").select("fp", "bands", F.posexplode(pieces).alias("piece", "members")), "band-sets")
    salts = F.ceil(F.col("members") / block)
    dealt = mixed.select("key", "fp", "n", "root", F.pmod(F.xxhash64("fp"), salts).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt"))
    dealt = dealt.select("key", "fp", "n", "root", F.least("own", "salt").alias("a"), F.greatest("own", "salt").alias("b"), F.expr("cast(own > salt as byte)").alias("role"))
    rows = dealt.join(pieces, "fp").select("key", "a", "b", "role", "fp", "n", "root", "piece", F.when(F.col("piece") == 0, F.col("bands")).alias("bands"), "members")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "role", "fp", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["key", "a", "b"]):
            u, v = _compared(cell, similarity)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of every row of docs (doc_id, text) that has a doc_id.

    component_id: the least doc_id among documents reachable over links.  Texts without words
    link with each other only; repeated rows come back as often as they went in.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialize(_signatures(rows, words), "shingle-signatures")
    reps = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("sim").alias("sim"), F.any_value("bands").alias("bands")), "distinct-sets")
    met = _anchored(reps)
    keys = reps.where("n > 0").select("fp", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    keys = materialize(keys.join(shared, "key", "left_semi"), "shared-bands")
    close = f"least(n, m) >= {similarity!r}D * greatest(n, m)"
    # neighbours by size first: they join a band of mutual copies without its pairs
    by_size = Window.partitionBy("key").orderBy("n", "fp")
    near = keys.select("fp", "n", F.lag("fp").over(by_size).alias("o"), F.lag("n").over(by_size).alias("m")).where(f"o is not null and {close}")
    near = materialize(met.unionByName(near.select(F.greatest("fp", "o").alias("u"), F.least("fp", "o").alias("v"))).distinct(), "band-neighbours")
    stars = components(_verified(near, reps, rows, words, similarity), "band-stars")
    rooted = keys.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted-bands")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("members")).where("low < high").select("key", "members")
    mixed = materialize(rooted.join(mixed, "key"), "mixed-bands")
    stars = components(stars.unionByName(_met(mixed, reps, rows, words, similarity, block)), "near-stars")
    rooted = reps.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return signed.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs whose doc_id names its group of near copies (or is null); columns unchanged."""
    gone = groups(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(materialize(gone, "near-copies"), "doc_id", "left_anti").select(docs.columns)
