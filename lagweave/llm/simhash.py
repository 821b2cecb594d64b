"""SimHash near-duplicate groups through anchor-point covering.

A fingerprint is 64 bits, each the majority of that bit over the XXH64 hashes of the
document's 3-word shingles.  Two fingerprints link at 3 or fewer differing bits.

Links are found with a covering code as anchor points.  Bits 0-22 and 23-45 are each
covered by the perfect [23, 12] Golay code (covering radius 3), so the anchors are the
2**24 pairs of code words and every fingerprint lies within the covering radius of one.
The threshold of 3 is shared out between the two sides of a link: on the shortest path
between two linked fingerprints lies a point one bit from one of them and at most two
bits from the other, and that point's own anchor exceeds the covering radius by at most
one for the first and by at most two for the second.  Each fingerprint is therefore
replicated to the anchors within covering radius plus 1 as *home* (about 10) and within
covering radius plus 2 as *probe* (about 61), and homes are compared with probes anchor
by anchor.  No link is lost; all 64 bits decide.

What scales: equal fingerprints are grouped before anything is replicated; anchors with
many homes are salted (probes dealt out, homes copied); a task emits a spanning forest
of the links it sees, never the pairs; components come from star contraction on tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

THRESHOLD = 3
SEED = 42
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
BLOCK = 23
#: Homes of an anchor from which it is salted.
HOT_HOMES = 2048
#: Distinct fingerprints from which anchors are over all 64 bits.
MANY = 1 << 26
#: Roles under an anchor and salt, in the order they are compared: homes of earlier salts, of this one, of later ones, probes.
EARLIER, OWN, LATER, PROBE = range(4)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of a text: A-Z lower-cased, words by ASCII white space; no word: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), 1 << 16):
        part = spans[at : at + (1 << 16)]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    v = v.astype(np.int64).copy()
    for bit in range(BLOCK - 1, 10, -1):
        v ^= np.where((v >> bit) & 1, np.int64(GOLAY) << (bit - 11), 0)
    return v


def coset_tables(excess: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For e = 0..excess: error patterns that lead from a word to code words at the covering
    radius plus e (e = 0: the one within the radius), by syndrome, and how many there are."""
    low = np.arange(1 << BLOCK, dtype=np.int64)
    weight = np.bitwise_count(low)
    tables = []
    for e in range(excess + 1):
        patterns = low[weight <= 3] if e == 0 else low[weight == 3 + e]
        s = _syndrome(patterns)
        order = np.argsort(s, kind="stable")
        patterns, count = patterns[order], np.bincount(s, minlength=2048)
        table = np.zeros((2048, max(1, count.max())), np.int64)
        table[s[order], np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)] = patterns
        tables.append((table, count))
    return tables


def replicas(fp: np.ndarray, tables: list, excess: int, blocks: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(index of the fingerprint, anchor, excess) for every anchor up to the given excess.

    With three blocks bits 46-63 are covered by all their 2**18 values, whose covering radius is 0.
    """
    if blocks == 3:
        top = np.uint64(2 * BLOCK)
        for c in range(excess + 1):
            flips = np.array([sum(1 << b for b in bits) for bits in combinations(range(64 - 2 * BLOCK), c)], np.uint64)
            for row, anchor, e in replicas(fp, tables, excess - c):
                high = (fp.view(np.uint64)[row] >> top)[:, None] ^ flips
                yield np.repeat(row, len(flips)), (anchor.view(np.uint64)[:, None] | (high << top)).ravel().view(np.int64), e + c
        return
    mask = np.int64((1 << BLOCK) - 1)
    low, high = fp.view(np.int64) & mask, (fp.view(np.int64) >> BLOCK) & mask
    s_low, s_high = _syndrome(low), _syndrome(high)
    for a in range(excess + 1):
        for b in range(excess + 1 - a):
            (ta, ca), (tb, cb) = tables[a], tables[b]
            i, j = np.nonzero(np.arange(ta.shape[1]) < ca[s_low][:, None])
            k = cb[s_high[i]]
            pick = np.repeat(np.arange(len(i)), k)
            col = np.arange(len(pick)) - np.repeat(np.cumsum(k) - k, k)
            row = i[pick]
            first = low[row] ^ ta[s_low[row], j[pick]]
            yield row, first | ((high[row] ^ tb[s_high[row], col]) << BLOCK), a + b


def _anchors(reps: DataFrame, excess: int, blocks: int) -> DataFrame:
    """(fp, anchor, home) of each fingerprint and anchor up to the excess; home: within radius plus 1."""
    tables = coset_tables(excess)
    shared = reps.sparkSession.sparkContext.broadcast(tables)  # about 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch["fp"])
            for at in range(0, len(fp), 2000):
                part = np.ascontiguousarray(fp[at : at + 2000])
                for row, anchor, e in replicas(part, shared.value, excess, blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(anchor), pa.array(np.full(len(row), e <= 1))], ["fp", "anchor", "home"])

    return reps.select("fp").mapInArrow(run, "fp long, anchor long, home boolean")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links reduced to stars: every linked value with the least value of its component, itself excluded."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        if (low == root[x]).all() and (low == root[y]).all():
            break
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _links(anchor: np.ndarray, salt: np.ndarray, role: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that the rows of each (anchor, salt) show: an own home with all homes before it, a probe with all homes."""
    n = len(fp)
    first = np.r_[True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group = np.cumsum(first) - 1
    homes = np.bincount(group, weights=role < PROBE, minlength=group[-1] + 1).astype(np.int64)[group]
    pairs = np.where(role == PROBE, homes, np.where(role == OWN, np.arange(n) - start, 0))
    ends, found = np.cumsum(pairs), ([], [])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000)))
        some = pairs[at:to]
        j = np.repeat(np.arange(at, to), some)
        i = start[j] + np.arange(len(j)) - np.repeat(np.cumsum(some) - some, some)
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= threshold) & (fp[i] != fp[j])
        if near.any():
            x, y = spanning(fp[i[near]], fp[j[near]])
            found[0].append(x)
            found[1].append(y)
        at = to
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


def _compare(batches: Iterator[pa.RecordBatch], threshold: int, buffer: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, salt, role, fp) come sorted: the homes of a key, then its probes.

    Of a key that outgrows the buffer only the homes stay (8 bytes each, not compared with each other again); its probes stream by.
    """
    out: tuple[list, list] = ([], [])

    def flush(rows: list[np.ndarray]) -> None:
        x, y = _links(*rows, threshold)
        if len(x):
            out[0].append(x)
            out[1].append(y)

    waiting: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append([np.asarray(batch[c]) for c in ("anchor", "salt", "role", "fp")])
        held += batch.num_rows
        if held < buffer:
            continue
        rows = [np.concatenate(x) for x in zip(*waiting)]
        other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            flush([x[:last] for x in rows])
        rest = [x[last:] for x in rows]
        if len(rest[0]) > buffer // 2:
            flush(rest)
            rest = [x[rest[2] < PROBE] for x in rest]
            rest[2] = np.full(len(rest[2]), EARLIER, rest[2].dtype)
        waiting, held = [rest], 0
        if len(out[0]) > 64:
            x, y = spanning(np.concatenate(out[0]), np.concatenate(out[1]))
            out = ([x], [y])
    if waiting:
        rows = [np.concatenate(x) for x in zip(*waiting)]
        if len(rows[0]):
            flush(rows)
    if out[0]:
        x, y = spanning(np.concatenate(out[0]), np.concatenate(out[1]))
        for at in range(0, len(x), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]), pa.array(y[at : at + 50_000])], ["u", "v"])


def links(reps: DataFrame, threshold: int = THRESHOLD, hot_homes: int = HOT_HOMES, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links at ``threshold`` bits or fewer.

    ``blocks``: 2 for anchors over 46 bits, 3 for anchors over all 64 (six times the replicas); by default 3 from the
    number of fingerprints at which two blocks would compare each with more than some thousands of others.  No link is lost either way.
    """
    if threshold > 3:
        raise ValueError("the cover splits a threshold of at most 3")
    blocks = blocks or (2 if reps.count() < MANY else 3)
    hot = materialize(_anchors(reps, 1, blocks).groupBy("anchor").count().where(F.col("count") > hot_homes).select("anchor", F.ceil(F.col("count") / hot_homes).cast("int").alias("salts")), "hot-anchors")
    rows = _anchors(reps, 2, blocks)
    if n_hot := hot.count():
        # a row of 12 bytes for each hot anchor: broadcast while that is surely small, joined by key beyond
        rows = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
        # probes are dealt out, homes go to every salt; two homes are compared in the later of their own salts
        every = F.when(F.col("home"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("own"))
        rows = rows.withColumn("salt", F.explode(every))
        role = F.when(~F.col("home"), PROBE).when(F.col("own") < F.col("salt"), EARLIER).when(F.col("own") == F.col("salt"), OWN).otherwise(LATER)
    else:
        rows = rows.withColumn("salt", F.lit(0))
        role = F.when(F.col("home"), OWN).otherwise(PROBE)
    rows = rows.select("anchor", "salt", role.cast("byte").alias("role"), "fp")
    rows = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "role")
    return rows.mapInArrow(lambda it: _compare(it, threshold), "u long, v long").distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(u, v): every node of ``edges`` but the least of its component, with that least node.

    Rounds end when one changes nothing; their number grows with the logarithm of the edges.  Alternating large and small star contractions; every round is written as a table.  So are the least
    neighbours that a round joins to: a join of two exchanges lets a node with very many links be split between tasks.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = materialize(e, name), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = THRESHOLD, hot_homes: int = HOT_HOMES) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text); other columns are ignored.

    fingerprint: 16 lower-case hex digits.  component_id: the least doc_id among documents
    reachable over links.  Null or empty texts have fingerprint zero and link like any other;
    rows with a null doc_id are kept and never name a component (null if it has no other);
    repeated rows come back as often as they went in; an empty table gives an empty table.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    stars = components(links(reps, threshold, hot_homes))
    rooted = reps.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(labels, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs whose doc_id names its group of near duplicates (or is null); columns unchanged."""
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(materialize(gone, "near-copies"), "doc_id", "left_anti").select(docs.columns)
