"""Removal of repeated passages with a log-structured index of window fingerprints.

A window is ``window`` consecutive words.  Its anchor is the least hash among the grams
(half a window long) inside it, so equal windows have equal anchors and about one word in
thirteen starts a new one.  The index holds every (anchor, doc_id): immutable runs sorted by
anchor, one for each batch, compacted when there are several.  It lives in a folder and can be
opened again for a later batch.

A batch of documents goes through four jobs.  Its anchors become a run; that run is
merge-joined with the older ones, which leaves the anchors that occur in a second document and
the earlier documents that have them; the anchors pass into a bit filter (bounded size; its false positives cost time,
not results) and windows of the batch and of those earlier documents whose anchor passes are verified by their own hash, 64 bits of one polynomial and 32
of another: the least document of each such window is aggregated, and joined back to mark
what a smaller document has.  Other earlier texts are not read.  Batches follow each other by doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, materialize, scratch_dir, slices, tokens, word_hashes

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MODULUS = 1 << 64
#: Text bytes taken at a time; the arrays over a slice hold some twenty times as much.
SLICE = 2 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every ``length`` consecutive values, from prefix sums of a polynomial modulo 2**64."""
    n = len(values)
    power = np.cumprod(np.full(n, base, np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power)])
    back = np.cumprod(np.full(n - length + 1, pow(base, -1, MODULUS), np.uint64))
    return (prefix[length:] - prefix[: n - length + 1]) * back


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of every ``length`` consecutive values."""
    have, out = 1, values
    while have * 2 <= length:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (length - have)], out[length - have :]) if length > have else out


def windows(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, word position, index among all words, anchor) of every window, and the hashes of all words."""
    codes, dictionary, per = tokens(texts)
    if len(codes) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), np.zeros(0, np.uint64)
    hashed = word_hashes(dictionary)[codes]
    gram = (window + 1) // 2
    anchor = sliding_min(_mix(rolling(hashed, gram, BASES[0])), window - gram + 1)
    owner = np.repeat(np.arange(len(per)), per)
    inside = np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :])
    start = (np.cumsum(per) - per)[owner[inside]]
    return owner[inside], inside - start, inside, anchor[inside], hashed


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id), each once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                owner, _, _, anchor, _ = windows(part["text"], window)
                fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])] if len(owner) else np.zeros(0, bool)
                ids = np.asarray(part["doc_id"])[owner[fresh]]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[fresh].view(np.int64)), pa.array(ids)], ["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


#: Runs are of like size within this factor.
SPREAD = 10


class WindowIndex:
    """Immutable runs (anchor, doc_id) in a folder, each sorted by anchor within its files; opening a folder finds the runs there.

    A run counts once it is written whole.  Runs may overlap, as after a compaction that was cut short: they are read as a set.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{scratch_dir(spark)}/lagweave-runs-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = self._files.listStatus(folder) if self._files.exists(folder) else []
        paths = sorted(str(f.getPath().toString()) for f in held)
        self.runs = [x for x in paths if self._files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]

    def append(self, anchors: DataFrame) -> DataFrame:
        """Write a batch's anchors as a new run."""
        return self._write(anchors)

    def _write(self, run: DataFrame) -> DataFrame:
        path = f"{self.path}/run-{len(self.runs):04d}-{uuid.uuid4().hex}"
        run = materialize(run.distinct().sortWithinPartitions("anchor"), "run", path)
        self.runs.append(path)
        return run

    def read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("anchor long, doc_id long").parquet(*runs)

    def repeated(self, run: DataFrame, older: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """(anchors of a run that a second document has, in the run itself or in an older one; the older documents with them)."""
        ends = materialize(run.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "run-anchors")
        inside = ends.where("first < last").select("anchor")
        if not older:
            return inside, None
        met = materialize(self.read(older).join(ends.select("anchor"), "anchor", "left_semi"), "met-anchors")
        return inside.unionByName(met.select("anchor")).distinct(), met.select("doc_id").distinct()

    def _like(self) -> list[str]:
        """Runs of like size, ``fanout`` or more: the smallest that has so many within ``SPREAD`` times its bytes, with these; none: empty."""
        size = {x: self._files.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(x)).getLength() for x in self.runs}
        for least in sorted(size.values()):
            like = [x for x in self.runs if least <= size[x] <= SPREAD * least]
            if len(like) >= max(2, self.fanout):
                return like
        return []

    def compact(self) -> None:
        """Merge runs of like size, once there are ``fanout`` of them, so that an anchor is rewritten only as its run grows by a factor.

        The merged run is written whole before the old ones go: what an interruption leaves is read as a set.
        """
        while old := self._like():
            self._write(self.read(old))
            self.runs = [x for x in self.runs if x not in old]
            for path in old:
                self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _candidates(docs: DataFrame, window: int, passed) -> DataFrame:
    """(key, mark, doc_id, pos) of the windows whose anchor passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = passed.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                owner, pos, at, anchor, hashed = windows(part["text"], window)
                hit = in_filter(held, anchor)
                if not hit.any():
                    continue
                owner, pos, at = owner[hit], pos[hit].astype(np.int32), at[hit]
                key = _mix(rolling(hashed, window, BASES[0]) + np.uint64(window))[at]
                mark = (_mix(rolling(hashed, window, BASES[1])) >> np.uint64(32))[at]
                ids = np.asarray(part["doc_id"])[owner]
                for a in range(0, len(at), 100_000):
                    cut = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(mark[cut].astype(np.uint32).view(np.int32)), pa.array(ids[cut]), pa.array(pos[cut])], ["key", "mark", "doc_id", "pos"])

    return docs.mapInArrow(run, "key long, mark int, doc_id long, pos int")


def repeated_positions(docs: DataFrame, window: int = 50, batches: int = 2, fanout: int = 2, index: WindowIndex | None = None, older: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos): windows of docs, by the position of their first word, that a document of smaller id also has.

    With an ``index`` of earlier batches the documents ``older`` (doc_id, text) that it was built from count as well; the batch is added to it.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cuts = rows.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    index, found = index or WindowIndex(spark, fanout=fanout), []
    if index.runs and older is None:
        raise ValueError("an index of earlier batches needs their documents")
    if older is not None:
        older = older.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for low, high in zip(edges[:-1], edges[1:]):
        batch = rows if low is None else rows.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        runs = list(index.runs)
        run = index.append(_anchors(batch, window))
        anchors, partners = index.repeated(run, runs)
        passed = spark.sparkContext.broadcast(bit_filter(anchors, "anchor"))
        every = batch
        if partners is not None:
            before = older if low is None else rows.where(F.col("doc_id") <= low)
            before = before if older is None or low is None else before.unionByName(older)
            every = every.unionByName(before.join(materialize(partners, "partners"), "doc_id", "left_semi"))
        first = _candidates(every, window, passed).groupBy("key", "mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        # as a table, so that the join reads two exchanges and a passage in very many documents can be split between tasks
        first = materialize(first.where("first < last").select("key", "mark", "first"), "first-windows")
        marked = _candidates(batch, window, passed).join(first, ["key", "mark"]).where("first < doc_id").select("doc_id", "pos")
        found.append(materialize(marked, "repeated-windows"))
        index.compact()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, window: int = 50, batches: int = 2, fanout: int = 2, index: WindowIndex | None = None, older: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text and any more columns) with ``text`` cut down to the kept words, joined by one space,
    and ``n_words``, ``n_removed`` appended.

    A word goes if a window over it also starts in a document of smaller doc_id; windows are
    judged on the input.  A text that loses nothing still has its words joined by one space.
    Null texts have no words and become empty; rows with a null doc_id are kept whole and never a
    source; rows that repeat a doc_id are treated alike and never a source for each other.  With an open ``index``
    and the documents ``older`` that are in it, docs is a later batch: theirs count as sources too, and docs join the index.
    """
    at = repeated_positions(docs, window, batches, fanout, index, older).groupBy("doc_id").agg(F.collect_list("pos").alias("lagweave_pos"))
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "lagweave_pos")]
    kind = docs.schema["doc_id"].dataType
    joined = docs.select(keep).join(at.withColumn("doc_id", F.col("doc_id").cast(kind)), "doc_id", "left").select(*keep, "lagweave_pos")
    schema = docs.select(keep).schema.add("n_words", "long").add("n_removed", "long")
    where = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts, n_words, n_removed = [], [], []
                for text, starts in zip(part["text"].to_pylist(), part["lagweave_pos"]):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n_words.append(len(words))
                    if starts.is_valid and words:
                        step = np.zeros(len(words) + 1, np.int64)
                        s = np.unique(starts.values.to_numpy(zero_copy_only=False))
                        np.add.at(step, s, 1)
                        np.subtract.at(step, s + window, 1)
                        gone = np.cumsum(step[:-1]) > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                columns = part.columns[:-1]
                columns[where] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)
