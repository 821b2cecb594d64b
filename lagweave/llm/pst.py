"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of a text and one end mark; a word that training lacks is the one unknown
symbol.  A state is a context of 1..``depth`` symbols before the next one, a start mark among
them, never past the start of its text.  A context is a candidate if it occurs ``min_count``
times; its distribution keeps the symbols that follow it ``min_edge`` times or more, each count
less ``discount``, and gives the mass left over to the distribution of its longest proper suffix,
down to the root c / (N + V) with V / (N + V) for the unknown symbol.  A candidate is retained if
the divergence of its distribution from that of its suffix, as the gain in log likelihood over
training, is ``divergence`` nats or more, or if a longer retained context ends in it.  Every
symbol, known or not, is scored by the longest retained suffix of what stands before it.

That score is a sum of looked-up numbers: log10 P(x | s) is the root's value of x plus, for each
retained suffix of the context, its back-off weight and, if x is kept there, a correction.  So
the model is one table (key, value) that grows with the corpus.  A pass over the texts adds up
the values of words and of other keys that occur ``hot`` times or more, at most ``most`` of either,
which are broadcast, and leaves the rest, a bit filter telling which exist, to a join by key and a sum
by row.  A frequent word has a small number as its symbol, any other its 64-bit hash; a context
is a key made of its symbols, exact for two frequent words and hashed beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, hashed_words, in_filter, materialize, slices, xxhash64

WORD_SEED = 7
#: Hashes that stand for the end and start marks, and what parts a state's key from that of a symbol.
END, START, STATE = np.uint64(0x8F3C1D5A96E2B471), np.uint64(0x2B9D64E07A51CF3D), np.uint64(0x5DEECE66D1B54A35)
#: Bits of a frequent word's number.
TURN = 22
#: Text bytes taken at a time: many where equal edges are counted together, fewer where texts are scored one by one; and symbols of them worked on at a time.
SLICE = 2 << 20
SCORED = 1 << 20
WINDOW = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the frequent words in order, their numbers, their counts by number, and the least of these counts."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    least: int

    def encode(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count) of hashed words; -1 as the count of others."""
        i, there = _find(self.hashes, hashed)
        number = self.numbers[i] if len(self.numbers) else np.zeros(len(hashed), np.uint64)
        return np.where(there, number, hashed), np.where(there, self.counts[np.where(there, number, 0).astype(np.int64)], -1)


@dataclass(frozen=True)
class SuffixTree:
    """Totals of the training texts, the frequent words, and the table (key, n, base, score) of other words, states and edges."""

    depth: int
    tokens: int
    distinct: int
    texts: int
    vocabulary: Vocabulary | None = None
    table: DataFrame | None = None
    states: list[DataFrame] = field(default_factory=list)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def joined(context: np.ndarray, symbol: np.ndarray, d: int) -> np.ndarray:
    """Key of a context of d symbols with the symbol after it, which is also the next longer context; hashed from three symbols on."""
    if d == 0:
        return symbol
    key = ((context << np.uint64(TURN)) | (context >> np.uint64(64 - TURN))) ^ symbol
    return xxhash64(key) if d > 1 else key


def _joined_sql(d: int) -> Column:
    key = F.expr(f"(shiftleft(context, {TURN}) | shiftrightunsigned(context, {64 - TURN})) ^ symbol")
    return F.xxhash64(key) if d > 1 else key


def _signed(key: np.uint64) -> Column:
    return F.lit(int(key.view(np.int64)))


def _filter(keys: DataFrame, most_bits: int) -> np.ndarray:
    """Bit filter of the hashed keys."""
    return bit_filter(keys.select(F.xxhash64("key").alias("key")), "key", most_bits)


def _may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return in_filter(held, xxhash64(keys))


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words and of the end mark, which of them each symbol of the texts is, one text after
    the other with an end mark after each, the place of each symbol in its text, symbols per text)."""
    words, per = hashed_words(texts, lower=True, seed=WORD_SEED)
    key, codes = np.unique(words, return_inverse=True)
    ends = np.cumsum(per + 1) - 1
    which = np.full(len(codes) + len(per), len(key), np.int64)
    inner = np.ones(len(which), bool)
    inner[ends] = False
    which[inner] = codes
    at = np.arange(len(which)) - np.repeat(ends - per, per + 1)
    return np.r_[key, END], which, at, per + 1


def contexts(symbol: np.ndarray, at: np.ndarray, depth: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For d = 0..depth: the context of d symbols before each of symbol[low:high], and whether its text reaches back so far."""
    first = max(0, low - depth)
    s, a = symbol[first:high], at[first:high]
    before = np.r_[np.uint64(0), s[:-1]]
    before[a == 0] = START
    ctx, own = np.zeros(len(s), np.uint64), slice(low - first, None)
    yield ctx[own], np.ones(high - low, bool)
    for d in range(1, depth + 1):
        ctx = joined(np.r_[np.uint64(0), ctx[:-1]], before, d - 1)
        yield ctx[own], (a >= d - 1)[own]


def _windows(symbol: np.ndarray) -> Iterator[tuple[int, int]]:
    for low in range(0, len(symbol), WINDOW):
        yield low, min(low + WINDOW, len(symbol))


def _words(docs: DataFrame) -> DataFrame:
    """(key, n) of every word, by hash, and of the end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                key, which, _, _ = stream(part["text"])
                n = np.bincount(which, minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[n > 0]), pa.array(n[n > 0])], ["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _least(table: DataFrame, hot: int, most: int) -> int:
    """The least count from ``hot`` on that at most ``most`` keys have or exceed, from a histogram of some hundred bins."""
    frequent = table.where(F.col("n") >= hot)
    if frequent.count() <= most:
        return hot
    bins = frequent.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.min("n").alias("low"), F.count("*").alias("keys"))
    low, held = 1 << 62, 0
    for r in bins.orderBy(F.desc("bin")).collect():  # 16 for each doubling of n
        held += r["keys"]
        if held > most:
            break
        low = r["low"]
    return low


def _vocabulary(words: DataFrame, hot: int, most: int) -> Vocabulary:
    """The frequent words, at most ``most`` rows of 16 bytes, numbered from 1 by falling count."""
    least = _least(words, hot, most)
    few = words.where(F.col("n") >= least).toArrow()
    key, n = np.asarray(few["key"]).view(np.uint64), np.asarray(few["n"])
    number = np.empty(len(key), np.uint64)
    number[np.lexsort((key, -n))] = np.arange(1, len(key) + 1, dtype=np.uint64)
    counts = np.zeros(len(key) + 1, np.int64)
    counts[number.astype(np.int64)] = n
    order = np.argsort(key)
    return Vocabulary(key[order], number[order], counts, least)


def _symbols(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(key, n) of the words as symbols."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol, _ = shared.value.encode(np.asarray(batch["key"]).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(symbol.view(np.int64)), batch["n"]], ["key", "n"])

    return words.mapInArrow(run, "key long, n long")


def _edges(docs: DataFrame, d: int, shorter: DataFrame, vocabulary: Vocabulary, min_count: int, min_edge: int, most_bits: int) -> DataFrame:
    """(context, suffix, symbol, n, total): symbols that follow a context of d symbols ``min_edge`` times or more.

    ``shorter`` (key, n) holds the keys of one symbol less; a context and a suffix with the symbol cannot be more frequent than these.
    """
    spark = docs.sparkSession
    unnamed = shorter.where(F.col("n") < vocabulary.least) if d == 1 else shorter
    often = _filter(unnamed.where(F.col("n") >= min_count), most_bits)
    known = _filter(unnamed.where(F.col("n") >= min_edge), most_bits)
    shared = spark.sparkContext.broadcast((vocabulary, often, known))  # two filters of at most most_bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, often, known = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashed, which, at, _ = stream(part["text"])
                word, count = vocabulary.encode(hashed)
                if d == 1:
                    # of single words by their counts; the start mark is a context as often as there are texts
                    leads = np.where(count < 0, _may_hold(often, word), count >= min_count)
                    follows = np.where(count < 0, _may_hold(known, word), count >= min_edge)
                    keep = follows[which] & ((at == 0) | np.r_[False, leads[which[:-1]]])
                symbol = word[which]
                for low, high in _windows(symbol):
                    *_, (suffix, _), (ctx, whole) = contexts(symbol, at, d, low, high)
                    now = symbol[low:high]
                    if d == 1:
                        some = np.flatnonzero(keep[low:high])
                    else:
                        some = np.flatnonzero(whole)
                        some = some[_may_hold(often, ctx[some])]
                        some = some[_may_hold(known, joined(suffix[some], now[some], d - 1))]
                    ctx, suffix, now = ctx[some], suffix[some], now[some]
                    _, first, n = np.unique(joined(ctx, now, d), return_index=True, return_counts=True)
                    order = np.argsort(ctx[first], kind="stable")
                    first, n = first[order], n[order]
                    columns = [pa.array(x[first].view(np.int64)) for x in (ctx, suffix, now)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], ["context", "suffix", "symbol", "n"])

    counted = docs.mapInArrow(run, "context long, suffix long, symbol long, n long")
    counted = counted.groupBy("context", "suffix", "symbol").agg(F.sum("n").alias("n")).where(F.col("n") >= min_edge)
    frequent = shorter.where(F.col("n") >= min_count).select(F.col("key").alias("context"), F.col("n").alias("total"))
    out = materialize(counted.join(frequent, "context"), f"suffix-edges-{d}")
    shared.unpersist()
    return out


def _level(edges: DataFrame, shorter: DataFrame, d: int, discount: float) -> tuple[DataFrame, DataFrame]:
    """Candidate states (context, suffix, total, backoff, gain) and their edges (.., p, q): p the symbol's probability after
    the context, q that after its suffix."""
    per = edges.groupBy("context", "suffix", "total").agg(F.sum("n").alias("kept"), F.count("*").alias("symbols"))
    per = per.withColumn("backoff", (F.col("total") - F.col("kept") + discount * F.col("symbols")) / F.col("total"))
    per = materialize(per, f"suffix-sums-{d}")
    full = edges.join(per.select("context", "backoff"), "context").join(shorter, ["suffix", "symbol"])
    full = full.withColumn("p", (F.col("n") - discount) / F.col("total") + F.col("backoff") * F.col("q"))
    full = materialize(full.select("context", "suffix", "symbol", "n", "p", "q", "backoff"), f"suffix-level-{d}")
    gains = full.groupBy("context").agg(F.sum(F.expr("n * ln(p / q)")).alias("gain"))
    per = per.join(gains, "context").withColumn("gain", F.expr("gain + (total - kept) * ln(backoff)"))
    return materialize(per.select("context", "suffix", "total", "backoff", "gain"), f"suffix-candidates-{d}"), full


def grow(docs: DataFrame, depth: int = 2, min_count: int = 32, min_edge: int = 4, divergence: float = 6.0, discount: float = 0.75, hot: int = 8, most: int = 2_000_000, most_bits: int = 1 << 27) -> SuffixTree:
    """Tree of all texts of ``docs`` (column text, no nulls).

    Every context and symbol that passes the tests above is kept, however many there are; ``hot`` and ``most`` only decide
    how they are looked up.
    """
    if depth < 1 or min_edge < 1 or min_count < min_edge or not 0 < discount < 1 or most >= 1 << TURN:
        raise ValueError("needs depth and min_edge from 1, min_count from min_edge, a discount in (0, 1), under 2**22 hot words")
    words = materialize(_words(docs), "word-counts")
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("key") == _signed(END), F.col("n"))).alias("texts")).first()
    n, v, texts = sums["n"] or 0, sums["v"], sums["texts"] or 0
    if not n:
        return SuffixTree(depth, 0, 0, 0)
    vocabulary = _vocabulary(words, hot, most)
    words = materialize(_symbols(words, vocabulary), "symbol-counts")
    # the start mark is a context, not a symbol
    shorter = words.unionByName(docs.sparkSession.createDataFrame([(int(START.view(np.int64)), texts)], "key long, n long"))
    lower = words.select(F.lit(0).cast("long").alias("suffix"), F.col("key").alias("symbol"), (F.col("n") / (n + v)).alias("q"))
    levels = []
    for d in range(1, depth + 1):
        states, full = _level(_edges(docs, d, shorter, vocabulary, min_count, min_edge, most_bits), lower, d, discount)
        levels.append((states, full))
        shorter = full.select(_joined_sql(d).alias("key"), "n")
        lower = full.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("q"))
    kept, longer = [], None
    for states, _ in reversed(levels):
        keep = states.where(F.col("gain") >= divergence)
        if longer is not None:
            ends = longer.select(F.col("suffix").alias("context")).distinct()
            keep = keep.unionByName(states.where(F.col("gain") < divergence).join(ends, "context", "left_semi"))
        longer = materialize(keep, "suffix-states")
        kept.insert(0, longer)
    zero = F.lit(0.0)
    rows = words.where(F.col("n") < vocabulary.least).select("key", "n", F.log10(F.col("n") + 1).alias("base"), F.log10(F.col("n") / v).alias("score"))
    for d, (states, (_, full)) in enumerate(zip(kept, levels), 1):
        rows = rows.unionByName(states.select(F.col("context").bitwiseXOR(_signed(STATE)).alias("key"), F.col("total").alias("n"), zero.alias("base"), F.log10("backoff").alias("score")))
        own = full.join(states.select("context"), "context", "left_semi")
        rows = rows.unionByName(own.select(_joined_sql(d).alias("key"), "n", zero.alias("base"), F.expr("log10(p) - log10(q) - log10(backoff)").alias("score")))
    return SuffixTree(depth, n, v, texts, vocabulary, materialize(rows, "suffix-tree"), kept)


@dataclass(frozen=True)
class _Hot:
    """The most frequent keys but those of frequent words, with their values, and a filter of all such keys.

    Words alone have a base; ``based`` are the places of those that have one.
    """

    keys: np.ndarray
    score: np.ndarray
    based: np.ndarray
    base: np.ndarray
    every: np.ndarray

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, score, whether the key is left to the join)."""
        base, score, cold = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), bool)
        some = np.flatnonzero(_may_hold(self.every, keys))
        i, there = _find(self.keys, keys[some])
        score[some[there]] = self.score[i[there]]
        if len(self.based):
            j, word = _find(self.based, i[there])
            base[some[there][word]] = self.base[j[word]]
        cold[some[~there]] = True
        return base, score, cold


def _hot(tree: SuffixTree, least: int, most_bits: int) -> _Hot:
    """16 bytes for each frequent key; every task's process holds its own copy."""
    few = tree.table.where(F.col("n") >= least).select("key", "base", "score").toArrow()
    key, base = np.asarray(few["key"]).view(np.uint64), np.asarray(few["base"])
    order = np.argsort(key)
    based = np.flatnonzero(base[order] != 0)
    return _Hot(key[order], np.asarray(few["score"])[order], based, base[order][based], _filter(tree.table, most_bits))


def _rows(docs: DataFrame, tree: SuffixTree, least: int, most_bits: int) -> DataFrame:
    """For each text a row with its sums over hot keys, and a row (row, key, tf) for each other key it needs.

    A text's row is named by its partition and its place there; ``key`` is of no use in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tree.vocabulary, _hot(tree, least, most_bits)))
    depth, distinct = tree.depth, tree.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, hot = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", SCORED):
                hashed, which, at, per = stream(part["text"])
                owner = np.repeat(np.arange(len(per)), per)
                word, count = vocabulary.encode(hashed)
                named = count >= 0
                base, score, cold = hot.look_up(np.where(named, np.uint64(0), word))
                base = np.where(named, np.log10(np.maximum(count, 0) + 1.0), base)
                score = np.where(named, np.log10(np.maximum(count, 1) / distinct), score)
                base, score, known = (np.bincount(owner, weights=x[which], minlength=len(per)) for x in (base, score, base > 0))
                left = (cold & ~named)[which]
                cold_key, cold_owner = [word[which[left]]], [owner[left]]
                # the states of one symbol are looked up once for each word
                one = np.r_[word, START] ^ STATE
                _, one_score, one_cold = hot.look_up(one)
                one_alive = one_cold | (one_score != 0)
                before = np.r_[len(word), which[:-1]]
                before[at == 0] = len(word)
                symbol = word[which]
                for low, high in _windows(symbol):
                    alive, own = np.arange(high - low), owner[low:high]
                    for d, (ctx, whole) in enumerate(contexts(symbol, at, depth, low, high)):
                        if d == 0:
                            continue
                        # no longer context is retained where a shorter one is not
                        if d == 1:
                            lead = before[low:high]
                            alive = alive[one_alive[lead]]
                            value, rest = one_score[lead[alive]], one_cold[lead[alive]]
                        else:
                            alive = alive[whole[alive]]
                            _, value, rest = hot.look_up(ctx[alive] ^ STATE)
                            held = rest | (value != 0)
                            alive, value, rest = alive[held], value[held], rest[held]
                        score += np.bincount(own[alive], weights=value, minlength=len(per))
                        cold_key.append(ctx[alive[rest]] ^ STATE)
                        cold_owner.append(own[alive[rest]])
                        key = joined(ctx[alive], symbol[low:high][alive], d)
                        _, value, rest = hot.look_up(key)
                        score += np.bincount(own[alive], weights=value, minlength=len(per))
                        cold_key.append(key[rest])
                        cold_owner.append(own[alive[rest]])
                k, o = np.concatenate(cold_key), np.concatenate(cold_owner)
                order = np.lexsort((k, o))
                k, o = k[order], o[order]
                new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, np.int64)
                tf = np.diff(np.r_[new, len(k)])
                own = row + np.arange(len(per))
                row += len(per)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), pa.array(np.zeros(len(per), np.int32)), part["doc_id"], part["learn"], *(pa.array(x) for x in (per, base, score, known))], names)
                for a in range(0, len(new), 200_000):
                    some = slice(a, a + 200_000)
                    at_rows = own[o[new[some]]]
                    none = [pa.nulls(len(at_rows), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(at_rows), pa.array(k[new[some]].view(np.int64)), pa.array(tf[some].astype(np.int32)), *none], names)

    schema = "row long, key long, tf int, doc_id long, learn boolean, n_tokens long, base double, score double, known double"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def score_with(rows: DataFrame, tree: SuffixTree, hot: int = 8, most: int = 2_000_000, most_bits: int = 1 << 27) -> DataFrame:
    """rows (doc_id, text, learn) scored by a tree: (doc_id, learn, n_tokens, n_known, base, score)."""
    if tree.table is None:
        count = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long") + 1
        return rows.select("doc_id", "learn", count.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"))
    least = _least(tree.table, hot, most)
    wanted = _rows(rows, tree, least, most_bits)
    table = tree.table.where(F.col("n") < least).select("key", F.col("base").alias("key_base"), F.col("score").alias("key_score"))
    # a text's own row finds nothing: its tf is 0
    both = wanted.join(table, "key", "left")
    zero = F.lit(0.0)
    sums = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("learn").alias("learn"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", zero) + F.when(F.col("key_base") > 0, F.col("tf")).otherwise(0)).cast("long").alias("n_known"),
        F.sum(F.coalesce("base", zero) + F.col("tf") * F.coalesce("key_base", zero)).alias("base"),
        F.sum(F.coalesce("score", zero) + F.col("tf") * F.coalesce("key_score", zero)).alias("score"),
    )
    unknown = math.log10(tree.distinct / (tree.tokens + tree.distinct))
    return sums.select(
        "doc_id",
        "learn",
        "n_tokens",
        "n_known",
        (F.col("base") - F.col("n_tokens") * math.log10(tree.tokens + tree.distinct + 1)).alias("base"),
        (F.col("score") + F.col("n_tokens") * unknown).alias("score"),
    )


def score_corpus(docs: DataFrame, held_out: Column, hot: int = 8, most: int = 2_000_000, **options) -> DataFrame:
    """Score all docs (doc_id, text) with a tree learned from those where ``held_out`` is not true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each input row, null ids
    (never held out) and repeated rows included; other columns are ignored.  A null text is empty: one token, the
    end mark.  Without training rows every token is unknown and both scores are 0.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("learn"))
    tree = grow(rows.where("learn").select("text"), hot=hot, most=most, **options)
    out = score_with(rows, tree, hot, most)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
