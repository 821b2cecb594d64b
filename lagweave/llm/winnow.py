"""Document fingerprints by winnowing, with SQL functions only.

A text is cut into pieces: words in parts of at most four characters, and each character of a script
that puts no spaces between words.  Every piece is hashed once, and the hashes of all runs of ``k`` consecutive pieces are the values of a rolling hash over these (the
cyclic polynomial: the run's hashes, each turned by one bit for every piece after it, in exclusive or; one step on turns the value by a bit, takes the leaving
piece out and the entering one in).  Of every
``w`` consecutive hashes the least is selected, the rightmost of equal ones, and kept with its position.
Any run of w + k - 1 pieces that two texts share, which is any run of so many characters without spaces or about four times as many
from a word's start on, therefore gives them a common fingerprint entry; runs under k pieces never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han and Hangul, as ranges of code points.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF"
PIECE = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,4}}"
#: The same for texts without a character from the first of these scripts on, and what tells others.
PLAIN = r"[^\x20\x09-\x0D]{1,4}"
BEYOND = r"[^\x00-\u0DFF]"
#: An entry packs 35 bits of hash above 28 bits of (largest position - position).
POSITION_BITS = 28
LAST = (1 << POSITION_BITS) - 1


def selected(text: str, k: int = 4, w: int = 6) -> Column:
    """Entries of a text column as an array of longs; a text under k pieces has one entry over all of them, one without pieces none."""
    turned = [f"hs[i + {j}]" if j == k - 1 else f"(shiftleft(hs[i + {j}], {k - 1 - j}) | shiftrightunsigned(hs[i + {j}], {65 - k + j}))" for j in range(k)]
    short = "aggregate(hs, 0L, (a, h) -> (shiftleft(a, 1) | shiftrightunsigned(a, 63)) ^ h)"
    entry = lambda gram, i: f"(shiftleft({gram} & {(1 << 35) - 1}L, {POSITION_BITS}) | ({LAST}L - {i}))"
    keys = f"if(size(hs) < {k}, array({entry(short, 0)}), transform(sequence(0, size(hs) - {k}), i -> {entry('(' + ' ^ '.join(turned) + ')', 'i')}))"
    window = ", ".join(f"ks[i + {j}]" for j in range(w)) if w > 1 else "ks[i], ks[i]"
    least = f"if(size(ks) < {w}, array(array_min(ks)), array_distinct(transform(sequence(0, size(ks) - {w}), i -> least({window}))))"
    per_text = f"if(size(hs) = 0, cast(array() as array<bigint>), element_at(transform(array({keys}), ks -> {least}), 1))"
    # the pattern with scripts without spaces is slow, and few texts hold any
    every, plain = ("regexp_extract_all(coalesce({}, ''), '{}', 0)".format(text, p.replace("\\", "\\\\")) for p in (PIECE, PLAIN))
    pieces = "if({} rlike '{}', {}, {})".format(text, BEYOND.replace("\\", "\\\\"), every, plain)
    return F.expr(f"element_at(transform(array(transform({pieces}, p -> xxhash64(p))), hs -> {per_text}), 1)")


def hashes(entries: str) -> Column:
    """Distinct hashes of an entry array."""
    return F.expr(f"array_distinct(transform({entries}, e -> shiftright(e, {POSITION_BITS})))")


def as_text(entries: str) -> Column:
    """``hash:position`` of every entry in order, hash in hex, joined by commas."""
    return F.expr(f"array_join(transform({entries}, e -> concat(lower(hex(shiftright(e, {POSITION_BITS}))), ':', {LAST}L - (e & {LAST}L))), ',')")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two arrays of distinct hashes; 1 if both are empty."""
    return F.expr(f"transform(array(size(array_intersect({a}, {b}))), n -> if(size({a}) + size({b}) = 0, 1D, n / cast(size({a}) + size({b}) - n as double)))[0]")


def fingerprint(docs: DataFrame, k: int = 4, w: int = 6) -> DataFrame:
    """docs (text and any other columns) with ``entries`` and ``fingerprint`` appended; a null text counts as empty."""
    keep = [c for c in docs.columns if c not in ("entries", "fingerprint")]
    return docs.select(*keep, selected("text", k, w).alias("entries")).withColumn("fingerprint", as_text("entries"))


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_chars): the document that each one follows in descending doc_id, and its length.

    The largest follows the smallest.  Ids are dealt by range; only each range's first and last id
    meet in one task.  A doc_id counts once; null ids have no neighbours.
    """
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).alias("n_chars"))
    ids = materialize(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "document-order")
    near = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    lagged = ids.select("part", "doc_id", F.lag("doc_id").over(near).alias("prev_id"), F.lag("n_chars").over(near).alias("prev_chars"))
    ends = ids.groupBy("part").agg(F.min(F.struct("doc_id", "n_chars")).alias("low"))
    every = Window.orderBy("part")
    last = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("low").over(every), F.last("low").over(last)).alias("before"))
    inner = lagged.where("prev_id is not null").select("doc_id", "prev_id", "prev_chars")
    heads = lagged.where("prev_id is null").join(ends, "part").select("doc_id", F.col("before.doc_id").alias("prev_id"), F.col("before.n_chars").alias("prev_chars"))
    return inner.unionByName(heads)


def edited_likeness(docs: DataFrame, k: int = 4, w: int = 6) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, a row for each row.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document in descending doc_id (after the last: the first).  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.  Null texts are empty; a single document follows
    itself; rows with a null doc_id have no next document (its text counts as empty); of rows that
    repeat a doc_id the neighbour sees the longest text, then the last in code point order.
    """
    links = materialize(following(docs), "document-links")
    # no alias on a doc_id that is long already: the two exchanges must be the same plan to be reused
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # both joins deal the texts by doc_id in the same way, so that they are shuffled once
    known = rows.where("doc_id is not null")
    piece = F.expr("substring(text, 1, cast(floor(prev_chars / 2) as int))")
    heads = known.join(links, "doc_id").select(F.col("prev_id").alias("doc_id"), F.char_length("text").alias("n"), piece.alias("head"), selected("text", k, w).alias("next"))
    # its hashes alone are needed there
    heads = heads.withColumn("next", hashes("next"))
    heads = heads.groupBy("doc_id").agg(F.max(F.struct("n", "head", "next")).alias("of")).select("doc_id", "of.head", "of.next")
    both = known.join(heads, "doc_id", "left").select("doc_id", "text", "head", "next")
    both = both.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    n = F.char_length("text").cast("long")
    both = both.select("doc_id", n.alias("n_chars"), "text", "next", F.expr("concat(left(text, cast(char_length(text) - floor(char_length(text) / 2) as int)), coalesce(head, ''))").alias("edited"))
    both = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), selected("text", k, w).alias("own"), selected("edited", k, w).alias("new"), F.coalesce("next", F.expr("cast(array() as array<bigint>)")).alias("next"))
    named = both.select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("new").alias("edited_fingerprint"), hashes("own").alias("a"), hashes("new").alias("b"), F.col("next").alias("c"))
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))
