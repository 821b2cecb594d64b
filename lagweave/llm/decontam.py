"""Benchmark decontamination by template canonicalisation, with SQL functions only.

Numbers, units after a number and names inside a sentence become typed placeholders.  Windows
of ``width`` template words are hashed and hash-joined with those of the benchmark; for every
match the values in the slots are compared along the alignment: one benchmark value must
always meet one document value and the other way round.  A changed slot that breaks this takes
away the windows over it and no others.  A window with hardly an ordinary word is hashed with its values.  Equal values make a copy, a consistent renaming makes
a re-parameterised question, anything else is no leak.  An item shorter than a window is one
window of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Measurement units that become <unit> after a number.
UNITS = "km cm mm mi ft in kg mg lb oz ml l s h min hours hour minutes minute seconds second days day weeks week months month years year meters meter metres metre miles mile feet inches kilometers kilograms grams gram litres liters dollars dollar euros euro cents percent degrees degree m g usd eur".split()
NUMBER = r"(?<![\\p{L}\\p{N}])[-+]?\\p{N}+(?:[.,:]\\p{N}+)*"
UNIT = r"(?<=znumz )(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\\p{L}\\p{N}])"
NAME = r"(?<=[\\p{Ll}\\p{N},;:] )\\p{Lu}[\\p{L}\\p{M}]*"
SPLIT = r"[^\\p{L}\\p{M}\\p{N}]+"
#: Placeholder words, by type.
SLOTS = {"znumz": NUMBER, "zunitz": UNIT, "znamez": NAME}
WIDTH = 8
#: Ordinary words that an item shorter than a window must have to be looked for.
FEWEST = 3
#: Ordinary words below which a window is compared with its values, not as a template.
LITERAL = 2
#: Consecutive template words that are a leak whatever their share of the item.
RUN = 13


def _steps(text: str) -> list[str]:
    """SQL of the text before each type of slot is replaced, and after the last."""
    out = [f"coalesce({text}, '')"]
    out.append(f"if({out[0]} rlike '\\\\p{{N}}', regexp_replace({out[0]}, '{NUMBER}', ' znumz '), {out[0]})")
    out.append(f"if({out[0]} rlike '\\\\p{{N}}', regexp_replace(regexp_replace({out[1]}, 'znumz +', 'znumz '), '{UNIT}', 'zunitz'), {out[1]})")
    out.append(f"regexp_replace({out[2]}, '{NAME}', 'znamez')")
    return out


def template(text: str) -> Column:
    """Template words of a text column: lower case, without punctuation, slots as placeholders."""
    return F.expr(f"filter(split(lower({_steps(text)[-1]}), '{SPLIT}', -1), w -> w <> '')")


#: Text whose words pair up with the template words: numbers on their own, without inner signs.
RAW = f"regexp_replace(regexp_replace(coalesce(text, ''), '{NUMBER}', ' $0 '), '(?<=\\\\p{{N}})[.,:](?=\\\\p{{N}})', '')"
_SLOT = ", ".join(f"'{kind}'" for kind in SLOTS)


def _hashes(width: str) -> str:
    """SQL of the hashes of all windows of so many template words ``ws`` of ``text``.

    A window of under ``LITERAL`` ordinary words says nothing as a template, and every table of numbers would match every other:
    it is hashed with the values in its slots.
    """
    plain = f"xxhash64(slice(ws, i, {width}))"
    either = f"if(size(filter(slice(ws, i, {width}), x -> x not in ({_SLOT}))) >= {LITERAL}, {plain}, xxhash64('', slice(rw, i, {width})))"
    places = f"sequence(1, size(ws) - {width} + 1)"
    words = f"filter(split(lower({RAW}), '{SPLIT}', -1), w -> w <> '')"
    valued = f"element_at(transform(array({words}), rw -> if(size(rw) = size(ws), transform({places}, i -> {either}), transform({places}, i -> {plain}))), 1)"
    few = f"size(filter(ws, x -> x in ({_SLOT}))) <= {width} - {LITERAL}"
    return f"if(size(ws) < {width}, cast(array() as array<bigint>), if({few}, transform({places}, i -> {plain}), {valued}))"


def _windows(rows: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """(key, pos, h) of every window of template words, pos from 1."""
    rows = rows.select(key, "text", template("text").alias("ws"))
    every = F.expr(" || ".join(f"transform({_hashes(str(w))}, (h, i) -> struct(i + 1 as pos, h as h))" for w in widths))
    return rows.select(key, F.explode(every).alias("x")).select(key, "x.pos", "x.h")


def _item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, w, pos, h): windows of w template words, w less than ``width`` for the one window of a short item."""
    rows = items.select("item_id", "text", template("text").alias("ws")).withColumn("w", F.expr(f"least({width}, size(ws))"))
    rows = rows.where(f"w = {width} or size(filter(ws, x -> x not in ({_SLOT}))) >= {FEWEST}")
    return rows.select("item_id", "w", F.posexplode(F.expr(_hashes("w"))).alias("pos", "h")).select("item_id", "w", (F.col("pos") + 1).alias("pos"), "h")


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, kind, value) of every slot: its place among the template words and what stood there."""
    steps = _steps("text")
    values = F.create_map(*(x for k, (kind, pattern) in enumerate(SLOTS.items()) for x in (F.lit(kind), F.expr(_values(steps, k, pattern)))))
    rows = rows.select(key, template("text").alias("ws"), values.alias("values"))
    # the n-th placeholder of a type holds the n-th value of that type
    places = "filter(transform(ws, (w, i) -> struct(w as kind, i + 1 as at)), x -> x.kind in ('znumz', 'zunitz', 'znamez'))"
    ranked = F.explode(F.expr(" || ".join(f"transform(filter(places, x -> x.kind = '{kind}'), (x, n) -> struct(x.kind as kind, x.at as at, n + 1 as n))" for kind in SLOTS))).alias("s")
    out = rows.select(key, "values", F.expr(places).alias("places")).select(key, "values", ranked)
    return out.select(key, F.col("s.at").alias("at"), F.col("s.kind").alias("kind"), F.lower(F.expr("try_element_at(element_at(values, s.kind), cast(s.n as int))")).alias("value"))


def _values(steps: list[str], k: int, pattern: str) -> str:
    before = steps[k] if k != 1 else f"regexp_replace({steps[1]}, 'znumz +', 'znumz ')"
    return f"regexp_extract_all({before}, '{pattern}', 0)"


def _has_run(starts: str, windows: Column) -> Column:
    """Whether sorted distinct window starts hold so many consecutive ones."""
    return F.exists(F.transform(starts, lambda p, i: F.get(F.col(starts), i + windows - 1) == p + windows - 1), lambda x: F.coalesce(x, F.lit(False)))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = 0.3, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, kind, n_windows, coverage): documents that hold a benchmark item.

    docs: doc_id, text; benchmark: item_id, text.  A pair counts if its consistent windows are at least ``coverage`` of the
    item's, or if those of one alignment span ``run`` consecutive words.  kind: ``copy`` if the windows of alignments
    without a consistent change are that many, else ``reparameterised``.  An item of fewer than ``width`` template words is
    looked for as a whole if ``FEWEST`` of them are no placeholders; null texts count as
    empty; rows with a null id are left out; repeated rows count once.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    known = materialize(_item_windows(items, width).distinct(), "benchmark-windows")
    total = known.groupBy("item_id").agg(F.countDistinct("pos").alias("total"), F.max("w").alias("w"))
    n = known.count()
    # at most ``width`` of them
    widths = sorted(r.w for r in known.select("w").distinct().collect()) or [width]
    known = known.select("item_id", F.col("pos").alias("item_pos"), "h")
    if n <= 1_000_000:  # 24 bytes a window
        known = F.broadcast(known)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = _windows(rows, "doc_id", widths).join(known, "h").select("doc_id", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = materialize(hits, "template-hits")
    # windows that span a run of words
    long = F.lit(max(1, run - width + 1))
    key = ["doc_id", "item_id", "shift"]
    spans = hits.groupBy(*key).agg(F.array_sort(F.collect_set("item_pos")).alias("starts"))
    spans = materialize(spans.withColumn("long", _has_run("starts", long)), "template-spans")
    enough = F.col("n") >= F.col("total") * coverage
    pairs = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("item_pos").alias("n")).join(total, "item_id").where(enough).select("doc_id", "item_id")
    pairs = pairs.unionByName(spans.where("long").select("doc_id", "item_id")).distinct()
    spans = spans.drop("long").join(pairs, ["doc_id", "item_id"], "left_semi").join(total.select("item_id", "w"), "item_id")
    spans = materialize(spans, "alignments")
    few = materialize(spans.select("doc_id").distinct(), "leaking-documents")
    doc_slots = _slots(rows.where("text rlike '\\\\p{N}|[\\\\p{Ll}\\\\p{N},;:] \\\\p{Lu}'").join(few, "doc_id", "left_semi"), "doc_id").distinct()
    item_slots = _slots(items, "item_id").distinct()
    inside = F.expr("exists(starts, p -> p <= at and at < p + w)")
    met = spans.join(item_slots.withColumnRenamed("value", "item_value"), "item_id").where(inside).withColumn("item_at", F.col("at")).withColumn("at", F.col("at") + F.col("shift"))
    met = met.join(doc_slots, ["doc_id", "at", "kind"]).select(*key, "item_at", "kind", "item_value", "value")
    met = materialize(met, "slots-met")
    forward = met.groupBy(*key, "kind", "item_value").agg(F.countDistinct("value").alias("m")).where("m > 1").drop("m").withColumn("torn", F.lit(True))
    backward = met.groupBy(*key, "kind", "value").agg(F.countDistinct("item_value").alias("m")).where("m > 1").drop("m").withColumn("merged", F.lit(True))
    changed = met.where("not (item_value <=> value)").join(forward, [*key, "kind", "item_value"], "left").join(backward, [*key, "kind", "value"], "left")
    broken = F.coalesce("torn", "merged", F.lit(False))
    changed = changed.groupBy(*key).agg(F.collect_set(F.when(broken, F.col("item_at"))).alias("broken"), F.max(~broken).alias("changed"))
    good = spans.join(changed, key, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    good = good.withColumn("starts", F.expr("filter(starts, p -> not exists(coalesce(broken, array()), at -> p <= at and at < p + w))"))
    good = good.select(*key, "starts", "changed", _has_run("starts", long).alias("long"))
    found = good.select(*key, F.explode("starts").alias("p"), "changed", "long")
    found = found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("p").alias("n_windows"), F.countDistinct(F.when(~F.col("changed"), F.col("p"))).alias("same"), F.max("long").alias("long"), F.max(F.col("long") & ~F.col("changed")).alias("long_same")
    )
    found = found.join(total, "item_id").where((F.col("n_windows") >= F.col("total") * coverage) | F.col("long"))
    kind = F.when((F.col("same") >= F.col("total") * coverage) | F.col("long_same"), "copy").otherwise("reparameterised")
    return found.select("doc_id", "item_id", kind.alias("kind"), "n_windows", (F.col("n_windows") / F.col("total")).alias("coverage"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of docs without those that hold a benchmark item; columns unchanged."""
    gone = leaks(docs, benchmark, **options).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(materialize(gone, "leaks"), "doc_id", "left_anti").select(docs.columns)
