"""Queries over the test tables, one for each operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, mixing, negatives, pst, resample, simhash, substring, toxicity, warc, winnow, zquality
from .common import held


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(_read(spark, sf_dir, "conversations"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held("doc_id", 3, 1)))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_corpus(_read(spark, sf_dir, "documents").select("doc_id", "text"), held("doc_id", 7, 2))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(~held("doc_id", 5, 0))
    out = zquality.classify(docs, zquality.train(docs, labels))
    return out.select("doc_id", held("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(_read(spark, sf_dir, "pages")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(~held("doc_id", 4, 2))
    out = toxicity.classify(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held("doc_id", 4, 2).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_preference, op3_langid, op4_suffix_tree, op5_quality, op6_substring, op7_decontam, op8_winnow, op9_warc, op10_mixing, op11_toxicity, op12_resample, op13_negatives)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE = {"op2_preference": chat.ORACLE}

ORACLE["op6_substring"] = f"""
with d as (select doc_id, {_WORDS} w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50),
k as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from p),
f as (select h, min(doc_id) first from k group by h),
c as (select distinct doc_id, unnest(range(i, i + 50)) j from k join f using (h) where first < doc_id),
g as (select doc_id, list(j order by j) js from c group by doc_id),
o as (select d.doc_id, len(w) n, case when js is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(js, x[2])), lambda x: x[1]) end kept from d left join g using (doc_id))
select doc_id, cast(n as bigint) n_words, cast(n - len(kept) as bigint) n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from o
"""

ORACLE["op9_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) s from pages),
f as (select s, min(page_id) first from p group by s),
x as (select p.page_id, octet_length(b) n, upper(s) s, first from p join f using (s))
select page_id, cast(n as bigint) payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(('0x' || '0' || substr(s, 1 + 5 * (g // 4), 5))::bigint >> (15 - 5 * (g % 4)) & 31 as int), 1), '' order by g) from range(32) t(g)) payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id = first then null else first end refers_to
from x
"""

ORACLE["op10_mixing"] = f"""
with d as (select doc_id, source, cast(len({_WORDS}) as bigint) size, md5('0:' || coalesce(cast(doc_id as varchar), '')) draw from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
a as (select *, [5.0::double, 2.0::double, 1.0::double][1 + cast((row_number() over (order by source nulls last) - 1) % 3 as int)] w, source_size * 3.0::double cap from s),
b as (select *, sum(source_size) over () total, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0) capped,
  sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0) rest from a),
c as (select *, (total - capped) / rest lev from b),
e as (select *, (select arg_min(lev, capped) from c where cap >= lev * w) fixed from c),
t as (select source, source_size, least(cap, fixed * w) target from e),
q as (select *, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end whole from t),
r as (select d.*, source_size, target, whole, cast(round(target) as bigint) - whole * source_size more,
  sum(size) over (partition by d.source order by draw, doc_id, size rows unbounded preceding) upto from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target, cast(size * whole + greatest(0, least(size, more - upto + size)) as bigint) taken from r
"""

ORACLE["op13_negatives"] = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor, b.vec_id other, a.label = b.label same, cast(list_inner_product(a.v, b.v) as bigint) score from r a join r b on a.vec_id % 100 = 0),
p as (select anchor, other, score from s where same and anchor <> other qualify row_number() over (partition by anchor order by score desc, other) <= 5),
n as (select p.anchor, p.other positive, p.score ps, s.other negative, s.score ns, row_number() over (partition by p.anchor, p.other order by s.score desc, s.other) k
  from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor anchor_id, positive positive_id, cast(k as integer) "rank", negative negative_id, ps positive_score, ns negative_score from n where k <= 10
"""
