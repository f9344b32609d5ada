"""The ten operators over their whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_crf, mixing, ngram_join, packing, pii, quality_rules, suffix_dedup, token_store, url_gbt
from .common import cut, raw, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.score_quality(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents are mixed and written in their global order; the columns that SQL has are returned of them."""
    mixed = cut(mixing.mix(table(spark, sf_dir, "documents")), "mixed")
    return mixed.select("doc_id", "source", F.col("__n").alias("n_copies"), F.col("__copy").alias("copy"), F.col("__key").alias("shuffle_key"), F.md5(raw("text")).alias("text_md5"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_exact_dedup, op3_packing, op4_quality_rules, op5_token_ids, op6_pii, op7_quality_classifier, op8_mixing,
        op9_ngram_jaccard_join, op10_url_filter,
    )
}

SQL = {
    "op2_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
""",
    "op4_quality_rules": quality_rules.rules_sql("doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"),
    "op8_mixing": """
with recursive c as (select coalesce(source, 'null') as src, count(*) as n from documents group by 1),
w as (select src, n, sqrt(n::double) as w from c), t as (select sum(w) as tw, sum(n) as tn from w),
r as (select src, rate, greatest(1, ceil(rate / 708))::int as parts, rate / greatest(1, ceil(rate / 708)) as part
      from (select src, 1.0::double * tn * (w / tw) / n as rate from w, t)),
cdf as (select src, part, 0 as j, exp(-part) as p, exp(-part) as c from r
        union all select src, part, j + 1, p * part / (j + 1), c + p * part / (j + 1) from cdf where j < ceil(part + 12 * sqrt(part) + 30)),
d as (select doc_id, documents.source, md5(coalesce(text, '')) as text_md5, r.src, unnest(range(1, parts + 1)) as i
      from documents join r on r.src = coalesce(documents.source, 'null')),
u as (select *, ('0x' || substr(md5('0:n' || (case when i > 1 then i::varchar else '' end) || ':' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0 as u from d),
k as (select u.doc_id, u.source, u.text_md5, count(*) filter (u.u >= cdf.c)::int as n_copies from u join cdf using (src) group by all)
select doc_id, source, n_copies, copy::int as copy, md5('0:k:' || coalesce(doc_id::varchar, 'null') || ':' || copy) as shuffle_key, text_md5
from (select *, unnest(range(1, n_copies + 1)) as copy from k)
""",
}
