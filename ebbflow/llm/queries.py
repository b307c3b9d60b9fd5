"""Registered queries of the subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.llm import angular, bytebpe, covertree, epsilongrid, html, jaccard, langid, lbl, packing, phrases, substrings
from ebbflow.llm.common import is_remainder, table
from ebbflow.llm.oracles import dedup_sql, hard_negatives_sql, jaccard_sql, near_vectors_sql, phrases_sql, quality_sql
from ebbflow.llm.quality import line_quality
from ebbflow.llm.registry import register
from ebbflow.llm.secrets import secret_spans
from ebbflow.llm.vocab import public_path


@register("op1_quality_rules", sql=quality_sql())
def op1_quality_rules(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"))


@register("op4_secret_scans")
def op4_secret_scans(spark, sf_dir):
    return secret_spans(table(spark, sf_dir, "documents"))


@register("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = is_remainder("doc_id", 4, 2)
    return langid.predict(docs, langid.fit(docs.filter(~held_out)), held_out)


@register("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


@register("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers
    return bytebpe.encode_documents(
        table(spark, sf_dir, "documents"), public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op3_lm_scoring")
def op3_lm_scoring(spark, sf_dir):
    return lbl.score(table(spark, sf_dir, "documents"), is_remainder("doc_id", 7, 2))


@register("op10_ngram_jaccard_join", sql=jaccard_sql())
def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_suffix_array_dedup", sql=dedup_sql())
def op8_suffix_array_dedup(spark, sf_dir):
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


@register("op9_exact_topk", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda k: q.v[k] * c.v[k])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
""")
def op9_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@register("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


@register("op11_phrase_collocations", sql=phrases_sql())
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@register("op12_embedding_near_dedup", sql=near_vectors_sql())
def op12_embedding_near_dedup(spark, sf_dir):
    return epsilongrid.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op13_hard_negatives", sql=hard_negatives_sql())
def op13_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return angular.mine(vectors, vectors.filter("vec_id % 100 = 0"))
