"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark, sf_dir):
    from pixelloom.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_line_dedup(spark, sf_dir):
    from pixelloom.llm.linededup import line_report

    return line_report(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op7_warc(spark, sf_dir):
    from pixelloom.llm.warc import warc_report

    return warc_report(spark, table(spark, sf_dir, "pages"), min_bytes=1000)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the files stay where they are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_store(spark, sf_dir):
    from pixelloom.llm.common import scratch
    from pixelloom.llm.tokenstore import store_report

    return store_report(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op9_simhash(spark, sf_dir):
    from pixelloom.llm.simhash import simhash_report

    return simhash_report(table(spark, sf_dir, "documents"), words=3, distance=3)


def op10_lm_score(spark, sf_dir):
    from pixelloom.llm.lm import lm_report

    return lm_report(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    from pixelloom.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_decontamination(spark, sf_dir):
    from pixelloom.llm.decontam import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secrets(spark, sf_dir):
    from pixelloom.llm.secrets import secrets_report

    return secrets_report(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark, sf_dir):
    from pixelloom.llm.spiece import encoded

    return encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_whitening(spark, sf_dir):
    from pixelloom.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"), k=4)


def relabelled(vectors: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, label is (label + 1) % 10."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def op12_hard_negatives(spark, sf_dir):
    from pixelloom.llm.hardneg import hard_negatives

    vectors = relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0), k_positive=5, k_negative=5, share=(4, 5))


def op13_vector_near_dedup(spark, sf_dir):
    from pixelloom.llm.vectordup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def queries():
    return {f.__name__: f for f in (op1_exact_topk, op2_line_dedup, op3_token_store, op4_decontamination, op5_quality, op6_sentencepiece, op7_warc, op8_secrets, op9_simhash, op10_lm_score, op11_whitening, op12_hard_negatives, op13_vector_near_dedup)}


OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), {LOWERED}) AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY k.doc_id
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP13 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.a AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)
"""


def oracle_sql():
    return {"op1_exact_topk": OP1, "op2_line_dedup": OP2, "op7_warc": OP7, "op12_hard_negatives": OP12, "op13_vector_near_dedup": OP13}
