"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, forest, langid, minhash, packing, quality, token_count, topk, toxicity, warc
from .common import hash_split
from .tokens import vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(divisor: int, remainder: int):
    """Whether the id's hash leaves ``remainder``; a null id's row is not held out."""
    return F.coalesce(hash_split("doc_id", divisor) == remainder, F.lit(False)).alias("held_out")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    identifier = langid.fit(documents.where(hash_split("doc_id", 3) != 1))
    return langid.identify(documents, identifier).select("doc_id", held_out(3, 1), "lang_pred", "score", "rejected")


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op6_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(hash_split("doc_id", 5) != 0)
    return quality.fit_and_score(documents, labels).select("doc_id", held_out(5, 0), "score", "predicted")


def op7_columnar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.link(table(spark, sf_dir, "embeddings"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(hash_split("doc_id", 4) != 2))
    return toxicity.score(documents, model).select("doc_id", held_out(4, 2), "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_warc_normaliser": op1_warc_normaliser,
    "op2_kneser_ney_language": op2_kneser_ney_language,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_tree_bpe": op4_tree_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_fourier_quality": op6_fourier_quality,
    "op7_columnar_top_k": op7_columnar_top_k,
    "op8_odd_sketch_minhash": op8_odd_sketch_minhash,
    "op9_projection_forest": op9_projection_forest,
    "op10_compression_toxicity": op10_compression_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_normaliser": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, url, payload_bytes, payload_digest,
          CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op7_columnar_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_odd_sketch_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        g AS (SELECT doc_id, CASE WHEN words IS NULL THEN [] WHEN len(words) < 2 THEN list_transform(words, lambda x: [x])
            ELSE list_distinct(list_transform(range(1, len(words)), lambda i: [words[i], words[i + 1]])) END AS shingles FROM w),
        n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM g),
        s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM g),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
          AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
        c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op9_projection_forest": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
          AND list_cosine_similarity(a.e, b.e) >= 0.93),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached),
        c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
}
