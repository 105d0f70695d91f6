"""The queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import ann, bpe, filter_audit, htmltext, jaccard, langid, lsh_forest, packing, pii, quality, suffix_dedup, topk, whitening
from tidepool.llm.common import table


def op1_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op8_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii_lstm_crf, op2_language_crf, op3_html_main_text, op4_best_fit_packing, op5_quality_rules,
        op6_chosen_path_join, op7_suffix_dedup, op8_dual_tree_topk, op9_block_matrix_ann, op10_byte_bpe,
        op11_filter_audit, op12_lsh_forest, op13_whitening)
}

ORACLE_SQL: dict[str, str] = {
    "op8_dual_tree_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        w AS (SELECT d.*, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, good, toxic,
                (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
                + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m FROM w),
        c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(f, b)),
        p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
        s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS bit, list_sum(bits[1:i]) - bits[i] AS before FROM p, range(1, 6) r(i)),
        x AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN m & before::INT = 0 AND m & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN m & before::INT > 0 AND m & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN m & before::INT = 0 AND m & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN m & before::INT = 0 AND m & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
              FROM c, s GROUP BY ALL)
        SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM x""",
    "op12_lsh_forest": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        s AS (SELECT doc_id, unnest(g) AS s FROM g),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        k AS (SELECT a, b FROM c JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
        r AS (SELECT doc_id, doc_id AS node FROM g UNION SELECT r.doc_id, k.b FROM r JOIN k ON k.a = r.node),
        m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN m USING (doc_id)""",
}
