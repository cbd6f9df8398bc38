"""The query ``opN_<name>`` of each operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .density import extract_pages
from .katz import score_documents
from .langid import identify
from .packing import best_fit
from .phrases import contamination
from .secrets import secret_rows
from .simhash import near_duplicate_rows
from .suffixes import deduplicated
from .topk import top_k_embeddings
from .warc import archive_pages


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"), near=True)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_embeddings(table(spark, sf_dir, "embeddings"))


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_rows(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_rows(table(spark, sf_dir, "documents"))


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_exact_topk": op5_exact_topk,
    "op6_text_density": op6_text_density,
    "op7_simhash_components": op7_simhash_components,
    "op8_suffix_array": op8_suffix_array,
    "op9_secret_scan": op9_secret_scan,
    "op10_katz_scores": op10_katz_scores,
}

#: What SQL can say exactly. It has no XXH64, and neither forests nor classifiers nor bins; the
#: sums of logarithms of op10 depend on their order, so brute force is its test.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
        )
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (k // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
            CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p
    """,
    "op4_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), bw AS (
            SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark WHERE item_id IS NOT NULL
        ), starts AS (
            SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0
        ), phrases AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS phrase FROM starts
        ), grams AS (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM phrases)
        ), found AS (
            SELECT g.doc_id, g.i, g.n, p.item_id FROM grams g JOIN phrases p ON g.n = p.n AND array_to_string(list_slice(g.w, g.i, g.i + g.n - 1), ' ') = p.phrase
        ), hits AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
        )
        SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op8_suffix_array": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
        ), w AS (
            SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)
        ), r AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1
        ), runs AS (
            SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)
        ), spans AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM runs GROUP BY doc_id, run
        ), kept AS (
            SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, n, n FROM d)
        ), said AS (
            SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS rest FROM kept JOIN d USING (doc_id) GROUP BY doc_id
        ), gone AS (
            SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
        )
        SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
        FROM d JOIN said USING (doc_id) LEFT JOIN gone USING (doc_id)
    """,
}
