"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .bpe import encode_decode
from .common import table
from .embedding_dedup import near_vectors
from .exact_dedup import exact_groups
from .language import identify
from .ngram_join import jaccard_groups
from .packing import pack
from .quality import quality_scores
from .substring_dedup import dedup_substrings
from .suffix_tree_lm import score_texts
from .warc import page_records, resolve_revisits


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_units", "n_removed", "removed_chars", "removed_spans")


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    return found.select(
        F.col("record_id").cast("long").alias("page_id"),
        "canonical_url",
        "outcome",
        F.col("source_id").cast("long").alias("source_id"),
        F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("headers"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language": op3_language,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_suffix_tree_lm": op5_suffix_tree_lm,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_quality": op10_quality,
}

QUERIES = {name: _shipped(f) for name, f in QUERIES.items()}

#: CTE comp(id, component): the smallest id that links reach, from a CTE link(a, b) with both directions.
REACHED = """reach(id, other) AS (SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
        comp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE x.norm > 0 AND y.norm > 0 AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
        {REACHED}
        SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id,
            vec_id <= coalesce(component, vec_id) AS kept
        FROM v LEFT JOIN comp ON id = vec_id""",
    "op6_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END AS sh FROM w),
        g AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
        link AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.t = y.t AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        {REACHED}
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(component, doc_id)) AS component_id,
            CASE WHEN len(sh) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY sh) END AS class_size
        FROM s LEFT JOIN comp ON id = doc_id""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op9_warc_revisits": r"""
        WITH s AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
        x AS (SELECT page_id, html, u, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*[^?]*(\?.*)?$') AS ok,
            regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(\?.*)?$', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
            regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(\?.*)?$', 2), '/+$', '') AS path,
            list_sort(list_filter(string_split(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(\?.*)?$', 3), '^\?', ''), '&'),
                lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|sessionid|phpsessid|fbclid|gclid)(=|$)'))) AS params FROM s),
        c AS (SELECT page_id, html, CASE WHEN ok THEN host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END ELSE u END AS canonical_url FROM x),
        full_ AS (SELECT canonical_url, 2 * page_id AS at, max(page_id) AS source_id FROM c WHERE canonical_url IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT c.page_id, c.canonical_url, c.html, f.source_id FROM (SELECT *, 2 * page_id + 2001 AS at FROM c) c ASOF LEFT JOIN full_ f ON c.canonical_url = f.canonical_url AND c.at > f.at)
        SELECT r.page_id, r.canonical_url, CASE WHEN r.source_id IS NULL THEN 'missing' WHEN md5(r.html) = md5(b.html) THEN 'resolved' ELSE 'changed' END AS outcome, r.source_id,
            CASE WHEN md5(r.html) = md5(b.html) THEN 'content-length: ' || strlen(b.html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (2 * r.page_id + 2001) || chr(10) || 'etag: W/"' || md5(r.html) || '"' END AS headers,
            CASE WHEN md5(r.html) = md5(b.html) THEN sha256(b.html) END AS payload_sha256
        FROM r LEFT JOIN c b ON b.page_id = r.source_id""",
}
