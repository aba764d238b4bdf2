"""One query per numbered operator, each over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlens.llm import alignment, bpe, exact_dedup, fingerprints, html_blocks, language, licenses, packing, quality, resampling, sharding, simhash, token_counts
from factlens.llm.common import ROW, read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that it is linked to."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop(ROW)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup.dedupe_once(read_table(spark, sf_dir, "documents")).drop(ROW)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_licenses": licenses.op2_licenses,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_language": language.op7_language,
    "op8_html": html_blocks.op8_html,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": quality.op10_quality,
    "op11_resampling": resampling.op11_resampling,
    "op12_sharding": sharding.op12_sharding,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
    """,
    "op11_resampling": r"""
        WITH crc_table AS (
            SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
            FROM documents
        ), b AS (
            SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), dw AS (SELECT r, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
        bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2))::BIGINT) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
        bucket AS (
            SELECT w, xor(list_reduce([4294967295::BIGINT] || x, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, crc_table
        ), raw AS (SELECT k, count(*) AS s FROM dw JOIN bucket USING (w) GROUP BY k), aim AS (SELECT k, count(*) AS t FROM bw JOIN bucket USING (w) GROUP BY k),
        gain AS (
            SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM raw)::DOUBLE + 10000)
                   / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM aim)::DOUBLE + 10000)))) AS BIGINT) AS g
            FROM raw FULL JOIN aim USING (k)
        ), weight AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
        scored AS (
            SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM d LEFT JOIN weight USING (r)
        ), ranked AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
    """,
}
