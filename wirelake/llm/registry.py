"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hmm_score, mixing, pii, quality, simhash_dedup, suffix_dedup, token_cache, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm": hmm_score.op1_hmm,
        "op2_simhash": simhash_dedup.op2_simhash,
        "op3_token_counts": token_cache.op3_token_counts,
        "op4_warc": warc.op4_warc,
        "op5_mixing": mixing.op5_mixing,
        "op6_personal_data": pii.op6_personal_data,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality": quality.op10_quality,
    }


#: Bare upper-case base32 of a SHA-1 in hex digits h: five hex digits are four base32 digits.
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1) FOR i IN range(32)], '')"

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
     d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""

#: All windows of 100 bytes as hex digits (unique ids), those seen before, the spans they cover, and what is left.
_REPEATS = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
     w AS (SELECT doc_id, i AS pos, md5(substr(h, 1 + 2 * i, 200)) AS k FROM (SELECT doc_id, h, unnest(range(CAST(length(h) // 2 - 99 AS BIGINT))) AS i FROM d WHERE length(h) >= 200)),
     again AS (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1),
     steps AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER o <= 100 THEN 0 ELSE 1 END AS fresh FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
     named AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM steps),
     spans AS (SELECT doc_id, min(pos) AS s, max(pos) + 100 AS e FROM named GROUP BY doc_id, g),
     lists AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS removed, count(*) AS n, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE
         array_to_string([substr(h, 1 + 2 * CASE WHEN i = 0 THEN 0 ELSE es[i] END, 2 * (CASE WHEN i = n THEN length(h) // 2 ELSE ss[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE es[i] END)) FOR i IN range(CAST(n + 1 AS BIGINT))], '') END)) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL knows neither models nor fingerprints, tokenizers or schedules; the operators without SQL are tested against brute force."""
    return {"op4_warc": _WARC, "op7_suffix_dedup": _REPEATS}
