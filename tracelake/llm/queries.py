"""The operators' queries under their contracts, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, exact_dedup, html, language, media, packing, pii, simhash, substrings, suffix_array
from tracelake.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup_bytes(table(spark, sf_dir, "documents"))


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_round_trip(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_pii, op3_html_extraction, op4_packing, op5_substring_dedup, op6_simhash_near_dedup, op7_language_id, op8_suffix_array_dedup, op9_media_tiff, op10_bpe)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""


#: The contract's rule for the driver's pages, all of which name their article, with the references that occur there.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), b AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a
)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10)))::BIGINT AS n_chars FROM b
"""

OP5_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS MATERIALIZED (SELECT r, k, array_to_string(w[k:k + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)
), hit AS (SELECT r, k FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)
), words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), marked AS (SELECT words.r, p, word, max(k) OVER (PARTITION BY words.r ORDER BY p) >= p - 34 AS gone FROM words LEFT JOIN hit ON hit.r = words.r AND k = p
), kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM marked WHERE NOT coalesce(gone, FALSE) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: Bytes by their two hexadecimal digits.
OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS MATERIALIZED (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)
), firsts AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT r, p AS k FROM win JOIN firsts USING (s) WHERE doc_id > least
), runs AS (SELECT r, k, k > coalesce(lag(k) OVER (PARTITION BY r ORDER BY k) + 50, -1) AS fresh FROM hit
), spans AS (SELECT r, min(k) AS a, max(k) + 50 AS b FROM (SELECT r, k, sum(fresh::INT) OVER (PARTITION BY r ORDER BY k) AS run FROM runs) GROUP BY r, run
), gaps AS (
  SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM spans UNION ALL SELECT r, 0, min(a) FROM spans GROUP BY r
), kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS t FROM gaps JOIN d USING (r) GROUP BY r
), counts AS (SELECT r, count(*) AS n FROM spans GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, ((length(h) - length(coalesce(t, h))) // 2)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_html_extraction": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op8_suffix_array_dedup": OP8_SQL}
