"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .jaccard_join import similar_sets
from .language_id import language_id
from .mixing import mix
from .quality import quality
from .substring_dedup import substring_dedup
from .token_output import token_output
from .toxicity import toxicity
from .warc import archive


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_substring_dedup, op4_toxicity, op5_token_output, op6_ngram_jaccard_join, op7_quality, op8_mixing, op9_decontamination, op10_warc)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size, min(doc_id) <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AS historical FROM d GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256, historical FROM d JOIN g USING (h)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        g AS (SELECT h, min(page_id) AS holder FROM d GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
            CASE WHEN n >= 100 AND page_id > holder THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id > holder THEN holder END AS refers_to
        FROM d JOIN g USING (h)""",
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 15))::BIGINT AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
        r AS (SELECT *, sum(2 * source_size) OVER o AS below, sum(w) OVER () - sum(w) OVER o AS above, sum(source_size) OVER () * 3.0::DOUBLE / 2 AS budget,
            lead(2 * source_size / w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS next_ratio, min(2 * source_size / w) OVER () AS least_ratio, row_number() OVER o AS place, sum(w) OVER () AS all_w
            FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT coalesce(min(CASE WHEN budget / all_w <= least_ratio THEN budget / all_w END),
            arg_min((budget - below) / above, place) FILTER (above > 0 AND (budget - below) / above <= next_ratio)) AS level FROM r),
        t AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE level * w END AS target FROM s, l),
        p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, source, size, source_size, target, (CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END * size
            + greatest(0, least(size, round(target)::BIGINT - CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken FROM p""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) t(k)),
        rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id),
        hit AS (SELECT DISTINCT doc_id, k + j AS p FROM rep, range(50) t(j)),
        one AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) t(p)),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 4], ' ')) AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(k) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, ',' ORDER BY g)) AS h FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        edges AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
        deg AS (SELECT a AS doc_id, count(*) AS n_links FROM edges GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(min(doc_id) OVER (PARTITION BY coalesce(h, doc_id::VARCHAR)), doc_id) AS class_id, coalesce(n_links, 0) AS n_links
        FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN deg USING (doc_id)""",
    "op9_decontamination": r"""
        WITH lo AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, lo),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, lo),
        p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS h FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(k) WHERE len(w) > 0),
        win AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS h FROM d, (SELECT DISTINCT n FROM p) s, unnest(range(1, len(w) - n + 2)) t(k)),
        hit AS (SELECT doc_id, item_id, k, n FROM win JOIN p USING (n, h)),
        pos AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, range(13) t(j) WHERE j < n GROUP BY doc_id),
        own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)""",
}
