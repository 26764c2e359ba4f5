"""Registered queries: the operators on the supplied tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.llm.contour_clusters import contour_clusters
from notewise.llm.contour_codes import contour_codes
from notewise.llm.decontaminate import contained_fragments
from notewise.llm.edit_walks import edit_fingerprints
from notewise.llm.kneser_ney import line_quality
from notewise.llm.license_scan import license_marks
from notewise.llm.packing import packed_sequences
from notewise.llm.secret_scan import secrets
from notewise.llm.simhash import near_copies
from notewise.llm.token_counts import token_counts
from notewise.llm.topk import top_matches
from notewise.llm.url_templates import url_verdicts
from notewise.llm.warc_zip import archived

RULES_BLOCK = (("net", ""), ("example.com", "de/"))
RULES_ALLOW = (("example.net", "en/"), ("org", "fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of documents that every label of theirs calls good and not toxic."""
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "doc_id", "text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(_table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir), "doc_id", "text", "lang")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_fragments(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archived(spark, _table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), RULES_BLOCK, RULES_ALLOW, "page_id", "url")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_matches(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 20, 64)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_marks(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op11_contour_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = contour_codes(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return coded.withColumnRenamed("style_error", "label_error")


def op12_contour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contour_clusters(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_packing, op3_quality, op4_decontamination, op5_warc, op6_url_filter, op7_exact_topk, op8_secret_scan,
    op9_license_scan, op10_simhash, op11_contour_codes, op12_contour_clusters, op13_edit_fingerprints)}

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _rounds_sql(rounds: int, columns: str) -> str:
    """CTEs e0 (given: part, entry, e) to e<rounds> and a0 to a<rounds>: entries, and the rows of v (part, x) with their nearest entry.

    Distances are whole numbers below 2 ** 40, so the entry rides in the last ten bits and ties go to the lower one.
    """
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS (
  SELECT {columns}, part, x, best >> 10 AS d, best & 1023 AS entry FROM (
    SELECT {columns}, v.part, any_value(x) AS x,
           min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e) AS BIGINT) * 1024 + entry) AS best
    FROM v JOIN e{k} e ON v.part = e.part GROUP BY {columns}, v.part))""")
        if k < rounds:
            out.append(f"""e{k + 1} AS (
  SELECT o.part, o.entry, coalesce(n.e, o.e) AS e FROM e{k} o LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY pos) AS e FROM (
      SELECT part, entry, pos, sum(c) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM a{k})
      GROUP BY part, entry, pos) GROUP BY part, entry) n ON n.part = o.part AND n.entry = o.entry)""")
    return ",\n".join(out)


ORACLES: dict[str, str] = {
    "op4_decontamination": """
WITH t AS (SELECT 'd' AS kind, doc_id AS k, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, k, unnest(l) AS word, generate_subscripts(l, 1) AS i
      FROM (SELECT kind, k, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS l FROM t)),
s AS (SELECT DISTINCT kind, k, s FROM (
        SELECT kind, k, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o,
               lead(word, 3) OVER o, lead(word, 4) OVER o) END AS s FROM w WINDOW o AS (PARTITION BY kind, k ORDER BY i)) WHERE s IS NOT NULL),
n AS (SELECT k, count(*) AS n FROM s WHERE kind = 'b' GROUP BY k)
SELECT d.k AS doc_id, b.k AS item_id, n AS n_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / n AS containment
FROM s d JOIN s b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' JOIN n ON n.k = b.k
GROUP BY d.k, b.k, n HAVING count(*) >= 0.8 * n - 1e-9""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, max(page_id) AS kept FROM p WHERE size >= 1000 GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept IS NULL OR kept = page_id THEN NULL ELSE kept END AS refers_to
FROM p LEFT JOIN m USING (digest)""",
    "op7_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(x.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op11_contour_codes": f"""
WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS f FROM embeddings WHERE {_FINITE}),
v AS (SELECT vec_id, label, part, f[part * len(f) // 4 + 1 : (part + 1) * len(f) // 4] AS x FROM w, (SELECT unnest([0, 1, 2, 3]) AS part)),
e0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM v
       WHERE vec_id IN (SELECT vec_id FROM w ORDER BY vec_id LIMIT 256)),
{_rounds_sql(4, "vec_id, label")},
h AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(e) AS c, generate_subscripts(e, 1) AS pos FROM e4)),
r AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT codebooks_sha256 FROM h) AS codebooks_sha256 FROM r JOIN l ON r.label IS NOT DISTINCT FROM l.label""",
    "op12_contour_clusters": f"""
WITH v AS (SELECT vec_id, 0 AS part, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE {_FINITE} AND len(embedding) = 64),
e0 AS (SELECT 0 AS part, row_number() OVER (ORDER BY h) - 1 AS entry, x AS e
       FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT 40)),
{_rounds_sql(5, "vec_id")},
c AS (SELECT entry, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY entry),
h AS (SELECT entry, sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256
      FROM (SELECT entry, unnest(e) AS c, generate_subscripts(e, 1) AS pos FROM e5) GROUP BY entry)
SELECT vec_id, CAST(a5.entry AS INT) AS cluster, d AS distance, cluster_inertia,
       (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM c) AS inertia, centroid_sha256
FROM a5 JOIN c ON c.entry = a5.entry JOIN h ON h.entry = a5.entry""",
}
