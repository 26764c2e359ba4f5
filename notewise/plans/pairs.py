"""Pair building, arcs and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions import names
from notewise.operators import pairing as P
from notewise.operators.ordered import dense_index, over
from notewise.operators.splits import dense_ids
from notewise.plans.oracle import NOTES, ROWS, ctes
from notewise.plans.registry import query
from notewise.sources import tables

SEQ = ["doc", "w"]


def two_voices(spark, sf, sparse_kinds="'purchase', 'signup'", dense_rule=None):
    """Dense voice: all notes (or some kinds); sparse voice: some kinds, renumbered."""
    notes = tables.melody_notes(spark, sf)
    dense = notes.select("doc", "idx", "st", "pitch")
    if dense_rule:
        dense = dense_index(notes.where(dense_rule).selectExpr("doc", "idx AS old", "st", "pitch"), ["doc"], ["st", "old"], "st").drop("old")
    sparse = dense_index(notes.where(f"kind IN ({sparse_kinds})").selectExpr("doc", "idx AS old", "st"), ["doc"], ["st", "old"], "st").drop("old")
    return dense, sparse


VOICES = """sp AS (SELECT doc, st, row_number() OVER (PARTITION BY doc ORDER BY st, idx) - 1 AS si, row_number() OVER (PARTITION BY doc, st ORDER BY idx DESC) AS r
  FROM notes WHERE kind IN ('purchase', 'signup')),
de AS (SELECT doc, idx, st, row_number() OVER (PARTITION BY doc, st ORDER BY idx DESC) AS r FROM notes),
mp AS (SELECT de.doc, de.idx, de.st, coalesce(sp.si, -1) AS pi FROM de LEFT JOIN sp USING (doc, st, r))"""


@query(ctes(NOTES, VOICES) + "SELECT doc, idx, pi FROM mp")
def suffix_mapping(spark, sf):
    return P.onset_mapping(*two_voices(spark, sf), "doc").select("doc", "idx", "pi")


@query(ctes(NOTES) + """, m AS (SELECT DISTINCT doc, st FROM notes WHERE kind = 'purchase' AND (doc, st) NOT IN (SELECT doc, st FROM notes WHERE kind IN ('click', 'view', 'error'))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY st) AS r FROM m)
SELECT doc, count(*) AS n_missing, CAST(sum(st) FILTER (WHERE r <= 16) AS BIGINT) AS missing_sum, max(r) FILTER (WHERE r <= 16) AS listed FROM r GROUP BY doc""")
def onset_subset(spark, sf):
    dense, sparse = two_voices(spark, sf, "'purchase'", "kind IN ('click', 'view', 'error')")
    return P.missing_onsets(dense, sparse, "doc").selectExpr(
        "doc", "n_missing", "aggregate(missing, 0L, (a, x) -> a + x) AS missing_sum", "size(missing) AS listed")


@query(ctes(NOTES, VOICES) + """, k AS (SELECT doc, count(*) AS k_m, max(pi) + 1 AS k_s FROM mp WHERE idx < 60 GROUP BY doc)
SELECT doc, k_m, k_s, round((k_s + 2) / CAST(k_m + 2 AS DOUBLE), 9) AS rho,
  CASE WHEN (k_s + 2) / CAST(k_m + 2 AS DOUBLE) < 0.35 - 1e-9 OR (k_s + 2) / CAST(k_m + 2 AS DOUBLE) > 0.45 + 1e-9 THEN 'rho_out_of_range' END AS skip_reason FROM k""")
def label_pairs(spark, sf):
    dense, sparse = two_voices(spark, sf)
    return P.label_pairs(dense, sparse, "doc", 60, 0.35, 0.45)[1].selectExpr("doc", "k_m", "k_s", "round(rho, 9) AS rho", "skip_reason")


@query(ctes(NOTES) + """, d AS (SELECT doc, st, count(*) FILTER (WHERE idx % 29 <> 3 OR kind = 'view') AS nd, count(*) FILTER (WHERE kind = 'purchase') AS ns FROM notes GROUP BY doc, st)
SELECT CASE WHEN lost > 0 THEN 'onset_not_subset' WHEN small > 0 THEN 'shared_onset_group_too_small' ELSE 'other' END AS reason, count(*) AS pieces
FROM (SELECT doc, count(*) FILTER (WHERE nd = 0 AND ns > 0) AS lost, count(*) FILTER (WHERE nd > 0 AND nd < ns) AS small FROM d WHERE nd + ns > 0 GROUP BY doc) GROUP BY 1""")
def pair_skip_reasons(spark, sf):
    dense, sparse = two_voices(spark, sf, "'purchase'", "idx % 29 <> 3 OR kind = 'view'")
    verdicts = P.label_pairs(dense, sparse, "doc", 512, 0.0, 1.0)[1]
    reason = "CASE WHEN skip_reason IN ('onset_not_subset', 'shared_onset_group_too_small') THEN skip_reason ELSE 'other' END AS reason"
    return verdicts.selectExpr(reason).groupBy("reason").agg(F.count("*").alias("pieces"))


@query("""WITH refs AS (SELECT CAST(s_nationkey % 20 AS BIGINT) AS family, min(s_suppkey) AS reference FROM supplier GROUP BY 1)
SELECT c_custkey AS song, family, reference FROM customer JOIN refs ON family = c_nationkey WHERE c_custkey <> reference""")
def pair_reference(spark, sf):
    labels, refs = _families(spark, sf)
    return P.reference_pairs(labels, refs)[0].select("song", "family", "reference")


@query("""WITH refs AS (SELECT CAST(s_nationkey % 20 AS BIGINT) AS family, min(s_suppkey) AS reference FROM supplier GROUP BY 1)
SELECT count(*) AS songs_total, count(*) FILTER (WHERE reference IS NULL) AS missing_reference, count(*) FILTER (WHERE reference = c_custkey) AS self_pairs
FROM customer LEFT JOIN refs ON family = c_nationkey""")
def pair_reference_stats(spark, sf):
    return P.reference_pairs(*_families(spark, sf))[1]


def _families(spark, sf):
    labels = tables.table(spark, sf, "customer").selectExpr("c_custkey AS song", "CAST(c_nationkey AS BIGINT) AS family")
    refs = tables.table(spark, sf, "supplier").selectExpr(
        "CAST(s_nationkey % 20 AS BIGINT) AS family", "s_suppkey AS reference", "s_suppkey AS line")
    return labels, refs


@query("""WITH refs AS (SELECT CAST(s_nationkey % 20 AS BIGINT) AS family, min(s_suppkey) AS reference FROM supplier GROUP BY 1),
d AS (SELECT DISTINCT family, reference FROM customer JOIN refs ON family = c_nationkey WHERE c_custkey <> reference)
SELECT family, reference, row_number() OVER (ORDER BY family, reference) - 1 AS doc_id FROM d""")
def reference_doc_ids(spark, sf):
    docs = P.reference_pairs(*_families(spark, sf))[0].select("family", "reference").distinct()
    return dense_ids(docs, ["family", "reference"])


CATALOGUE = """cat AS (SELECT o_orderkey, 'M' || (100 + o_custkey % 40) || '_V' || lpad(CAST(o_orderkey % 12 AS VARCHAR), 2, '0') || '_' ||
  CASE o_orderkey % 7 WHEN 0 THEN 'e' WHEN 1 THEN '2' WHEN 2 THEN '022' ELSE lpad(CAST(o_orderkey % 5 AS VARCHAR), 2, '0') END || '_score.krn' AS name FROM orders),
pr AS (SELECT *, regexp_extract(name, '^([A-Z0-9]+)_V(\\d\\d)_([^_]+)_', 1) AS opus, regexp_extract(name, '_V(\\d\\d)_', 1) AS var, regexp_extract(name, '_V\\d\\d_([^_]+)_', 1) AS ph FROM cat),
ba AS (SELECT *, CASE WHEN length(regexp_extract(ph, '^(\\d+)', 1)) = 1 THEN '0' || ph WHEN length(regexp_extract(ph, '^(\\d+)', 1)) > 1 THEN substr(ph, 1, 2) END AS base FROM pr),
th AS (SELECT opus, base, arg_min(name, (length(ph), ph, name)) AS theme FROM ba WHERE var = '00' AND base IS NOT NULL GROUP BY opus, base)"""


def catalogue(spark, sf):
    o = tables.table(spark, sf, "orders")
    phrase = "CASE o_orderkey % 7 WHEN 0 THEN 'e' WHEN 1 THEN '2' WHEN 2 THEN '022' ELSE lpad(CAST(o_orderkey % 5 AS STRING), 2, '0') END"
    return o.selectExpr("o_orderkey", f"concat('M', 100 + o_custkey % 40, '_V', lpad(CAST(o_orderkey % 12 AS STRING), 2, '0'), '_', {phrase}, '_score.krn') AS name")


@query(ctes(CATALOGUE) + "SELECT ba.opus, ba.base, var AS variation, ph AS var_phrase, name AS variation_file, theme AS theme_file FROM ba JOIN th USING (opus, base) WHERE var <> '00'")
def theme_variation_pairs(spark, sf):
    return P.theme_variation_pairs(catalogue(spark, sf), "name")


@query(ctes(CATALOGUE) + """, p AS (SELECT name, theme FROM ba JOIN th USING (opus, base) WHERE var <> '00')
SELECT count(*) AS n_files FROM (SELECT name FROM p UNION SELECT theme FROM p)""")
def pair_file_count(spark, sf):
    pairs = P.theme_variation_pairs(catalogue(spark, sf), "name")
    return P.distinct_files(pairs, ["variation_file", "theme_file"]).agg(F.count("*").alias("n_files"))


@query("""SELECT p_partkey, CAST(full_match AS BIGINT) AS full_match, CAST(word_match AS BIGINT) AS word_match FROM (SELECT p_partkey, CASE WHEN regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') = 'redwidget' THEN 3 WHEN regexp_matches(p_name, '(?i)(^|[\\s_\\-])widget($|[\\s_\\-])')
  AND false THEN 2 ELSE 0 END AS full_match, CASE WHEN regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') = 'ring' THEN 3
  WHEN regexp_matches(p_name, '(?i)(^|[\\s_\\-])ring($|[\\s_\\-])') THEN 2 WHEN contains(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 'ring') THEN 1 ELSE 0 END AS word_match FROM part)""")
def label_match(spark, sf):
    p = tables.table(spark, sf, "part")
    return p.select("p_partkey", names.label_match([F.col("p_name")], "red widget").alias("full_match"), names.label_match([F.col("p_name")], "ring").alias("word_match"))


@query(ctes(NOTES) + """, ch AS (SELECT doc, kind, count(*) AS n FROM notes WHERE kind IN ('purchase', 'signup') OR (doc % 5 = 4 AND kind = 'view') GROUP BY doc, kind),
g AS (SELECT doc, count(*) AS k, arg_max(kind, n) AS big, arg_min(kind, n) AS small, max(n) <> min(n) AS differ, doc % 3 = 0 AS named FROM ch GROUP BY doc)
SELECT doc, CASE WHEN named AND k >= 2 THEN 'name' WHEN k = 2 AND differ THEN 'note_count' ELSE 'unresolved' END AS strategy,
  CASE WHEN named AND k >= 2 THEN 'signup' WHEN k = 2 AND differ THEN big END AS dense, CASE WHEN named AND k >= 2 THEN 'purchase' WHEN k = 2 AND differ THEN small END AS sparse FROM g""")
def resolve_voices(spark, sf):
    n = tables.melody_notes(spark, sf).where("kind IN ('purchase', 'signup') OR (doc % 5 = 4 AND kind = 'view')")
    ch = n.groupBy("doc", "kind").agg(F.count("*").alias("note_count")).selectExpr(
        "*", "CASE WHEN doc % 3 = 0 AND kind = 'signup' THEN 'the Ornamented line' WHEN doc % 3 = 0 AND kind = 'purchase' THEN 'SKELETON' END AS track_name",
        "CAST(NULL AS STRING) AS instrument_name")
    return P.resolve_voices(ch, "doc", "kind", "Ornamented", "Skeleton")


# ------------------------------------------------------------------ trees


def heap_arcs(spark, sf):
    rows = tables.melody_rows(spark, sf)
    nodes = rows.selectExpr(*SEQ, "CAST(i + 1 AS INT) AS node", "kind = 'error' AND i > wlen * 3 / 4 AS is_rest")
    arcs = rows.selectExpr(*SEQ, "explode(CASE WHEN i = 0 THEN array(struct(0 AS h, 0 AS d), struct(0 AS h, 1 AS d)) "
                                 "ELSE array(struct(CAST((i + 1) div 2 AS INT) AS h, CAST(i + 1 AS INT) AS d)) END) AS a").selectExpr(*SEQ, "a.h AS head", "a.d AS dep")
    return nodes, arcs


ARCS = """nd AS (SELECT doc, w, i + 1 AS node, kind = 'error' AND i > wlen * 3 / CAST(4 AS DOUBLE) AS is_rest FROM rows_),
arcs AS (SELECT doc, w, CASE WHEN i = 0 THEN 0 ELSE (i + 1) // 2 END AS head, i + 1 AS dep FROM rows_ UNION ALL SELECT DISTINCT doc, w, 0, 0 FROM rows_)"""


TREE = "WITH RECURSIVE " + ctes(ROWS, ARCS)[5:] + """, t AS (SELECT doc, w, dep AS node, 0 AS depth FROM arcs WHERE head = 0 AND dep <> 0
UNION ALL SELECT a.doc, a.w, a.dep, t.depth + 1 FROM t JOIN arcs a ON a.doc = t.doc AND a.w = t.w AND a.head = t.node AND a.dep <> 0)
"""


@query(TREE + "SELECT doc, w, node, CAST(depth AS BIGINT) AS depth FROM t")
def tree_depth(spark, sf):
    nodes, arcs = heap_arcs(spark, sf)
    return P.tree_depth(arcs, nodes, SEQ)


@query(TREE + """SELECT k.doc, k.w, k.pos, k.note, CAST(coalesce(t.depth, -1) AS BIGINT) AS depth, round(coalesce(exp(-t.depth / CAST(2 AS DOUBLE)), 0), 9) AS score
FROM (SELECT doc, w, i + 1 AS pos, i AS note FROM rows_) k LEFT JOIN t ON t.doc = k.doc AND t.w = k.w AND t.node = k.pos
UNION ALL SELECT doc, w, unnest([0, wlen + 1]), -1, -1, 0 FROM rows_ WHERE i = 0""")
def token_depths(spark, sf):
    """Tree depth and depth score of every token of BOS, notes and EOS."""
    nodes, arcs = heap_arcs(spark, sf)
    rows = tables.melody_rows(spark, sf)
    notes = rows.selectExpr(*SEQ, "CAST(i + 1 AS BIGINT) AS pos", "CAST(i AS BIGINT) AS note")
    ends = rows.where("i = 0").selectExpr(*SEQ, "explode(array(0L, CAST(wlen + 1 AS BIGINT))) AS pos", "-1L AS note")
    found, _ = P.token_depths(notes.unionByName(ends), P.tree_depth(arcs, nodes, SEQ), SEQ, 2.0)
    return found.selectExpr(*SEQ, "pos", "note", "depth", "round(score, 9) AS score")


@query(ctes(ROWS, ARCS) + """, c AS (SELECT doc, w, count(*) FILTER (WHERE NOT is_rest) AS m FROM nd GROUP BY doc, w),
g AS (SELECT a.doc, a.w, count(*) AS n_gold, count(*) FILTER (WHERE NOT ((head = 0 AND dep = 0) OR (head <> dep AND dep <> 0 AND NOT coalesce(h.is_rest, false) AND NOT coalesce(d.is_rest, false)))) AS n_outside
  FROM arcs a LEFT JOIN nd h ON h.doc = a.doc AND h.w = a.w AND h.node = a.head LEFT JOIN nd d ON d.doc = a.doc AND d.w = a.w AND d.node = a.dep GROUP BY a.doc, a.w)
SELECT doc, w, (m + 1) * (m + 1) - (m + 1) - m + 1 AS n_candidates, n_gold, n_outside FROM c JOIN g USING (doc, w)""")
def candidate_arcs(spark, sf):
    nodes, arcs = heap_arcs(spark, sf)
    return P.candidate_counts(nodes, arcs, SEQ)


@query(ctes(ROWS, ARCS) + """, x AS (SELECT doc, w, head, dep FROM arcs UNION ALL SELECT doc, w, 1, dep FROM arcs WHERE dep % 16 = 7)
SELECT doc, w, dep, count(*) AS n_heads FROM x GROUP BY doc, w, dep HAVING count(*) <> 1""")
def many_headed(spark, sf):
    arcs = heap_arcs(spark, sf)[1]
    extra = arcs.where("dep % 16 = 7").selectExpr(*SEQ, "1 AS head", "dep")
    return P.many_headed(arcs.unionByName(extra), SEQ)


@query(ctes(NOTES) + """, m AS (SELECT doc, idx, st // 48 AS measure FROM notes),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, measure ORDER BY idx) AS ordinal FROM m WHERE idx >= doc % 3),
ids AS (SELECT doc, measure, ordinal FROM o WHERE idx % 4 = 1),
a AS (SELECT doc, idx, measure, s AS skip, row_number() OVER (PARTITION BY doc, s, measure ORDER BY idx) AS ordinal FROM m, (SELECT unnest([0, 1, 2]) AS s) WHERE idx >= s),
f AS (SELECT a.doc, a.skip, a.idx, a.measure, a.ordinal FROM ids JOIN a USING (doc, measure, ordinal)),
b AS (SELECT doc, min(skip) AS skip FROM (SELECT doc, skip, count(*) AS c FROM f GROUP BY doc, skip) JOIN (SELECT doc, count(*) AS n FROM ids GROUP BY doc) USING (doc) WHERE c = n GROUP BY doc)
SELECT f.doc, CAST(f.skip AS BIGINT) AS skip, measure, ordinal, idx FROM f JOIN b ON b.doc = f.doc AND b.skip = f.skip""")
def ordinal_notes(spark, sf):
    n = tables.melody_notes(spark, sf).selectExpr("doc", "idx", "st div 48 AS measure")
    ids = n.where("idx >= doc % 3").selectExpr("*", f"row_number() {over(['doc', 'measure'], ['idx'])} AS ordinal").where("idx % 4 = 1").select("doc", "measure", "ordinal")
    return P.ordinal_notes(n, ids, "doc").select("doc", "skip", "measure", "ordinal", "idx")


MEMBERS = """len_ AS (SELECT user_id AS piece, count(*) AS n FROM events GROUP BY 1),
pr AS (SELECT piece AS member, piece % 30 AS family, min(piece) OVER (PARTITION BY piece % 30) AS reference, n AS mn FROM len_),
jd AS (SELECT pr.*, CASE WHEN l.n < 60 THEN 'short_document' WHEN mn < 65 THEN 'short_query' END AS skip_reason FROM pr JOIN len_ l ON l.piece = reference WHERE member <> reference),
ids AS (SELECT reference, row_number() OVER (ORDER BY family, reference) - 1 AS doc_id FROM (SELECT DISTINCT family, reference FROM jd WHERE skip_reason IS NULL))"""


def member_corpus(spark, sf):
    melodies = tables.table(spark, sf, "events").groupBy(F.col("user_id").alias("piece")).agg(F.count("*").alias("n_notes"))
    labels = melodies.selectExpr("piece AS song", "piece % 30 AS family")
    refs = labels.selectExpr("family", "song AS reference", "song AS line")
    pairs = P.reference_pairs(labels, refs)[0].select(F.col("song").alias("member"), "family", "reference")
    return P.retrieval_corpus(pairs, melodies, "member", "reference", "family", 60, 65)


@query(ctes(MEMBERS) + "SELECT member, family, reference, doc_id AS target_doc_id FROM jd JOIN ids USING (reference) WHERE skip_reason IS NULL")
def member_reference_queries(spark, sf):
    return member_corpus(spark, sf)[1].select("member", "family", "reference", "target_doc_id")


@query(ctes(MEMBERS) + "SELECT skip_reason, count(*) AS n FROM jd WHERE skip_reason IS NOT NULL GROUP BY 1")
def member_reference_skips(spark, sf):
    return member_corpus(spark, sf)[2]
