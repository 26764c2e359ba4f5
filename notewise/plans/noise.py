"""Augmentation, corruption and denoising-noise queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from notewise.functions.draws import nonzero_offset_cdf, poisson_cdf
from notewise.operators import denoise as D
from notewise.operators import transforms as T
from notewise.plans.oracle import ROWS, ctes, discrete_sql, hash_sql, normal_sql, uniform_int_sql, uniform_sql
from notewise.plans.registry import query
from notewise.sources import tables

SEQ = ["doc", "w"]


def packed(spark, sf):
    return tables.melody_sequences(spark, sf).select("doc", "w", "notes")


def _long(df, *extra):
    return df.select(*SEQ, *extra, F.posexplode_outer("notes").alias("i", "x")).where("i IS NOT NULL").select(*SEQ, *extra, "i", "x.*")


CUM = "[" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in T.shift_cdf(4.0, -8, 8)) + "]"


@query(ctes(ROWS) + f""", s AS (SELECT doc, w, greatest(-8, -min(pitch)) AS a, least(8, 127 - max(pitch)) AS b FROM rows_ GROUP BY doc, w),
u AS (SELECT *, {CUM}[a + 9] + {uniform_sql('transpose', 21, 'doc', 'w')} * ({CUM}[b + 10] - {CUM}[a + 9]) AS u FROM s),
k AS (SELECT *, CASE WHEN a > b THEN 0 ELSE greatest(a, least(b, -8 + len(list_filter({CUM}[2:], lambda c: c <= u)))) END AS shift FROM u)
SELECT doc, w, i, pitch + shift AS pitch, shift FROM rows_ JOIN k USING (doc, w)""")
def transpose(spark, sf):
    return _long(T.transpose(packed(spark, sf), SEQ, 21), "shift").select(*SEQ, "i", "pitch", "shift")


@query(ctes(ROWS) + f""", k AS (SELECT *, {uniform_sql('time_scale', 22, 'doc', 'w')} AS u FROM rows_),
s AS (SELECT *, CASE WHEN u < CAST(0.2 AS DOUBLE) THEN CAST(2 AS DOUBLE) WHEN u < CAST(0.4 AS DOUBLE) THEN 0.5 ELSE 1 END AS scale FROM k)
SELECT doc, w, i, CAST(CASE WHEN scale = 1 THEN dur ELSE least(95, greatest(1, round_even(dur * scale, 0))) END AS BIGINT) AS dur,
  CAST(CASE WHEN scale = 1 THEN dt ELSE least(95, greatest(-96, round_even(dt * scale, 0))) END AS BIGINT) AS dt, scale FROM s""")
def time_scale(spark, sf):
    return _long(T.time_scale(packed(spark, sf), SEQ, 22), "scale").select(*SEQ, "i", "dur", "dt", "scale")


INNER = "i < wlen - 1"


@query(ctes(ROWS) + f""", k AS (SELECT *, {uniform_sql('boundary', 23, 'doc', 'w', 'i')} AS u, {uniform_int_sql('boundary.d', 23, -3, 3, 'doc', 'w', 'i')} AS d FROM rows_),
o AS (SELECT *, {INNER} AND u < CAST(0.1 AS DOUBLE) AND dt >= 0 AND dur + d BETWEEN 1 AND 95 AND dt - d BETWEEN 0 AND 95 AS ok FROM k)
SELECT doc, w, i, dur + CASE WHEN ok THEN d ELSE 0 END AS dur, dt - CASE WHEN ok THEN d ELSE 0 END AS dt FROM o""")
def boundary_shift(spark, sf):
    return _long(T.boundary_shift(packed(spark, sf), SEQ, 23)).select(*SEQ, "i", "dur", "dt")


def jittered_pitch_sql(seed):
    return f"""CASE WHEN {uniform_sql('jitter', seed, 'doc', 'w', 'i')} < CAST(0.12 AS DOUBLE)
  THEN greatest(0, least(127, pitch + {discrete_sql(nonzero_offset_cdf(2, 1.0), uniform_sql('jitter.k', seed, 'doc', 'w', 'i'))})) ELSE pitch END"""


@query(ctes(ROWS) + f"SELECT doc, w, i, {jittered_pitch_sql(24)} AS pitch FROM rows_")
def pitch_jitter(spark, sf):
    return _long(T.pitch_jitter(packed(spark, sf), SEQ, 24)).select(*SEQ, "i", "pitch")


@query(ctes(ROWS) + f"""SELECT doc, w, i,
  CASE WHEN {uniform_sql('durj', 25, 'doc', 'w', 'i')} < CAST(0.1 AS DOUBLE) THEN greatest(1, least(95, dur + {uniform_int_sql('durj.d', 25, -2, 2, 'doc', 'w', 'i')})) ELSE dur END AS dur,
  CASE WHEN {INNER} AND {uniform_sql('dtj', 25, 'doc', 'w', 'i')} < CAST(0.05 AS DOUBLE) THEN greatest(-96, least(95, dt + {uniform_int_sql('dtj.d', 25, -2, 2, 'doc', 'w', 'i')})) ELSE dt END AS dt FROM rows_""")
def time_jitter(spark, sf):
    return _long(T.time_jitter(packed(spark, sf), SEQ, 25)).select(*SEQ, "i", "dur", "dt")


def _factor(op, sigma, lo, hi):
    return f"greatest(CAST({lo} AS DOUBLE), least(CAST({hi} AS DOUBLE), exp(abs(CAST({sigma} AS DOUBLE) * {normal_sql(op, 26, 'doc', 'w', 'i')}))))"


@query(ctes(ROWS) + f""", f AS (SELECT *, {uniform_sql('fr.seq', 26, 'doc', 'w')} < CAST(0.25 AS DOUBLE) AS fr FROM rows_)
SELECT doc, w, i,
  CAST(CASE WHEN fr AND {uniform_sql('fr.dur', 26, 'doc', 'w', 'i')} < CAST(0.12 AS DOUBLE) THEN greatest(1, least(95, round_even(dur * {_factor('fr.dz', 0.4, 0.6, 1.8)}, 0))) ELSE dur END AS BIGINT) AS dur,
  CAST(CASE WHEN fr AND {INNER} AND dt >= 0 AND {uniform_sql('fr.gap', 26, 'doc', 'w', 'i')} < CAST(0.06 AS DOUBLE) THEN greatest(0, least(95, round_even(dt * {_factor('fr.gz', 0.6, 0.5, 2.5)}, 0))) ELSE dt END AS BIGINT) AS dt FROM f""")
def free_rhythm(spark, sf):
    return _long(T.free_rhythm(packed(spark, sf), SEQ, 26)).select(*SEQ, "i", "dur", "dt")


@query(ctes(ROWS) + f""", s AS (SELECT doc, w, max(wlen) AS n, row_number() OVER (ORDER BY {hash_sql('frag.order', 27, 'doc', 'w')}, doc, w) - 1 AS rw FROM rows_ WHERE wlen >= 20 GROUP BY doc, w),
c AS (SELECT count(*) AS m FROM s),
q AS (SELECT id, CAST(floor({uniform_sql('frag.doc', 27, 'id')} * m) AS BIGINT) AS rw FROM c, (SELECT unnest(range(0, (SELECT count(*) FROM s))) AS id)),
l AS (SELECT id, doc, w, n, {uniform_int_sql('frag.len', 27, 20, 'least(40, n)', 'id')} AS frag_len FROM q JOIN s USING (rw))
SELECT id AS query_id, doc, w, frag_len, {uniform_int_sql('frag.start', 27, 0, 'n - frag_len', 'id')} AS frag_start FROM l""")
def random_fragments(spark, sf):
    s = packed(spark, sf)
    n = s.where("size(notes) >= 20").count()
    f = T.random_fragments(s, SEQ, n, 27, 20, 40)
    return f.selectExpr("query_id", *SEQ, "size(notes) AS frag_len", "frag_start")


# ------------------------------------------------------------------ denoising noise

TOK = """tk AS (SELECT doc, w, i, wlen, pitch + 5 AS p, dur + 133 AS d, CASE WHEN dt >= 0 THEN 229 + dt ELSE 324 - dt END AS t FROM rows_)"""


def tokens(spark, sf):
    return tables.melody_rows(spark, sf).selectExpr(
        *SEQ, "i", "wlen", "pitch + 5 AS p", "dur + 133 AS d", "CASE WHEN dt >= 0 THEN 229 + dt ELSE 324 - dt END AS t")


def _cnt(ratio):
    return f"CAST(least(greatest(round_even(wlen * CAST({ratio} AS DOUBLE), 0), 1), wlen) AS BIGINT)"


@query(ctes(ROWS, TOK) + f""", m AS (SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY {hash_sql('pick', 31, 'doc', 'w', 'i')}, i) <= {_cnt(0.333)} AS masked,
  {hash_sql('mask.attr', 31, 'doc', 'w', 'i')} % 3 AS a FROM tk)
SELECT doc, w, i, masked, CASE WHEN masked AND a = 0 THEN 4 ELSE p END AS p, CASE WHEN masked AND a = 1 THEN 4 ELSE d END AS d, CASE WHEN masked AND a = 2 THEN 4 ELSE t END AS t FROM m""")
def mask_k(spark, sf):
    picked = D.pick_k(tokens(spark, sf), SEQ, D.ratio_count("wlen", 0.333), 31, "masked")
    return D.mask_notes(picked, SEQ, 31, whole="false").select(*SEQ, "i", "masked", "p", "d", "t")


def _spans(ratio, seed, lam=3.0):
    mean = lam + math.exp(-lam)
    return f"""sq AS (SELECT DISTINCT doc, w, wlen, {_cnt(ratio)} AS target FROM tk),
sp AS (SELECT doc, w, CAST(floor({uniform_sql('span.start', seed, 'doc', 'w', 'j')} * wlen) AS BIGINT) AS a, {discrete_sql(poisson_cdf(lam), uniform_sql('span.len', seed, 'doc', 'w', 'j'))} AS l
  FROM (SELECT *, unnest(range(1, 1 + least(greatest(CAST(floor(target / CAST({mean!r} AS DOUBLE)) AS BIGINT), 1), target))) AS j FROM sq)),
hit AS (SELECT *, EXISTS (SELECT 1 FROM sp WHERE sp.doc = tk.doc AND sp.w = tk.w AND tk.i >= a AND tk.i < a + l) AS hit FROM tk),
sh AS (SELECT *, {_cnt(ratio)} - count(*) FILTER (WHERE hit) OVER (PARTITION BY doc, w) AS short FROM hit),
ms AS (SELECT *, hit OR row_number() OVER (PARTITION BY doc, w, hit ORDER BY {hash_sql('span.fill', seed, 'doc', 'w', 'i')}, i) <= short AS masked FROM sh)"""


@query(ctes(ROWS, TOK, _spans(0.333, 32)) + "SELECT doc, w, i, masked FROM ms")
def span_mask(spark, sf):
    return D.span_mask(tokens(spark, sf), SEQ, 0.333, 32).select(*SEQ, "i", "masked")


@query(ctes(ROWS, TOK, _spans(0.333, 32)) + """, e AS (SELECT *, masked AND NOT coalesce(lag(masked) OVER (PARTITION BY doc, w ORDER BY i), false) AS head FROM ms)
SELECT doc, w, row_number() OVER (PARTITION BY doc, w ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc, w) AS wlen,
  CASE WHEN masked THEN 4 ELSE p END AS p, CASE WHEN masked THEN 4 ELSE d END AS d, CASE WHEN masked THEN 4 ELSE t END AS t FROM e WHERE NOT masked OR head""")
def span_collapse(spark, sf):
    return D.collapse(D.span_mask(tokens(spark, sf), SEQ, 0.333, 32), SEQ).select(*SEQ, "i", "wlen", "p", "d", "t")


@query(ctes(ROWS, TOK) + f""", k AS (SELECT *, {uniform_sql('delete', 33, 'doc', 'w', 'i')} > CAST(0.2 AS DOUBLE) AS keep FROM tk)
SELECT doc, w, row_number() OVER (PARTITION BY doc, w ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc, w) AS wlen, p FROM k WHERE keep""")
def delete_notes(spark, sf):
    return D.delete_notes(tokens(spark, sf), SEQ, 33).select(*SEQ, "i", "wlen", "p")


@query(ctes(ROWS, TOK, _spans(0.2, 34)) + """SELECT doc, w, row_number() OVER (PARTITION BY doc, w ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc, w) AS wlen, p FROM ms WHERE NOT masked""")
def delete_spans(spark, sf):
    return D.delete_notes(tokens(spark, sf), SEQ, 34, spans="true").select(*SEQ, "i", "wlen", "p")


@query(ctes(ROWS, TOK) + f"""SELECT doc, w, p, d, t, CASE WHEN {uniform_sql('rotate', 35, 'doc', 'w')} < CAST(0.5 AS DOUBLE) AND wlen > 1
  THEN (i - CAST(floor({uniform_sql('rotate.at', 35, 'doc', 'w')} * wlen) AS BIGINT) + wlen) % wlen ELSE i END AS i FROM tk""")
def rotate(spark, sf):
    return D.rotate(tokens(spark, sf), SEQ, 35).select(*SEQ, "p", "d", "t", "i")


def _cover(tag, src, ratio, seed, when, lam=3.0):
    """Span masking of ``src`` rows, spans only where ``when`` holds; leaves ms_<tag> with ``masked``."""
    mean = lam + math.exp(-lam)
    return f"""sq_{tag} AS (SELECT DISTINCT doc, w, wlen, {_cnt(ratio)} AS target FROM {src} WHERE {when}),
sp_{tag} AS (SELECT doc, w, CAST(floor({uniform_sql('span.start', seed, 'doc', 'w', 'j')} * wlen) AS BIGINT) AS a, {discrete_sql(poisson_cdf(lam), uniform_sql('span.len', seed, 'doc', 'w', 'j'))} AS l
  FROM (SELECT *, unnest(range(1, 1 + least(greatest(CAST(floor(target / CAST({mean!r} AS DOUBLE)) AS BIGINT), 1), target))) AS j FROM sq_{tag})),
hit_{tag} AS (SELECT *, EXISTS (SELECT 1 FROM sp_{tag} s WHERE s.doc = x.doc AND s.w = x.w AND x.i >= a AND x.i < a + l) AS hit FROM {src} x),
sh_{tag} AS (SELECT *, {_cnt(ratio)} - count(*) FILTER (WHERE hit) OVER (PARTITION BY doc, w) AS short FROM hit_{tag}),
ms_{tag} AS (SELECT * EXCLUDE (hit, short), hit OR row_number() OVER (PARTITION BY doc, w, hit ORDER BY {hash_sql('span.fill', seed, 'doc', 'w', 'i')}, i) <= short AS masked FROM sh_{tag})"""


def _drawn(op, seed, n):
    return discrete_sql([(k, (k + 1) / n) for k in range(n)], uniform_sql(op, seed, "doc", "w"))


def _masked_ids(when):
    return ", ".join(f"CASE WHEN {when.format(k=k)} THEN 4 ELSE {c} END AS {c}" for k, c in enumerate("pdt"))


@query(ctes(ROWS, TOK, f"g0 AS (SELECT *, {_drawn('mask.gran', 36, 4)} AS g FROM tk)", _cover("a", "g0", 0.333, 36, "g >= 2")) + f""",
mk AS (SELECT doc, w, i, wlen, g, masked, {_masked_ids("masked AND (g IN (1, 3) OR a = {k})")} FROM (SELECT *, {hash_sql('mask.attr', 36, 'doc', 'w', 'i')} % 3 AS a FROM ms_a)),
cl AS (SELECT *, masked AND NOT coalesce(lag(masked) OVER (PARTITION BY doc, w ORDER BY i), false) AS head FROM mk),
g1 AS (SELECT doc, w, row_number() OVER (PARTITION BY doc, w ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc, w) AS wlen, {_masked_ids("masked AND g = 3")},
  {_drawn('del.gran', 36, 2)} AS g FROM cl WHERE NOT masked OR head OR g <> 3),
""" + _cover("b", "g1", 0.2, 36, "g = 1") + f""",
dr AS (SELECT *, CASE WHEN g = 1 THEN masked ELSE {uniform_sql('delete', 36, 'doc', 'w', 'i')} <= CAST(0.2 AS DOUBLE) END AS gone FROM ms_b),
sv AS (SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY {hash_sql('delete.keep', 36, 'doc', 'w', 'i')}, i) = 1 AS saved,
  count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY doc, w) = 0 AS empty FROM dr),
fin AS (SELECT doc, w, p, d, t, row_number() OVER (PARTITION BY doc, w ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc, w) AS wlen FROM sv WHERE NOT gone OR (empty AND saved))
SELECT doc, w, wlen, p, d, t, CASE WHEN {uniform_sql('rotate', 36, 'doc', 'w')} < CAST(0.5 AS DOUBLE) AND wlen > 1
  THEN (i - CAST(floor({uniform_sql('rotate.at', 36, 'doc', 'w')} * wlen) AS BIGINT) + wlen) % wlen ELSE i END AS i FROM fin""")
def denoise_pipeline(spark, sf):
    return D.corrupt(tokens(spark, sf), SEQ, 36).select(*SEQ, "i", "wlen", "p", "d", "t")
