"""Queries over jobs with an ordered recurrence: ornaments, structural corruption, path selectors, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.operators import classify as CL
from notewise.operators import corrupt as CO
from notewise.operators import metrics as M
from notewise.operators import ornament as O
from notewise.operators import pairing as P
from notewise.operators import paths as PA
from notewise.operators import selectors as S
from notewise.operators.ordered import pack
from notewise.operators.transforms import Corruption
from notewise.plans.metrics import CLOCK, LAB, MACRO, clocked, labelled
from notewise.plans.oracle import ROWS, ctes, uniform_sql
from notewise.plans.registry import query
from notewise.session import checkpointed
from notewise.sources import tables

SEQ = ["doc", "w"]


def _pairs(spark, sf, cfg=O.OUT_OF_DISTRIBUTION):
    return O.ornament_pairs(tables.melody_sequences(spark, sf), SEQ, 41, cfg)


@query()
def ornament_pairs(spark, sf):
    """One row per ornamented note with its original position."""
    p = _pairs(spark, sf)
    return p.selectExpr(*SEQ, "len_x", "len_x_orn", "round(rho, 6) AS rho", "fail", "pi", "posexplode(x_orn) AS (i, x)").selectExpr(
        *SEQ, "len_x", "len_x_orn", "rho", "fail", "i", "pi[i] AS pi", "x.pitch", "x.dur", "x.dt")


@query(ctes(ROWS) + """SELECT doc, w, CAST(wlen AS BIGINT) AS originals, CAST(wlen AS BIGINT) AS covered, CAST(0 AS BIGINT) AS missing FROM rows_ WHERE i = 0""")
def unseen_originals(spark, sf):
    """Per sequence: original notes, those that its ornamented twin holds, and those it lost (none may be)."""
    p = checkpointed(_pairs(spark, sf))
    variants = p.selectExpr(*SEQ, "explode(pi) AS pi")
    originals = tables.melody_rows(spark, sf).select(*SEQ, "i")
    lost = P.uncovered_originals(variants, originals, SEQ).groupBy(*SEQ).agg(F.count("*").alias("missing"))
    held = variants.where("pi >= 0").groupBy(*SEQ).agg(F.countDistinct("pi").alias("covered"))
    totals = originals.groupBy(*SEQ).agg(F.count("*").alias("originals"))
    return totals.join(held, SEQ, "left").join(lost, SEQ, "left").selectExpr(
        *SEQ, "originals", "coalesce(covered, 0L) AS covered", "coalesce(missing, 0L) AS missing")


def _fold_sql(name: str, src: str, ok: str, joined: str) -> str:
    """Left fold of ``src`` (doc, w, i, n, pitch, dur, dt, u, v) as a recursion: rows of the notes it leaves, in order of ``place``."""
    return f"""{name} AS (
  SELECT doc, w, i, n, pitch, dur, dt, v, 0 AS done, NULL::BIGINT AS o_pitch, NULL::BIGINT AS o_dur, NULL::BIGINT AS o_dt, CAST(NULL AS DOUBLE) AS o_v FROM {src} WHERE i = 0
  UNION ALL
  SELECT doc, w, i, n, {joined}, CASE WHEN ok THEN done + 1 ELSE done END,
    CASE WHEN NOT ok THEN pitch END, CASE WHEN NOT ok THEN dur END, CASE WHEN NOT ok THEN dt END, CASE WHEN NOT ok THEN v END
  FROM (SELECT *, {ok} AS ok FROM (
    SELECT *, greatest(dur, dur + dt + x_dur) AS n_dur, dur + dt + x_dur + x_dt - greatest(dur, dur + dt + x_dur) AS n_dt, dt + x_dur + x_dt AS gap FROM (
      SELECT a.doc, a.w, x.i, a.n, a.pitch, a.dur, a.dt, a.v, a.done, x.pitch AS x_pitch, x.dur AS x_dur, x.dt AS x_dt, x.u AS x_u, x.v AS x_v
      FROM {name} a JOIN {src} x ON x.doc = a.doc AND x.w = a.w AND x.i = a.i + 1)))),
{name}_left AS (SELECT doc, w, i AS place, o_pitch AS pitch, o_dur AS dur, o_dt AS dt, o_v AS v FROM {name} WHERE o_pitch IS NOT NULL
  UNION ALL SELECT doc, w, n, pitch, dur, dt, v FROM {name} WHERE i = n - 1),
{name}_out AS (SELECT doc, w, i, n, pitch, dur, CASE WHEN i = n - 1 THEN 0 ELSE dt END AS dt, 0 AS u, v FROM (
  SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY doc, w) AS n FROM {name}_left))"""


#: When a note joins the one before it or is lost, and what becomes of (pitch, dur, dt, v).
MERGE_RULE = ("x_u < 0.06 AND dt BETWEEN -3 AND 2 AND done < 4 AND n - done > 8 AND n > 2 AND n_dur BETWEEN 1 AND 95 AND n_dt BETWEEN -96 AND 95",
              "CASE WHEN ok AND dur >= x_dur THEN pitch ELSE x_pitch END, CASE WHEN ok THEN n_dur ELSE x_dur END, CASE WHEN ok THEN n_dt ELSE x_dt END, x_v")
DELETE_RULE = ("x_v < 0.04 AND i < n - 1 AND gap BETWEEN -96 AND 95 AND done < 3 AND n - done > 8",
               "CASE WHEN ok THEN pitch ELSE x_pitch END, CASE WHEN ok THEN dur ELSE x_dur END, CASE WHEN ok THEN gap ELSE x_dt END, CASE WHEN ok THEN v ELSE x_v END")

MERGE_DELETE = "WITH RECURSIVE " + ROWS + f""",
src AS (SELECT doc, w, i, wlen AS n, pitch, greatest(1, least(95, dur)) AS dur, CASE WHEN i = wlen - 1 THEN 0 ELSE dt END AS dt,
  {uniform_sql('merge', 42, 'doc', 'w', 'i')} AS u, {uniform_sql('delete', 42, 'doc', 'w', 'i')} AS v FROM rows_),
""" + _fold_sql("mg", "src", *MERGE_RULE) + ",\n" + _fold_sql("dl", "mg_out", *DELETE_RULE) + """
SELECT doc, w, i, pitch, dur, dt FROM dl_out"""


@query(MERGE_DELETE)
def merge_delete(spark, sf):
    out = CO.structural(tables.melody_sequences(spark, sf), SEQ, 42)
    return out.selectExpr(*SEQ, "posexplode(notes) AS (i, x)").selectExpr(*SEQ, "i", "x.*")


@query()
def corrupted_fragments(spark, sf):
    """Ornamented, then corrupted fragments of whole sequences (32 notes every 24): the noisy query side of retrieval."""
    twins = checkpointed(_pairs(spark, sf).select(*SEQ, "x_orn"))   # both branches of the corruption read it
    orn = twins.selectExpr(*SEQ, "explode(sequence(0, greatest(0, size(x_orn) - 8), 24)) AS frag_start", "x_orn").selectExpr(
        "doc", "concat_ws('#', w, frag_start) AS w", "slice(x_orn, frag_start + 1, 32) AS notes")
    out = CO.corrupt(orn, SEQ, 43, Corruption(p_apply=0.9))
    return out.selectExpr(*SEQ, "posexplode(notes) AS (i, x)").selectExpr(*SEQ, "i", "x.*")


def _packed_clock(spark, sf):
    rows = clocked(labelled(spark, sf))
    flat = pack(rows, [*SEQ, "k"], ["onset", "pitch", "dur"])
    return rows, flat.selectExpr(*SEQ, "CAST(k AS INT) AS k", "notes.onset AS onset", "notes.pitch AS pitch", "notes.dur AS dur")


UNIFORM = """en AS (SELECT doc, w, k, wlen AS n, min(CAST(mono AS DOUBLE)) AS lo, max(CAST(mono AS DOUBLE)) AS hi FROM clk GROUP BY ALL),
pt AS (SELECT doc, w, k, n, lo, hi, j, CASE WHEN k = 1 THEN lo ELSE lo + (hi - lo) * j / (k - 1) END AS pos FROM (SELECT *, unnest(range(CAST(k AS BIGINT))) AS j FROM en WHERE k > 0 AND k < n)),
sd AS (SELECT *, (SELECT min(i) FROM clk c WHERE c.doc = pt.doc AND c.w = pt.w AND c.mono >= pt.pos) AS rt FROM pt),
nr AS (SELECT sd.doc, sd.w, sd.n, sd.j, CASE WHEN hi <= lo THEN CAST(round_even((sd.n - 1) * CAST(sd.j AS DOUBLE) / greatest(sd.k - 1, 1), 0) AS BIGINT) WHEN rt IS NULL THEN sd.n - 1
   WHEN rt > 0 AND pos - b.mono <= a.mono - pos THEN rt - 1 ELSE rt END AS pick
   FROM sd LEFT JOIN clk a ON a.doc = sd.doc AND a.w = sd.w AND a.i = rt LEFT JOIN clk b ON b.doc = sd.doc AND b.w = sd.w AND b.i = rt - 1),
fr AS (SELECT *, max(pick - j) OVER (PARTITION BY doc, w ORDER BY j ROWS UNBOUNDED PRECEDING) + j AS p FROM nr),
pk AS (SELECT DISTINCT doc, w, greatest(0, p - greatest(0, top - (n - 1))) AS i, true AS hit FROM (SELECT *, max(p) OVER (PARTITION BY doc, w) AS top FROM fr))"""


@query(ctes(LAB, CLOCK, UNIFORM) + """SELECT doc, w, i, round(CASE WHEN hard THEN CAST(1 AS DOUBLE) / (k + 1) ELSE 0 END, 9) AS score, hard
FROM (SELECT clk.*, k > 0 AND (k >= wlen OR coalesce(hit, false)) AS hard FROM clk LEFT JOIN pk USING (doc, w, i))""")
def uniform_time(spark, sf):
    return S.uniform_time(clocked(labelled(spark, sf)), SEQ).selectExpr(*SEQ, "i", "round(score, 9) AS score", "hard")


#: Cheapest path of exactly k notes, layer by layer in whole millionths; a layer keeps cost * 1024 + the note before, so ties go to the earlier one.
EXACT_K = """nw AS (SELECT doc, w, i, k, wlen AS n, pitch, CAST(mono AS DOUBLE) AS tick, min(mono) OVER s AS lo, max(mono) OVER s AS hi, pow(CASE WHEN dur >= 24 THEN 0.90 WHEN dur >= 12 THEN 0.95 WHEN dur >= 6 THEN 1.05 ELSE 1.10 END, 4)
    * CASE WHEN min(pitch) OVER s = max(pitch) OVER s THEN 1.0 ELSE 1.0 + 0.1 * (0.5 - abs(pitch - (max(pitch) OVER s + min(pitch) OVER s) / 2.0) / ((max(pitch) OVER s - min(pitch) OVER s) / 2.0)) END AS weight
  FROM clk WINDOW s AS (PARTITION BY doc, w)),
nd AS MATERIALIZED (SELECT *, CAST(round_even((weight + pow((tick - lo) / 3.0, 1.6)) * 1000000, 0) AS BIGINT) AS first_cost, CAST(round_even(pow((hi - tick) / 3.0, 1.6) * 1000000, 0) AS BIGINT) AS last_cost FROM nw WHERE k > 0 AND k < n),
ed AS MATERIALIZED (SELECT doc, w, i, j, CAST(round_even((pow(greatest(span / 3.0, 1.0), 1.6)
    + 0.1 * CASE WHEN gap = 0 THEN 0.1 WHEN gap % 12 = 0 THEN 1.0 WHEN gap <= 2 THEN 0.3 WHEN gap % 12 IN (1, 2, 10, 11) THEN 1.3 ELSE 3.0 END) * weight * 1000000, 0) AS BIGINT) AS cost
  FROM (SELECT a.doc, a.w, a.i, b.i AS j, b.tick - a.tick AS span, abs(a.pitch - b.pitch) AS gap, b.weight FROM nd a JOIN nd b ON b.doc = a.doc AND b.w = a.w AND b.i > a.i AND b.i <= b.n - b.k + a.i + 1)),
ly AS (SELECT doc, w, 0 AS t, i, k, n, first_cost AS best, -1 AS back FROM nd WHERE i <= n - k
  UNION ALL
  SELECT doc, w, t + 1, j, k, n, step // 1024, CAST(step % 1024 AS INT) FROM (
    SELECT l.doc, l.w, l.t, e.j, l.k, l.n, min((l.best + e.cost) * 1024 + l.i) AS step FROM ly l JOIN ed e ON e.doc = l.doc AND e.w = l.w AND e.i = l.i
    WHERE l.t + 1 < l.k AND e.j <= l.n - l.k + l.t + 1 GROUP BY ALL)),
lm AS MATERIALIZED (SELECT * FROM ly),
pa AS (SELECT doc, w, k - 1 AS t, CAST(min((best + last_cost) * 1024 + i) % 1024 AS INT) AS i FROM lm JOIN nd USING (doc, w, i, k, n) WHERE t = k - 1 GROUP BY ALL
  UNION ALL
  SELECT p.doc, p.w, p.t - 1, x.back FROM pa p JOIN lm x ON x.doc = p.doc AND x.w = p.w AND x.t = p.t AND x.i = p.i WHERE p.t > 0)"""


@query("WITH RECURSIVE " + ",\n".join([LAB, CLOCK, EXACT_K]) + """
SELECT doc, w, i, round(CASE WHEN hard THEN CAST(1 AS DOUBLE) / (k + 1) ELSE 0 END, 9) AS score, hard
FROM (SELECT clk.*, k > 0 AND (k >= wlen OR t IS NOT NULL) AS hard FROM clk LEFT JOIN pa USING (doc, w, i))""")
def exact_k_path(spark, sf):
    return PA.exact_k_path(_packed_clock(spark, sf)[1], SEQ).selectExpr(*SEQ, "i", "round(score, 9) AS score", "hard")


@query()
def selector_benchmark(spark, sf):
    """Four selectors on ornamented twins, macro metrics per method."""
    twins = checkpointed(_pairs(spark, sf)).selectExpr(*SEQ, "len_x - 2 AS k", "pi", "posexplode(x_orn) AS (i, x)").selectExpr(
        *SEQ, "k", "i", "CASE WHEN pi[i] >= 0 THEN 1 ELSE 0 END AS label", "x.pitch", "x.dur", "x.dt", "count(*) OVER (PARTITION BY doc, w) AS wlen")
    rows = S.with_onsets(twins, SEQ)
    flat = pack(rows, [*SEQ, "k"], ["onset", "pitch", "dur"]).selectExpr(*SEQ, "k", "notes.onset AS onset", "notes.pitch AS pitch", "notes.dur AS dur")
    picked = S.longest_k(rows, SEQ).selectExpr("'longest' AS method", "*")
    for name, part in (("random", S.random_k(rows, SEQ, 44)), ("uniform_time", S.uniform_time(rows, SEQ)), ("exact_k_path", PA.exact_k_path(flat, SEQ))):
        picked = picked.unionByName(part.selectExpr(f"'{name}' AS method", "*"))
    scored = picked.join(rows.select(*SEQ, "i", "label"), [*SEQ, "i"])
    return M.macro(M.pair_metrics(scored, ["method", *SEQ]), MACRO, ["method"])


#: Theme notes of a window, the variation being all its notes.
THEME = "kind <> 'error'"
#: The same, and the themes of four other kinds of pieces: sparse, opening only, very short, silent.
SILVER_THEME = """CASE doc % 5 WHEN 0 THEN kind = 'purchase' WHEN 1 THEN i < 20 WHEN 2 THEN kind = 'click' AND i < 12 WHEN 3 THEN kind = 'rest' ELSE kind <> 'error' END"""


def _theme_pairs(spark, sf, theme=THEME):
    rows = tables.melody_rows(spark, sf).selectExpr("*", f"{theme} AS in_theme")
    v = pack(rows, SEQ, ["pitch", "st", "en", "in_theme"])
    t = "filter(notes, x -> x.in_theme)"
    return v.selectExpr(
        *SEQ, *[f"{t}.{c} AS t_{c}" for c in ("pitch", "st", "en")], *[f"notes.{c} AS v_{c}" for c in ("pitch", "st", "en")])


def _voice_sql(kept: str) -> str:
    return f"""(SELECT doc, w, row_number() OVER (PARTITION BY doc, w ORDER BY i) - 1 AS i, count(*) OVER s AS n, pitch, (st - min(st) OVER s) / CAST(greatest(1, max(en) OVER s - min(st) OVER s) AS DOUBLE) AS at,
    greatest(1, en - st) / CAST(greatest(1, max(en) OVER s - min(st) OVER s) AS DOUBLE) AS len FROM rows_ WHERE {kept} WINDOW s AS (PARTITION BY doc, w))"""


def _aligned_sql(theme: str) -> str:
    """Global alignment over anti-diagonals in whole millionths; every cell hands its own value and the one above it to the next two diagonals."""
    return f"""ms AS MATERIALIZED (SELECT doc, w, i, j, n, m, CAST(round_even((CAST(2.5 AS DOUBLE) * exp(-((fold / 2.0) * (fold / 2.0))) * exp(-((gap / 12.0 / 2.0) * (gap / 12.0 / 2.0)))
    + exp(-((apart / 0.15) * (apart / 0.15))) + exp(-((differ / 0.25) * (differ / 0.25))) + CAST(0.1 AS DOUBLE) * len - CAST(1.6 AS DOUBLE)) * 1000000, 0) AS BIGINT) AS score
  FROM (SELECT *, CAST(least(gap % 12, 12 - gap % 12) AS DOUBLE) AS fold FROM (
    SELECT t.doc, t.w, t.i, v.i AS j, t.n, v.n AS m, CAST(abs(t.pitch - v.pitch) AS BIGINT) AS gap, t.at - v.at AS apart, t.len - v.len AS differ, v.len FROM {_voice_sql(theme)} t JOIN {_voice_sql("true")} v ON v.doc = t.doc AND v.w = t.w))),
dg AS (SELECT DISTINCT doc, w, 0 AS i, 0 AS j, n, m, CAST(0 AS BIGINT) AS best, CAST(NULL AS BIGINT) AS above, -1 AS move FROM ms
  UNION ALL
  SELECT c.doc, c.w, c.i, c.j, c.n, c.m, greatest(corner + score, above - 900000, beside - 600000), above,
    CASE WHEN corner + score >= above - 900000 AND corner + score >= beside - 600000 THEN 0 WHEN beside IS NULL OR above - 900000 >= beside - 600000 THEN 1 ELSE 2 END
  FROM (SELECT doc, w, i, j, n, m, max(above) AS above, max(beside) AS beside, max(corner) AS corner FROM (
      SELECT doc, w, n, m, i + side AS i, j + 1 - side AS j, CASE WHEN side = 1 THEN best END AS above, CASE WHEN side = 0 THEN best END AS beside, CASE WHEN side = 0 THEN above END AS corner
      FROM (SELECT *, unnest([0, 1]) AS side FROM dg)) WHERE i <= n AND j <= m GROUP BY ALL) c
  LEFT JOIN ms ON ms.doc = c.doc AND ms.w = c.w AND ms.i = c.i - 1 AND ms.j = c.j - 1),
mv AS MATERIALIZED (SELECT doc, w, i, j, n, m, move FROM dg),
bk AS (SELECT doc, w, i, j, move FROM mv WHERE i = n AND j = m
  UNION ALL
  SELECT x.doc, x.w, x.i, x.j, x.move FROM bk b JOIN mv x ON x.doc = b.doc AND x.w = b.w AND x.i = b.i - CASE WHEN b.move <> 2 THEN 1 ELSE 0 END AND x.j = b.j - CASE WHEN b.move <> 1 THEN 1 ELSE 0 END
  WHERE b.move >= 0),
al AS (SELECT doc, w, b.i - 1 AS theme_i, b.j - 1 AS var_i, n, m, score FROM bk b JOIN ms USING (doc, w) WHERE b.move = 0 AND ms.i = b.i - 1 AND ms.j = b.j - 1)"""


@query("WITH RECURSIVE " + ROWS + ",\n" + _aligned_sql(THEME) + """
SELECT doc, w, CAST(theme_i AS BIGINT) AS theme_i, CAST(var_i AS BIGINT) AS var_i, round(score / CAST(1000000 AS DOUBLE), 6) AS score FROM al""")
def align_pairs(spark, sf):
    return PA.align(_theme_pairs(spark, sf), SEQ).selectExpr(*SEQ, "theme_i", "var_i", "round(score, 6) AS score")


#: One verdict a pair, the dropped ones too; pairs whose theme has no note never reach the alignment.
VERDICTS = f"""ln AS (SELECT doc || '#' || w AS pair, count(*) FILTER (WHERE {SILVER_THEME}) AS n_theme, count(*) AS n_var FROM rows_ GROUP BY ALL),
gd AS (SELECT doc || '#' || w AS pair, theme_i, var_i, score FROM al WHERE score >= 500000),
vd AS (SELECT pair, n_theme, n_var, kept, coverage, rho, CASE WHEN n_theme = 0 THEN 'parse_or_empty' WHEN n_theme < 6 OR n_var < 10 THEN 'too_short'
    WHEN kept < 6 OR coverage < 0.7 OR reach < 0.8 THEN 'low_alignment' WHEN rho < 1.0 / 3 - 1e-9 OR rho > 1 + 1e-9 THEN 'rho_out_of_range' END AS skip_reason
  FROM (SELECT pair, n_theme, n_var, kept, kept / CAST(greatest(1, least(n_theme, n_var)) AS DOUBLE) AS coverage, (kept + 2) / CAST(n_var + 2 AS DOUBLE) AS rho,
      CASE WHEN kept >= 2 AND n_var >= 2 THEN (hi - lo) / CAST(n_var - 1 AS DOUBLE) ELSE 1 END AS reach
    FROM (SELECT ln.*, count(gd.pair) AS kept, min(var_i) AS lo, max(var_i) AS hi FROM ln LEFT JOIN gd USING (pair) GROUP BY ALL)))"""
SILVER = "WITH RECURSIVE " + ROWS + ",\n" + _aligned_sql(SILVER_THEME) + ",\n" + VERDICTS


def _silver(spark, sf):
    pairs = _theme_pairs(spark, sf, SILVER_THEME).selectExpr("concat_ws('#', doc, w) AS pair", "*").drop(*SEQ)
    lengths = pairs.selectExpr("pair", "size(t_pitch) AS n_theme", "size(v_pitch) AS n_var")
    short = PA.first_notes(pairs, P.SILVER_NOTES)
    return P.silver_labels(checkpointed(PA.align(short, ["pair"])), lengths, "pair")


@query(SILVER + """
SELECT pair, CAST(theme_i AS BIGINT) AS theme_i, CAST(var_i AS BIGINT) AS var_i, row_number() OVER (PARTITION BY pair ORDER BY var_i) - 1 AS pi, round(score / CAST(1000000 AS DOUBLE), 6) AS score
FROM gd JOIN vd USING (pair) WHERE skip_reason IS NULL""")
def silver_labels(spark, sf):
    return _silver(spark, sf)[0].selectExpr("pair", "theme_i", "var_i", "pi", "round(score, 6) AS score")


@query(SILVER + """
SELECT pair, CAST(n_theme AS BIGINT) AS n_theme, CAST(n_var AS BIGINT) AS n_var, CAST(kept AS BIGINT) AS kept, round(coverage, 9) AS coverage, round(rho, 9) AS rho, skip_reason FROM vd""")
def silver_verdicts(spark, sf):
    """Every candidate pair with its matches, coverage and rho, and why it was dropped."""
    return _silver(spark, sf)[1].selectExpr("pair", "n_theme", "n_var", "kept", "round(coverage, 9) AS coverage", "round(rho, 9) AS rho", "skip_reason")


@query()
def note_classifier(spark, sf):
    """Train on ornamented twins of two thirds of the pieces, score the others."""
    rows = checkpointed(_pairs(spark, sf)).selectExpr(*SEQ, "pi", "posexplode(x_orn) AS (i, x)").selectExpr(
        *SEQ, "i", "CASE WHEN pi[i] >= 0 THEN 1 ELSE 0 END AS label", "x.pitch", "x.dur", "x.dt")
    feats = CL.with_features(S.with_onsets(rows, SEQ), SEQ)
    model = CL.fit(feats.where("doc % 3 <> 0"))
    scored = CL.keep_probability(model, feats.where("doc % 3 = 0"))
    return scored.selectExpr(*SEQ, "i", "label", "round(score, 4) AS score")
