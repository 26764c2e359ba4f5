"""Selectors, rhythm closure and evaluation queries.  Gold: every note except 'error' events."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise import constants as C
from notewise.functions import weights as W
from notewise.operators import bias as B
from notewise.operators import closure as K
from notewise.operators import metrics as M
from notewise.operators import selectors as S
from notewise.operators import stats as ST
from notewise.operators.ordered import over
from notewise.plans.oracle import ROWS, ctes, uniform_sql
from notewise.plans.registry import query
from notewise.sources import tables

SEQ = ["doc", "w"]

# ---------------------------------------------------------------- shared views


def labelled(spark, sf):
    """Windowed notes with label and k = gold notes of the sequence."""
    rows = tables.melody_rows(spark, sf).selectExpr("*", "CASE WHEN kind <> 'error' THEN 1 ELSE 0 END AS label")
    return rows.selectExpr("*", f"sum(label) {over(SEQ)} AS k")


def longest(spark, sf):
    rows = labelled(spark, sf)
    total = f"sum(dur) {over(SEQ)}"
    marked = S.top_k(rows, SEQ, "dur")
    return marked.selectExpr("*", f"dur / {total} * (1 - 1D / (k + 1)) AS score", "1D / (k + 1) AS bos_mass")


LAB = ROWS + """,
lab AS (SELECT *, CASE WHEN kind <> 'error' THEN 1 ELSE 0 END AS label,
  sum(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, w) AS k FROM rows_)"""
LONGEST = LAB + """,
sc AS (SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY dur DESC, i) <= k AS hard, CAST(1 AS DOUBLE) / (k + 1) AS bos_mass,
  dur / CAST(sum(dur) OVER (PARTITION BY doc, w) AS DOUBLE) * (1 - CAST(1 AS DOUBLE) / (k + 1)) AS score FROM lab)"""
RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY score DESC, i) AS r, count(*) OVER (PARTITION BY doc, w) AS n,
  sum(label) OVER (PARTITION BY doc, w ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) AS hits,
  sum(label) OVER (PARTITION BY doc, w) AS n_pos FROM sc)"""


def _curve(by="doc, w", src="rk"):
    rhos = ", ".join(f"CAST({r!r} AS DOUBLE)" for r in C.CUT_RHOS)
    return f"""cut AS (SELECT {by}, rho, n, n_pos, least(greatest(CAST(ceil(rho * n) AS BIGINT), 1), n) AS k, r, label FROM {src}, (SELECT unnest([{rhos}]) AS rho)),
cv AS (SELECT {by}, rho, 2.0 * sum(label) FILTER (WHERE r <= k) / CAST(max(k) + max(n_pos) AS DOUBLE) AS f1,
   CAST(sum(label / log2(r + 1)) FILTER (WHERE r <= k) AS DOUBLE) / sum(1 / log2(r + 1)) FILTER (WHERE r <= least(k, n_pos)) AS ndcg FROM cut GROUP BY {by}, rho),
tr AS (SELECT *, (rho - lag(rho) OVER q) * (f1 + lag(f1) OVER q) / 2 AS part FROM cv WINDOW q AS (PARTITION BY {by} ORDER BY rho)),
cc AS (SELECT {by}, sum(part) AS cut_f1_auc, sum(part) / CAST(max(rho) - min(rho) AS DOUBLE) AS cut_f1_auc_norm, avg(ndcg) AS mean_ndcg_cut FROM tr GROUP BY {by})"""


def per_sequence_sql(by="doc, w"):
    return f"""cnt AS (SELECT {by}, CAST(count(*) FILTER (WHERE hard AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE hard AND label = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE NOT hard AND label = 1) AS DOUBLE) AS fn, max(n) AS n, max(n_pos) AS n_pos,
  CAST(sum(label) FILTER (WHERE r <= n_pos) AS DOUBLE) AS tk, sum(hits / CAST(r AS DOUBLE)) FILTER (WHERE label = 1) / max(n_pos) AS ap_soft,
  sum(label / log2(r + 1)) FILTER (WHERE r <= n_pos) / sum(1 / log2(r + 1)) FILTER (WHERE r <= n_pos) AS ndcg_soft,
  coalesce(sum(score) FILTER (WHERE label = 0), 0) / greatest(sum(score) + max(bos_mass), 1e-8) AS ins_mass_soft FROM rk GROUP BY {by}),
per AS (SELECT cnt.*, tp / greatest(tp + fp, 1e-8) AS precision_hard, tp / greatest(tp + fn, 1e-8) AS recall_hard,
  2 * tp / greatest(2 * tp + fp + fn, 1e-8) AS f1_hard, tp / greatest(tp + fp + fn, 1e-8) AS iou_hard,
  tk / n_pos AS f1_hard_topk, tk / (2 * n_pos - tk) AS iou_hard_topk, tk / n_pos - 2 * tp / greatest(2 * tp + fp + fn, 1e-8) AS gap_f1,
  cut_f1_auc, cut_f1_auc_norm, mean_ndcg_cut FROM cnt JOIN cc USING ({by}))"""


def _rounded(df, *names):
    return df.selectExpr(*SEQ, *[f"round({n}, 9) AS {n}" for n in names])


def _sel(*names):
    return "SELECT doc, w, " + ", ".join(f"round({n}, 9) AS {n}" for n in names) + " FROM "


# ---------------------------------------------------------------- selectors


@query(ctes(LONGEST) + "SELECT doc, w, i, round(score, 9) AS score, hard, round(bos_mass, 9) AS bos_mass FROM sc")
def longest_k(spark, sf):
    return S.longest_k(labelled(spark, sf), SEQ).selectExpr(*SEQ, "i", "round(score, 9) AS score", "hard", "round(bos_mass, 9) AS bos_mass")


RANDOM = f"""seg AS (SELECT *, ((i + 1) * k - 1) // wlen AS seg FROM lab),
sc AS (SELECT doc, w, i, label, CASE WHEN hard THEN CAST(1 AS DOUBLE) / (k + 1) ELSE 0 END AS score, hard, CAST(1 AS DOUBLE) / (k + 1) AS bos_mass FROM (
  SELECT *, CASE WHEN k >= wlen THEN i < k ELSE i = lo + CAST(floor({uniform_sql('random_k', 13, 'doc', 'w', 'seg')} * (hi - lo + 1)) AS BIGINT) END AS hard
  FROM (SELECT *, seg * wlen // k AS lo, (seg + 1) * wlen // k - 1 AS hi FROM seg)))"""


@query(ctes(LAB, RANDOM) + "SELECT doc, w, i, round(score, 9) AS score, hard FROM sc")
def random_downsample(spark, sf):
    return S.random_k(labelled(spark, sf), SEQ, 13).selectExpr(*SEQ, "i", "round(score, 9) AS score", "hard")


@query(ctes(LAB, """e AS (SELECT *, dur / CAST(24 AS DOUBLE) AS s FROM lab)""") + """
SELECT doc, w, i, s >= 0.9 OR (max(s) OVER (PARTITION BY doc, w) < 0.9 AND row_number() OVER (PARTITION BY doc, w ORDER BY s DESC, i) = 1) AS kept,
  round(exp(s * 2) / sum(exp(s * 2)) OVER (PARTITION BY doc, w), 9) AS share FROM e""")
def threshold_and_softmax(spark, sf):
    e = labelled(spark, sf).selectExpr(*SEQ, "i", "dur / 24D AS score")
    return S.normalised(S.keep_by_threshold(e, SEQ, 0.9), SEQ, 0.5).selectExpr(*SEQ, "i", "kept", "round(share, 9) AS share")


@query(ctes(ROWS) + """, d AS (SELECT *, i % 6 AS depth FROM rows_)
SELECT doc, w, i, rho, row_number() OVER (PARTITION BY doc, w, rho ORDER BY depth, i) <= greatest(ceil(rho * wlen), 1) AS in_cut
FROM d, (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75]) AS rho)""")
def gold_cuts(spark, sf):
    d = tables.melody_rows(spark, sf).selectExpr(*SEQ, "i", "i % 6 AS depth")
    return S.gold_cuts(d, SEQ, (0.25, 0.5, 0.75))


@query(ctes(LAB) + """SELECT doc, w, i,
  CAST(CASE WHEN st % 24 = 0 THEN 0.85 WHEN st % 12 = 0 THEN 0.95 WHEN st % 6 = 0 THEN 1.05 ELSE 1.15 END AS DOUBLE) AS metric_w,
  CAST(CASE WHEN dur >= 24 THEN 0.9 WHEN dur >= 12 THEN 0.95 WHEN dur >= 6 THEN 1.05 ELSE 1.1 END AS DOUBLE) AS dur_w,
  round(CASE WHEN hi = lo THEN 1 ELSE (0.5 - abs(pitch - (hi + lo) / CAST(2 AS DOUBLE)) / ((hi - lo) / CAST(2 AS DOUBLE))) * 0.1 + 1 END, 9) AS pitch_w,
  CAST(CASE WHEN p IS NULL THEN -1 WHEN abs(pitch - p) = 0 THEN 0.1 WHEN abs(pitch - p) % 12 = 0 THEN 1 WHEN abs(pitch - p) <= 2 THEN 0.3
    WHEN abs(pitch - p) % 12 IN (1, 2, 10, 11) THEN 1.3 ELSE 3 END AS DOUBLE) AS rel, coalesce(least(abs(pitch - p) % 12, 12 - abs(pitch - p) % 12), -1) AS oct,
  round(exp(-(i % 6) / CAST(2 AS DOUBLE)), 9) AS depth_s, round(sqrt(dur), 9) AS tok_w
FROM (SELECT *, min(pitch) OVER (PARTITION BY doc, w) AS lo, max(pitch) OVER (PARTITION BY doc, w) AS hi, lag(pitch) OVER (PARTITION BY doc, w ORDER BY i) AS p FROM lab)""")
def note_weights(spark, sf):
    r = tables.melody_rows(spark, sf).selectExpr(
        "*", f"min(pitch) {over(SEQ)} AS lo", f"max(pitch) {over(SEQ)} AS hi", f"lag(pitch) {over(SEQ, ['i'])} AS p")
    return r.selectExpr(
        *SEQ, "i", f"{W.metric_weight('st')} AS metric_w", f"{W.duration_weight('dur')} AS dur_w", f"round({W.pitch_weight('pitch', 'lo', 'hi')}, 9) AS pitch_w",
        f"CASE WHEN p IS NOT NULL THEN {W.interval_cost('pitch', 'p')} ELSE -1D END AS rel", f"CASE WHEN p IS NOT NULL THEN {W.octave_distance('pitch', 'p')} ELSE -1 END AS oct",
        f"round({W.depth_score('(i % 6)', 2.0)}, 9) AS depth_s", f"round({W.token_weight('dur', 'sqrt_duration')}, 9) AS tok_w")


@query(ctes(LAB, """v AS (SELECT *, CASE WHEN label = 1 THEN sum(label) OVER (PARTITION BY doc, w ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 ELSE -1 END AS pi FROM lab)""") + """,
s AS (SELECT doc, w, pi, sum(dur) / CAST(24 AS DOUBLE) AS score FROM v WHERE pi >= 0 GROUP BY doc, w, pi)
SELECT v.doc, v.w, CAST(v.pi AS BIGINT) AS pi, round(coalesce(s.score, 0), 9) AS score FROM v LEFT JOIN s USING (doc, w, pi) WHERE v.pi >= 0""")
def scores_onto_original(spark, sf):
    v = labelled(spark, sf).selectExpr(
        *SEQ, "i", "label", "dur / 24D AS score", f"CASE WHEN label = 1 THEN sum(label) {over(SEQ, ['i'])} - 1 ELSE -1 END AS pi")
    originals = v.where("pi >= 0").selectExpr(*SEQ, "pi AS i")
    return S.onto_original(v, originals, SEQ).selectExpr(*SEQ, "pi", "round(score, 9) AS score")


# ---------------------------------------------------------------- clock and closure

CLOCK = """ck AS (SELECT *, b + coalesce(sum(dur + dt) OVER (PARTITION BY doc, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset
  FROM (SELECT *, least(95, first_value(st) OVER (PARTITION BY doc, w ORDER BY i)) AS b FROM lab)),
clk AS (SELECT *, max(onset) OVER (PARTITION BY doc, w ORDER BY i ROWS UNBOUNDED PRECEDING) AS mono FROM ck)"""


def clocked(df):
    bos = f"least(95, first_value(st) {over(SEQ, ['i'])})"
    return S.with_onsets(df.selectExpr("*", f"{bos} AS b"), SEQ, "b")


@query(ctes(LAB, CLOCK) + "SELECT doc, w, i, CAST(onset AS BIGINT) AS onset, CAST(mono AS BIGINT) AS onset_mono FROM clk")
def onset_prefix(spark, sf):
    return clocked(labelled(spark, sf)).selectExpr(*SEQ, "i", "onset", "onset_mono")


@query(ctes(LAB, CLOCK) + """, t AS (SELECT *, onset - 100 AS o FROM clk),
u AS (SELECT *, min(o) OVER (PARTITION BY doc, w) AS lo FROM t)
SELECT doc, w, i, pitch, CAST(o + CASE WHEN lo < 0 THEN CAST(ceil(-lo / CAST(48 AS DOUBLE)) AS BIGINT) * 48 ELSE 0 END AS BIGINT) AS start_pos,
  CAST(o + CASE WHEN lo < 0 THEN CAST(ceil(-lo / CAST(48 AS DOUBLE)) AS BIGINT) * 48 ELSE 0 END + dur AS BIGINT) AS end_pos FROM u""")
def decode_notes(spark, sf):
    shifted = clocked(labelled(spark, sf)).withColumn("onset", F.expr("onset - 100"))
    return K.note_times(shifted, SEQ)


CLOSE = """sg AS (SELECT *, sum(label) OVER (PARTITION BY doc, w ORDER BY i ROWS UNBOUNDED PRECEDING) AS seg,
   max(onset + dur + dt) FILTER (WHERE i = wlen - 1) OVER (PARTITION BY doc, w) AS fin FROM clk),
rc AS (SELECT *, max(onset + dur) OVER (PARTITION BY doc, w, seg) AS reach FROM sg),
kp AS (SELECT *, coalesce(lead(onset) OVER (PARTITION BY doc, w ORDER BY i), fin) AS nx, least(greatest(reach - onset, 1), 95) AS nd FROM rc WHERE label = 1)"""


@query(ctes(LAB, CLOCK, CLOSE) + """SELECT doc, w, i, pitch, CAST(nd AS BIGINT) AS new_dur, CAST(least(greatest(nx - onset - nd, -96), 95) AS BIGINT) AS new_dt,
  CAST(least(greatest(min(onset) OVER (PARTITION BY doc, w), -96), 95) AS BIGINT) AS bos_dt FROM kp""")
def rhythm_closure(spark, sf):
    rows = clocked(labelled(spark, sf)).selectExpr("*", "label = 1 AS keep")
    return K.rhythm_closure(rows, SEQ).selectExpr(*SEQ, "i", "pitch", "new_dur", "new_dt", "bos_dt")


@query(ctes(LAB, CLOCK) + """SELECT doc, w, i, pitch, dur, CAST(coalesce(lead(onset) OVER (PARTITION BY doc, w ORDER BY i) - onset - dur, 0) AS BIGINT) AS new_dt
FROM clk WHERE label = 1""")
def dt_relink(spark, sf):
    return K.relink(clocked(labelled(spark, sf)).selectExpr("*", "label = 1 AS keep"), SEQ)


@query(ctes(LAB, CLOCK) + "SELECT doc, w, CAST(least(greatest(arg_min(onset, i), 0), 95) AS BIGINT) AS bos FROM clk WHERE label = 1 GROUP BY doc, w")
def skeleton_anchor(spark, sf):
    return K.anchors(clocked(labelled(spark, sf)).selectExpr("*", "label = 1 AS keep"), SEQ)


@query(ctes(LAB, CLOCK, CLOSE) + """SELECT doc, w, count(*) + 2 AS used_len, CAST(sum(nd) AS BIGINT) AS dur_sum, CAST(sum(i) AS BIGINT) AS idx_sum,
  round((count(*) + 2) / CAST(max(wlen) + 2 AS DOUBLE), 9) AS rho FROM kp GROUP BY doc, w""")
def skeleton_export(spark, sf):
    rows = clocked(labelled(spark, sf)).selectExpr("*", "label = 1 AS keep")
    lengths = rows.groupBy(*SEQ).agg(F.max("wlen").alias("wlen"))
    out = K.skeleton_export(K.rhythm_closure(rows, SEQ), SEQ, lengths)
    return out.selectExpr(
        *SEQ, "used_len", "aggregate(notes, 0L, (a, x) -> a + x.dur) AS dur_sum", "aggregate(source_idx, 0L, (a, x) -> a + x) AS idx_sum", "round(rho, 9) AS rho")


# ---------------------------------------------------------------- metrics


@query(ctes(LONGEST, RANKED, _curve(), per_sequence_sql()) + _sel("precision_hard", "recall_hard", "f1_hard", "iou_hard", "f1_hard_topk", "iou_hard_topk", "gap_f1") + "per")
def set_scores(spark, sf):
    return _rounded(M.pair_metrics(longest(spark, sf), SEQ), "precision_hard", "recall_hard", "f1_hard", "iou_hard", "f1_hard_topk", "iou_hard_topk", "gap_f1")


@query(ctes(LONGEST, RANKED) + """SELECT doc, w, round(sum(hits / CAST(r AS DOUBLE)) FILTER (WHERE label = 1) / max(n_pos), 9) AS ap_soft FROM rk GROUP BY doc, w""")
def average_precision(spark, sf):
    return _rounded(M.pair_metrics(longest(spark, sf), SEQ), "ap_soft")


@query(ctes(LONGEST, RANKED) + """SELECT doc, w, round(sum(label / log2(r + 1)) FILTER (WHERE r <= n_pos) / sum(1 / log2(r + 1)) FILTER (WHERE r <= n_pos), 9) AS ndcg_soft FROM rk GROUP BY doc, w""")
def ndcg(spark, sf):
    return _rounded(M.pair_metrics(longest(spark, sf), SEQ), "ndcg_soft")


@query(ctes(LONGEST, RANKED, _curve()) + _sel("cut_f1_auc", "cut_f1_auc_norm", "mean_ndcg_cut") + "cc")
def cut_curve_auc(spark, sf):
    return _rounded(M.pair_metrics(longest(spark, sf), SEQ), "cut_f1_auc", "cut_f1_auc_norm", "mean_ndcg_cut")


@query(ctes(LONGEST) + """SELECT doc, w, round(coalesce(sum(score) FILTER (WHERE label = 0), 0) / (sum(score) + max(bos_mass)), 9) AS ins_mass_soft FROM sc GROUP BY doc, w""")
def insertion_mass(spark, sf):
    return _rounded(M.pair_metrics(longest(spark, sf), SEQ), "ins_mass_soft")


MACRO = ("precision_hard", "recall_hard", "f1_hard", "iou_hard", "f1_hard_topk", "gap_f1", "ap_soft", "ndcg_soft", "ins_mass_soft", "cut_f1_auc_norm", "mean_ndcg_cut")


@query(ctes(LONGEST, RANKED, _curve(), per_sequence_sql()) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS value, count({m}) AS n FROM per" for m in MACRO))
def backbone_eval(spark, sf):
    return M.macro(M.pair_metrics(longest(spark, sf), SEQ), MACRO)


def predictions(spark, sf):
    """Scores as an outside model might hand them in: pieces left out or cut short, positions and pieces too many."""
    rows = tables.melody_rows(spark, sf)
    told = rows.where("doc % 7 <> 3 AND (doc % 7 <> 5 OR i < 10)").selectExpr(*SEQ, "i", "((pitch * 7 + i * 3 + doc) % 101) / 101D AS score")
    over_long = rows.where("doc % 7 = 1 AND i < 3").selectExpr(*SEQ, "CAST(i + wlen AS INT) AS i", "0.5D AS score")
    unknown = rows.where("doc % 7 = 2 AND i < 4").selectExpr("doc + 1000000 AS doc", "w", "i", "0.5D AS score")
    return told.unionByName(over_long).unionByName(unknown)


SUPPLIED = LAB + """,
pred AS (SELECT doc, w, i, ((pitch * 7 + i * 3 + doc) % 101) / CAST(101 AS DOUBLE) AS score FROM rows_ WHERE doc % 7 <> 3 AND (doc % 7 <> 5 OR i < 10)
  UNION ALL SELECT doc, w, i + wlen, 0.5 FROM rows_ WHERE doc % 7 = 1 AND i < 3 UNION ALL SELECT doc + 1000000, w, i, 0.5 FROM rows_ WHERE doc % 7 = 2 AND i < 4),
sc AS (SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY score DESC, i) <= k AS hard, CAST(0 AS DOUBLE) AS bos_mass
  FROM (SELECT lab.*, coalesce(pred.score, 0) AS score FROM lab LEFT JOIN pred USING (doc, w, i)))"""


@query(ctes(SUPPLIED, RANKED, _curve(), per_sequence_sql()) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS value, count({m}) AS n FROM per" for m in MACRO))
def supplied_scores(spark, sf):
    """Evaluation of a table of predicted scores."""
    scored, _ = S.with_scores(labelled(spark, sf), predictions(spark, sf), SEQ)
    return M.macro(M.pair_metrics(S.top_k(scored, SEQ, "score"), SEQ), MACRO)


@query(ctes(SUPPLIED) + """SELECT doc, w, n_notes, n_scores, n_missing, n_surplus,
  CASE WHEN n_notes = 0 THEN 'surplus' WHEN n_scores = 0 THEN 'missing' WHEN n_missing + n_surplus > 0 THEN 'mismatch' ELSE 'ok' END AS status
FROM (SELECT doc, w, count(lab.pitch) AS n_notes, count(pred.score) AS n_scores, count(*) - count(pred.score) AS n_missing, count(*) - count(lab.pitch) AS n_surplus
  FROM lab FULL JOIN pred USING (doc, w, i) GROUP BY doc, w)""")
def supplied_score_report(spark, sf):
    """Which sequences a table of predicted scores covers, and what in it belongs to none."""
    return S.with_scores(labelled(spark, sf), predictions(spark, sf), SEQ)[1]


BINS = "CASE " + " ".join(
    f"WHEN rho >= CAST({a!r} AS DOUBLE) AND rho < CAST({b!r} AS DOUBLE) THEN {j}" for j, (a, b) in enumerate(zip(C.RHO_BINS, C.RHO_BINS[1:]))) + " END"


@query(ctes(LONGEST, RANKED, _curve(), per_sequence_sql()) + f""", b AS (SELECT *, {BINS} AS bin FROM (SELECT *, (n_pos + 2) / CAST(n + 2 AS DOUBLE) AS rho FROM per))
SELECT CAST(s.bin AS BIGINT) AS bin, count(b.bin) AS n, round(avg(f1_hard), 6) AS f1_hard, round(avg(ap_soft), 6) AS ap_soft FROM (SELECT unnest(range(0, 4)) AS bin) s LEFT JOIN b USING (bin) GROUP BY s.bin""")
def rho_buckets(spark, sf):
    per = M.pair_metrics(longest(spark, sf), SEQ).selectExpr("*", "(n_pos + 2) / CAST(n + 2 AS DOUBLE) AS rho")
    return M.by_rho(per, ["f1_hard", "ap_soft"])


@query(ctes(LAB) + """, r AS (SELECT (max(k) + 2) / CAST(max(wlen) + 2 AS DOUBLE) AS rho FROM lab GROUP BY doc, w)
SELECT CAST(b AS BIGINT) AS bin, count(rho) AS n FROM (SELECT unnest(range(0, 20)) AS b) LEFT JOIN r ON rho >= b / CAST(20 AS DOUBLE) AND rho < (b + 1) / CAST(20 AS DOUBLE) GROUP BY b""")
def rho_histogram(spark, sf):
    r = labelled(spark, sf).groupBy(*SEQ).agg(F.expr("(max(k) + 2) / CAST(max(wlen) + 2 AS DOUBLE) AS rho"))
    return ST.binned(r, F.col("rho"), [j / 20 for j in range(21)], [])


@query(ctes(LONGEST.replace("sc AS (", "sc_l AS ("), RANDOM.replace("sc AS (", "sc_r AS ("), """sc AS (
  SELECT 'longest' AS method, doc, w, i, label, score, hard, bos_mass FROM sc_l UNION ALL SELECT 'random', doc, w, i, label, score, hard, bos_mass FROM sc_r)""",
            RANKED.replace("PARTITION BY doc, w", "PARTITION BY method, doc, w"), _curve("method, doc, w"), per_sequence_sql("method, doc, w")) + " UNION ALL ".join(
    f"SELECT method, '{m}' AS metric, round(avg({m}), 6) AS value, count({m}) AS n FROM per GROUP BY method" for m in MACRO))
def selector_comparison(spark, sf):
    rows = labelled(spark, sf)
    picked = S.longest_k(rows, SEQ).selectExpr("'longest' AS method", "*").unionByName(
        S.random_k(rows, SEQ, 13).selectExpr("'random' AS method", "*")).join(rows.select(*SEQ, "i", "label"), [*SEQ, "i"])
    return M.macro(M.pair_metrics(picked, ["method", *SEQ]), MACRO, ["method"])


GRADED = ROWS + """,
sc AS (SELECT doc, w, i, dur AS score, exp(-(i % 6)) AS gold, row_number() OVER (PARTITION BY doc, w ORDER BY pitch DESC, i) <= wlen // 2 AS hard FROM rows_)"""


def graded(spark, sf):
    rows = tables.melody_rows(spark, sf)
    return S.top_k(rows.selectExpr("*", "wlen div 2 AS k"), SEQ, "pitch").selectExpr(
        *SEQ, "i", "dur AS score", "exp(CAST(-(i % 6) AS DOUBLE)) AS gold", "hard")


@query(ctes(GRADED) + """, r AS (SELECT doc, w, rank() OVER a + (count(*) OVER (PARTITION BY doc, w, score) - 1) / CAST(2 AS DOUBLE) AS rx,
  rank() OVER b + (count(*) OVER (PARTITION BY doc, w, gold) - 1) / CAST(2 AS DOUBLE) AS ry FROM sc
  WINDOW a AS (PARTITION BY doc, w ORDER BY score), b AS (PARTITION BY doc, w ORDER BY gold))
SELECT doc, w, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY doc, w""")
def spearman(spark, sf):
    return _rounded(M.spearman(graded(spark, sf), SEQ), "spearman")


G_RHOS = [1 / 3 + (2 / 3) * j / 20 for j in range(21)]
TWO = f"""rr AS (SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY gold DESC, i) AS rg, row_number() OVER (PARTITION BY doc, w ORDER BY score DESC, i) AS rs,
  count(*) OVER (PARTITION BY doc, w) AS n FROM sc),
kk AS (SELECT *, least(greatest(CAST(ceil(CAST({2 / 3!r} AS DOUBLE) * n) AS BIGINT), 1), n) AS k FROM rr),
hh AS (SELECT *, CASE WHEN rg <= k THEN 1 ELSE 0 END AS label, sum(CASE WHEN rg <= k THEN 1 ELSE 0 END) OVER (PARTITION BY doc, w ORDER BY rs ROWS UNBOUNDED PRECEDING) AS hits FROM kk),
ev AS (SELECT doc, w, 2.0 * count(*) FILTER (WHERE hard AND label = 1) / CAST(count(*) FILTER (WHERE hard) + max(k) AS DOUBLE) AS f1_hard,
  count(*) FILTER (WHERE rs <= k AND label = 1) / CAST(max(k) AS DOUBLE) AS f1_hard_topk, sum(hits / CAST(rs AS DOUBLE)) FILTER (WHERE label = 1) / sum(label) AS ap_soft,
  sum(gold / log2(rs + 1)) FILTER (WHERE rs <= k) / sum(gold / log2(rg + 1)) FILTER (WHERE rg <= k) AS ndcg_soft,
  sum(gold / log2(rs + 1)) / sum(gold / log2(rg + 1)) AS ndcg_full FROM hh GROUP BY doc, w),
cut AS (SELECT doc, w, rho, rs, rg, gold, least(greatest(CAST(ceil(rho * n) AS BIGINT), 1), n) AS k FROM rr, (SELECT unnest([{', '.join(f'CAST({r!r} AS DOUBLE)' for r in G_RHOS)}]) AS rho)),
cv AS (SELECT doc, w, rho, count(*) FILTER (WHERE rs <= k AND rg <= k) / CAST(max(k) AS DOUBLE) AS f1,
  sum(gold / log2(rs + 1)) FILTER (WHERE rs <= k) / sum(gold / log2(rg + 1)) FILTER (WHERE rg <= k) AS nd FROM cut GROUP BY doc, w, rho),
tr AS (SELECT *, (rho - lag(rho) OVER q) * (f1 + lag(f1) OVER q) / 2 AS part FROM cv WINDOW q AS (PARTITION BY doc, w ORDER BY rho)),
cc AS (SELECT doc, w, sum(part) / (max(rho) - min(rho)) AS cut_f1_auc_norm, avg(nd) AS mean_ndcg_cut FROM tr GROUP BY doc, w)"""


@query(ctes(GRADED, TWO) + _sel("f1_hard", "f1_hard_topk", "ap_soft", "ndcg_soft", "ndcg_full", "cut_f1_auc_norm", "mean_ndcg_cut") + "ev JOIN cc USING (doc, w)")
def hierarchy_eval(spark, sf):
    return _rounded(M.graded_metrics(graded(spark, sf), SEQ, rhos=G_RHOS), "f1_hard", "f1_hard_topk", "ap_soft", "ndcg_soft", "ndcg_full", "cut_f1_auc_norm", "mean_ndcg_cut")


@query(ctes(GRADED) + """, x AS (SELECT *, rho, row_number() OVER (PARTITION BY doc, w, rho ORDER BY gold DESC, i) AS rg, count(*) OVER (PARTITION BY doc, w, rho) AS n,
  row_number() OVER (PARTITION BY doc, w, rho ORDER BY score * (1 + rho) - i * rho DESC, i) AS rs FROM sc, (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75, 1.0]) AS rho)),
y AS (SELECT *, least(greatest(CAST(ceil(rho * n) AS BIGINT), 1), n) AS k FROM x),
z AS (SELECT doc, w, rho, count(*) FILTER (WHERE rs <= k AND rg <= k) / CAST(max(k) AS DOUBLE) AS f1,
  sum(gold / log2(rs + 1)) FILTER (WHERE rs <= k) / sum(gold / log2(rg + 1)) FILTER (WHERE rg <= k) AS nd FROM y GROUP BY doc, w, rho),
t AS (SELECT *, (rho - lag(rho) OVER q) * (f1 + lag(f1) OVER q) / 2 AS part FROM z WINDOW q AS (PARTITION BY doc, w ORDER BY rho))
SELECT doc, w, round(sum(part), 9) AS cut_f1_auc, round(sum(part) / 0.75, 9) AS cut_f1_auc_norm, round(avg(nd), 9) AS mean_ndcg_cut FROM t GROUP BY doc, w""")
def per_cut_curve(spark, sf):
    rows = graded(spark, sf).selectExpr("*", "explode(array(0.25D, 0.5D, 0.75D, 1D)) AS rho").selectExpr(
        *SEQ, "rho", "i", "gold", "score * (1 + rho) - i * rho AS score", "CAST(NULL AS BOOLEAN) AS hard")
    return _rounded(M.per_cut_curve(rows, SEQ), "cut_f1_auc", "cut_f1_auc_norm", "mean_ndcg_cut")


# ---------------------------------------------------------------- bias

FEAT = """ft AS (SELECT sc.*, mono % 24 = 0 AS strong, CASE WHEN (sc.pitch > lag(sc.pitch) OVER q AND sc.pitch > lead(sc.pitch) OVER q) OR (sc.pitch < lag(sc.pitch) OVER q AND sc.pitch < lead(sc.pitch) OVER q) THEN 1 ELSE 0 END AS ext
  FROM sc JOIN (SELECT doc, w, i, mono FROM clk) USING (doc, w, i) WINDOW q AS (PARTITION BY doc, w ORDER BY i))"""


@query(ctes(LONGEST, CLOCK, FEAT) + """SELECT doc, w,
  round(CASE WHEN avg(CAST(strong AS INT)) > 0 THEN sum(score * CAST(strong AS INT)) / sum(score) / avg(CAST(strong AS INT)) END, 9) AS lift_strong,
  round(sum(score * dur) / sum(score) / avg(dur), 9) AS lift_duration,
  round(CASE WHEN avg(ext) > 0 THEN sum(score * ext) / sum(score) / avg(ext) END, 9) AS lift_extrema FROM ft GROUP BY doc, w""")
def lifts(spark, sf):
    rows = clocked(longest(spark, sf)).withColumn("onset", F.col("onset_mono"))
    return _rounded(B.lifts(B.features(rows, SEQ), SEQ), "lift_strong", "lift_duration", "lift_extrema")


def _js(a, b):
    m = f"(({a} + {b}) / 2)"
    return f"({_kl(a, m)} + {_kl(b, m)}) / 2"


def _kl(a, b):
    return f"sum({a} * (ln(greatest({a}, 1e-8)) - ln(greatest({b}, 1e-8))))"


@query(ctes(LONGEST) + f""", pc AS (SELECT doc, w, pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS x, CAST(sum(dur) AS DOUBLE) AS xd, sum(score) AS s, sum(score * dur) AS sd,
   CAST(count(*) FILTER (WHERE hard) AS DOUBLE) AS h FROM sc GROUP BY ALL),
nm AS (SELECT doc, w, x / sum(x) OVER q AS x, xd / sum(xd) OVER q AS xd, s / sum(s) OVER q AS s, sd / sum(sd) OVER q AS sd, h / sum(h) OVER q AS h FROM pc WINDOW q AS (PARTITION BY doc, w))
SELECT doc, w, round({_kl('x', 's')}, 9) AS kl_x_sel_cnt, round({_kl('s', 'x')}, 9) AS kl_sel_x_cnt, round({_js('x', 's')}, 9) AS js_cnt,
  round({_js('xd', 'sd')}, 9) AS js_dur, round({_js('x', 'h')}, 9) AS js_hard_cnt FROM nm GROUP BY doc, w""")
def pitch_class_js(spark, sf):
    return _rounded(B.pitch_class_distance(longest(spark, sf), SEQ, hard=True), "kl_x_sel_cnt", "kl_sel_x_cnt", "js_cnt", "js_dur", "js_hard_cnt")


# ---------------------------------------------------------------- corpus-level reports


@query("""WITH c AS (SELECT unnest([0, 1]) AS cl), n AS (SELECT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
f AS (SELECT cl, 2.0 * count(*) FILTER (WHERE quality = cl AND toxic = cl) / greatest(CAST(count(*) FILTER (WHERE quality = cl) + count(*) FILTER (WHERE toxic = cl) AS DOUBLE), 1e-8) AS f1 FROM n, c GROUP BY cl)
SELECT (SELECT count(*) FROM n) AS n, round((SELECT count(*) FILTER (WHERE quality = toxic) / CAST(count(*) AS DOUBLE) FROM n), 9) AS accuracy, round(avg(f1), 9) AS macro_f1 FROM f""")
def confusion_macro_f1(spark, sf):
    pairs = tables.table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return ST.macro_scores(pairs, "quality", "toxic", 2)


@query("""SELECT t.a AS quality, g.b AS toxic, count(doc_id) AS n FROM (SELECT CAST(unnest([0, 1]) AS BIGINT) AS a) t, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS b) g
LEFT JOIN labels ON quality = t.a AND toxic = g.b GROUP BY 1, 2""")
def confusion_matrix(spark, sf):
    return ST.confusion(tables.table(spark, sf, "labels"), "quality", "toxic", 2)


@query("""SELECT user_id % 5 AS variant, event_type AS metric, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, count(v) AS n
FROM (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def metric_summary(spark, sf):
    runs = tables.table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return ST.metric_summary(runs.selectExpr("user_id % 5 AS variant", "metric", "value"), ["variant", "metric"])


@query("""WITH m AS (SELECT user_id AS run, event_type, avg(value) / 20 AS v FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2)
SELECT run, round(exp(least(max(v) FILTER (WHERE event_type = 'click'), 20)), 6) AS ppl_click, round(exp(least(max(v) FILTER (WHERE event_type = 'view'), 20)), 6) AS ppl_view,
  round(exp(least(max(v) FILTER (WHERE event_type = 'error'), 20)), 6) AS ppl_error,
  round(exp(least(coalesce(max(v) FILTER (WHERE event_type = 'click') * 0.5, 0) + coalesce(max(v) FILTER (WHERE event_type = 'view') * 0.25, 0)
    + coalesce(max(v) FILTER (WHERE event_type = 'error') * 0.25, 0), 20)), 6) AS ppl FROM m GROUP BY run""")
def perplexity(spark, sf):
    runs = tables.table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("metric")).agg((F.avg("value") / 20).alias("value"))
    return ST.perplexity(runs, ["run"], {"click": 2.0, "view": 1.0, "error": 1.0})


@query(ctes(LAB) + """, x AS (SELECT label, (dur - 12) / CAST(4 AS DOUBLE) AS z FROM lab),
l AS (SELECT label, greatest(z, 0) - z * label + ln(1 + exp(-abs(z))) AS l FROM x),
s AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS kept, sum(l) FILTER (WHERE label = 1) AS a, sum(l) FILTER (WHERE label = 0) AS b,
  least(greatest(sum(label) / CAST(greatest(count(*) - sum(label), 1) AS DOUBLE), 1), 3) AS wt FROM l)
SELECT n, kept, round(wt, 9) AS drop_weight, round((a + wt * b) / n, 9) AS loss FROM s""")
def keep_loss(spark, sf):
    rows = labelled(spark, sf).selectExpr("label", "(dur - 12) / 4D AS z")
    return M.keep_loss(rows, "z", "label", 3.0)


@query(ctes(LAB) + """SELECT CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg, round(least(greatest(sum(label) / CAST(greatest(count(*) - sum(label), 1) AS DOUBLE), 1), 10), 9) AS neg_weight,
  round(count(*) / CAST(greatest(sum(label), 1) AS DOUBLE), 9) AS total_per_pos FROM lab""")
def class_weight(spark, sf):
    return ST.class_weight(labelled(spark, sf), F.col("label") == 1, 10.0)


@query(ctes(LAB) + """, p AS (SELECT count(*) AS n, max(i) FILTER (WHERE label = 1) AS hi, min(i) FILTER (WHERE label = 1) AS lo, avg(i) FILTER (WHERE label = 1) AS mid, avg(label) AS sh FROM lab GROUP BY doc, w),
q AS (SELECT (hi - lo) / CAST(n - 1 AS DOUBLE) AS span_ratio, (mid + 0.5) / n AS center, sh AS skel_frac FROM p WHERE n > 1 AND hi IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(min({m}), 9) AS lo, round(avg({m}), 9) AS mean, round(max({m}), 9) AS hi FROM q" for m in ("span_ratio", "center", "skel_frac")))
def label_coverage(spark, sf):
    return M.coverage(labelled(spark, sf), SEQ)
