"""Set, ranking and correlation metrics of note scores.

Input rows: keys, i, score, label (0/1) and optionally hard (boolean) and bos_mass.
Sequences are windows of at most 512 notes.  Each one is ranked once and a single
grouped pass over the ranking yields every metric, the whole cut curve included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise import constants as C
from notewise.functions.weights import gain
from notewise.operators.ordered import UPTO, over
from notewise.operators.stats import bin_index

EPS = "1e-8D"


def set_scores(tp: str, fp: str, fn: str) -> dict[str, str]:
    return {
        "precision": f"{tp} / greatest({tp} + {fp}, {EPS})", "recall": f"{tp} / greatest({tp} + {fn}, {EPS})",
        "f1": f"2 * {tp} / greatest(2 * {tp} + {fp} + {fn}, {EPS})", "iou": f"{tp} / greatest({tp} + {fp} + {fn}, {EPS})"}


def auc(xs: Sequence[float], ys: Sequence[str]) -> str:
    """Trapezoid rule over fixed abscissae."""
    return " + ".join(f"({xs[j]!r}D - {xs[j - 1]!r}D) * ({ys[j]} + {ys[j - 1]}) / 2D" for j in range(1, len(xs)))


def cut_size(rho: float, n: str = "n") -> str:
    return f"least(greatest(CAST(ceil({rho!r}D * {n}) AS INT), 1), {n})"


def ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank by falling score (earlier note first on ties) with running hits."""
    by = over(keys, ["score DESC", "i"])
    return rows.selectExpr(
        "*", f"row_number() {by} AS r", f"sum(label) {over(keys, ['score DESC', 'i'], UPTO)} AS hits",
        f"count(*) {over(keys)} AS n", f"sum(label) {over(keys)} AS n_pos")


def pair_metrics(rows: DataFrame, keys: Sequence[str], rhos: Sequence[float] = C.CUT_RHOS) -> DataFrame:
    """Per sequence: hard, top-k, AP, NDCG, insertion mass and cut-curve metrics (NULL when undefined)."""
    rhos = sorted(set(rhos))
    has_hard, has_bos = "hard" in rows.columns, "bos_mass" in rows.columns
    log = "log2(r + 1)"
    cols = [
        "max(n) AS n", "max(n_pos) AS n_pos", "sum(CASE WHEN r <= n_pos THEN label ELSE 0 END) AS tp_k",
        "sum(CASE WHEN label = 1 THEN hits / CAST(r AS DOUBLE) ELSE 0D END) AS ap_sum",
        f"sum(CASE WHEN r <= n_pos THEN label / {log} ELSE 0D END) AS dcg", f"sum(CASE WHEN r <= n_pos THEN 1 / {log} ELSE 0D END) AS idcg",
        f"sum(CASE WHEN label = 0 THEN score ELSE 0D END) / greatest(sum(score){' + max(bos_mass)' if has_bos else ''}, {EPS}) AS ins_mass_soft"]
    if has_hard:
        cols += ["CAST(sum(CASE WHEN hard AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp",
                 "CAST(sum(CASE WHEN hard AND label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp",
                 "CAST(sum(CASE WHEN NOT hard AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn"]
    for j, rho in enumerate(rhos):
        k = cut_size(rho)
        cols += [f"sum(CASE WHEN r <= {k} THEN label ELSE 0 END) AS tp_{j}", f"max({k}) AS k_{j}",
                 f"sum(CASE WHEN r <= {k} THEN label / {log} ELSE 0D END) AS dcg_{j}",
                 f"sum(CASE WHEN r <= least({k}, n_pos) THEN 1 / {log} ELSE 0D END) AS idcg_{j}"]
    agg = ranked(rows, keys).groupBy(*keys).agg(*[F.expr(c) for c in cols])
    hard = set_scores("tp", "fp", "fn") if has_hard else dict.fromkeys(("precision", "recall", "f1", "iou"), "CAST(NULL AS DOUBLE)")
    some = lambda e: f"CASE WHEN n_pos > 0 THEN {e} END"
    top = set_scores("CAST(tp_k AS DOUBLE)", "(n_pos - tp_k)", "(n_pos - tp_k)")
    f1 = [f"2D * tp_{j} / greatest(k_{j} + n_pos, {EPS})" for j in range(len(rhos))]
    ndcg = [f"dcg_{j} / idcg_{j}" for j in range(len(rhos))]
    area = auc(rhos, f1)
    out = agg.selectExpr(
        *keys, "n", "n_pos", "n_pos / CAST(n AS DOUBLE) AS rho_note",
        *[f"{e} AS {m}_hard" for m, e in hard.items()], *[f"{some(e)} AS {m}_hard_topk" for m, e in top.items()],
        f"{some('ap_sum / n_pos')} AS ap_soft", f"{some('dcg / idcg')} AS ndcg_soft", "ins_mass_soft",
        f"{some(area)} AS cut_f1_auc", f"{some(f'({area}) / {rhos[-1] - rhos[0]!r}D')} AS cut_f1_auc_norm",
        f"{some('(' + ' + '.join(ndcg) + f') / {len(rhos)}')} AS mean_ndcg_cut")
    return out.selectExpr("*", "f1_hard_topk - f1_hard AS gap_f1")


PAIR_METRICS = (
    "precision_hard", "recall_hard", "f1_hard", "iou_hard", "precision_hard_topk", "recall_hard_topk", "f1_hard_topk",
    "iou_hard_topk", "gap_f1", "ap_soft", "ndcg_soft", "ins_mass_soft", "cut_f1_auc", "cut_f1_auc_norm", "mean_ndcg_cut")


def macro(per_sequence: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long table (metric, value, n): mean and count of defined values."""
    agg = per_sequence.groupBy(*by).agg(*[F.expr(f"struct(avg({m}) AS value, count({m}) AS n) AS {m}") for m in names])
    pairs = ", ".join(f"struct('{m}' AS metric, {m}.value AS value, {m}.n AS n)" for m in names)
    return agg.selectExpr(*by, f"explode(array({pairs})) AS x").selectExpr(*by, "x.metric", "round(x.value, 6) AS value", "x.n")


def by_rho(per_sequence: DataFrame, names: Sequence[str], edges: Sequence[float] = C.RHO_BINS, rho: str = "rho") -> DataFrame:
    """Macro means per half-open rho bucket; empty buckets keep a row."""
    spark = per_sequence.sparkSession
    spine = spark.range(len(edges) - 1).selectExpr("CAST(id AS INT) AS bin")
    per = per_sequence.withColumn("bin", bin_index(F.col(rho), edges)).where("bin IS NOT NULL").groupBy("bin").agg(
        F.expr("count(*) AS n"), *[F.expr(f"round(avg({m}), 6) AS {m}") for m in names])
    return spine.join(per, "bin", "left").fillna({"n": 0})


def average_ranks(rows: DataFrame, keys: Sequence[str], value: str) -> str:
    """Ascending rank with ties sharing their mean rank, as a window expression."""
    return f"rank() {over(keys, [value])} + (count(*) {over([*keys, value])} - 1) / 2D"


def spearman(rows: DataFrame, keys: Sequence[str], x: str = "score", y: str = "gold") -> DataFrame:
    """Rank correlation per sequence; NULL below two notes or without spread."""
    r = rows.selectExpr(*keys, f"{average_ranks(rows, keys, x)} AS rx", f"{average_ranks(rows, keys, y)} AS ry")
    m = r.groupBy(*keys).agg(F.expr("count(*) AS n"), F.expr("sum(rx * ry) AS xy"), F.expr("sum(rx * rx) AS xx"), F.expr("sum(ry * ry) AS yy"))
    c = "n * (n + 1D) * (n + 1D) / 4D"
    den = f"sqrt((xx - {c}) * (yy - {c}))"
    return m.selectExpr(*keys, f"CASE WHEN n >= 2 AND {den} > 1e-12D THEN (xy - {c}) / {den} END AS spearman")


def graded_metrics(rows: DataFrame, keys: Sequence[str], eval_rho: float = 2 / 3, ap_rho: float | None = None,
                   rhos: Sequence[float] | None = None, gain_kind: str = "identity") -> DataFrame:
    """Per sequence metrics against graded gold: rows hold keys, i, score, gold and optionally hard.

    Gold sets are the top ceil(rho n) notes by gold.  Two rankings (score, gold) serve all cuts.
    """
    ap_rho = eval_rho if ap_rho is None else ap_rho
    rhos = sorted(set(rhos if rhos is not None else [1 / 3 + (2 / 3) * j / 20 for j in range(21)]))
    k_ap = cut_size(ap_rho)
    two = rows.selectExpr(
        "*", f"row_number() {over(keys, ['gold DESC', 'i'])} AS rg", f"count(*) {over(keys)} AS n",
        f"row_number() {over(keys, ['score DESC', 'i'])} AS rs").selectExpr("*", f"CASE WHEN rg <= {k_ap} THEN 1 ELSE 0 END AS label")
    two = two.selectExpr("*", f"sum(label) {over(keys, ['rs'], UPTO)} AS hits")
    g = gain("gold", gain_kind)
    ls, lg = "log2(rs + 1)", "log2(rg + 1)"
    k = cut_size(eval_rho)
    cols = ["max(n) AS n", f"max({k}) AS k", f"CAST(sum(CASE WHEN rs <= {k} AND rg <= {k} THEN 1 ELSE 0 END) AS DOUBLE) AS tp_k",
            "sum(CASE WHEN label = 1 THEN hits / CAST(rs AS DOUBLE) ELSE 0D END) / sum(label) AS ap_soft",
            f"sum(CASE WHEN rs <= {k} THEN {g} / {ls} ELSE 0D END) AS dcg", f"sum(CASE WHEN rg <= {k} THEN {g} / {lg} ELSE 0D END) AS idcg",
            f"sum({g} / {ls}) AS dcg_full", f"sum({g} / {lg}) AS idcg_full"]
    if "hard" in rows.columns:
        cols += [f"CAST(sum(CASE WHEN hard AND rg <= {k} THEN 1 ELSE 0 END) AS DOUBLE) AS tp",
                 f"CAST(sum(CASE WHEN hard AND rg > {k} THEN 1 ELSE 0 END) AS DOUBLE) AS fp",
                 f"CAST(sum(CASE WHEN NOT hard AND rg <= {k} THEN 1 ELSE 0 END) AS DOUBLE) AS fn"]
    for j, rho in enumerate(rhos):
        kj = cut_size(rho)
        cols += [f"sum(CASE WHEN rs <= {kj} AND rg <= {kj} THEN 1 ELSE 0 END) / CAST(max({kj}) AS DOUBLE) AS f1_{j}",
                 f"sum(CASE WHEN rs <= {kj} THEN {g} / {ls} ELSE 0D END) AS dcg_{j}", f"sum(CASE WHEN rg <= {kj} THEN {g} / {lg} ELSE 0D END) AS idcg_{j}"]
    agg = two.groupBy(*keys).agg(*[F.expr(c) for c in cols])
    hard = set_scores("tp", "fp", "fn") if "hard" in rows.columns else dict.fromkeys(("precision", "recall", "f1", "iou"), "CAST(NULL AS DOUBLE)")
    top = set_scores("tp_k", "(k - tp_k)", "(k - tp_k)")
    ratio = lambda a, b: f"CASE WHEN {b} > {EPS} THEN {a} / {b} END"
    area = auc(rhos, [f"f1_{j}" for j in range(len(rhos))])
    terms = ", ".join(ratio(f"dcg_{j}", f"idcg_{j}") for j in range(len(rhos)))
    out = agg.selectExpr(
        *keys, "n AS n_notes", "k / CAST(n AS DOUBLE) AS rho", *[f"{e} AS {m}_hard" for m, e in hard.items()],
        *[f"{e} AS {m}_hard_topk" for m, e in top.items()], "ap_soft", f"{ratio('dcg', 'idcg')} AS ndcg_soft",
        f"{ratio('dcg_full', 'idcg_full')} AS ndcg_full", f"{area} AS cut_f1_auc", f"({area}) / {rhos[-1] - rhos[0]!r}D AS cut_f1_auc_norm",
        f"filter(array({terms}), x -> x IS NOT NULL) AS __ndcg")
    out = out.selectExpr("*", "CASE WHEN size(__ndcg) > 0 THEN aggregate(__ndcg, 0D, (a, x) -> a + x) / size(__ndcg) END AS mean_ndcg_cut",
                         "f1_hard_topk - f1_hard AS gap_f1").drop("__ndcg")
    return out.join(spearman(rows, keys), list(keys))


def per_cut_curve(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cut curve from predictions made separately for each rho: rows hold keys, rho, i, score, gold, hard."""
    k = "least(greatest(CAST(ceil(rho * n) AS INT), 1), n)"
    by = [*keys, "rho"]
    two = rows.selectExpr("*", f"row_number() {over(by, ['gold DESC', 'i'])} AS rg", f"row_number() {over(by, ['score DESC', 'i'])} AS rs",
                          f"count(*) {over(by)} AS n").selectExpr("*", f"{k} AS k", f"rg <= {k} AS is_gold", f"coalesce(hard, rs <= {k}) AS is_pred")
    per = two.groupBy(*by).agg(
        F.expr("2D * count_if(is_pred AND is_gold) / greatest(count_if(is_pred) + count_if(is_gold), 1) AS f1"),
        F.expr("sum(CASE WHEN rs <= k THEN gold / log2(rs + 1) ELSE 0D END) / nullif(sum(CASE WHEN rg <= k THEN gold / log2(rg + 1) ELSE 0D END), 0D) AS ndcg"))
    step = f"(rho - lag(rho) {over(keys, ['rho'])}) * (f1 + lag(f1) {over(keys, ['rho'])}) / 2D"
    return per.selectExpr(*keys, "rho", "ndcg", f"{step} AS part").groupBy(*keys).agg(
        F.expr("sum(part) AS cut_f1_auc"), F.expr("sum(part) / (max(rho) - min(rho)) AS cut_f1_auc_norm"), F.expr("avg(ndcg) AS mean_ndcg_cut"))


def keep_loss(rows: DataFrame, logit: str, keep: str, cap: float = 0.0) -> DataFrame:
    """Mean logistic loss of keep logits in the overflow-free form; dropped notes weigh clip(kept/dropped, 1, cap) when cap > 0."""
    loss = f"greatest({logit}, 0D) - {logit} * {keep} + log1p(exp(-abs({logit})))"
    s = rows.agg(
        F.expr("count(*) AS n"), F.expr(f"sum({keep}) AS kept"), F.expr(f"sum(CASE WHEN {keep} = 1 THEN {loss} ELSE 0D END) AS on_kept"),
        F.expr(f"sum(CASE WHEN {keep} = 0 THEN {loss} ELSE 0D END) AS on_dropped"))
    w = f"least(greatest(kept / greatest(n - kept, 1D), 1D), {float(cap)!r}D)" if cap > 0 else "1D"
    return s.selectExpr("n", "kept", f"round({w}, 9) AS drop_weight", f"round((on_kept + {w} * on_dropped) / greatest(n, 1D), 9) AS loss")


def coverage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Span, centre and share of kept notes: min, mean and max over sequences with a kept note."""
    kept = "CASE WHEN label = 1 THEN i END"
    per = rows.groupBy(*keys).agg(
        F.expr("count(*) AS n"), F.expr(f"max({kept}) AS hi"), F.expr(f"min({kept}) AS lo"), F.expr(f"avg({kept}) AS mid"),
        F.expr("avg(CAST(label AS DOUBLE)) AS share")).where("n > 1 AND hi IS NOT NULL")
    per = per.selectExpr("(hi - lo) / (n - 1D) AS span_ratio", "(mid + 0.5D) / n AS center", "share AS skel_frac")
    names = ("span_ratio", "center", "skel_frac")
    agg = per.agg(*[F.expr(f"struct(min({m}) AS lo, avg({m}) AS mean, max({m}) AS hi) AS {m}") for m in names])
    return agg.selectExpr("explode(array(" + ", ".join(f"struct('{m}' AS metric, {m}.lo AS lo, {m}.mean AS mean, {m}.hi AS hi)" for m in names) + ")) AS x").selectExpr(
        "x.metric", "round(x.lo, 9) AS lo", "round(x.mean, 9) AS mean", "round(x.hi, 9) AS hi")
