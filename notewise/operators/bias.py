"""Musical bias of a selection: lifts and pitch-class histogram distances per sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise import constants as C
from notewise.operators.ordered import over

EPS = "1e-8D"


def features(rows: DataFrame, keys: Sequence[str], period: int = 2 * C.POS_PER_QUARTER) -> DataFrame:
    """Strong-beat and strict three-point extremum flags from onset and pitch."""
    before, after = f"lag(pitch) {over(keys, ['i'])}", f"lead(pitch) {over(keys, ['i'])}"
    return rows.selectExpr(
        "*", f"CASE WHEN pmod(onset, {period}) = 0 THEN 1 ELSE 0 END AS strong",
        f"CASE WHEN (pitch > {before} AND pitch > {after}) OR (pitch < {before} AND pitch < {after}) THEN 1 ELSE 0 END AS extremum")


def lifts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score-weighted mean over plain mean of each feature; NULL without mass or without the feature."""
    names = {"strong": "strong", "duration": "dur", "extrema": "extremum"}
    agg = rows.groupBy(*keys).agg(
        F.expr("sum(score) AS mass"), *[F.expr(f"sum(score * {c}) / greatest(sum(score), {EPS}) AS es_{m}") for m, c in names.items()],
        *[F.expr(f"avg(CAST({c} AS DOUBLE)) AS eu_{m}") for m, c in names.items()])
    return agg.selectExpr(
        *keys, *[f"es_{m} AS mass_{m}" for m in names], *[f"eu_{m} AS rate_{m}" for m in names],
        *[f"CASE WHEN mass > {EPS} AND eu_{m} > {EPS} THEN es_{m} / eu_{m} END AS lift_{m}" for m in names])


def pitch_class_distance(rows: DataFrame, keys: Sequence[str], hard: bool = False) -> DataFrame:
    """KL (both ways) and Jensen-Shannon distance of the pitch-class histogram of all notes and of
    the selection, by note count and by duration.  ``hard`` adds the distance to the hard selection."""
    weights = {"x_cnt": "1D", "x_dur": "CAST(dur AS DOUBLE)", "s_cnt": "score", "s_dur": "score * dur"}
    if hard:
        weights |= {"h_cnt": "CASE WHEN hard THEN 1D ELSE 0D END", "h_dur": "CASE WHEN hard THEN CAST(dur AS DOUBLE) ELSE 0D END"}
    per = rows.groupBy(*keys, F.expr("pmod(pitch, 12) AS pc")).agg(*[F.expr(f"sum({e}) AS {c}") for c, e in weights.items()])
    shares = per.selectExpr(*keys, *[f"sum({c}) {over(keys)} AS t_{c}" for c in weights],
                            *[f"{c} / greatest(sum({c}) {over(keys)}, {EPS}) AS {c}" for c in weights])

    def kl(p: str, q: str) -> str:
        return f"{p} * (ln(greatest({p}, {EPS})) - ln(greatest({q}, {EPS})))"

    def js(p: str, q: str) -> str:
        m = f"(({p} + {q}) / 2D)"
        return f"({kl(p, m)} + {kl(q, m)}) / 2D"

    cols = []
    for u in ("cnt", "dur"):
        x, s = f"x_{u}", f"s_{u}"
        ok = f"max(t_{x}) > {EPS} AND max(t_{s}) > {EPS} AND max(t_s_cnt) > {EPS}"
        cols += [f"CASE WHEN {ok} THEN sum({kl(x, s)}) END AS kl_x_sel_{u}", f"CASE WHEN {ok} THEN sum({kl(s, x)}) END AS kl_sel_x_{u}",
                 f"CASE WHEN {ok} THEN sum({js(x, s)}) END AS js_{u}"]
        if hard:
            h = f"h_{u}"
            cols.append(f"CASE WHEN max(t_{x}) > {EPS} AND max(t_{h}) > {EPS} THEN sum({js(x, h)}) END AS js_hard_{u}")
    return shares.groupBy(*keys).agg(*[F.expr(c) for c in cols])
