"""Exact top-k search over contour vectors, pruned by segment statistics of growing resolution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.llm.frames import picked

RESOLUTIONS = (1, 4, 16)
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Float sums of this many integer products stay exact below 2 ** 53.
EXACT = float(2 ** 53)


def usable(vector: str) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return F.expr(f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))")


def scaled(vector: str, scale: int) -> Column:
    return F.expr(f"transform({vector}, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))")


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _segments(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of ``parts`` segments, each weighed by the root of its length.

    The inner product of two such rows bounds the inner product of the vectors from above: within a segment it is
    length x (product of means) plus a rest that is at most length x (product of deviations).  With the vectors'
    norms this is the same as a lower bound of their distance.
    """
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    centred = x - np.repeat(mean, length, axis=1)
    deviation = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1) / length)
    root = np.sqrt(length)
    return np.concatenate([mean * root, deviation * root], axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows; beyond the range of a long they are clipped to it."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound < EXACT:
        return np.einsum("ij,ij->i", q.astype(np.float64), x.astype(np.float64)).astype(np.int64)
    if bound < 2.0 ** 62:
        return np.einsum("ij,ij->i", q, x)
    top = 2 ** 63 - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(u, v)))) for u, v in zip(q, x)], np.int64)


def _best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, live: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best live candidates of each query; one product for all where doubles hold it exactly."""
    if not live.any():
        return []
    if float(np.abs(q).max()) * float(np.abs(x).max()) * max(1, q.shape[1]) < EXACT:
        score = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    else:
        score = np.zeros(live.shape, np.int64)
        rows, columns = np.nonzero(live)
        score[rows, columns] = _exact(q[rows], x[columns])
    if live.shape[1] > 4 * k:
        shown = np.where(live, score, -2 ** 63)
        live = live & (shown >= np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k, None])
    rows, columns = np.nonzero(live)
    order = np.lexsort((ids[columns], -score[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, columns = rows[place < k], columns[place < k]
    return list(zip(q_ids[rows].tolist(), ids[columns].tolist(), score[rows, columns].tolist()))


def block_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in one block of candidates; ties to smaller ids."""
    out: list[tuple[int, int, int]] = []
    if not len(ids):
        return out
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    levels = [(_segments(qf, parts), _segments(xf, parts)) for parts in RESOLUTIONS]
    slack = 1e-9 * (1 + np.linalg.norm(qf, axis=1) * np.linalg.norm(xf, axis=1).max(initial=0))
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        own = q_ids[part, None] == ids[None, :]
        threshold = np.full(len(own), -math.inf)
        live, columns = ~own, np.arange(len(ids))
        for fine_q, fine_x in levels:
            bound = np.where(live, fine_q[part] @ fine_x[columns].T, -math.inf)
            if len(columns) > k:
                # the most promising ones give a threshold
                seeds = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                usable_rows = np.take_along_axis(live, seeds, 1).all(1)
                rows = np.flatnonzero(usable_rows)
                picked_x = x[columns[seeds[rows]].ravel()]
                score = _exact(np.repeat(q[part][rows], k, 0), picked_x).reshape(-1, k)
                threshold[rows] = np.maximum(threshold[rows], score.min(1, initial=2 ** 63 - 1))
            live &= bound + slack[part, None] >= threshold[:, None]
            kept = live.any(0)
            live, columns = live[:, kept], columns[kept]
        out += _best_of(q_ids[part], q[part], ids[columns], x[columns], live, k)
    return out


def top_matches(queries: DataFrame, sequences: DataFrame, piece: str = "piece", contour: str = "contour", k: int = 20,
                scale: int = 64) -> DataFrame:
    """Each query's ``k`` candidates of the highest integer inner product, exactly.

    ``queries`` and ``sequences`` hold a ``piece`` key (an integer) and a ``contour`` vector, whose components are taken as
    floor(scale x).  Candidates are all sequences but the query's own key.  Returns ``query_id``, ``rank`` (int, from 1),
    ``piece`` and ``score``; fewer rows if there are fewer candidates; ties go to smaller keys.  Rows with a null key, and
    vectors that are null or hold null or non-finite components, take no part.  Rows that repeat a key count once (the
    smallest vector).  Shorter vectors are filled up with zeros; empty ones score 0.  Other columns are not looked at.

    Blocks of queries meet blocks of candidates, one task a pair; a block gives k rows a query at most.  Block counts follow
    the row counts, so tasks stay of one size while their number grows.
    """
    def prepared(df: DataFrame) -> DataFrame:
        rows = picked(df, piece=piece, contour=contour).where(usable("contour")).where("piece IS NOT NULL")
        rows = rows.select(F.col("piece").cast("long").alias("piece"), scaled("contour", scale).alias("contour"))
        return rows.groupBy("piece").agg(F.min("contour").alias("contour"))

    q, x = prepared(queries), prepared(sequences)
    q_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    x_blocks = max(1, math.ceil(sequences.count() / CANDIDATE_BLOCK))

    def dealt(df: DataFrame, own: int, other: int, name: str, over: str) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64("piece"), F.lit(own))).withColumn(over, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = dealt(q, q_blocks, x_blocks, "qb", "xb").select("qb", F.col("xb").cast("long").alias("xb"), "piece", "contour")
    right = dealt(x, x_blocks, q_blocks, "xb", "qb").select(F.col("qb").cast("long").alias("qb"), "xb", "piece", "contour")

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "piece", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        width = max(1, int(a["contour"].map(len).max()), int(b["contour"].map(len).max()))
        rows = block_best(a["piece"].to_numpy(), _stacked(a["contour"], width), b["piece"].to_numpy(), _stacked(b["contour"], width), k)
        return pd.DataFrame(rows, columns=names, dtype=np.int64)

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(met, "query_id bigint, piece bigint, score bigint")
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, piece) AS rank").where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("piece").alias(piece), "score")
