"""Structural corruption of packed sequences: merging neighbours and losing notes.

Both are left folds over a bounded note array with draws keyed by note, written as SQL expressions: no shuffle, no Python,
and the same result for any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from notewise import constants as C
from notewise.functions.draws import uniform
from notewise.functions.relation import let
from notewise.operators.transforms import Corruption, note_corruption

NOTE = "STRUCT<pitch: INT, dur: INT, dt: INT, u: DOUBLE, v: DOUBLE>"


def _note(pitch: str, dur: str, dt: str, u: str, v: str) -> str:
    return f"named_struct('pitch', CAST({pitch} AS INT), 'dur', CAST({dur} AS INT), 'dt', CAST({dt} AS INT), 'u', {u}, 'v', {v})"


def _between(value: str, low: int, high: int) -> str:
    return f"{value} BETWEEN {low} AND {high}"


def _range(value: str, low: int, high: int, clip: bool) -> str:
    return f"greatest({low}, least({high}, {value}))" if clip else value


def merge_fold(notes: str, cfg: Corruption) -> str:
    """Merge drawn neighbours; a merged note may merge again.

    A pair whose gap lies in [-merge_overlap, merge_gap] becomes one note that lasts to the later end and keeps the
    onset after it.  With ``clip`` values beyond the code ranges are clipped, without it such a pair stays.
    """
    span = "(a.now.dur + a.now.dt + x.dur)"
    longer = f"greatest(a.now.dur, {span})"
    rest = f"({span} + x.dt - {longer})"
    first = {"first": "true", "second": "false", "longer": "a.now.dur >= x.dur"}[cfg.merge_pick]
    drawn = f"x.u < {cfg.p_merge!r}D AND {_between('a.now.dt', -cfg.merge_overlap, cfg.merge_gap)}"
    room = f"a.n < {cfg.merge_most} AND size({notes}) - a.n > {cfg.min_notes} AND size({notes}) > 2"
    fits = "true" if cfg.clip else f"{_between(longer, 1, C.MAX_DUR)} AND {_between(rest, C.MIN_DT, C.MAX_DT)}"
    joined = _note(f"IF({first}, a.now.pitch, x.pitch)", _range(longer, 1, C.MAX_DUR, cfg.clip), _range(rest, C.MIN_DT, C.MAX_DT, cfg.clip), "x.u", "x.v")
    step = (f"CASE WHEN {drawn} AND {room} AND {fits} THEN named_struct('done', a.done, 'now', {joined}, 'n', a.n + 1) "
            f"ELSE named_struct('done', concat(a.done, array(a.now)), 'now', x, 'n', a.n) END")
    start = f"named_struct('done', CAST(array() AS ARRAY<{NOTE}>), 'now', {notes}[0], 'n', 0)"
    return f"aggregate(slice({notes}, 2, size({notes})), {start}, (a, x) -> {step}, a -> concat(a.done, array(a.now)))"


def delete_fold(notes: str, cfg: Corruption) -> str:
    """Drop drawn inner notes; the gap before takes over their time if the code range holds it (or is clipped to it)."""
    gap = "(a.now.dt + x.dur + x.dt)"
    drawn = f"x.v < {cfg.p_delete!r}D" + ("" if cfg.clip else f" AND {_between(gap, C.MIN_DT, C.MAX_DT)}")
    room = f"a.n < {cfg.delete_most} AND size({notes}) - a.n > {cfg.min_notes}"
    held = _note("a.now.pitch", "a.now.dur", _range(gap, C.MIN_DT, C.MAX_DT, cfg.clip), "a.now.u", "a.now.v")
    step = (f"CASE WHEN {drawn} AND {room} THEN named_struct('done', a.done, 'now', {held}, 'n', a.n + 1) "
            f"ELSE named_struct('done', concat(a.done, array(a.now)), 'now', x, 'n', a.n) END")
    start = f"named_struct('done', CAST(array() AS ARRAY<{NOTE}>), 'now', {notes}[0], 'n', 0)"
    inner = f"slice({notes}, 2, greatest(0, size({notes}) - 2))"
    last = f"slice({notes}, greatest(2, size({notes})), 1)"
    return f"aggregate({inner}, {start}, (a, x) -> {step}, a -> concat(a.done, array(a.now), {last}))"


def _last_gap_zero(notes: str) -> str:
    return let(notes, "q", f"transform(q, (x, j) -> {_note('x.pitch', 'x.dur', 'IF(j = size(q) - 1, 0, x.dt)', 'x.u', 'x.v')})")


def structural(seqs: DataFrame, keys: Sequence[str], seed: int, cfg: Corruption = Corruption()) -> DataFrame:
    """Merge, then delete notes of every sequence of two notes or more; durations enter clipped, the last gap ends as 0."""
    draws = (f"(x, i) -> {_note('x.pitch', f'greatest(1, least({C.MAX_DUR}, x.dur))', 'IF(i = size(s) - 1 AND size(s) > 1, 0, x.dt)', uniform('merge', seed, *keys, 'i'), uniform('delete', seed, *keys, 'i'))}")
    merged = let(let("notes", "s", f"transform(s, {draws})"), "m", f"IF(size(m) < 2, m, {merge_fold('m', cfg)})")
    ended = _last_gap_zero(merged)
    out = let(ended, "e", f"IF(size(e) < 2, e, {delete_fold('e', cfg)})")
    return seqs.selectExpr(*keys, f"CASE WHEN size(notes) < 2 THEN transform(notes, x -> struct(CAST(x.pitch AS INT) AS pitch, CAST(greatest(1, least({C.MAX_DUR}, x.dur)) AS INT) AS dur, "
                           f"CAST(x.dt AS INT) AS dt)) ELSE transform({out}, x -> struct(x.pitch AS pitch, x.dur AS dur, x.dt AS dt)) END AS notes")


def corrupt(seqs: DataFrame, keys: Sequence[str], seed: int, cfg: Corruption = Corruption()) -> DataFrame:
    """The whole corruption: structural folds, then boundary, pitch, time and free-rhythm noise.

    Sequences not drawn by ``p_apply`` pass through unchanged.
    """
    base = seqs.select(*keys, "notes")
    if cfg.p_apply >= 1.0:
        return note_corruption(structural(base, keys, seed, cfg), keys, seed, cfg)
    chosen = f"{uniform('corrupt', seed, *keys)} <= {cfg.p_apply!r}D"
    changed = note_corruption(structural(base.where(chosen), keys, seed, cfg), keys, seed, cfg)
    return changed.unionByName(base.where(f"NOT ({chosen})"))
