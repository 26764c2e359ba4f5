"""Augmentation and note-wise corruption of packed sequences.

Rows hold key columns and ``notes`` ARRAY<STRUCT<pitch, dur, dt>> of at most one window.
Everything here is row-local: random draws are hashes of (operation, seed, keys, note), so no
shuffle is needed and results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from notewise import constants as C
from notewise.functions.draws import hash_of, nonzero_offset, normal, phi, uniform, uniform_int
from notewise.functions.relation import let
from notewise.operators.ordered import dense_index
from notewise.operators.splits import BUCKET


def _triple(pitch: str = "x.pitch", dur: str = "x.dur", dt: str = "x.dt") -> str:
    return f"struct(CAST({pitch} AS INT) AS pitch, CAST({dur} AS INT) AS dur, CAST({dt} AS INT) AS dt)"


def _clamp(x: str, low: int, high: int) -> str:
    return f"greatest({low}, least({high}, {x}))"


def shift_cdf(sigma: float, low: int, high: int) -> list[float]:
    """Normal mass below the rounding edges of low .. high."""
    return [round(phi((k + 0.5) / sigma), 12) for k in range(low - 1, high + 1)]


def transpose(seqs: DataFrame, keys: Sequence[str], seed: int, sigma: float = 4.0, low: int = -8, high: int = 8) -> DataFrame:
    """One shift per sequence, a rounded normal truncated to [low, high] and to the pitch range.  Adds ``shift``."""
    cum = "array(" + ", ".join(f"{c!r}D" for c in shift_cdf(sigma, low, high)) + ")"
    pitches = seqs.selectExpr("*", "array_min(notes.pitch) AS __lo", "array_max(notes.pitch) AS __hi").selectExpr(
        "*", f"greatest({low}, -__lo) AS __a", f"least({high}, {C.MAX_PITCH} - __hi) AS __b")
    at = pitches.selectExpr("*", f"{cum}[__a - {low}] AS __f0", f"{cum}[__b - {low} + 1] AS __f1")
    u = at.selectExpr("*", f"__f0 + {uniform('transpose', seed, *keys)} * (__f1 - __f0) AS __u")
    drawn = u.selectExpr("*", f"CASE WHEN __a > __b THEN 0 ELSE greatest(__a, least(__b, {low} + size(filter(slice({cum}, 2, {high - low + 1}), c -> c <= __u)))) END AS shift")
    rest = [c for c in seqs.columns if c != "notes"]
    moved = let("shift", "k", f"transform(notes, x -> {_triple('x.pitch + k')})")
    return drawn.selectExpr(*rest, f"{moved} AS notes", "shift")


def time_scale(seqs: DataFrame, keys: Sequence[str], seed: int, p_double: float = 0.2, p_half: float = 0.2) -> DataFrame:
    """Double or halve all durations and gaps of a sequence, halves to even.  Adds ``scale``."""
    u = uniform("time_scale", seed, *keys)
    scaled = seqs.selectExpr("*", f"CASE WHEN {u} < {p_double!r}D THEN 2D WHEN {u} < {p_double + p_half!r}D THEN 0.5D ELSE 1D END AS scale")
    dur = _clamp("CAST(rint(x.dur * f) AS INT)", 1, C.MAX_DUR)
    dt = _clamp("CAST(rint(x.dt * f) AS INT)", C.MIN_DT, C.MAX_DT)
    body = let("scale", "f", f"CASE WHEN f = 1D THEN notes ELSE transform(notes, x -> {_triple('x.pitch', dur, dt)}) END")
    rest = [c for c in seqs.columns if c != "notes"]
    return scaled.selectExpr(*rest, f"{body} AS notes", "scale")


def augment(seqs: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    return time_scale(transpose(seqs, keys, seed), keys, seed)


def _per_note(seqs: DataFrame, body: str) -> DataFrame:
    """Map every note x at position i; ``ns`` is the whole sequence, bound once per row."""
    cols = [c if c != "notes" else f"{let('notes', 'ns', f'transform(ns, (x, i) -> {body})')} AS notes" for c in seqs.columns]
    return seqs.selectExpr(*cols)


INNER = "i < size(ns) - 1"


def boundary_shift(seqs: DataFrame, keys: Sequence[str], seed: int, p: float = 0.10, most: int = 3) -> DataFrame:
    """Move the boundary between a note and its following gap; the next onset stays."""
    d = uniform_int("boundary.d", seed, -most, most, *keys, "i")
    ok = (f"{INNER} AND {uniform('boundary', seed, *keys, 'i')} < {p!r}D AND x.dt >= 0 "
          f"AND x.dur + {d} BETWEEN 1 AND {C.MAX_DUR} AND x.dt - {d} BETWEEN 0 AND {C.MAX_DT}")
    return _per_note(seqs, f"CASE WHEN {ok} THEN {_triple('x.pitch', f'x.dur + {d}', f'x.dt - {d}')} ELSE {_triple()} END")


def pitch_jitter(seqs: DataFrame, keys: Sequence[str], seed: int, p: float = 0.12, spread: int = 2, sigma: float = 1.0) -> DataFrame:
    off = nonzero_offset("jitter.k", seed, spread, sigma, *keys, "i")
    moved = _clamp(f"x.pitch + {off}", 0, C.MAX_PITCH)
    return _per_note(seqs, f"CASE WHEN {uniform('jitter', seed, *keys, 'i')} < {p!r}D THEN {_triple(moved)} ELSE {_triple()} END")


def time_jitter(seqs: DataFrame, keys: Sequence[str], seed: int, p_dur: float = 0.10, p_dt: float = 0.05, dur_most: int = 2, dt_most: int = 2) -> DataFrame:
    """Small errors of durations and gaps; the last gap stays."""
    d = f"CASE WHEN {uniform('durj', seed, *keys, 'i')} < {p_dur!r}D THEN {_clamp('x.dur + ' + uniform_int('durj.d', seed, -dur_most, dur_most, *keys, 'i'), 1, C.MAX_DUR)} ELSE x.dur END"
    t = f"CASE WHEN {INNER} AND {uniform('dtj', seed, *keys, 'i')} < {p_dt!r}D THEN {_clamp('x.dt + ' + uniform_int('dtj.d', seed, -dt_most, dt_most, *keys, 'i'), C.MIN_DT, C.MAX_DT)} ELSE x.dt END"
    return _per_note(seqs, _triple("x.pitch", d, t))


def free_rhythm(seqs: DataFrame, keys: Sequence[str], seed: int, p_seq: float = 0.25, p_dur: float = 0.12, dur_sigma: float = 0.40,
                dur_range: tuple[float, float] = (0.6, 1.8), p_gap: float = 0.06, gap_sigma: float = 0.60,
                gap_range: tuple[float, float] = (0.5, 2.5), expand_only: bool = True) -> DataFrame:
    """On some sequences stretch durations and non-negative gaps by log-normal factors; total time may drift."""

    def factor(op: str, sigma: float, limits: tuple[float, float]) -> str:
        z = f"{sigma!r}D * {normal(op, seed, *keys, 'i')}"
        z = f"abs({z})" if expand_only else z
        return f"greatest({limits[0]!r}D, least({limits[1]!r}D, exp({z})))"

    d = f"CASE WHEN {uniform('fr.dur', seed, *keys, 'i')} < {p_dur!r}D THEN {_clamp(f'CAST(rint(x.dur * ' + factor('fr.dz', dur_sigma, dur_range) + ') AS INT)', 1, C.MAX_DUR)} ELSE x.dur END"
    t = f"CASE WHEN {INNER} AND x.dt >= 0 AND {uniform('fr.gap', seed, *keys, 'i')} < {p_gap!r}D THEN {_clamp('CAST(rint(x.dt * ' + factor('fr.gz', gap_sigma, gap_range) + ') AS INT)', 0, C.MAX_DT)} ELSE x.dt END"
    stretched = let("notes", "ns", f"transform(ns, (x, i) -> {_triple('x.pitch', d, t)})")
    chosen = f"{uniform('fr.seq', seed, *keys)} < {p_seq!r}D"
    return seqs.selectExpr(*[c if c != "notes" else f"CASE WHEN {chosen} THEN {stretched} ELSE notes END AS notes" for c in seqs.columns])


@dataclass(frozen=True)
class Corruption:
    """Rates of the corruption pipeline."""

    p_apply: float = 1.0
    min_notes: int = 8
    p_merge: float = 0.06
    merge_most: int = 4
    merge_gap: int = 2
    merge_overlap: int = 3
    merge_pick: str = "longer"
    p_delete: float = 0.04
    delete_most: int = 3
    #: clip values that leave the code range instead of leaving the pair or note alone
    clip: bool = False
    p_boundary: float = 0.10
    p_pitch: float = 0.12
    p_dur: float = 0.10
    p_dt: float = 0.05
    p_free: float = 0.25


def note_corruption(seqs: DataFrame, keys: Sequence[str], seed: int, cfg: Corruption = Corruption()) -> DataFrame:
    """The note-wise part: boundary shift, pitch jitter, time jitter, free rhythm; last gap 0."""
    out = boundary_shift(seqs, keys, seed, cfg.p_boundary)
    out = pitch_jitter(out, keys, seed, cfg.p_pitch)
    out = time_jitter(out, keys, seed, cfg.p_dur, cfg.p_dt)
    out = free_rhythm(out, keys, seed, cfg.p_free)
    return _per_note(out, _triple("x.pitch", "x.dur", f"CASE WHEN {INNER} THEN x.dt ELSE 0 END"))


def cut_fragment(seqs: DataFrame, start: str, length: str) -> DataFrame:
    """Notes [start, start + length) of each sequence."""
    rest = [c for c in seqs.columns if c != "notes"]
    return seqs.selectExpr(*rest, f"slice(notes, CAST({start} + 1 AS INT), CAST({length} AS INT)) AS notes")


def random_fragments(seqs: DataFrame, keys: Sequence[str], n_queries: int, seed: int, low: int, high: int) -> DataFrame:
    """Fragment queries: a uniform document among those long enough, then uniform length and start.

    Eligible documents are numbered in hash order (4,096 buckets, two-level prefix), so a drawn
    number finds its document by an equi join.  Adds query_id, frag_start, frag_len.
    """
    hashed = seqs.where(f"size(notes) >= {low}").selectExpr(*keys, f"{hash_of('frag.order', seed, *keys)} AS __h")
    fit = dense_index(hashed, [], ["__h", *keys], BUCKET, idx="__row").drop("__h")
    n_fit = fit.count()
    spark = seqs.sparkSession
    drawn = spark.range(n_queries).selectExpr("id AS query_id", f"CAST(floor({uniform('frag.doc', seed, 'id')} * {n_fit}) AS BIGINT) AS __row")
    picked = drawn.join(fit, "__row").join(seqs, list(keys))
    sized = picked.selectExpr("*", f"{uniform_int('frag.len', seed, low, f'least({high}, size(notes))', 'query_id')} AS frag_len")
    sized = sized.selectExpr("*", f"{uniform_int('frag.start', seed, 0, 'size(notes) - frag_len', 'query_id')} AS frag_start")
    return cut_fragment(sized.drop("__row"), "frag_start", "frag_len")
