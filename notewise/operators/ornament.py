"""Ornamentation of packed sequences with an alignment back to the original notes.

Every note states the figure it would like from draws keyed by (sequence, try, note), and how many notes that adds.  Overlapping
two-note figures are settled by their parity in a run, and figures are kept while the running sum of added notes fits the
budget.  All of it is expressions and windows of one bounded sequence; the figures are arrays of (pitch, dur, dt, pi)
that are laid end to end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise import constants as C
from notewise.functions.draws import nonzero_offset, uniform, uniform_int
from notewise.functions.relation import let
from notewise.operators.ordered import UPTO, over


@dataclass(frozen=True)
class Ornaments:
    """Rates and limits; positions are 1/12 quarter."""

    p_apply: float = 0.8
    max_extra: int = 128
    spread: int = 2
    sigma: float = 1.0
    min_split: int = 6
    p_pre_grace: float = 0.15
    p_post_grace: float = 0.15
    grace_ratio: float = 0.40
    grace_overlap: float = 0.2
    grace_overlap_most: int = 3
    p_trill: float = 0.10
    trill_min: int = 6
    trill_most: int = 5
    p_turn: float = 0.0
    turn_min: int = 6
    turn_notes: int = 4
    p_repeat: float = 0.10
    repeat_min: int = 6
    repeat_most: int = 4
    repeat_gap: int = 1
    p_pair: float = 0.0
    pair_most: int = 4
    pair_overlap: bool = False
    p_insert: float = 0.15
    insert_dur: tuple[int, int] = (1, 4)
    min_gap: int = 2
    toward_next: float = 0.5
    steps: tuple[int, ...] = (1, 2)
    p_run: float = 0.0
    run_notes: tuple[int, int] = (2, 4)
    run_dur: tuple[int, int] = (1, 2)
    run_jitter: float = 0.15
    p_extend: float = 0.1


# fixed values of the out-of-distribution set; every other value keeps its default
OUT_OF_DISTRIBUTION = replace(
    Ornaments(), p_trill=0.15, trill_min=4, p_repeat=0.15, repeat_min=4, p_turn=0.15, turn_min=4, p_run=0.10, run_notes=(2, 4),
    run_dur=(1, 2), run_jitter=0.30, p_insert=0.15, p_extend=0.2, spread=4, grace_overlap=0.6, p_pair=0.15)


NO_NOTES = "CAST(array() AS ARRAY<STRUCT<pitch: INT, dur: INT, dt: INT, pi: INT>>)"


def _note(pitch: str, dur: str, dt: str, pi: str = "-1") -> str:
    """One note of a figure inside the code ranges."""
    def inside(x: str, low: int, high: int) -> str:
        return f"CAST(greatest({low}, least({high}, {x})) AS INT)"

    return (f"named_struct('pitch', {inside(pitch, 0, C.MAX_PITCH)}, 'dur', {inside(dur, 1, C.MAX_DUR)}, "
            f"'dt', {inside(dt, C.MIN_DT, C.MAX_DT)}, 'pi', CAST({pi} AS INT))")


def _parts(total: str, n: str, op: str, seed: int, at: Sequence[str]) -> str:
    """Array of n positive parts of a duration by drawn weights, the longest first."""
    weights = f"transform(sequence(1, {n}), j -> {uniform(op, seed, *at, 'j')})"
    shares = let(weights, "ws", f"transform(ws, v -> 1 + CAST(floor((({total}) - ({n})) * v / greatest(aggregate(ws, 0D, (a, v) -> a + v), 1e-9D)) AS INT))")
    return let(f"reverse(array_sort({shares}))", "ps",
               f"transform(ps, (v, j) -> CASE WHEN j = 0 THEN v + ({total}) - aggregate(ps, 0, (a, v) -> a + v) ELSE v END)")


def _chain(n: str, parts: str, pitch: str, gap: str = "0") -> str:
    """Figure over one note: ``pitch`` and ``gap`` are expressions of the running number j; the first note is the original."""
    return let(parts, "qs", f"transform(sequence(0, {n} - 1), j -> {_note(pitch, 'qs[j]', f'CASE WHEN j = {n} - 1 THEN dt ELSE {gap} END', 'CASE WHEN j = 0 THEN i ELSE -1 END')})")


def _wishes(rows: DataFrame, keys: Sequence[str], seed: int, cfg: Ornaments) -> DataFrame:
    """Adds ``kind`` and ``m`` (size) of the wanted figure, ``btw`` and ``add`` for what follows it, all before the budget."""
    at = [*keys, "try", "i"]
    u = lambda op: uniform(f"orn.{op}", seed, *at)
    num = lambda op, low, high: uniform_int(f"orn.{op}", seed, low, high, *at)
    most = f"least({cfg.pair_most}, dur, next_dur)"
    r = rows.selectExpr("*", f"""coalesce(try IS NOT NULL AND next_pitch IS NOT NULL AND {u('pair')} < {cfg.p_pair!r}D AND least(dur, next_dur) >= {cfg.min_split}
        AND {'true' if cfg.pair_overlap else 'dt >= 0'} AND {most} >= 2, false) AS cand""")
    start = f"max(CASE WHEN cand AND NOT before THEN i END) {over(keys, ['i'], UPTO)}"
    r = r.selectExpr("*", f"coalesce(lag(cand) {over(keys, ['i'])}, false) AS before").selectExpr("*", f"cand AND (i - {start}) % 2 = 0 AS opens")
    r = r.selectExpr("*", f"coalesce(lag(opens) {over(keys, ['i'])}, false) AS closes", f"{num('pair.n', 2, most)} AS pair_n")
    grace_most = f"least(CAST(rint(dur * {cfg.grace_ratio!r}D) AS INT), dur - 1)"
    graced = f"dur >= {cfg.min_split} AND {grace_most} >= 1"
    r = r.selectExpr("*", f"""CASE WHEN try IS NULL THEN 'plain' WHEN opens THEN 'opens' WHEN closes THEN 'closes'
        WHEN {u('trill')} < {cfg.p_trill!r}D AND dur >= {max(3, cfg.trill_min)} AND {cfg.trill_most} >= 3 THEN 'trill'
        WHEN {u('turn')} < {cfg.p_turn!r}D AND dur >= {max(cfg.turn_min, 4)} THEN 'turn'
        WHEN {u('repeat')} < {cfg.p_repeat!r}D AND dur >= {max(2, cfg.repeat_min)} AND {cfg.repeat_most} >= 2 THEN 'repeat'
        WHEN {u('grace')} < {cfg.p_pre_grace!r}D AND {graced} THEN 'pre'
        WHEN {u('grace')} BETWEEN {cfg.p_pre_grace!r}D AND {cfg.p_pre_grace + cfg.p_post_grace!r}D AND {graced} THEN 'post' ELSE 'plain' END AS kind""",
        f"{grace_most} AS grace_most")
    odd = let(num("trill.n", 3, f"least({max(3, cfg.trill_most)}, dur)"), "z", "z - CASE WHEN z % 2 = 0 THEN 1 ELSE 0 END")
    r = r.selectExpr("*", f"""CASE kind WHEN 'trill' THEN {odd} WHEN 'turn' THEN {3 if cfg.turn_notes <= 3 else 4}
        WHEN 'repeat' THEN {num('repeat.n', 2, f'least({max(2, cfg.repeat_most)}, dur)')} WHEN 'pre' THEN 2 WHEN 'post' THEN 2 WHEN 'opens' THEN 2 * pair_n - 1 ELSE 1 END AS m""")
    low, high = min(cfg.run_notes), max(cfg.run_notes)
    r = r.selectExpr("*", f"""CASE WHEN try IS NULL OR next_pitch IS NULL OR dt < 0 OR kind = 'opens' THEN NULL WHEN {u('between')} < {cfg.p_run!r}D THEN 'run'
        WHEN {u('between')} < {cfg.p_run + cfg.p_insert!r}D THEN 'insert' END AS want""", f"{num('run.n', low, high)} AS run_n")
    r = r.selectExpr("*", "CASE want WHEN 'run' THEN run_n WHEN 'insert' THEN 1 ELSE 0 END AS add0", f"CASE WHEN want = 'run' THEN {cfg.run_dur[0]} ELSE {cfg.insert_dur[0]} END AS dmin",
                     f"CASE WHEN want = 'run' THEN {cfg.run_dur[1]} ELSE {cfg.insert_dur[1]} END AS dmax")
    drawn = f"transform(sequence(1, greatest(add0, 1)), j -> {uniform_int('orn.between.dur', seed, 'dmin', 'dmax', *at, 'j')})"
    r = r.selectExpr("*", f"{drawn} AS durs0").selectExpr("*", "aggregate(durs0, 0, (a, v) -> a + v) AS sum0")
    squeezed = f"transform({_parts('dt - add0 * (dmin - 1)', 'greatest(add0, 1)', 'orn.between.part', seed, at)}, v -> v + dmin - 1)"
    r = r.selectExpr("*", f"""want IS NOT NULL AND (extend OR (dt >= {cfg.min_gap} AND dt >= add0 * dmin AND (want = 'run' OR sum0 <= dt))) AS fits""")
    return r.selectExpr("*", "CASE WHEN fits THEN want END AS btw", "CASE WHEN fits THEN add0 ELSE 0 END AS add",
                        f"CASE WHEN NOT fits THEN CAST(array() AS ARRAY<INT>) WHEN extend OR sum0 <= dt THEN durs0 ELSE {squeezed} END AS durs")


def _figure(keys: Sequence[str], seed: int, cfg: Ornaments) -> str:
    """The kept figure of a note as an array of notes; its last note still has the note's own gap."""
    at = [*keys, "try", "i"]
    near = lambda op: f"pitch + {nonzero_offset(f'orn.{op}', seed, cfg.spread, cfg.sigma, *at)}"
    num = lambda op, low, high: uniform_int(f"orn.{op}", seed, low, high, *at)
    short = num("grace.dur", 1, "grace_most")
    overlap = f"CASE WHEN {uniform('orn.grace.over', seed, *at)} < {cfg.grace_overlap!r}D AND g >= 2 THEN {num('grace.by', 1, f'least({cfg.grace_overlap_most}, g - 1)')} ELSE 0 END"

    def grace(first: str, second: str) -> str:
        return let(short, "g", let(overlap, "o", f"array({first}, {second})"))

    side, rest = near("grace.pitch"), "dur - g + o"
    gaps = let(f"transform(sequence(1, m - 1), j -> {uniform_int('orn.repeat.gap', seed, 0, cfg.repeat_gap, *at, 'j')})", "gs",
               "CASE WHEN aggregate(gs, 0, (a, v) -> a + v) <= dur - m THEN gs ELSE transform(gs, v -> 0) END")
    repeat = let(gaps, "hs", _chain("m", _parts("dur - aggregate(hs, 0, (a, v) -> a + v)", "m", "orn.repeat.part", seed, at), "pitch", "hs[j]"))
    trill = let(near("trill.pitch"), "s", _chain("m", _parts("dur", "m", "orn.trill.part", seed, at), "CASE WHEN j % 2 = 1 THEN s ELSE pitch END"))
    turn = let(f"array(pitch, {near('turn.up')}, pitch, {near('turn.down')})", "ts", _chain("m", _parts("dur", "m", "orn.turn.part", seed, at), "ts[j]"))
    here, last = [*keys, "try", "i"], [*keys, "try", "(i - 1)"]
    first_parts, second_parts = _parts("dur", "pair_n", "orn.pair.a", seed, here), _parts("next_dur", "pair_n", "orn.pair.b", seed, here)
    alternate = let(first_parts, "xs", let(second_parts, "ys", f"""transform(sequence(0, m - 1), j -> CASE WHEN j % 2 = 0
        THEN {_note('pitch', 'xs[CAST(j div 2 AS INT)]', 'CASE WHEN j = 0 THEN dt ELSE 0 END', 'CASE WHEN j = 0 THEN i ELSE -1 END')}
        ELSE {_note('next_pitch', 'ys[CAST(j div 2 AS INT)]', '0', 'CASE WHEN j = 1 THEN i + 1 ELSE -1 END')} END)"""))
    closing = let(_parts("dur", "prev_n", "orn.pair.b", seed, last), "ys", f"array({_note('pitch', 'ys[prev_n - 1]', 'dt')})")
    plain = f"array({_note('pitch', 'dur', 'dt', 'i')})"
    return f"""CASE WHEN kind = 'closes' AND prev_kept THEN {closing} WHEN NOT kept THEN {plain}
        WHEN kind = 'trill' THEN {trill} WHEN kind = 'turn' THEN {turn} WHEN kind = 'repeat' THEN {repeat} WHEN kind = 'opens' THEN {alternate}
        WHEN kind = 'pre' THEN {grace(_note(side, 'g', '-o'), _note('pitch', rest, 'dt', 'i'))}
        WHEN kind = 'post' THEN {grace(_note('pitch', rest, '-o', 'i'), _note(side, 'g', 'dt'))} ELSE {plain} END"""


def _between(keys: Sequence[str], seed: int, cfg: Ornaments) -> tuple[str, str]:
    """(gap left before the inserted notes, the inserted notes)."""
    at = [*keys, "try", "i"]
    room = "CASE WHEN extend THEN dt ELSE dt - aggregate(durs, 0, (a, v) -> a + v) END"
    lead = let(room, "r", uniform_int("orn.between.lead", seed, 0, "r", *at))
    jitter = (f"CASE WHEN {uniform('orn.run.jitter', seed, *at, 'j')} < {cfg.run_jitter!r}D THEN {nonzero_offset('orn.run.by', seed, cfg.spread, cfg.sigma, *at, 'j')} ELSE 0 END")
    along = f"CAST(rint(pitch + (next_pitch - pitch) * (j + 1) / CAST(add + 1 AS DOUBLE)) AS INT) + {jitter}"
    step = f"element_at(array({', '.join(map(str, cfg.steps))}), {uniform_int('orn.insert.step', seed, 1, len(cfg.steps), *at)})"
    single = (f"CASE WHEN abs(next_pitch - pitch) >= 3 THEN pitch + CAST(sign(next_pitch - pitch) AS INT) * {step} "
              f"ELSE CASE WHEN {uniform('orn.insert.base', seed, *at)} < {cfg.toward_next!r}D THEN next_pitch ELSE pitch END + {nonzero_offset('orn.insert.by', seed, cfg.spread, cfg.sigma, *at)} END")
    made = f"transform(durs, (v, j) -> {_note(f'CASE WHEN btw = {chr(39)}run{chr(39)} THEN {along} ELSE {single} END', 'v', f'CASE WHEN j = add - 1 THEN {room} - lead ELSE 0 END')})"
    return lead, made


def ornament_pairs(seqs: DataFrame, keys: Sequence[str], seed: int, cfg: Ornaments = Ornaments(), rho_min: float = 1 / 3,
                   tries: int = 8, min_extra: int = 1, capacity: int = C.MAX_EVENTS) -> DataFrame:
    """Ornamented twin of every sequence: x_orn, pi, len_x, len_x_orn (BOS and EOS counted), rho, fail.

    At most floor(len * (1 / rho_min - 1)) notes are added.  A sequence is ornamented with ``p_apply``, drawn up to ``tries`` times; one that
    gains fewer than ``min_extra`` notes or falls below ``rho_min`` is marked as failed.
    """
    drawn = " ".join(f"WHEN {uniform('orn.apply', seed, *keys, str(t))} <= {cfg.p_apply!r}D THEN {t}" for t in range(tries))
    base = seqs.selectExpr(*keys, "size(notes) AS n", f"CASE {drawn} END AS try", "notes").selectExpr("*", f"coalesce({uniform('orn.extend', seed, *keys, 'try')} < {cfg.p_extend!r}D, false) AS extend")
    rows = base.selectExpr(*keys, "n", "try", "extend", "posexplode(notes) AS (i, x)").selectExpr(
        *keys, "n", "try", "extend", "i", "CAST(x.pitch AS INT) AS pitch", "CAST(x.dur AS INT) AS dur", "CAST(x.dt AS INT) AS dt").selectExpr(
        "*", f"lead(pitch) {over(keys, ['i'])} AS next_pitch", f"lead(dur) {over(keys, ['i'])} AS next_dur")
    wished = _wishes(rows, keys, seed, cfg)
    cap = f"least({cfg.max_extra}, greatest(0, {capacity} - n - 2), greatest(0, CAST(floor((n + 2) * {1 / rho_min - 1!r}D + 1e-9D) AS INT)))"
    # a two-note figure counts as a whole where it opens: all its notes but the two originals
    extra = "CASE WHEN kind = 'opens' THEN m - 1 WHEN kind = 'closes' THEN 0 ELSE m - 1 END"
    summed = wished.selectExpr("*", f"sum({extra} + add) {over(keys, ['i'], UPTO)} AS upto", f"{cap} AS cap").selectExpr(
        "*", "upto - add <= cap AS kept", "upto <= cap AND btw IS NOT NULL AS follows")
    settled = summed.selectExpr("*", f"coalesce(lag(kept) {over(keys, ['i'])}, false) AS prev_kept", f"lag(pair_n) {over(keys, ['i'])} AS prev_n")
    lead, made = _between(keys, seed, cfg)
    laid = settled.selectExpr(*keys, "n", "i", "btw", "add", "durs", "extend", "try", "pitch", "next_pitch", "dt", "follows", f"{_figure(keys, seed, cfg)} AS fig", f"CASE WHEN follows THEN {lead} END AS lead")
    shorter = f"transform(fig, (x, j) -> CASE WHEN j = size(fig) - 1 THEN {_note('x.pitch', 'x.dur', 'lead', 'x.pi')} ELSE x END)"
    notes = laid.selectExpr(*keys, "n", "i", f"CASE WHEN follows THEN concat({shorter}, {made}) ELSE fig END AS part")
    whole = notes.groupBy(*keys, "n").agg(F.expr("flatten(transform(array_sort(collect_list(struct(i, part))), x -> x.part)) AS y"))
    # sequences without notes have no rows above
    empty = seqs.where("size(notes) = 0").selectExpr(*keys, "0 AS n", f"{NO_NOTES} AS y")
    rho = "(n + 2) / CAST(size(y) + 2 AS DOUBLE)"
    return whole.unionByName(empty).selectExpr(
        *keys, "transform(y, x -> struct(x.pitch AS pitch, x.dur AS dur, x.dt AS dt)) AS x_orn", "y.pi AS pi", "n + 2 AS len_x", "size(y) + 2 AS len_x_orn",
        f"{rho} AS rho", f"size(y) - n < {min_extra} OR {rho} + 1e-9D < {rho_min!r}D AS fail")


def identity_alignment(notes: str = "notes") -> str:
    """pi of an unchanged sequence, as SQL text."""
    return f"CASE WHEN size({notes}) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE sequence(0, size({notes}) - 1) END"
