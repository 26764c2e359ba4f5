"""Masking, deletion and rotation noise over bounded windows in long form.

Rows hold keys, i, wlen and token ids p, d, t.  Windows are partitioned by sequence
(at most 512 rows); all choices are hash draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from notewise import constants as C
from notewise.functions.draws import discrete, hash_of, poisson_cdf, uniform
from notewise.operators.ordered import over


def ratio_count(n: str, ratio: float) -> str:
    """round(n * ratio) with halves to even, at least 1 and at most n."""
    return f"CAST(least(greatest(rint({n} * {ratio!r}D), 1), {n}) AS INT)"


def pick_k(rows: DataFrame, keys: Sequence[str], k: str, seed: int, out: str, among: str = "true", op: str = "pick") -> DataFrame:
    """Mark exactly k rows of each sequence (of those in ``among``) by hash order."""
    h = hash_of(op, seed, *keys, "i")
    ranked = rows.selectExpr("*", f"{h} AS __h").selectExpr("*", f"row_number() {over([*keys, among], ['__h', 'i'])} AS __r")
    return ranked.selectExpr("*", f"({among}) AND __r <= {k} AS {out}").drop("__h", "__r")


def span_list(keys: Sequence[str], target: str, n: str, lam: float, seed: int) -> str:
    """Random spans of a sequence as an array: floor(target / mean length) starts with Poisson lengths."""
    mean = lam + math.exp(-lam)
    count = f"least(greatest(CAST(floor({target} / {mean!r}D) AS INT), 1), {target})"
    start = f"CAST(floor({uniform('span.start', seed, *keys, 'j')} * {n}) AS INT)"
    length = discrete(poisson_cdf(lam), uniform("span.len", seed, *keys, "j"))
    return f"transform(sequence(1, {count}), j -> struct({start} AS a, {length} AS l))"


def span_mask(rows: DataFrame, keys: Sequence[str], ratio: float, seed: int, lam: float = 3.0, out: str = "masked", when: str = "true") -> DataFrame:
    """Cover about ratio * n notes by spans; single notes fill what is missing to the target.

    Sequences where ``when`` is false get no spans, so the fill alone picks exactly the target.
    The span list is drawn once per sequence, on its first note, and shared by the window.
    """
    spans = f"CASE WHEN i = 0 AND ({when}) THEN {span_list(keys, ratio_count('wlen', ratio), 'wlen', lam, seed)} END"
    hit = rows.selectExpr("*", f"{spans} AS __s").selectExpr("*", f"first_value(__s) {over(keys, ['i'])} AS __spans").selectExpr(
        "*", "coalesce(exists(__spans, s -> i >= s.a AND i < s.a + s.l), false) AS __hit").drop("__s", "__spans")
    short = hit.selectExpr("*", f"{ratio_count('wlen', ratio)} - sum(CASE WHEN __hit THEN 1 ELSE 0 END) {over(keys)} AS __short")
    filled = pick_k(short, keys, "__short", seed, "__fill", "NOT __hit", "span.fill")
    return filled.selectExpr("*", f"__hit OR __fill AS {out}").drop("__hit", "__short", "__fill")


def mask_notes(rows: DataFrame, keys: Sequence[str], seed: int, masked: str = "masked", whole: str = "true") -> DataFrame:
    """Replace marked notes by the mask id: all attributes, or one drawn attribute where ``whole`` is false."""
    rest = [c for c in rows.columns if c not in ("p", "d", "t")]
    attr = f"{hash_of('mask.attr', seed, *keys, 'i')} % 3"
    return rows.selectExpr(*rest, *[
        f"CASE WHEN {masked} AND (({whole}) OR {attr} = {k}) THEN {C.MASK} ELSE {c} END AS {c}" for k, c in enumerate("pdt")])


def collapse(rows: DataFrame, keys: Sequence[str], masked: str = "masked", when: str = "true") -> DataFrame:
    """Each run of marked notes becomes one mask token (where ``when`` holds); positions are renumbered."""
    edge = rows.selectExpr("*", f"NOT coalesce(lag({masked}) {over(keys, ['i'])}, false) AS __edge")
    kept = edge.where(f"NOT {masked} OR __edge OR NOT ({when})").drop("__edge")
    return _renumber(mask_notes(kept, keys, 0, f"({masked} AND ({when}))"), keys)


def _renumber(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("i", "wlen")]
    return rows.selectExpr(*rest, f"CAST(row_number() {over(keys, ['i'])} - 1 AS INT) AS i", f"count(*) {over(keys)} AS wlen")


def delete_notes(rows: DataFrame, keys: Sequence[str], seed: int, p: float = 0.2, spans: str = "false", lam: float = 3.0) -> DataFrame:
    """Delete notes one by one, or in spans where ``spans`` holds; pack to the left, at least one note stays."""
    single = f"{uniform('delete', seed, *keys, 'i')} <= {p!r}D"
    if spans == "false":
        drop = rows.selectExpr("*", f"{single} AS __drop")
    else:
        drop = span_mask(rows, keys, p, seed, lam, "__cover", spans).selectExpr(
            "*", f"CASE WHEN {spans} THEN __cover ELSE {single} END AS __drop").drop("__cover")
    saved = pick_k(drop, keys, "1", seed, "__saved", op="delete.keep")
    none = saved.selectExpr("*", f"count_if(NOT __drop) {over(keys)} = 0 AS __none")
    kept = none.where("NOT __drop OR (__none AND __saved)").drop("__drop", "__saved", "__none")
    return _renumber(kept, keys)


def rotate(rows: DataFrame, keys: Sequence[str], seed: int, p: float = 0.5) -> DataFrame:
    """Rotate some sequences by a random pivot; a pure renumbering."""
    pivot = f"CAST(floor({uniform('rotate.at', seed, *keys)} * wlen) AS INT)"
    rest = [c for c in rows.columns if c != "i"]
    turned = f"CASE WHEN {uniform('rotate', seed, *keys)} < {p!r}D AND wlen > 1 THEN CAST(pmod(i - {pivot}, wlen) AS INT) ELSE i END"
    return rows.selectExpr(*rest, f"{turned} AS i")


def corrupt(rows: DataFrame, keys: Sequence[str], seed: int, density: float = 0.333, lam: float = 3.0, p_delete: float = 0.2,
            p_rotate: float = 0.5, masking: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), deletion: tuple[float, ...] = (0.5, 0.5)) -> DataFrame:
    """Noise pipeline: one masking granularity per sequence (note attribute, note, span attribute,
    span collapsed), one deletion granularity, then rotation."""

    def choice(op: str, probs: Sequence[float]) -> str:
        total, acc, cdf = sum(probs), 0.0, []
        for k, q in enumerate(probs):
            acc += q / total
            cdf.append((k, round(acc, 12)))
        return discrete(cdf, uniform(op, seed, *keys))

    marked = rows.selectExpr("*", f"{choice('mask.gran', masking)} AS __g")
    masked = span_mask(marked, keys, density, seed, lam, when="__g >= 2")
    masked = collapse(mask_notes(masked, keys, seed, whole="__g IN (1, 3)"), keys, when="__g = 3").drop("masked", "__g")
    out = delete_notes(masked.selectExpr("*", f"{choice('del.gran', deletion)} AS __d"), keys, seed, p_delete, "__d = 1", lam)
    return rotate(out.drop("__d"), keys, seed, p_rotate)
