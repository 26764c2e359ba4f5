"""Relation tokens between neighbouring notes and n-grams over them; row-local array expressions.

Arguments are SQL text.  ``let`` binds an array to a lambda variable so that it is
evaluated once per row, not once per element.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewise import constants as C

DP_OFFSET = 128
RATIO_MAX = 255


def let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def coarse_bin(dur: str, edges: Sequence[int] = C.COARSE_EDGES) -> str:
    """Number of bin edges below the duration."""
    if not edges or any(e <= 0 for e in edges) or list(edges) != sorted(edges) or len(edges) > 255:
        raise ValueError(f"edges must be positive, ascending and at most 255: {edges}")
    whens = " ".join(f"WHEN {dur} <= {e} THEN {k}" for k, e in enumerate(edges))
    return f"CASE {whens} ELSE {len(edges)} END"


def gcd(a: str, b: str) -> str:
    """Greatest common divisor of two durations up to 95, read from a folded literal table."""
    size = C.MAX_DUR + 1
    table = ",".join(str(max(1, math.gcd(i, j))) for i in range(size) for j in range(size))
    return f"CAST(split('{table}', ',') AS ARRAY<INT>)[{a} * {size} + {b}]"


def relation_token(a: str, b: str, mode: str) -> str:
    """Token of the step from note a to note b (structs with pitch and dur)."""
    dp = f"least(greatest({b}.pitch - {a}.pitch + {DP_OFFSET}, 0), 255)"
    d0, d1 = f"least(greatest({a}.dur, 1), {C.MAX_DUR})", f"least(greatest({b}.dur, 1), {C.MAX_DUR})"
    if mode == "dp_only":
        return f"CAST({dp} AS INT)"
    if mode == "dp_coarse_dur":
        hi, lo = coarse_bin(d0), coarse_bin(d1)
    elif mode == "dp_dur_ratio":
        g = gcd(d0, d1)
        return let(g, "g", f"CAST({dp} * 65536 + least({d1} div g, {RATIO_MAX}) * 256 + least({d0} div g, {RATIO_MAX}) AS INT)")
    else:
        raise ValueError(f"unknown relation mode: {mode}")
    return f"CAST({dp} * 65536 + ({hi}) * 256 + ({lo}) AS INT)"


def relation_tokens(notes: str, mode: str = "dp_dur_ratio") -> str:
    """Tokens of all neighbouring pairs; fewer than two notes give none."""
    token = relation_token("a", "ns[j + 1]", mode)
    return let(notes, "ns", f"transform(slice(ns, 1, greatest(size(ns) - 1, 0)), (a, j) -> {token})")


def unpack_token(token: Column, mode: str) -> Column:
    """Struct(dp, a, b) of a token; a and b are NULL for interval-only tokens."""
    byte = lambda shift: F.shiftrightunsigned(token, shift).bitwiseAND(F.lit(255))
    if mode == "dp_only":
        none = F.lit(None).cast("int")
        return F.struct((byte(0) - DP_OFFSET).alias("dp"), none.alias("a"), none.alias("b"))
    return F.struct((byte(16) - DP_OFFSET).alias("dp"), byte(8).alias("a"), byte(0).alias("b"))


def ngrams(tokens: str, n: int, item: str = "array<int>", run: str = "slice(xs, p, {n})") -> str:
    """All runs of n consecutive tokens as exact array keys."""
    picked = run.format(n=n)
    return let(tokens, "xs", f"CASE WHEN size(xs) < {n} THEN CAST(array() AS array<{item}>) "
                             f"ELSE transform(sequence(1, size(xs) - {n - 1}), p -> {picked}) END")


# bits that hold one token of each mode; coarse bins are narrowed to four bits each
TOKEN_BITS = {"dp_only": 8, "dp_coarse_dur": 16, "dp_dur_ratio": 24}


def ngram_keys(tokens: str, n: int, mode: str) -> str:
    """Exact n-gram keys: one BIGINT per gram while the tokens fit into 63 bits, else token arrays."""
    bits = TOKEN_BITS[mode]
    if bits * n > 63:
        return ngrams(tokens, n)
    if mode == "dp_coarse_dur":
        tokens = f"transform({tokens}, v -> (v div 65536) * 256 + (v div 256) % 256 * 16 + v % 256)"
    key = "CAST(xs[p - 1] AS BIGINT)"
    for j in range(1, n):
        key = f"({key} * {1 << bits} + xs[p + {j - 1}])"
    return ngrams(tokens, n, "bigint", key)


def word_ngrams(words: str, n: int) -> str:
    """All runs of n consecutive words as text keys."""
    return ngrams(words, n, "string", "array_join(slice(xs, p, {n}), ' ')")


def length_factor(mode: str, n_notes: str, n_terms: str) -> str:
    """Score factor that makes fragments of different lengths comparable."""
    forms = {
        "none": "1D",
        "notes": f"1D / greatest({n_notes}, 1)",
        "terms": f"1D / greatest({n_terms}, 1)",
        "sqrt_terms": f"1D / sqrt(greatest({n_terms}, 1))",
    }
    if mode not in forms:
        raise ValueError(f"unknown length mode: {mode}")
    return forms[mode]
