"""Musical weights and small scalar rules, as SQL text over column expressions."""

from __future__ import annotations

from notewise import constants as C


def pitch_class(pitch: str) -> str:
    return f"pmod({pitch}, 12)"


def octave_distance(a: str, b: str) -> str:
    """Pitch-class distance of two pitches folded into 0..6."""
    d = f"abs({a} - {b}) % 12"
    return f"least({d}, 12 - {d})"


def _grid(beats: int, unit: int) -> tuple[int, int, int]:
    return unit * (2 if beats == 4 else 3), unit, max(1, unit // 2)


def metric_weight(onset: str, beats: int = 4, unit: int = C.POS_PER_QUARTER) -> str:
    """0.85 on strong beats, 0.95 on weak beats, 1.05 on eighths, 1.15 elsewhere."""
    half, quarter, eighth = _grid(beats, unit)
    return f"CASE WHEN {onset} % {half} = 0 THEN 0.85D WHEN {onset} % {quarter} = 0 THEN 0.95D WHEN {onset} % {eighth} = 0 THEN 1.05D ELSE 1.15D END"


def duration_weight(dur: str, beats: int = 4, unit: int = C.POS_PER_QUARTER) -> str:
    """0.90 from half a bar, 0.95 from a beat, 1.05 from half a beat, 1.10 below."""
    half, quarter, eighth = _grid(beats, unit)
    return f"CASE WHEN {dur} >= {half} THEN 0.9D WHEN {dur} >= {quarter} THEN 0.95D WHEN {dur} >= {eighth} THEN 1.05D ELSE 1.1D END"


def pitch_weight(pitch: str, low: str, high: str) -> str:
    """Slightly below 1 towards the extremes of the range, above 1 in the middle; 1 for a flat line."""
    ratio = f"abs({pitch} - ({high} + {low}) / 2D) / (({high} - {low}) / 2D)"
    return f"CASE WHEN {high} = {low} THEN 1D ELSE (0.5D - {ratio}) * 0.1D + 1D END"


def interval_cost(a: str, b: str) -> str:
    """Relation cost: same 0.1, octave 1.0, step 0.3, step class 1.3, otherwise 3.0."""
    d = f"abs({a} - {b})"
    return (f"CASE WHEN {d} = 0 THEN 0.1D WHEN {d} % 12 = 0 THEN 1D WHEN {d} <= 2 THEN 0.3D "
            f"WHEN {d} % 12 IN (1, 2, 10, 11) THEN 1.3D ELSE 3D END")


def depth_score(depth: str, temperature: float = 1.0) -> str:
    return f"CASE WHEN {depth} >= 0 THEN exp(-{depth} / {float(temperature)!r}D) ELSE 0D END"


def gain(rel: str, kind: str = "identity") -> str:
    return {"identity": f"({rel})", "exp2": f"(pow(2D, {rel}) - 1D)"}[kind]


def token_weight(dur: str, mode: str = "duration") -> str:
    """Reconstruction weight of a note by its duration (specials weigh 1)."""
    return {
        "uniform": "1D", "duration": f"CAST({dur} AS DOUBLE)", "sqrt_duration": f"sqrt(greatest({dur}, 1))",
        "log_duration": f"log1p(greatest({dur}, 0))",
    }[mode]


def target_length(rho: str, length: str) -> str:
    """z = ceil(rho * L) with BOS and EOS counted, at least 1 and at most L."""
    return f"CAST(least(greatest(ceil({rho} * {length}), 1), {length}) AS INT)"


def kept_by_ratio(rho: str, n_notes: str) -> str:
    """Notes kept by the keep-score exporter: z - 1 with z in [2, n + 1]."""
    return f"CAST(least(greatest(ceil({rho} * ({n_notes} + 2)), 2), {n_notes} + 1) - 1 AS INT)"
