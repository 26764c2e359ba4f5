"""Note selectors.  Input: windowed notes (keys, i, wlen, pitch, dur, dt) with ``k`` notes to keep.

Output columns: keys, i, score, hard, bos_mass.  ``z - 1 = k + 1`` steps share the soft mass:
one belongs to BOS, the others to the kept notes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.functions.draws import uniform
from notewise.operators.ordered import BEFORE, UPTO, over


def with_onsets(notes: DataFrame, keys: Sequence[str], bos: str = "0", carry: Sequence[str] = ()) -> DataFrame:
    """Onset of each note from the clock (BOS anchor plus durations and gaps) and its running maximum."""
    w = over(keys, ["i"], BEFORE)
    timed = notes.selectExpr("*", f"CAST({bos} + coalesce(sum(dur + dt) {w}, 0) AS BIGINT) AS onset")
    return timed.selectExpr("*", f"max(onset) {over(keys, ['i'], UPTO)} AS onset_mono")


def top_k(notes: DataFrame, keys: Sequence[str], by: str, k: str = "k") -> DataFrame:
    """Mark the k best notes; the earlier note wins a tie."""
    return notes.selectExpr("*", f"row_number() {over(keys, [f'{by} DESC', 'i'])} <= {k} AS hard")


def longest_k(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    marked = top_k(notes, keys, "dur")
    total = f"sum(dur) {over(keys)}"
    return marked.selectExpr(
        *keys, "i", f"dur / {total} * (1 - 1D / (k + 1)) AS score", "hard", "1D / (k + 1) AS bos_mass")


def random_k(notes: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """One note drawn from each of k equal index segments; needs no shuffle at all.

    Note i lies in segment j = ((i + 1) * k - 1) div n, which spans floor(j n / k) .. floor((j + 1) n / k) - 1.
    """
    seg = notes.selectExpr("*", "CASE WHEN k > 0 THEN ((i + 1) * k - 1) div wlen END AS seg").selectExpr(
        "*", "seg * wlen div k AS lo", "(seg + 1) * wlen div k - 1 AS hi")
    pick = f"lo + CAST(floor({uniform('random_k', seed, *keys, 'seg')} * (hi - lo + 1)) AS BIGINT)"
    return _even_soft(seg.selectExpr(*keys, "i", "k", f"coalesce(CASE WHEN k >= wlen THEN i < k ELSE i = {pick} END, false) AS hard"), keys)


def uniform_time(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The k notes nearest to k even points of the clock, every note once (rows with ``onset_mono``, ``k``, ``wlen``).

    Points and notes are put in one order per sequence, where a point's neighbours are the next note and the one before.  A
    taken note passes the point on to the next free one; if that leads beyond the end, all picks move back.
    """
    clock = notes.selectExpr(*keys, "CAST(i AS INT) AS i", "CAST(k AS INT) AS k", "CAST(wlen AS INT) AS n", "CAST(onset_mono AS DOUBLE) AS at")
    ends = clock.groupBy(*keys, "k", "n").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    points = ends.where("k > 0 AND k < n").selectExpr(*keys, "k", "n", "lo", "hi", "explode(sequence(0, k - 1)) AS j").selectExpr(
        "*", "CASE WHEN k = 1 THEN lo ELSE lo + (hi - lo) * j / (k - 1) END AS at")
    mixed = points.selectExpr(*keys, "k", "n", "lo", "hi", "j", "at", "CAST(NULL AS INT) AS i", "CAST(NULL AS DOUBLE) AS note_at").unionByName(
        clock.selectExpr(*keys, "k", "n", "CAST(NULL AS DOUBLE) AS lo", "CAST(NULL AS DOUBLE) AS hi", "CAST(NULL AS INT) AS j", "at", "i", "at AS note_at"))
    line = ["at", "CASE WHEN i IS NULL THEN 0 ELSE 1 END", "coalesce(i, j)"]
    behind, before = (over(keys, line, f"ROWS BETWEEN {f}") for f in ("CURRENT ROW AND UNBOUNDED FOLLOWING", "UNBOUNDED PRECEDING AND CURRENT ROW"))
    sides = mixed.selectExpr("*", f"first_value(i, true) {behind} AS right", f"first_value(note_at, true) {behind} AS right_at",
                             f"last_value(note_at, true) {before} AS left_at").where("j IS NOT NULL")
    near = sides.selectExpr(*keys, "n", "j", """CASE WHEN hi <= lo THEN CAST(rint((n - 1) * CAST(j AS DOUBLE) / greatest(k - 1, 1)) AS INT)
        WHEN right IS NULL THEN n - 1 WHEN right > 0 AND at - left_at <= right_at - at THEN right - 1 ELSE right END AS pick""")
    free = near.selectExpr(*keys, "n", "j", f"max(pick - j) {over(keys, ['j'], UPTO)} + j AS pick")
    inside = free.selectExpr(*keys, f"greatest(0, pick - greatest(0, max(pick) {over(keys)} - (n - 1))) AS i").distinct().selectExpr("*", "true AS hard")
    marked = notes.join(inside, [*keys, "i"], "left").selectExpr(*keys, "i", "k", "k > 0 AND (k >= wlen OR coalesce(hard, false)) AS hard")
    return _even_soft(marked, keys)


def _even_soft(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return marked.selectExpr(*keys, "i", "CASE WHEN hard THEN 1D / (k + 1) ELSE 0D END AS score", "hard", "1D / (k + 1) AS bos_mass")


def keep_by_threshold(scored: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Keep notes scoring at least the threshold; when none does, the best note stays."""
    best = f"row_number() {over(keys, ['score DESC', 'i'])}"
    peak = f"max(score) {over(keys)}"
    return scored.selectExpr("*", f"score >= {threshold!r}D OR ({peak} < {threshold!r}D AND {best} = 1) AS kept")


def normalised(scored: DataFrame, keys: Sequence[str], temperature: float | None = None) -> DataFrame:
    """Scores that sum to 1 per sequence: plain ratio, or softmax with a temperature."""
    if temperature is None:
        return scored.selectExpr("*", f"score / greatest(sum(score) {over(keys)}, 1e-8D) AS share")
    t = max(float(temperature), 1e-6)
    shifted = scored.selectExpr("*", f"exp((score - max(score) {over(keys)}) / {t!r}D) AS __e")
    return shifted.selectExpr("*", f"__e / greatest(sum(__e) {over(keys)}, 1e-8D) AS share").drop("__e")


def with_scores(notes: DataFrame, scores: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Join supplied scores (keys, i, score) to notes (keys, i, ...); nothing that does not fit goes unreported.

    Returns the notes with ``score`` and one row for every sequence of either table: ``n_notes``, ``n_scores``, ``n_missing`` notes
    without a score, ``n_surplus`` scores without a note, and ``status``: ok, missing (no score at all), surplus (no such sequence)
    or mismatch.  Null and NaN scores count as missing, notes without one score 0, of repeated positions the highest counts.
    """
    on = [*keys, "i"]
    best = scores.where("score IS NOT NULL AND NOT isnan(score)").groupBy(*on).agg(F.max("score").alias("__score"))
    both = notes.withColumn("__note", F.lit(True)).join(best, on, "full")
    scored = both.where("__note").withColumn("score", F.coalesce("__score", F.lit(0.0))).select(*notes.columns, "score")
    counts = both.groupBy(*keys).agg(
        F.count("__note").alias("n_notes"), F.count("__score").alias("n_scores"),
        F.count_if(F.col("__score").isNull()).alias("n_missing"), F.count_if(F.col("__note").isNull()).alias("n_surplus"))
    status = ("CASE WHEN n_notes = 0 THEN 'surplus' WHEN n_scores = 0 THEN 'missing' WHEN n_missing + n_surplus > 0 THEN 'mismatch' ELSE 'ok' END")
    return scored, counts.selectExpr("*", f"{status} AS status")


def gold_cuts(depths: DataFrame, keys: Sequence[str], rhos: Sequence[float]) -> DataFrame:
    """First ceil(rho n) notes by (depth, position) for every rho, ranked once."""
    ranked = depths.selectExpr("*", f"row_number() {over(keys, ['depth', 'i'])} AS r", f"count(*) {over(keys)} AS n")
    spine = ", ".join(f"{float(r)!r}D" for r in rhos)
    return ranked.selectExpr("*", f"explode(array({spine})) AS rho").selectExpr(
        *keys, "i", "rho", "r <= least(greatest(CAST(ceil(rho * n) AS INT), 1), n) AS in_cut")


def onto_original(scored: DataFrame, originals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum the scores of variant notes (column ``pi``) onto original positions; uncovered ones get 0."""
    summed = scored.where("pi >= 0").groupBy(*keys, "pi").agg({"score": "sum"}).withColumnRenamed("sum(score)", "score")
    return originals.selectExpr(*keys, "i AS pi").join(summed, [*keys, "pi"], "left").fillna({"score": 0.0})
