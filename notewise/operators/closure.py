"""Rhythm of a skeleton: closing gaps, re-linking delta times, anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise import constants as C
from notewise.operators.ordered import UPTO, over


def rhythm_closure(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kept notes absorb time up to the latest offset before the next kept note.

    Rows hold keys, i, pitch, dur, dt, onset (with the BOS anchor) and keep.  The duration is
    clamped first and the gap is taken from the clamped value, so kept onsets stay exact
    unless the gap itself is out of range.  The last kept note runs to the end of the clock.
    Adds seg-wise ``new_dur``, ``new_dt``; ``bos_dt`` is the anchor of the closed skeleton.
    """
    seg = notes.selectExpr("*", f"sum(CASE WHEN keep THEN 1 ELSE 0 END) {over(keys, ['i'], UPTO)} AS seg",
                           f"max_by(onset + dur + dt, i) {over(keys)} AS end_onset")
    top = seg.selectExpr("*", f"max(onset + dur) {over([*keys, 'seg'])} AS reach").where("keep")
    nxt = f"coalesce(lead(onset) {over(keys, ['i'])}, end_onset)"
    linked = top.selectExpr("*", f"{nxt} AS next_onset", f"CAST(least(greatest(reach - onset, 1), {C.MAX_DUR}) AS INT) AS new_dur")
    return linked.selectExpr(
        *keys, "i", "pitch", "onset", "new_dur",
        f"CAST(least(greatest(next_onset - onset - new_dur, {C.MIN_DT}), {C.MAX_DT}) AS INT) AS new_dt",
        f"CAST(least(greatest(min(onset) {over(keys)}, {C.MIN_DT}), {C.MAX_DT}) AS INT) AS bos_dt")


def relink(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kept notes with dt = next kept onset - own offset, last 0; durations unchanged."""
    return notes.where("keep").selectExpr(
        *keys, "i", "pitch", "dur", f"coalesce(lead(onset) {over(keys, ['i'])} - onset - dur, 0) AS new_dt")


def anchors(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """BOS anchor of each skeleton: clipped onset of its first kept note."""
    first = notes.where("keep").groupBy(*keys).agg(F.min_by("onset", "i").alias("onset"))
    return first.selectExpr(*keys, f"CAST(least(greatest(onset, 0), {C.MAX_DT}) AS INT) AS bos")


def note_times(notes: DataFrame, keys: Sequence[str], whole: int = 4 * C.POS_PER_QUARTER) -> DataFrame:
    """Start and end of every note from its onset; a sequence reaching below 0 moves up by whole notes."""
    low = f"min(onset) {over(keys)}"
    up = f"CASE WHEN {low} < 0 THEN -(floor({low} / {float(whole)!r}D) * {whole}) ELSE 0 END"
    return notes.selectExpr("*", f"CAST(onset + {up} AS BIGINT) AS start_pos").selectExpr(
        *keys, "i", "pitch", "start_pos", "start_pos + greatest(dur, 1) AS end_pos")


def skeleton_export(closed: DataFrame, keys: Sequence[str], lengths: DataFrame) -> DataFrame:
    """One row per sequence: closed notes, source indices, kept length and rho (BOS and EOS counted)."""
    packed = closed.groupBy(*keys).agg(
        F.expr("array_sort(collect_list(struct(i, pitch, new_dur AS dur, new_dt AS dt))) AS rows"), F.expr("max(bos_dt) AS bos_dt"))
    return packed.join(lengths, list(keys)).selectExpr(
        *keys, "bos_dt", "transform(rows, x -> struct(x.pitch AS pitch, x.dur AS dur, x.dt AS dt)) AS notes", "rows.i AS source_idx",
        "size(rows) + 2 AS used_len", "(size(rows) + 2) / CAST(wlen + 2 AS DOUBLE) AS rho")
