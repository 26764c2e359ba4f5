"""Note table clean-up: filters, bar grids, empty-bar removal, note order, voices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewise import constants as C
from notewise.functions.draws import hash_of
from notewise.operators.ordered import dense_index


def in_range(notes: DataFrame) -> DataFrame:
    """Pitch 0..127 and start below the limit; the end is capped and lies after the start."""
    st = F.col("st")
    return notes.where(F.col("pitch").between(0, C.MAX_PITCH) & (st < C.TRUNC_POS)).withColumn(
        "en", F.greatest(st + 1, F.least(F.col("en"), F.lit(C.TRUNC_POS))))


def sounding(notes: DataFrame, is_drum: str = "is_drum", is_grace: str = "is_grace") -> DataFrame:
    """Leave out percussion voices and grace notes."""
    return notes.where(~F.col(is_drum) & ~F.col(is_grace))


def voice_sizes(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Notes and distinct pitches per voice; the pitch set has at most 128 members."""
    return notes.groupBy(*keys).agg(F.count("*").alias("n_notes"), F.size(F.collect_set("pitch")).alias("n_pitches"))


def admitted_voices(
    notes: DataFrame, keys: Sequence[str], min_notes: int = C.MIN_NOTES_PER_VOICE, min_pitches: int = C.MIN_UNIQUE_PITCHES
) -> DataFrame:
    return voice_sizes(notes, keys).where((F.col("n_notes") >= min_notes) & (F.col("n_pitches") >= min_pitches))


def admit(notes: DataFrame, keys: Sequence[str], **limits) -> DataFrame:
    return notes.join(admitted_voices(notes, keys, **limits).select(*keys), list(keys), "left_semi")


def skip_reason(n_notes: Column, n_pitches: Column, min_notes: int, min_pitches: int) -> Column:
    """First failed admission rule, NULL when admitted."""
    return F.when(n_notes < min_notes, "too_few_notes").when(n_pitches < min_pitches, "too_few_pitches")


def reduced_signature(num: Column, den: Column, max_den: int = 64, max_ratio: int = 2) -> Column:
    """Struct(num, den): halve both while den > max_den; then divide num by its smallest
    divisor while num > max_ratio * den.  Every round at least halves a number, so a
    fixed count of rounds covers all 32-bit signatures."""
    rounds = F.sequence(F.lit(1), F.lit(31))
    start = F.struct(num.cast("int").alias("num"), den.cast("int").alias("den"))

    def halve(s: Column, _: Column) -> Column:
        go = (s["den"] > max_den) & (s["den"] % 2 == 0) & (s["num"] % 2 == 0)
        return F.struct(
            F.when(go, (s["num"] / 2).cast("int")).otherwise(s["num"]).alias("num"),
            F.when(go, (s["den"] / 2).cast("int")).otherwise(s["den"]).alias("den"))

    def divide(s: Column, _: Column) -> Column:
        # a number without a divisor up to its root is its own smallest one
        root = F.greatest(F.floor(F.sqrt(s["num"])).cast("int"), F.lit(2))
        smallest = F.coalesce(F.get(F.filter(F.sequence(F.lit(2), root), lambda d: s["num"] % d == 0), F.lit(0)), s["num"])
        return F.struct(
            F.when(s["num"] > max_ratio * s["den"], (s["num"] / smallest).cast("int")).otherwise(s["num"]).alias("num"),
            s["den"].alias("den"))

    return F.aggregate(rounds, F.aggregate(rounds, start, halve), divide)


def bar_grid(signatures: DataFrame, extents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars of each piece from (keys, pos, num, den) changes and (keys, max_pos).

    A change inside a bar cuts the bar.  Without a signature at 0 the piece starts in 4/4.
    Positions are below the start limit, so the per-piece window stays small.
    """
    keys = list(keys)
    # the latest of several signatures at one position wins; 4/4 stands in where none is at 0
    given = signatures.select(*keys, F.col("pos").cast("long").alias("pos"), F.struct("seq_no", "num", "den").alias("s"))
    default = extents.select(*keys, F.lit(0).cast("long").alias("pos"), F.struct(
        F.lit(-1).alias("seq_no"), F.lit(4).alias("num"), F.lit(4).alias("den")).alias("s"))
    points = given.unionByName(default).groupBy(*keys, "pos").agg(F.max("s").alias("s")).select(
        *keys, "pos", reduced_signature(F.col("s.num"), F.col("s.den")).alias("sig"))
    nxt = F.lead("pos").over(Window.partitionBy(*keys).orderBy("pos"))
    length = F.greatest(F.lit(1), F.rint(F.col("sig.num") * 4 * C.POS_PER_QUARTER / F.col("sig.den"))).cast("long")
    spans = (
        points.withColumn("next_pos", nxt).withColumn("len", length)
        .join(extents.select(*keys, "max_pos"), keys)
        .withColumn("stop", F.least(F.coalesce("next_pos", "max_pos"), F.col("max_pos")))
        .where(F.col("pos") < F.col("stop"))
    )
    return spans.withColumn("m_start", F.explode(F.sequence("pos", F.col("stop") - 1, F.col("len")))).select(
        *keys, "m_start",
        F.least(F.col("m_start") + F.col("len"), F.coalesce("next_pos", F.col("m_start") + F.col("len"))).alias("m_end"))


def even_bars(extents: DataFrame, keys: Sequence[str], length: int = 48) -> DataFrame:
    """Equal bars from 0 until max_pos is covered."""
    return extents.where(F.col("max_pos") > 0).withColumn(
        "m_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_pos") - 1, F.lit(length).cast("long")))
    ).select(*keys, "m_start", (F.col("m_start") + length).alias("m_end"))


def bar_sweep(notes: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ordered pass over distinct note starts and bar ends.

    Note starts are first reduced to one row per (keys, st) holding the latest end, so the
    pass is bounded by the position limit however many notes a piece has.  At equal
    positions bars come first: a bar ending where a note starts counts as before it.
    Returns rows with __kind 0 (bar, with ``empty``) and 1 (start, with ``removed``).
    """
    keys = list(keys)
    starts = notes.groupBy(*keys, "st").agg(F.max("en").alias("top")).select(
        *keys, F.col("st").alias("at"), F.lit(1).alias("__kind"), "top", F.lit(None).cast("long").alias("m_start"))
    ends = bars.select(*keys, F.col("m_end").alias("at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("top"), "m_start")
    w = Window.partitionBy(*keys).orderBy("at", "__kind", "m_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.coalesce(F.max("top").over(w), F.lit(-1))
    marked = starts.unionByName(ends).withColumn("empty", (F.col("__kind") == 0) & (seen <= F.col("m_start")))
    cut = F.when(F.col("empty"), F.col("at") - F.col("m_start")).otherwise(F.lit(0))
    return marked.withColumn("removed", F.sum(cut).over(w))


def empty_bars(notes: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars touched by no note of the key (a voice, or a whole piece for the joint form)."""
    return bar_sweep(notes, bars, keys).where("empty").select(*keys, "m_start", F.col("at").alias("m_end"))


def merge_islands(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join touching or overlapping [m_start, m_end) spans."""
    w = Window.partitionBy(*keys).orderBy("m_start", "m_end")
    before = F.max("m_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("fresh", F.when(before >= F.col("m_start"), 0).otherwise(1))
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.withColumn("island", island).groupBy(*keys, "island").agg(
        F.min("m_start").alias("m_start"), F.max("m_end").alias("m_end")).drop("island")


def trim_empty_bars(notes: DataFrame, bars: DataFrame, keys: Sequence[str], bar_keys: Sequence[str] | None = None) -> DataFrame:
    """Drop empty bars and move later notes left; adds ``new_st`` and ``new_en``.

    ``bar_keys`` shorter than ``keys`` gives the joint form: a bar goes only when all voices rest.
    """
    on = list(bar_keys or keys)
    shift = bar_sweep(notes, bars, on).where("__kind = 1").select(*on, F.col("at").alias("st"), "removed")
    new_st = F.col("st") - F.col("removed")
    return notes.join(shift, on + ["st"]).withColumn("new_st", new_st).withColumn(
        "new_en", F.greatest(F.col("en") - F.col("removed"), new_st + 1)).drop("removed")


def note_order(notes: DataFrame, keys: Sequence[str], seed: int, ident: Sequence[str], out: str = "order_idx") -> DataFrame:
    """Time order with a seeded shuffle inside equal onsets, independent of partitioning."""
    mixed = notes.selectExpr("*", f"{hash_of('order', seed, *keys, *ident)} AS __mix")
    return dense_index(mixed, keys, ["st", "__mix", *ident], "st", idx=out).drop("__mix")


def shift_to_zero(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    first = notes.groupBy(*keys).agg(F.min("st").alias("__st0"))
    st = F.col("st") - F.col("__st0")
    return notes.join(first, list(keys)).withColumn("en", F.greatest(F.col("en") - F.col("__st0"), st + 1)).withColumn("st", st).drop("__st0")


def monophonise(notes: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Highest pitch per onset, the longest on ties (then the earliest row)."""
    best = F.max(F.struct("pitch", (F.col("en") - F.col("st")).alias("len"), (-F.col("idx")).alias("neg_idx"), *keep)).alias("b")
    return notes.groupBy(*keys, "st").agg(best).select(
        *keys, "st", F.col("b.pitch").alias("pitch"), (F.col("st") + F.col("b.len")).alias("en"),
        (-F.col("b.neg_idx")).alias("idx"), *[F.col(f"b.{c}").alias(c) for c in keep])


def voice_profile(notes: DataFrame, piece: str, voice: str) -> DataFrame:
    """Size and pitch profile per voice; the exact median counts at most 128 distinct pitches."""
    return notes.groupBy(piece, voice).agg(
        F.count("*").alias("n"), F.median("pitch").alias("median_pitch"), F.max("pitch").alias("max_pitch"))


def pick_voice(profile: DataFrame, piece: str, voice: str, voice_rank: Column, rule: str = "primary") -> DataFrame:
    """primary: most notes, then median, then top pitch.  treble: highest median, then most notes.
    The earlier voice wins a full tie."""
    lead = {"primary": ["n", "median_pitch", "max_pitch"], "treble": ["median_pitch", "n"]}[rule]
    best = F.max(F.struct(*lead, (-voice_rank).alias("r"), voice)).alias("b")
    return profile.groupBy(piece).agg(best).select(piece, *[F.col(f"b.{c}").alias(c) for c in [*lead, voice]])


def dominant_signature(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent (num, den); the lowest pair on ties."""
    per = counts.groupBy(*keys, "num", "den").agg(F.sum("bars").alias("bars"))
    best = F.max(F.struct("bars", (-F.col("num")).alias("a"), (-F.col("den")).alias("b"))).alias("x")
    return per.groupBy(*keys).agg(best).select(
        *keys, (-F.col("x.a")).alias("num"), (-F.col("x.b")).alias("den"), F.col("x.bars").alias("bars"))
