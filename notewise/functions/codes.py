"""Event codes: clipping, vocabulary ids, local ids.  All pure column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise import constants as C


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def tick_to_pos(tick: Column, ticks_per_quarter: Column) -> Column:
    """MIDI ticks to positions, rounding halves to even."""
    return F.rint(tick * C.POS_PER_QUARTER / ticks_per_quarter).cast("int")


def quarters_to_pos(num: Column, den: Column | None = None) -> Column:
    """Quarter lengths (optionally a fraction) to positions, rounding halves to even."""
    q = num if den is None else num / den
    return F.rint(q * C.POS_PER_QUARTER).cast("int")


def dur_code(dur: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("negative duration: "), dur.cast("string"))).cast("int")
    return F.when(dur < 0, bad).otherwise(clamp(dur, 0, C.MAX_DUR).cast("int"))


def dt_code(dt: Column) -> Column:
    return clamp(dt, C.MIN_DT, C.MAX_DT).cast("int")


def pitch_id(pitch: Column) -> Column:
    return F.when(pitch.between(0, C.MAX_PITCH), pitch + C.PITCH_BASE).otherwise(C.UNK).cast("int")


def dur_id(dur: Column) -> Column:
    return F.when(dur.between(0, C.MAX_DUR), dur + C.DUR_BASE).otherwise(C.UNK).cast("int")


def dt_id(dt: Column) -> Column:
    return (
        F.when(dt.between(0, C.MAX_DT), dt + C.DT_BASE)
        .when(dt.between(C.MIN_DT, -1), F.lit(C.DT_NEG_BASE - 1) - dt)
        .otherwise(C.UNK).cast("int")
    )


def _decode(value: Column, inside: Column, gid: Column, what: str, strict: bool) -> Column:
    other = F.raise_error(F.concat(F.lit(f"not a {what} id: "), gid.cast("string"))).cast("int") if strict else F.lit(None)
    return F.when(inside, value).otherwise(other).cast("int")


def pitch_of(gid: Column, strict: bool = False) -> Column:
    return _decode(gid - C.PITCH_BASE, gid.between(C.PITCH_BASE, C.DUR_BASE - 1), gid, "pitch", strict)


def dur_of(gid: Column, strict: bool = False) -> Column:
    return _decode(gid - C.DUR_BASE, gid.between(C.DUR_BASE, C.DT_BASE - 1), gid, "duration", strict)


def dt_of(gid: Column, strict: bool = False) -> Column:
    value = F.when(gid < C.DT_NEG_BASE, gid - C.DT_BASE).otherwise(F.lit(C.DT_NEG_BASE - 1) - gid)
    return _decode(value, gid.between(C.DT_BASE, C.VOCAB_SIZE - 1), gid, "delta-time", strict)


def to_local(gid: Column, attribute: str) -> Column:
    """Global id to the attribute's own id space; specials keep their id, foreign ids are an error."""
    base = {"pitch": C.PITCH_BASE, "dur": C.DUR_BASE, "dt": C.DT_BASE}[attribute]
    upto = {"pitch": C.DUR_BASE, "dur": C.DT_BASE, "dt": C.VOCAB_SIZE}[attribute]
    n = len(C.SPECIALS)
    return (
        F.when(gid.between(0, n - 1), gid)
        .when(gid.between(base, upto - 1), gid - base + n)
        .otherwise(F.raise_error(F.concat(F.lit(f"id outside {attribute}: "), gid.cast("string"))).cast("int")).cast("int")
    )


def to_global(local: Column, attribute: str) -> Column:
    base = {"pitch": C.PITCH_BASE, "dur": C.DUR_BASE, "dt": C.DT_BASE}[attribute]
    n = len(C.SPECIALS)
    return F.when(local < n, local).otherwise(local - n + base).cast("int")


def local_dur_to_pos(local: Column) -> Column:
    """Local duration id to positions; specials last 0."""
    n = len(C.SPECIALS)
    return F.when(local < n, 0).otherwise(F.least(local - n, F.lit(C.MAX_DUR))).cast("int")


def pos_to_local_dur(pos: Column) -> Column:
    """Positions to a local duration id; a note lasts at least one position."""
    return (clamp(pos, 1, C.MAX_DUR) + len(C.SPECIALS)).cast("int")


def local_dt_to_pos(local: Column) -> Column:
    n = len(C.SPECIALS)
    return (
        F.when(local.between(n, n + C.DT_CODES - 1), local - n)
        .when(local.between(n + C.DT_CODES, n + 2 * C.DT_CODES - 1), F.lit(n + C.DT_CODES - 1) - local)
        .otherwise(0).cast("int")
    )


def pos_to_local_dt(pos: Column) -> Column:
    n = len(C.SPECIALS)
    p = clamp(pos, C.MIN_DT, C.MAX_DT)
    return F.when(p >= 0, p + n).otherwise(F.lit(n + C.DT_CODES - 1) - p).cast("int")


def dt_text(dt: Column) -> Column:
    return F.when(dt < 0, F.concat(F.lit("!"), (-dt).cast("string"))).otherwise(dt.cast("string"))


def vocabulary(spark: SparkSession) -> DataFrame:
    """The id table: token, global_id, attr, code, local_id."""
    ids = spark.range(C.VOCAB_SIZE).select(F.col("id").cast("int").alias("global_id"))
    g, n = F.col("global_id"), len(C.SPECIALS)
    attr = (
        F.when(g < C.PITCH_BASE, "special").when(g < C.DUR_BASE, "pitch")
        .when(g < C.DT_BASE, "dur").otherwise("dt")
    )
    code = F.coalesce(pitch_of(g), dur_of(g), dt_of(g))
    slot = F.when(g < C.DUR_BASE, "0").when(g < C.DT_BASE, "1").otherwise("2")
    special = F.element_at(F.array(*[F.lit(s) for s in C.SPECIALS]), F.least(g + 1, F.lit(n)))
    named = F.concat(F.lit("<"), slot, F.lit("-"), F.when(attr == "dt", dt_text(code)).otherwise(code.cast("string")), F.lit(">"))
    local = (
        F.when(g < C.PITCH_BASE, g).when(g < C.DUR_BASE, g - C.PITCH_BASE + n)
        .when(g < C.DT_BASE, g - C.DUR_BASE + n).otherwise(g - C.DT_BASE + n)
    )
    return ids.select(
        F.when(attr == "special", special).otherwise(named).alias("token"),
        "global_id", attr.alias("attr"), code.alias("code"), local.cast("int").alias("local_id"),
    )


def note_ids(notes: Column) -> Column:
    """ARRAY<STRUCT<pitch, dur, dt>> of codes to the same array of global ids."""
    return F.transform(notes, lambda x: F.struct(
        pitch_id(x["pitch"]).alias("pitch"), dur_id(x["dur"]).alias("dur"), dt_id(x["dt"]).alias("dt")))


def same_triple(value: Column | int) -> Column:
    v = F.lit(value) if isinstance(value, int) else value
    v = v.cast("int")
    return F.struct(v.alias("pitch"), v.alias("dur"), v.alias("dt"))


def padded_events(notes: Column, bos_start: Column, length: int = C.MAX_EVENTS) -> Column:
    """BOS + notes + EOS + PAD global-id triples of a fixed length; EOS survives truncation."""
    bos = F.struct(F.lit(C.BOS).alias("pitch"), F.lit(C.BOS).alias("dur"), dt_id(dt_code(bos_start)).alias("dt"))
    body = F.slice(note_ids(notes), 1, length - 2)
    used = F.concat(F.array(bos), body, F.array(same_triple(C.EOS)))
    return F.concat(used, F.array_repeat(same_triple(C.PAD), (F.lit(length) - F.size(used)).cast("int")))


def used_length(events: Column) -> Column:
    """Valid events of a padded array: up to the first EOS, else up to the last non-PAD."""
    pitch = F.transform(events, lambda e: e["pitch"])
    last = F.array_max(F.transform(pitch, lambda p, j: F.when(p != C.PAD, j + 1).otherwise(0)))
    eos = F.array_position(F.slice(pitch, 1, F.greatest(last, F.lit(1))), C.EOS)
    return F.when(eos > 0, eos).otherwise(F.coalesce(last, F.lit(0))).cast("int")


def resolved_length(events: Column, stated: Column, policy: str) -> Column:
    """Length policy: infer, metadata, none, or auto (stated when it fits, else inferred)."""
    size = F.size(events)
    inferred = used_length(events)
    if policy == "none":
        return size
    if policy == "infer":
        return inferred
    fits = stated.between(1, size)
    if policy == "metadata":
        return F.when(fits, stated).otherwise(F.raise_error(F.lit("stated length out of range")).cast("int"))
    return F.when(fits, stated).otherwise(inferred)


def length_mismatch(events: Column, stated: Column) -> Column:
    return stated.isNotNull() & (stated != used_length(events))


def decode_events(events: Column, strict: bool = False) -> Column:
    """Global-id events to code triples: stop at the first EOS, skip specials (or raise)."""
    eos = F.array_position(F.transform(events, lambda e: e["pitch"]), C.EOS)
    upto = F.when(eos > 0, eos - 1).otherwise(F.size(events)).cast("int")
    body = F.filter(F.slice(events, 1, upto), lambda e: ~e["pitch"].isin(C.PAD, C.BOS))
    triples = F.transform(body, lambda e: F.struct(
        pitch_of(e["pitch"], strict).alias("pitch"), dur_of(e["dur"], strict).alias("dur"), dt_of(e["dt"], strict).alias("dt")))
    return F.filter(triples, lambda t: t["pitch"].isNotNull() & t["dur"].isNotNull() & t["dt"].isNotNull())


def bos_anchor(events: Column) -> Column:
    """Start position held by the first BOS row; 0 when there is none."""
    at = F.array_position(F.transform(events, lambda e: e["pitch"]), C.BOS)
    return F.when(at > 0, F.coalesce(dt_of(F.element_at(events, F.greatest(at, F.lit(1)).cast("int"))["dt"]), F.lit(0))).otherwise(0)


def token_line(notes: Column, bos_start: Column) -> Column:
    """Space-separated token text of one sequence."""
    words = F.transform(notes, lambda x: F.concat(
        F.lit("<0-"), x["pitch"].cast("string"), F.lit("> <1-"), x["dur"].cast("string"),
        F.lit("> <2-"), dt_text(x["dt"]), F.lit(">")))
    head = F.concat(F.lit("<s> <s> <2-"), dt_text(dt_code(bos_start)), F.lit(">"))
    return F.concat_ws(" ", head, F.array_join(words, " "), F.lit("</s> </s> </s>"))
