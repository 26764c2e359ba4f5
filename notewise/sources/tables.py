"""Melody, word and label tables derived from the supplied Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewise.operators.ordered import dense_index, pack, to_windows
from notewise.session import checkpointed

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def melody_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user is one piece: doc, idx, n, pitch, st, en, dur, raw dt, event type."""
    raw = table(spark, sf_dir, "events").selectExpr(
        "user_id AS doc", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "event_id", "event_type AS kind",
        "48 + CAST(floor(value) AS INT) % 37 AS pitch",
        "1 + CAST(get_json_object(props, '$.k') AS INT) % 24 AS dur")
    numbered = dense_index(
        raw, ["doc"], ["us", "event_id"], f"us div {MINUTE_US}",
        total="n", first_of=("us", "us0"), next_of=("us", "us1"))
    return numbered.selectExpr(
        "doc", "idx", "n", "pitch", f"(us - us0) div {HOUR_US} AS st", "dur", "kind", f"(us1 - us0) div {HOUR_US} AS st1"
    ).selectExpr("doc", "idx", "n", "pitch", "st", "st + dur AS en", "dur", "coalesce(st1 - st - dur, 0L) AS dt", "kind")


def melody_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed notes in long form: doc, w, i, wlen and the note columns, dt clipped."""
    rows = to_windows(melody_notes(spark, sf_dir))
    return rows.selectExpr("doc", "w", "concat_ws('#', doc, w) AS seq", "i", "wlen", "pitch", "st", "en", "dur",
                           "CAST(greatest(-96, least(95, dt)) AS INT) AS dt", "kind")


def melody_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed windows: doc, w, seq, bos, kinds, notes ARRAY<STRUCT<pitch, dur, dt>>, at most 512 notes."""
    packed = pack(melody_rows(spark, sf_dir), ["doc", "w"], ["pitch", "dur", "dt", "st", "kind"])
    return packed.selectExpr(
        "doc", "w", "concat_ws('#', doc, w) AS seq", "notes[0].st AS bos", "notes.kind AS kinds",
        "transform(notes, x -> struct(x.pitch AS pitch, x.dur AS dur, x.dt AS dt)) AS notes")


def melody_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus written once to the checkpoint folder, for jobs that read it several times."""
    return checkpointed(pack(melody_rows(spark, sf_dir), ["doc", "w"], ["pitch", "dur", "dt"]))


def shipment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier as a long sequence: supp, idx, n, order and line keys."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS supp", "l_orderkey AS okey", "l_linenumber AS line",
        "unix_micros(CAST(l_shipdate AS TIMESTAMP)) AS us", "l_quantity AS qty")
    return dense_index(li, ["supp"], ["us", "okey", "line", "qty"], f"us div {24 * HOUR_US}", total="n").drop("us")


def document_words(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Whole texts as arrays of lower-case words."""
    return table(spark, sf_dir, name).select(key, "text").selectExpr(
        f"{key} AS doc_id", r"split(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' '))), ' ') AS words")
