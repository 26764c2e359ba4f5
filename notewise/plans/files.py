"""Queries over written corpora: every one writes to the shared folder and reads back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from notewise.plans.notes import USERS, _split_sql, split_pieces
from notewise.plans.oracle import ROWS, ctes
from notewise.plans.registry import query
from notewise.session import shared_folder
from notewise.sources import corpora, sinks, tables


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@query(ctes(ROWS, _split_sql(11, USERS)) + """SELECT split, doc, w, count(*) AS n_notes, CAST(sum(pitch + CASE WHEN split = 'valid' THEN 1 ELSE 0 END) AS BIGINT) AS pitch_sum
FROM rows_ JOIN sp ON grp = doc % 40 GROUP BY split, doc, w""")
def corpus_round_trip(spark, sf):
    """A corpus written by split, its validation split alone replaced by transposed sequences, then read split by split."""
    path = _fresh(spark, "corpus")
    corpus = tables.melody_sequences(spark, sf).join(split_pieces(spark, sf).select("doc", "split"), "doc")
    sinks.write_corpus(corpus, path)
    up = corpora.read_corpus(spark, path, "valid").withColumn("notes", F.transform("notes", lambda x: x.withField("pitch", x["pitch"] + 1)))
    draft = _fresh(spark, "draft")
    sinks.write_corpus(up, draft)
    sinks.replace_split(spark.read.parquet(draft), path, "valid")
    parts = [corpora.read_corpus(spark, path, s) for s in ("train", "valid", "test")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.selectExpr("split", "doc", "w", "size(notes) AS n_notes", "aggregate(notes.pitch, 0L, (a, p) -> a + p) AS pitch_sum")


@query(ctes(ROWS) + """SELECT doc, w, n_notes, CASE WHEN n_notes < 60 THEN 'too_short' WHEN high - low < 35 THEN 'narrow_range' END AS skip_reason
FROM (SELECT doc, w, count(*) AS n_notes, max(pitch) AS high, min(pitch) AS low FROM rows_ GROUP BY doc, w)""")
def dead_letters(spark, sf):
    """Accepted and rejected sequences, written apart in one evaluation and read back with their reasons."""
    judged = tables.melody_sequences(spark, sf).selectExpr("doc", "w", "notes", """CASE WHEN size(notes) < 60 THEN 'too_short'
        WHEN array_max(notes.pitch) - array_min(notes.pitch) < 35 THEN 'narrow_range' END AS skip_reason""")
    good, rejected = _fresh(spark, "good"), _fresh(spark, "rejected")
    sinks.write_with_rejects(judged, good, rejected)
    kept = spark.read.parquet(good).selectExpr("doc", "w", "size(notes) AS n_notes", "CAST(NULL AS STRING) AS skip_reason")
    lost = spark.read.schema("doc long, w long, notes array<struct<pitch: int>>, skip_reason string").json(rejected)
    return kept.unionByName(lost.selectExpr("doc", "w", "size(notes) AS n_notes", "skip_reason"))
