"""Readers for manifests, metadata, pairing tables and metric records.  Schemas are always declared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise import constants as C
from notewise.functions import names
from notewise.operators.ordered import dense_index
from notewise.operators.splits import dense_ids


def score_files(spark: SparkSession, root: str, extensions: Sequence[str] = C.SCORE_EXTENSIONS) -> DataFrame:
    """Recursive file listing by case-insensitive extension; file contents are not read."""
    pattern = r"\.(" + "|".join(extensions) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.where(F.lower("path").rlike(pattern))


def midi_files(spark: SparkSession, root: str) -> DataFrame:
    return score_files(spark, root, ("mid", "midi"))


def class_labels(files: DataFrame, folder: str) -> DataFrame:
    """Volume name of a folder and its dense label over the sorted names."""
    named = files.withColumn("volume", names.volume_name(F.col(folder)))
    labels = dense_ids(named.select("volume").distinct(), ["volume"], "label")
    return named.join(labels, "volume")


def folder_manifest(spark: SparkSession, root: str, extensions: Sequence[str] = ("mid", "midi", "musicxml", "xml")) -> DataFrame:
    """Files of labelled folders: path, label, group."""
    files = score_files(spark, root, extensions)
    labelled = class_labels(files.withColumn("folder", names.parent_name(F.col("path"))), "folder")
    group = F.concat("volume", F.lit("/"), names.anthology_title(names.stem(F.col("path"))))
    return labelled.select("path", "label", group.alias("group"))


def labelled_manifest(spark: SparkSession, path: str, base_dir: str) -> DataFrame:
    """JSON lines with path, label and optional group (default: the file stem)."""
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("group", T.StringType())])
    m = spark.read.schema(schema).json(path).where("path IS NOT NULL")
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), F.col("path")))
    return m.select(full.alias("path"), "label", F.coalesce("group", names.stem(F.col("path"))).alias("group"))


QUERY_META = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("target_doc_id", T.LongType()),
    T.StructField("frag_start_note", T.IntegerType()), T.StructField("frag_len_notes", T.IntegerType()),
    T.StructField("used_len_events", T.IntegerType()), T.StructField("ornament", T.BooleanType()),
    T.StructField("corruption", T.BooleanType())])


def query_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_META).json(path)


CORPUS_META = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("row_idx", T.LongType()), T.StructField("source_file", T.StringType()),
    T.StructField("voice_id", T.StringType()), T.StructField("voice_idx", T.IntegerType()), T.StructField("window_idx", T.IntegerType()),
    T.StructField("window_start_note_idx", T.IntegerType()), T.StructField("bos_start_pos", T.IntegerType()),
    T.StructField("used_len_events", T.IntegerType())])


def corpus_metadata(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Sequence metadata of one split with its stable sequence id."""
    m = spark.read.schema(CORPUS_META).json(path).where(F.col("split") == split)
    return m.withColumn("seq_id", F.concat_ws("#", "source_file", "voice_id", "window_idx"))


def with_metadata(sequences: DataFrame, metadata: DataFrame, key: str = "seq_id") -> DataFrame:
    """Attach metadata to sequences by key; sequences without any keep NULLs."""
    return sequences.join(metadata.select(key, *[c for c in metadata.columns if c not in sequences.columns]), key, "left")


PIECE_META = T.StructType([
    T.StructField("piece", T.StringType()), T.StructField("row_idx", T.LongType()),
    T.StructField("time_signature", T.ArrayType(T.IntegerType())), T.StructField("n_notes_kept", T.IntegerType())])


def benchmark_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Piece records; a missing row_idx falls back to the line order of the file."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(
        F.from_json("value", PIECE_META).alias("r"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("line"))
    numbered = dense_index(lines, ["f"], ["line"], "shiftright(line, 33)", idx="line_no")
    return numbered.select(
        F.col("r.piece").alias("piece"), F.coalesce("r.row_idx", "line_no").alias("row_idx"),
        F.get("r.time_signature", F.lit(0)).alias("ts_num"), F.get("r.time_signature", F.lit(1)).alias("ts_den"),
        F.col("r.n_notes_kept").alias("n_notes_kept"))


def two_column_csv(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Header-less two-column CSV: byte-order mark removed, values trimmed, blank rows dropped."""
    schema = T.StructType([T.StructField(first, T.StringType()), T.StructField(second, T.StringType())])
    raw = spark.read.schema(schema).csv(path, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    clean = lambda c: F.trim(F.regexp_replace(c, "^﻿", ""))
    return raw.select(clean(first).alias(first), clean(second).alias(second)).where(
        (F.coalesce(F.length(first), F.lit(0)) > 0) & (F.coalesce(F.length(second), F.lit(0)) > 0))


def metric_records(spark: SparkSession, glob: str, pattern: str = r"seed(\d+)/([^/]+)/") -> DataFrame:
    """Flat JSON metric maps, one file per run; seed and variant come from the path."""
    files = spark.read.option("wholetext", "true").text(glob).select(
        F.input_file_name().alias("file"), F.from_json("value", T.MapType(T.StringType(), T.DoubleType())).alias("m"))
    return files.select(
        F.regexp_extract("file", pattern, 1).alias("seed"), F.regexp_extract("file", pattern, 2).alias("variant"),
        F.explode("m").alias("metric", "value"))


TRACK = T.StructType([
    T.StructField("track", T.StringType()), T.StructField("count", T.LongType()), T.StructField("sum", T.DoubleType()),
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])


def split_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Roll up per-split track statistics; unreadable records are left out."""
    r = spark.read.schema(TRACK).option("mode", "PERMISSIVE").json(path).where("track IS NOT NULL")
    return r.groupBy("track").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum("sum") / F.greatest(F.sum("count"), F.lit(1))).alias("mean"))
