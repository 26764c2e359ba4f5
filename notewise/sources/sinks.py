"""Writers.  Every writer refuses an existing folder unless told to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from notewise.functions import codes, names


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_corpus(sequences: DataFrame, path: str, overwrite: bool = False) -> None:
    """Sequences (with any label columns) partitioned by split, unpadded."""
    sequences.write.mode(_mode(overwrite)).partitionBy("split").parquet(path)


def replace_split(sequences: DataFrame, path: str, split: str) -> None:
    """Overwrite one split of a written corpus; the others stay untouched.  ``sequences`` must not be read from that split itself."""
    sequences.where(F.col("split") == split).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def write_padded(sequences: DataFrame, path: str, length: int, bos: str = "bos", overwrite: bool = False) -> None:
    """Fixed-length global-id events for array consumers."""
    events = codes.padded_events(F.col("notes"), F.col(bos), length)
    sequences.withColumn("events", events).drop("notes").write.mode(_mode(overwrite)).parquet(path)


def write_split_lists(files: DataFrame, column: str, path: str, overwrite: bool = False) -> None:
    """One row per file and split, in split and path order inside each split's folder."""
    files.select("split", column).repartitionByRange("split", column).sortWithinPartitions("split", column).write.mode(
        _mode(overwrite)).partitionBy("split").json(path)


def write_token_lines(sequences: DataFrame, path: str, bos: str = "bos", overwrite: bool = False) -> None:
    sequences.select(codes.token_line(F.col("notes"), F.col(bos)).alias("value")).write.mode(_mode(overwrite)).text(path)


def write_counts(counts: DataFrame, path: str, overwrite: bool = False) -> None:
    """Vocabulary file: token, blank, count per line."""
    counts.select("token", "n").write.mode(_mode(overwrite)).csv(path, sep=" ", quote="")


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).json(path)


def write_with_rejects(df: DataFrame, good: str, rejected: str, overwrite: bool = False) -> dict[str, int]:
    """Rows without a skip_reason go to the result, the others with their reason to JSON lines; returns both counts.

    The rows are evaluated once, kept between the two writes and recomputed if an executor is lost; the writes themselves count.
    """
    kept = df.persist()
    counts = {"good": Observation(), "rejected": Observation()}
    try:
        for name, rows in (("good", kept.where("skip_reason IS NULL").drop("skip_reason")), ("rejected", kept.where("skip_reason IS NOT NULL"))):
            out = rows.observe(counts[name], F.count(F.lit(1)).alias("n")).write.mode(_mode(overwrite))
            out.parquet(good) if name == "good" else out.json(rejected)
    finally:
        kept.unpersist()
    return {name: seen.get.get("n", 0) for name, seen in counts.items()}


def keywords(files: DataFrame, column: str) -> DataFrame:
    """Distinct words of the file stems in order."""
    words = files.select(F.explode(F.split(F.trim(names.stem(F.col(column))), r"\s+")).alias("word"))
    return words.where("word <> ''").distinct().orderBy("word")


def write_keywords(files: DataFrame, column: str, path: str, overwrite: bool = False) -> None:
    keywords(files, column).select(F.col("word").alias("value")).write.mode(_mode(overwrite)).text(path)
