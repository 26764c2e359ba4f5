"""Readers of written corpora, aligned pairs and gold tables."""

from __future__ import annotations

import dataclasses
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.functions import codes

Config = TypeVar("Config")


def configured(base: Config, overrides: dict) -> Config:
    """A settings dataclass with the known fields of a JSON object applied; unknown names are ignored."""
    known = {f.name for f in dataclasses.fields(base)}
    return dataclasses.replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in overrides.items() if k in known})


def read_corpus(spark: SparkSession, path: str, split: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """A written corpus, pruned to one split and to the key range [low, high) when given."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if low is not None:
        df = df.where(F.col("seq") >= low)
    return df if high is None else df.where(F.col("seq") < high)


def with_local_ids(sequences: DataFrame, out: str = "local") -> DataFrame:
    """Notes as per-attribute local ids."""
    ids = codes.note_ids(F.col("notes"))
    local = F.transform(ids, lambda x: F.struct(
        codes.to_local(x["pitch"], "pitch").alias("pitch"), codes.to_local(x["dur"], "dur").alias("dur"), codes.to_local(x["dt"], "dt").alias("dt")))
    return sequences.withColumn(out, local)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Aligned pairs; missing lengths and rho are derived (BOS and EOS counted)."""
    df = spark.read.parquet(path)
    derived = {"len_x": "size(x) + 2", "len_x_orn": "size(x_orn) + 2", "rho": "len_x / CAST(greatest(len_x_orn, 1) AS DOUBLE)"}
    for name, expr in derived.items():
        df = df.withColumn(name, F.expr(f"coalesce({name}, {expr})" if name in df.columns else expr))
    return df


def pair_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of aligned pairs: one row per ornamented note with its label."""
    return pairs.selectExpr(*keys, "pi", "posexplode(x_orn) AS (i, x)").selectExpr(
        *keys, "i", "pi[i] AS pi", "CASE WHEN pi[i] >= 0 THEN 1 ELSE 0 END AS label", "x.pitch", "x.dur", "x.dt")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Hierarchy gold: piece, i, depth, score; notes without a depth are left out of the evaluation."""
    df = spark.read.parquet(path)
    score = "coalesce(score, exp(-CAST(depth AS DOUBLE)))" if "score" in df.columns else "exp(-CAST(depth AS DOUBLE))"
    return df.where("depth >= 0").selectExpr("piece", "note_idx AS i", "depth", f"{score} AS gold")
