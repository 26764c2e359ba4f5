"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise import constants as C
from notewise.functions import codes


def summary(value: Column, name: str, digits: int = 6) -> list[Column]:
    """Mergeable count, sum, min, max and mean of one track."""
    return [
        F.count(value).alias(f"{name}_count"), F.sum(value).alias(f"{name}_sum"), F.min(value).alias(f"{name}_min"),
        F.max(value).alias(f"{name}_max"), F.round(F.avg(value), digits).alias(f"{name}_mean")]


def span_of(notes: Column) -> Column:
    """Latest end of a packed sequence whose clock runs by dur + max(dt, -dur)."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("top"))
    return F.aggregate(notes, zero, lambda s, x: F.struct(
        (s["at"] + F.greatest(x["dur"], F.lit(1)) + F.greatest(x["dt"], -F.greatest(x["dur"], F.lit(1)))).cast("long").alias("at"),
        F.greatest(s["top"], s["at"] + F.greatest(x["dur"], F.lit(1))).cast("long").alias("top")), lambda s: s["top"])


def seconds(pos: Column, bpm: float = 120.0) -> Column:
    return pos / float(C.POS_PER_QUARTER) * (60.0 / bpm)


def duration_text(secs: Column) -> Column:
    """1d02h03m04s; leading zero units are left out."""
    total = F.rint(secs).cast("long")
    d, h = F.floor(total / 86400), F.floor(total % 86400 / 3600)
    m, s = F.floor(total % 3600 / 60), total % 60
    return (
        F.when(d > 0, F.format_string("%dd%02dh%02dm%02ds", d, h, m, s))
        .when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s))
        .when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s)))


def export_stats(sequences: DataFrame, split: str = "split", bpm: float = 120.0) -> DataFrame:
    """Sequence, event, note, span and time statistics per split and over all (one rollup)."""
    m = sequences.select(split, F.size("notes").alias("n"), span_of(F.col("notes")).alias("span"))
    rolled = m.rollup(split).agg(
        F.count("*").alias("sequences"), F.sum(F.col("n") + 2).alias("events_sum"),
        F.sum("n").alias("notes_sum"), F.min("n").alias("notes_min"), F.max("n").alias("notes_max"),
        F.round(F.avg("n"), 6).alias("notes_mean"),
        F.sum("span").alias("span_sum"), F.min("span").alias("span_min"), F.max("span").alias("span_max"),
        F.round(F.avg("span"), 6).alias("span_mean"))
    return rolled.select(
        F.coalesce(split, F.lit("all")).alias("split"), *[c for c in rolled.columns if c != split],
        F.round(seconds(F.col("span_sum"), bpm), 6).alias("seconds_sum"))


def file_accounting(files: DataFrame, sequences: DataFrame, file: str, split: str, error: Column | None = None) -> DataFrame:
    """Per split: files assigned, failed (``error``), and of the others those with and without sequences."""
    has = sequences.select(file).distinct().withColumn("__has", F.lit(True))
    bad = F.lit(False) if error is None else error
    j = files.join(has, file, "left").withColumn("__has", F.coalesce("__has", F.lit(False))).withColumn("__bad", F.coalesce(bad, F.lit(False)))
    return j.groupBy(split).agg(
        F.count("*").alias("assigned"), F.count_if(F.col("__bad")).alias("error"),
        F.count_if(F.col("__has") & ~F.col("__bad")).alias("with_sequences"),
        F.count_if(~F.col("__has") & ~F.col("__bad")).alias("zero_sequences"))


def token_counts(sequences: DataFrame, bos: str = "bos") -> DataFrame:
    """Count of each vocabulary id over BOS, notes and EOS; the 421-row vocabulary is the spine."""
    ids = codes.note_ids(F.col("notes"))
    flat = F.flatten(F.transform(ids, lambda x: F.array(x["pitch"], x["dur"], x["dt"])))
    head = F.array(F.lit(C.BOS), F.lit(C.BOS), codes.dt_id(codes.dt_code(F.col(bos))))
    tail = F.array_repeat(F.lit(C.EOS), 3)
    counted = sequences.select(F.explode_outer(F.concat(head, flat, tail)).alias("global_id")).groupBy("global_id").agg(
        F.count("*").alias("n"))
    vocab = codes.vocabulary(sequences.sparkSession).select("token", "global_id")
    return vocab.join(counted, "global_id", "left").select("token", "global_id", F.coalesce("n", F.lit(0)).alias("n"))


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Half-open bin [edge j, edge j+1) of a value; NULL outside."""
    expr = None
    for j in range(len(edges) - 1):
        cond = (value >= F.lit(float(edges[j]))) & (value < F.lit(float(edges[j + 1])))
        expr = F.when(cond, F.lit(j)) if expr is None else expr.when(cond, F.lit(j))
    return expr


def binned(df: DataFrame, value: Column, edges: Sequence[float], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate per bin; bins without rows appear with NULL means and n = 0."""
    spark = df.sparkSession
    spine = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    per = df.withColumn("bin", bin_index(value, edges)).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), *aggs)
    return spine.join(per, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_weight(labels: DataFrame, positive: Column, cap: float) -> DataFrame:
    """Weight pos/neg of the negative class clipped to [1, cap], and total/pos."""
    pos, total = F.count_if(positive), F.count("*")
    neg = F.greatest(total - pos, F.lit(1))
    return labels.agg(
        pos.alias("pos"), (total - pos).alias("neg"),
        F.round(F.least(F.greatest(pos / neg, F.lit(1.0)), F.lit(float(cap))), 9).alias("neg_weight"),
        F.round(total / F.greatest(pos, F.lit(1)), 9).alias("total_per_pos"))


def confusion(pairs: DataFrame, truth: str, guess: str, n_classes: int) -> DataFrame:
    """Class-by-class counts on a full n_classes x n_classes spine."""
    spark = pairs.sparkSession
    spine = spark.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).cast("int").alias(truth), (F.col("id") % n_classes).cast("int").alias(guess))
    counts = pairs.groupBy(F.col(truth).cast("int").alias(truth), F.col(guess).cast("int").alias(guess)).agg(F.count("*").alias("n"))
    return spine.join(counts, [truth, guess], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def macro_scores(pairs: DataFrame, truth: str, guess: str, n_classes: int) -> DataFrame:
    """Accuracy and macro F1 (mean over all classes, absent ones score 0)."""
    counts = confusion(pairs, truth, guess, n_classes)
    both = F.explode(F.array(
        F.struct(F.col(truth).alias("c"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col(guess).alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"))))
    per = counts.select(both.alias("x")).groupBy("x.c").agg(
        F.sum("x.tp").alias("tp"), F.sum("x.actual").alias("actual"), F.sum("x.said").alias("said"))
    f1 = 2 * F.col("tp") / F.greatest((F.col("actual") + F.col("said")).cast("double"), F.lit(1e-8))
    return per.agg(
        F.sum("actual").alias("n"), F.round(F.sum("tp") / F.greatest(F.sum("actual").cast("double"), F.lit(1e-8)), 9).alias("accuracy"),
        F.round(F.avg(f1), 9).alias("macro_f1"))


def metric_summary(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over runs, non-finite values left out."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return metrics.groupBy(*by).agg(
        F.round(F.avg(v), 9).alias("mean"), F.round(F.stddev_samp(v), 9).alias("std"), F.count(v).alias("n"))


def perplexity(metrics: DataFrame, by: Sequence[str], weights: dict[str, float], clip: float = 20.0) -> DataFrame:
    """exp of the (clipped) cross-entropy per attribute and their weighted geometric mean."""
    total = sum(weights.values())
    ce = F.least(F.col("value"), F.lit(clip))
    w = F.lit(0.0)
    for name, share in weights.items():
        w = w + F.when(F.col("metric") == name, F.lit(share / total)).otherwise(0.0)
    cols = [F.round(F.max(F.when(F.col("metric") == name, F.exp(ce))), 6).alias(f"ppl_{name}") for name in weights]
    return metrics.where(F.col("metric").isin(*weights)).groupBy(*by).agg(
        *cols, F.round(F.exp(F.sum(w * ce)), 6).alias("ppl"))
