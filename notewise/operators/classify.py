"""Keep-or-ornament classifier of notes: window features and a distributed logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.operators.ordered import over

FEATURES = ("f_dur", "f_prev_dur", "f_next_dur", "f_share", "f_up", "f_down", "f_beat", "f_eighth", "f_gap", "f_prev_gap", "f_same")


def with_features(rows: DataFrame, keys: Sequence[str], unit: int = 12) -> DataFrame:
    """Local features of each note from its neighbours; rows hold keys, i, pitch, dur, dt, onset."""
    w = over(keys, ["i"])
    near = rows.selectExpr(
        "*", f"coalesce(lag(dur) {w}, dur) AS __d0", f"coalesce(lead(dur) {w}, dur) AS __d1", f"coalesce(pitch - lag(pitch) {w}, 0) AS __p0",
        f"coalesce(lead(pitch) {w} - pitch, 0) AS __p1", f"coalesce(lag(dt) {w}, 0) AS __g0")
    out = near.selectExpr(
        "*", "ln(1D + dur) AS f_dur", "ln(1D + __d0) AS f_prev_dur", "ln(1D + __d1) AS f_next_dur", "dur / CAST(__d0 + dur + __d1 AS DOUBLE) AS f_share",
        "least(abs(__p0), 12) / 12D AS f_up", "least(abs(__p1), 12) / 12D AS f_down", f"CASE WHEN pmod(onset, {unit}) = 0 THEN 1D ELSE 0D END AS f_beat",
        f"CASE WHEN pmod(onset, {unit // 2}) = 0 THEN 1D ELSE 0D END AS f_eighth", "least(greatest(dt, -12), 12) / 12D AS f_gap",
        "least(greatest(__g0, -12), 12) / 12D AS f_prev_gap", "CASE WHEN __p0 = 0 THEN 1D ELSE 0D END AS f_same")
    return out.drop("__d0", "__d1", "__p0", "__p1", "__g0")


def fit(rows: DataFrame, label: str = "label", cap: float = 10.0, iterations: int = 20) -> PipelineModel:
    """Logistic regression on the features; dropped notes weigh clip(kept/dropped, 1, cap)."""
    kept, n = rows.agg(F.sum(label), F.count("*")).first()
    weight = min(max((kept or 0) / max(n - (kept or 0), 1), 1.0), cap)
    train = rows.selectExpr("*", f"CAST({label} AS DOUBLE) AS __y", f"CASE WHEN {label} = 1 THEN 1D ELSE {weight!r}D END AS __w")
    model = LogisticRegression(featuresCol="__f", labelCol="__y", weightCol="__w", maxIter=iterations, regParam=1e-4, probabilityCol="__prob",
                               rawPredictionCol="__raw", predictionCol="__guess")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="__f"), model]).fit(train)


def keep_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``score``: the probability that a note is kept."""
    scored = model.transform(rows).withColumn("score", vector_to_array("__prob")[1])
    return scored.drop("__f", "__prob", "__raw", "__guess", "__y", "__w")
