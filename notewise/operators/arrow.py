"""Runs a function over bounded packed sequences in Arrow batches; no shuffle, nothing collected."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from notewise.functions.draws import hash_of


def map_sequences(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], outputs: dict[str, str],
                  fn: Callable[..., Sequence], seed: int | None = None, op: str = "arrow") -> DataFrame:
    """Apply ``fn(*inputs)`` to every row; it returns one value per output column.

    Inputs are columns of the frame (arrays arrive as NumPy).  With a ``seed`` the function first
    receives a generator seeded by the row's keys, so results do not depend on the batches.
    """
    keys, inputs = list(keys), list(inputs)
    seeded = seed is not None
    src = df.selectExpr(*keys, *inputs, *([f"{hash_of(op, seed, *keys)} AS __seed"] if seeded else []))
    fields = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields} | outputs
    names = list(outputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [batch[c].to_list() for c in inputs]
            rngs = [np.random.default_rng(int(s)) for s in batch["__seed"]] if seeded else None
            rows = []
            for k, args in enumerate(zip(*cells)):
                rows.append(fn(rngs[k], *args) if seeded else fn(*args))
            out = {c: batch[c].to_numpy() for c in keys}
            out |= {c: [r[j] for r in rows] for j, c in enumerate(names)}
            yield pd.DataFrame(out, columns=[*keys, *names])

    return src.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in fields.items()))


def zipped(pitch: str, dur: str, dt: str) -> str:
    """Three parallel arrays back to ARRAY<STRUCT<pitch, dur, dt>>."""
    return f"transform({pitch}, (v, j) -> struct(v AS pitch, {dur}[j] AS dur, {dt}[j] AS dt))"
