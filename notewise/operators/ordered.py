"""Row numbers, running totals and sliding windows over long keyed sequences.

One piece may hold a large share of all rows, so no window here is partitioned by
the piece alone.  The order is first cut into coarse buckets (an order-preserving
function of the leading order column, e.g. the minute of a timestamp).  Rows are only
sorted inside (piece, bucket); the piece-wide prefix runs over one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise import constants as C


def over(keys: Sequence[str], order: Sequence[str] = (), frame: str = "") -> str:
    """SQL window clause."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    by = f" ORDER BY {', '.join(order)}" if order else ""
    return f"OVER ({part}{by} {frame})"


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    coarse: str,
    *,
    idx: str = "idx",
    total: str | None = None,
    weight: str | None = None,
    first_of: tuple[str, str] | None = None,
    next_of: tuple[str, str] | None = None,
) -> DataFrame:
    """Zero-based position of each row within its keys, by a two-level prefix sum.

    ``order`` and ``coarse`` are SQL expressions.

    ``total``     also adds the number of rows (or weight) of the keys
    ``weight``    makes ``idx`` an exclusive running sum of the weight
    ``first_of``  (column, name): smallest value of a column over the keys
    ``next_of``   (column, name): the column in the following row; it must not
                  decrease along the order
    """
    keys = list(keys)
    cols = df.columns
    tagged = df.selectExpr("*", f"{coarse} AS __bucket")
    buckets = tagged.groupBy(*keys, "__bucket").agg(
        F.expr(f"CAST(sum({weight or 1}) AS BIGINT) AS __n"),
        *([F.expr(f"min({first_of[0]}) AS __first")] if first_of else []),
        *([F.expr(f"min({next_of[0]}) AS __lo")] if next_of else []),
    ).selectExpr(
        *keys, "__bucket",
        f"coalesce(sum(__n) {over(keys, ['__bucket'], BEFORE)}, 0) AS __base",
        *([f"sum(__n) {over(keys)} AS {total}"] if total else []),
        *([f"min(__first) {over(keys)} AS {first_of[1]}"] if first_of else []),
        *([f"lead(__lo) {over(keys, ['__bucket'])} AS __next_lo"] if next_of else []),
    )
    inner = [*keys, "__bucket"]
    local = f"row_number() {over(inner, order)} - 1" if weight is None else f"coalesce(sum({weight}) {over(inner, order, BEFORE)}, 0)"
    rows = tagged.selectExpr(
        "*", f"CAST({local} AS BIGINT) AS __local",
        *([f"lead({next_of[0]}) {over(inner, order)} AS __next"] if next_of else []))
    return rows.join(buckets, inner).selectExpr(
        *cols, f"__base + __local AS {idx}", *([total] if total else []), *([first_of[1]] if first_of else []),
        *([f"coalesce(__next, __next_lo) AS {next_of[1]}"] if next_of else []))


def to_windows(
    df: DataFrame,
    *,
    idx: str = "idx",
    total: str = "n",
    size: int = C.WINDOW_NOTES,
    step: int = C.WINDOW_STEP,
    min_len: int = C.WINDOW_MIN_NOTES,
) -> DataFrame:
    """Assign each row to the sliding windows that hold it: adds ``w``, ``i`` and ``wlen``.

    Window w starts at w*step.  A window is dropped when it is shorter than ``min_len`` or
    when the window before it already reached the end.  Every (key, w) has at most ``size`` rows.
    """
    reach = -(-size // step)
    choices = ", ".join(f"{idx} div {step} - {j}" for j in range(reach))
    return df.selectExpr("*", f"explode(array({choices})) AS w").where(
        f"w >= 0 AND {idx} < w * {step} + {size} AND (w = 0 OR (w - 1) * {step} + {size} < {total}) "
        f"AND least({size}, {total} - w * {step}) >= {min_len}"
    ).selectExpr("*", f"least({size}L, {total} - w * {step}) AS wlen", f"CAST({idx} - w * {step} AS INT) AS i")


def window_table(
    voices: DataFrame,
    *,
    total: str = "n",
    size: int = C.WINDOW_NOTES,
    step: int = C.WINDOW_STEP,
    min_len: int = C.WINDOW_MIN_NOTES,
) -> DataFrame:
    """Windows of each voice from its length alone: adds ``w``, ``w_start`` and ``wlen``."""
    last = f"CAST(greatest(0, ceil(({total} - {size}) / {step})) AS INT)"
    return voices.where(f"{total} >= {min_len}").selectExpr("*", f"explode(sequence(0, {last})) AS w").selectExpr(
        "*", f"w * {step} AS w_start", f"least({size}L, {total} - w * {step}) AS wlen").where(f"wlen >= {min_len}")


def pack(df: DataFrame, keys: Sequence[str], fields: Sequence[str], *, pos: str = "i", out: str = "notes") -> DataFrame:
    """Collect bounded groups into position-ordered arrays of structs (no padding)."""
    inner = ", ".join(fields)
    taken = ", ".join(f"x.{f} AS {f}" for f in fields)
    packed = df.groupBy(*keys).agg(F.expr(f"array_sort(collect_list(struct({pos}, {inner}))) AS __packed"))
    return packed.selectExpr(*keys, f"transform(__packed, x -> struct({taken})) AS {out}")
