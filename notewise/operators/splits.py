"""Leak-free group splits and stratified splits, in hash order and without a global window over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise import constants as C
from notewise.functions.draws import HASH_MODULUS, hash_of
from notewise.operators.ordered import dense_index
from notewise.session import checkpointed

HASH_BUCKETS = 4096


BUCKET = f"__h div {HASH_MODULUS // HASH_BUCKETS + 1}"


def group_split(items: DataFrame, group: str, seed: int, ratios: Sequence[float] = C.SPLIT_RATIOS) -> DataFrame:
    """Give every group to one split: in hash order groups fill train, then valid, by item count.

    A group joins while the count before it is below the target, so a split may overshoot
    by one group.  Adds ``split`` to the items.
    """
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    sizes = items.groupBy(group).agg(F.count("*").alias("__size"))
    hashed = sizes.selectExpr("*", f"{hash_of('split', seed, group)} AS __h")
    ranked = dense_index(hashed, [], ["__h", group], BUCKET, idx="__before", total="__all", weight="__size")
    in_train = F.col("__before") < F.rint(F.col("__all") * ratios[0])
    train_total = ranked.agg(F.max(F.when(in_train, F.col("__before") + F.col("__size")))).first()[0] or 0
    in_valid = F.col("__before") - F.lit(train_total) < F.rint(F.col("__all") * ratios[1])
    assigned = ranked.select(group, F.when(in_train, "train").when(in_valid, "valid").otherwise("test").alias("split"))
    return items.join(assigned, group)


def stratified_split(items: DataFrame, label: str | None, ident: str, seed: int, ratio: float) -> DataFrame:
    """Per label round(n * ratio) test items, between 1 and n - 1; none when the label has one item.

    ``label`` None treats all items as one stratum.  Adds ``is_test``.
    """
    keys = [label] if label else []
    hashed = items.selectExpr("*", f"{hash_of('strata', seed, ident)} AS __h")
    ranked = dense_index(hashed, keys, ["__h", ident], BUCKET, idx="__rank", total="__n")
    quota = F.when(F.col("__n") < 2, 0).otherwise(
        F.least(F.greatest(F.rint(F.col("__n") * ratio), F.lit(1)), F.col("__n") - 1))
    return ranked.withColumn("is_test", F.col("__rank") < quota).drop("__h", "__rank", "__n")


def dense_ids(items: DataFrame, order: Sequence[str], out: str = "doc_id") -> DataFrame:
    """Ids 0.. in a sort order, without a window over rows.

    Rows are dealt to sampled ranges of the order and sorted there; written down, partitions keep their rows, so
    a row's id is its place in the partition plus the number of rows in those before.  Only that number reaches the
    driver, once a partition.  Equal rows share a range.
    """
    ranged = checkpointed(items.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.select("*", F.spark_partition_id().alias("__part"), place.alias("__place"))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["__part"], before))
        before += r["n"]
    base = items.sparkSession.createDataFrame(offsets, "__part int, __base bigint")
    return placed.join(F.broadcast(base), "__part").select(*items.columns, (F.col("__base") + F.col("__place")).alias(out))


def capped_windows(windows: DataFrame, file: str, voice: str, per_voice: int = 0, per_file: int = 0) -> DataFrame:
    """Keep the first windows of each voice and of each file (0 = no limit), in (voice, window) order.

    The rank filter reaches every input partition first, so a busy file sends few rows.
    """
    out = windows
    if per_voice:
        out = out.where(F.col("w") < per_voice)
    if per_file:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(file).orderBy(voice, "w"))).where(
            F.col("__r") <= per_file).drop("__r")
    return out
