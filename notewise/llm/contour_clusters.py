"""Clusters of contour vectors around centroids, with squared differences looked up in scalar tables."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.value_blocks import assigned, integers, long_sum, refined, usable_vectors, vector_blocks
from notewise.session import checkpointed

CENTROIDS = 40
ROUNDS = 5


def contour_clusters(sequences: DataFrame, piece: str = "piece", contour: str = "contour", width: int = 64, scale: int = 256,
                     centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2) -> DataFrame:
    """The nearest of ``centroids`` centroids of each contour vector, in integers.

    ``sequences`` holds a ``piece`` key and a ``contour`` vector per row; vectors of exactly ``width`` finite components take part, as
    floor(scale x).  Centroids start as the vectors of the pieces with the smallest SHA-256 of ``seed:piece``, in that order.  Each
    round assigns every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces
    centroids by the componentwise floor(sum / count) of their vectors; empty ones stay; then vectors are assigned once more.
    Returns per vector the key, ``cluster`` (int), ``distance``, ``cluster_inertia`` and ``inertia`` (distances summed over the cluster
    and over all) and ``centroid_sha256`` (the final centroid's components, comma-joined).

    Rows that repeat a piece all take part (as first centroids in the order of their vectors); null keys are never first centroids
    while other rows are left.  With fewer vectors than centroids all are centroids; without any the result is empty.  Integers are
    clipped so that distances fit a long (about 9e7 for 64 components).  Other columns are not looked at.

    In every round each block has one table (occurring integer x centroid) a dimension, and distances are gathered from these.
    Only centroids and one sum a cluster pass the driver.
    """
    rows = usable_vectors(sequences, piece, contour).where(F.size("contour") == width)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("piece").cast("string")), 256)
    seeds = rows.select(order.alias("draw"), "contour").orderBy(F.asc_nulls_last("draw"), "contour").limit(centroids).collect()
    blocks = vector_blocks(rows, width, scale)
    book = refined(blocks, [integers([r["contour"] for r in seeds], width, scale)], rounds)[0]
    kind = rows.schema["piece"].dataType.simpleString()

    def columns(index: np.ndarray, distance: np.ndarray) -> list:
        return [index[:, 0].astype(np.int32), distance[:, 0]]

    near = checkpointed(assigned(blocks, [book], f"piece {kind}, style int, cluster int, distance bigint", columns))
    sums = {r["cluster"]: r["s"] for r in near.groupBy("cluster").agg(long_sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book.tolist()]
    # one row a centroid
    facts = near.sparkSession.createDataFrame([(c, s, min(sum(sums.values()), 2 ** 63 - 1), digests[c]) for c, s in sums.items()],
                                              "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return near.join(F.broadcast(facts), "cluster").select(F.col("piece").alias(piece), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
