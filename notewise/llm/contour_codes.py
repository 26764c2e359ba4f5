"""Product codes of contour vectors: small codebooks for consecutive parts, trained over all vectors with value dictionaries."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.value_blocks import assigned, integers, long_sum, refined, usable_vectors, vector_blocks
from notewise.session import checkpointed

PARTS = 4
ENTRIES = 256
ROUNDS = 4


def contour_codes(sequences: DataFrame, piece: str = "piece", contour: str = "contour", style: str = "style", scale: int = 1024,
                  parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of contour vectors, one byte a part.

    ``sequences`` holds a ``piece`` key, a ``contour`` vector and a ``style`` per row.  Components become floor(scale x); vectors are cut
    into ``parts`` equal consecutive parts.  Each part's codebook starts as that part of the ``entries`` (256 at most) smallest kept
    pieces, ascending; each round assigns all parts to their nearest entry (squared Euclidean distance, ties to the lower index)
    and replaces entries by the componentwise floor(sum / count) of their parts; unused ones stay.  Returns per kept row the key,
    ``code`` (two hex digits a part), ``error`` (squared distances over all parts), ``style_error`` (errors summed over equal styles,
    nulls together) and ``codebooks_sha256`` (the components of all entries by part, entry and position, comma-joined).

    Vectors that are null or hold null or non-finite components are dropped.  Shorter ones are filled up with zeros to the longest
    length, rounded up to a multiple of ``parts``.  Pieces that repeat stand in the order of their vectors, null keys last; every row
    returns.  With fewer rows than entries all are entries; without any the result is empty.  Integers are clipped so that
    distances fit a long (about 9e7 for 64 components).  Other columns are not looked at.

    Only codebooks (parts x entries x width numbers) pass the driver.  Vectors are read once into checkpointed blocks; each round is
    one pass over these.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    rows = usable_vectors(sequences, piece, contour, style)
    longest = rows.agg(F.max(F.size("contour"))).first()[0] or 1
    width = -(-longest // parts) * parts
    seeds = rows.orderBy(F.asc_nulls_last("piece"), "contour").limit(entries).select("contour").collect()
    start = integers([r["contour"] for r in seeds], width, scale)
    blocks = vector_blocks(rows, width, scale)
    books = refined(blocks, [np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)], rounds)
    text = ",".join(str(v) for book in books for v in book.ravel().tolist())
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("piece", "style")}

    def columns(index: np.ndarray, distance: np.ndarray) -> list:
        return [[bytes(r).hex() for r in index.astype(np.uint8)], distance.sum(axis=1)]

    coded = checkpointed(assigned(blocks, books, f"piece {kinds['piece']}, style {kinds['style']}, code string, error bigint", columns))
    # a style may hold most rows: its error is summed before the join, whose long side adaptive execution can split
    totals = coded.groupBy("style").agg(long_sum("error").alias("style_error")).withColumnRenamed("style", "of_style")
    joined = coded.join(totals, coded["style"].eqNullSafe(totals["of_style"]))
    return joined.select(F.col("piece").alias(piece), "code", "error", "style_error",
                         F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
