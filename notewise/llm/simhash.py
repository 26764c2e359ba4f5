"""Near copies of token lines by SimHash fingerprints and bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.components import components
from notewise.llm.frames import picked, slices, text_of
from notewise.session import checkpointed

BITS = 64
BANDS = 8
BAND_BITS = BITS // BANDS
SEED = 42
FINGERPRINTS_A_TASK = 50_000


def fingerprint(line: bytes, words: int = 3) -> int:
    """SimHash of a UTF-8 line: majority of the bits of its word shingles' hashes; ties are 0."""
    parts = line.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    stop = np.cumsum([len(p) + 1 for p in parts]) - 1
    start = np.r_[0, stop[:-1] + 1]
    k = min(words, len(parts))
    digest = xxhash.xxh64_digest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(start[: len(parts) - k + 1].tolist(), stop[k - 1:].tolist())]
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):
        ones += np.unpackbits(raw[at:at + 65536], axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(sequences: DataFrame, piece: str, token_line: str, words: int = 3) -> DataFrame:
    """(piece, fp) of every row; fp is the unsigned fingerprint's bits as a long."""
    src = picked(sequences, piece=piece, line=token_line).select("piece", text_of("line").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line"):
            lines = batch.column("line").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(x, words) for x in lines], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(fps)], ["piece", "fp"])

    return src.mapInArrow(run, f"piece {src.schema['piece'].dataType.simpleString()}, fp bigint")


def within(fps: np.ndarray, probe: np.ndarray, radius: int, block: int = 32768) -> Iterator[tuple[int, np.ndarray]]:
    """For each probe the positions in ``fps`` at most ``radius`` bits away, by vertical bit planes.

    Planes hold bit j of 64 fingerprints in one word.  Differences are added, by carry-save logic on whole words, into counters
    that start so far below their overflow that one more than ``radius`` differences carries out of the top plane; this carry
    sticks.  A block is left as soon as every one of its fingerprints is beyond the radius.
    """
    used = int(np.bitwise_or.reduce(fps ^ fps[0])) if len(fps) else 0
    bits = [j for j in range(BITS) if used >> j & 1]
    height = radius.bit_length()
    below = (1 << height) - 1 - radius
    ones, none = ~np.uint64(0), np.uint64(0)
    for at in range(0, len(fps), block):
        part = fps[at:at + block]
        pad = -len(part) % 64
        rows = np.r_[part, np.repeat(part[-1:], pad)]
        planes = [np.packbits((rows >> np.uint64(j) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for j in bits]
        for k, value in enumerate(probe):
            # a probe from elsewhere may differ from all of them in bits that they share
            common = ((int(value) ^ int(fps[0])) & ~used & (1 << BITS) - 1).bit_count()
            if common > radius:
                continue
            start = below + common
            words = len(rows) // 64
            count = [np.full(words, ones if start >> c & 1 else none) for c in range(height)]
            over = np.zeros(words, np.uint64)
            for done, (j, plane) in enumerate(zip(bits, planes)):
                carry = ~plane if int(value) >> j & 1 else plane
                for c in range(height):
                    count[c], carry = count[c] ^ carry, count[c] & carry
                over |= carry
                if done % 4 == 3 and (over == ones).all():
                    break
            near = np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(part)]
            hits = np.flatnonzero(near)
            if len(hits):
                yield k, hits + at


def local_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Star edges (fingerprint, smallest of its component) inside one bucket of distinct fingerprints."""
    fps = np.sort(np.array(values, np.int64)).view(np.uint64)
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(values[0], values[1])] if (a ^ b).bit_count() <= radius else []
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    for k, hits in within(fps, fps, radius):
        for other in np.unique(root[hits]).tolist():
            a, b = find(k), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
    signed = fps.view(np.int64).tolist()
    tops = [find(i) for i in range(len(fps))]
    return [(signed[i], signed[t]) for i, t in enumerate(tops) if i != t]


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) at most ``radius`` bits apart.

    Two such fingerprints agree in at least BANDS - radius whole bands, so they meet under one of the choices of that
    many bands.  A bucket's fingerprints differ in the other bands only: it has 2 ** (radius * BAND_BITS) = 65,536 at
    most, whatever the data.  Buckets give star edges, not pairs.
    """
    choices = list(combinations(range(BANDS), BANDS - radius))
    masks = [sum(((1 << BAND_BITS) - 1) << (BAND_BITS * b) for b in chosen) for chosen in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # a small table of fingerprints becomes many rows: it is dealt to all cores before
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.count() // FINGERPRINTS_A_TASK)
    keyed = distinct.repartition(tasks, "fp").select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)
    ])).alias("x")).select("fp", "x.choice", "x.key")
    buckets = keyed.groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [e for fps in batch.column("fps").to_pylist() for e in local_links(fps, radius)]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(sequences: DataFrame, piece: str = "piece", token_line: str = "token_line", words: int = 3,
                radius: int = 2) -> DataFrame:
    """Groups of near copies among token lines.

    ``sequences`` holds one melody (or any text) per row: its ``piece`` key (an integer) and its ``token_line``.  A line,
    A-Z lower-cased, is cut at ASCII white space; its shingles are ``words`` words (fewer: all of them) with repeats, hashed by
    XXH64 with seed 42.  Lines are linked when their fingerprints differ in at most ``radius`` (0 to 2) bits; components
    of links are groups.  Returns per row: the key, ``fingerprint`` (16 hex digits), ``component_id`` (smallest key of
    the group).  Null and empty lines have fingerprint zero and are linked like any other.  Repeated rows each return;
    a null key never is a component's id unless all keys of the group are null.  Other columns are not looked at.
    """
    prints = checkpointed(fingerprints(sequences, piece, token_line, words))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("piece").alias("least")))
    links = fingerprint_links(classes.select("fp"), radius)
    roots = components(links)
    known = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = checkpointed(known)
    groups = checkpointed(known.groupBy("root").agg(F.min("least").alias("component_id")))
    named = known.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("piece").alias(piece), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, piece: str = "piece", token_line: str = "token_line", words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``documents`` with the smallest key of their group; repeated keys once, rows without a key as they are."""
    groups = near_copies(documents.where(F.col(piece).isNotNull()), piece, token_line, words, radius)
    first = groups.where(F.col(piece) == F.col("component_id")).select(piece).distinct()
    kept = documents.join(first, piece, "left_semi").dropDuplicates([piece]).select(documents.columns)
    return kept.unionAll(documents.where(F.col(piece).isNull()))
