"""Fingerprints of token lines that keep edit distance: shared random walks, sampled steps, banding and verification."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.bucket_links import alike_nodes, crowded
from notewise.llm.frames import picked, slices, text_of
from notewise.session import checkpointed

SEED = 7
PERIOD_BITS = 12
CLASSES = 256
#: A fingerprint samples one step in 2 ** level, with the smallest level at which there are at most so many.
SAMPLES = 256
SIMILARITY = 0.8
BANDS = 10
BAND_SAMPLES = 7
#: Sketches of 64 bits that differ in more than this many are not verified: of alike lines some 6 to 12 differ, of others 29.
RADIUS = 22
#: Lines of consecutive keys are dealt to buckets of about this size; their number is bounded, as the driver holds their edges.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 16_384
LOT_LINES, LOT_CHARS = 1024, 4_000_000
#: With fewer lines left the walk goes on line by line.
FEW = 24
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@cache
def steps() -> np.ndarray:
    """Steps that the walk stays at a symbol, by class and time: up to the next time at which the class's shared random bit is 1."""
    period = 1 << PERIOD_BITS
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, period)).astype(bool)
    out, following = np.zeros((CLASSES, period), np.uint8), np.full(CLASSES, 2 * period)
    for t in range(2 * period - 1, -1, -1):
        following = np.where(bits[:, t % period], t, following)
        if t < period:
            out[:, t] = following - t + 1
    return out.ravel()


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a.astype(np.uint64) * _M1) ^ (np.asarray(b).astype(np.uint64) * _M2)
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def code_points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


def walked(points: list[np.ndarray], start: list[int]) -> list[np.ndarray]:
    """For each line the times at which the walk leaves its symbols; all lines of a lot take their steps side by side."""
    stay, mask = steps(), (1 << PERIOD_BITS) - 1
    order = sorted(range(len(points)), key=lambda k: -len(points[k]))
    lengths = np.array([len(points[k]) for k in order], np.int64)
    first = np.cumsum(lengths) - lengths
    flat = np.concatenate([*(points[k] for k in order), np.zeros(0, np.uint32)])
    offset = ((flat * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64) << PERIOD_BITS
    left = np.zeros(len(flat), np.int64)
    time = np.array([start[k] for k in order], np.int64)
    at, active = 0, len(order)
    while True:
        active = int(np.searchsorted(-lengths[:active], -at, side="left"))
        if active < FEW:
            break
        for _ in range(int(lengths[active - 1]) - at):
            place = first[:active] + at
            time[:active] += stay[offset[place] | (time[:active] & mask)]
            left[place] = time[:active]
            at += 1
    table = stay.tobytes()
    for k in range(active):
        t = int(time[k])
        for low in range(int(first[k]) + at, int(first[k] + lengths[k]), 1 << 16):
            high, out = min(low + (1 << 16), int(first[k] + lengths[k])), []
            for c in offset[low:high].tolist():
                t += table[c | (t & mask)]
                out.append(t)
            left[low:high] = out
    found: list[np.ndarray] = [left[:0]] * len(order)
    for place, k in enumerate(order):
        found[k] = left[first[place]:first[place] + lengths[place]]
    return found


@cache
def _descended(level: int, down: int) -> np.ndarray:
    """For each sample of a level its place among those of the level ``down``: every sample is one of two of the level below."""
    at = np.arange(SAMPLES, dtype=np.int64)
    for step in range(level, down, -1):
        at = 2 * at + (_mixed(at, step) & np.uint64(1)).astype(np.int64)
    return at


def sampled(points: np.ndarray, left: np.ndarray) -> bytes:
    """The fingerprint: a byte for the level (top bit: odd number of samples) and four hashed bits of the symbol at each sampled time."""
    level, end = 0, int(left[-1]) if len(left) else 0
    while end > SAMPLES << level:
        level += 1
    times = _descended(level, 0)
    times = times[:int(np.searchsorted(times, end))]
    symbol = points[np.searchsorted(left, times, side="right")]
    nibbles = (_mixed(symbol, times) & np.uint64(15)).astype(np.uint8)
    odd = len(nibbles) & 1
    pairs = np.r_[nibbles, np.zeros(odd, np.uint8)]
    return bytes([level | odd << 7]) + (pairs[::2] << 4 | pairs[1::2]).tobytes()


def samples_of(fingerprint: bytes) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(fingerprint, np.uint8)
    nibbles = np.stack([raw[1:] >> 4, raw[1:] & 15], 1).ravel()
    return int(raw[0]) & 127, nibbles[:len(nibbles) - (int(raw[0]) >> 7)]


def coarser(level: int, nibbles: np.ndarray, wanted: int) -> np.ndarray:
    if wanted == level:
        return nibbles
    at = _descended(wanted, level)
    return nibbles[at[:int(np.searchsorted(at, len(nibbles)))]]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal symbols, from 0 to 1, among the times that both fingerprints sample; chance hits are taken off."""
    if a == b:
        return 1.0
    (la, x), (lb, y) = samples_of(a), samples_of(b)
    level = max(la, lb)
    x, y = coarser(la, x, level), coarser(lb, y, level)
    most = max(len(x), len(y))
    both = min(len(x), len(y))
    agree = int((x[:both] == y[:both]).sum()) / most if most else 1.0
    return max(0.0, (agree - 1 / 16) / (15 / 16))


@cache
def _band_places(size: int) -> np.ndarray:
    return np.random.default_rng(SEED + size).integers(0, size, (BANDS, BAND_SAMPLES))


def bands(fingerprint: bytes) -> list[tuple[int, int]]:
    """(bucket key, sketch) pairs: a key is a hash of a few sampled bits, a sketch has one bit of 64 samples.

    Places are drawn below a power of two that the line's samples reach.  Lines whose size is near the next smaller or the next larger
    class are in that one too, so two alike lines always share a class.
    """
    level, nibbles = samples_of(fingerprint)
    n, classes, out = len(nibbles), [], []
    if n:
        size = 1 << (n.bit_length() - 1)
        classes.append((level, nibbles, size))
        if size > 1 and n < 1.25 * size:
            classes.append((level, nibbles, size // 2))
        if n >= 0.8 * SAMPLES:
            classes.append((level + 1, coarser(level, nibbles, level + 1), SAMPLES // 4))
    for at, held, size in classes:
        chosen = held[np.minimum(_band_places(size), len(held) - 1)].tobytes()
        bits = held[np.minimum(np.arange(64) * size // 64, len(held) - 1)] & 1
        sketch = int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)
        for k in range(BANDS):
            key = xxhash.xxh64_digest(chosen[BAND_SAMPLES * k:BAND_SAMPLES * (k + 1)], (at << 16) + size * 32 + k)
            out.append((int.from_bytes(key, "big", signed=True), sketch))
    return out


def neighbours(sequences: DataFrame) -> DataFrame:
    """(bucket, tail, void, place, h, piece, packed): lines dealt to ranges of ascending (piece, hash), null pieces last.

    The first line of a range also stands, as ``tail``, at the end of the range before, so each line meets the next one in its own
    task.  The driver holds one edge a range; texts are shuffled once, compressed.
    """
    order = ["void", "place", "h"]
    keyed = sequences.select("piece", "line", F.col("piece").isNull().cast("int").alias("void"), F.coalesce("piece", F.lit(0)).cast("long").alias("place"),
                             F.xxhash64("line").alias("h"))
    narrow = checkpointed(keyed.select(*order, F.octet_length("line").cast("long").alias("size")))
    bytes_, rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(MOST_BUCKETS, max(1, bytes_ // BUCKET_BYTES, rows // 200_000)))
    drawn = sorted(tuple(r) for r in narrow.orderBy(F.xxhash64(*order)).limit(20 * ranges).select(*order).collect())
    edges = sorted({drawn[k * len(drawn) // ranges] for k in range(1, ranges)}) if drawn else []

    def bucket(void, place, h):
        return [bisect_right(edges, x) for x in zip(void, place, h)]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in order]
            yield pa.RecordBatch.from_arrays([pa.array(bucket(*(c.to_pylist() for c in columns)), pa.int32()), *columns], ["bucket", *order])

    least = narrow.select(*order).mapInArrow(numbered, "bucket int, void int, place bigint, h bigint").groupBy("bucket").agg(F.min(F.struct(*order)).alias("x"))
    firsts = sorted((r["bucket"], tuple(r["x"])) for r in least.collect())
    before = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices([batch], "line"):
                keys = list(zip(*(part.column(c).to_pylist() for c in order)))
                own = bucket(*zip(*keys))
                tails = [k for k, key in enumerate(keys) if key in before]
                rows = pa.array([*range(len(keys)), *tails])
                packed = pa.array([pack.compress(x) for x in part.column("line").cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*own, *(before[keys[k]] for k in tails)], pa.int32()), pa.array([0] * len(keys) + [1] * len(tails), pa.int32()),
                     *(part.column(c).take(rows) for c in (*order, "piece")), packed.take(rows)], ["bucket", "tail", *order, "piece", "packed"])

    kind = sequences.schema["piece"].dataType.simpleString()
    out = keyed.mapInArrow(dealt, f"bucket int, tail int, void int, place bigint, h bigint, piece {kind}, packed binary")
    return out.repartition(max(1, len(firsts)), "bucket").sortWithinPartitions("bucket", "tail", *order, "packed")


def walk_table(sequences: DataFrame) -> DataFrame:
    """(piece, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next), checkpointed; the fingerprints are bytes."""
    kind = sequences.schema["piece"].dataType.simpleString()
    names = ["piece", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]

    def lot(pieces: list, lines: list[str], last: str) -> pa.RecordBatch:
        following = [*lines[1:], last]
        points = [code_points(x) for x in [*lines, last]]
        left = walked(points, [0] * len(points))
        prints = [sampled(p, t) for p, t in zip(points, left)]
        half = [len(p) // 2 for p in points[:-1]]
        kept = [len(p) - k for p, k in zip(points, half)]
        tails = [q[:k] for q, k in zip(points[1:], half)]
        # the edited line begins as the line itself, so the walk goes on from where that part ends
        rest = walked(tails, [int(t[k - 1]) if k else 0 for t, k in zip(left, kept)])
        edited = [sampled(np.concatenate([p[:k], q]), np.concatenate([t[:k], u])) for p, k, q, t, u in zip(points, kept, tails, left, rest)]
        digests = [hashlib.sha256((x[:k] + y[:h]).encode("utf-8", "surrogatepass")).digest() for x, k, y, h in zip(lines, kept, following, half)]
        columns = [pa.array(pieces), [len(p) for p in points[:-1]], digests, prints[:-1], edited,
                   [likeness(a, b) for a, b in zip(prints, edited)], [likeness(a, b) for a, b in zip(prints, prints[1:])]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pieces, lines, chars, now = zstandard.ZstdDecompressor(), [], [], 0, None
        for batch in batches:
            for bucket, tail, piece, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "piece", "packed"))):
                if tail and (not lines or bucket != now):
                    continue
                line = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                full = len(lines) >= LOT_LINES or chars >= LOT_CHARS
                if lines and (tail or full):
                    yield lot(pieces, lines, line)
                    pieces, lines, chars = [], [], 0
                if not tail:
                    pieces, lines, chars, now = [*pieces, piece], [*lines, line], chars + len(line), bucket

    return checkpointed(neighbours(sequences).mapInArrow(
        run, f"piece {kind}, n_chars bigint, edited_sha256 binary, fp binary, edited_fp binary, near_edited double, near_next double"))


def alike(prints: DataFrame, similarity: float) -> DataFrame:
    """(node, root): components of distinct fingerprints, prints(node, fp), whose likeness reaches ``similarity``."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, node, bits) for node, fp in zip(batch.column("node").to_pylist(), batch.column("fp").to_pylist()) for key, bits in dict(bands(fp)).items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["key", "node", "sketch"])

    def judge(one: bytes, others: list[bytes]) -> np.ndarray:
        return np.array([likeness(one, o) >= similarity for o in others], bool)

    members = crowded(prints.mapInArrow(keyed, "key bigint, node bigint, sketch bigint"))
    return alike_nodes(members, prints.select("node", F.col("fp").alias("payload")), judge, RADIUS)


def edit_fingerprints(sequences: DataFrame, piece: str = "piece", token_line: str = "token_line", similarity: float = SIMILARITY) -> DataFrame:
    """Fingerprints of token lines whose likeness follows edit distance, with each line's edited form and near lines.

    ``sequences`` holds a ``piece`` key (an integer) and a ``token_line`` per row.  A walk reads a line symbol by symbol and stays at each
    for a number of steps that shared random bits of (symbol, time) give, so lines that differ by few edits fall into step again and
    agree at most times.  A fingerprint samples up to 256 of these times over the whole line and keeps four hashed bits of each
    symbol.  A line's edited form has its last floor(n / 2) code points replaced by as many (or all) of the next line in ascending
    order of pieces, after the last that of the first.  Returns per row the key, ``n_chars`` (code points), ``edited_sha256``,
    ``fingerprint`` and ``edited_fingerprint`` (hex; a byte of level first), ``near_edited`` and ``near_next``
    (likeness of its fingerprint to these lines', 0 to 1), and ``component_id``: the smallest piece of the lines that are linked by a
    likeness of at least ``similarity``.

    Links are found by 10 bands of 7 samples (and 10 more for a neighbouring size class) and verified on whole
    fingerprints: two lines that agree in 0.8 of their times meet with a chance of 0.93, in 0.9 with more than 0.99.  Equal lines have
    equal fingerprints.  Null and empty lines have no samples, are like each other (1) and like no other (0).  Repeated keys follow
    each other in the order of their lines' hashes, null keys come last and every row returns; ``component_id`` is null only if
    all keys of the group are.  A single row is its own next.  Other columns are not looked at.
    """
    src = picked(sequences, piece=piece, line=token_line).select("piece", text_of("line").alias("line"))
    rows = walk_table(src).withColumn("node", F.xxhash64("fp"))
    classes = checkpointed(rows.groupBy("node").agg(F.min("piece").alias("least"), F.min("fp").alias("fp"), F.count("*").alias("n")))
    tops = alike(classes.select("node", "fp"), similarity)
    # only lines that stand with others have to look their group up; an exact copy's group may hold most rows, but one row a node is joined
    grouped = classes.select("node", "least", "n").join(tops, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("joined"))
    grouped = checkpointed(grouped.where("joined OR n > 1"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("node", "component_id", F.lit(True).alias("found"))
    return rows.join(named, "node", "left").select(
        F.col("piece").alias(piece), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("piece")).alias("component_id"))
