"""Components of nodes that are alike and share a bucket: stars first, then members of different groups, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.components import components
from notewise.llm.simhash import within
from notewise.session import checkpointed

#: A task compares two chunks of a bucket at most, of so many nodes and about so many bytes each.
CHUNK = 4096
CHUNK_BYTES = 16 << 20
#: From so many fingerprints on the bit planes are worth their making.
PLANES_FROM = 128

#: judge(one, others): which of the other payloads are alike to the one.
Judge = Callable[[bytes, list[bytes]], np.ndarray]


def crowded(members: DataFrame) -> DataFrame:
    """(key, node, sketch, n): members(key, node, sketch) of buckets that hold more than one node.

    A node stands in a bucket once; its sketch may differ from bucket to bucket.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return checkpointed(members.join(sizes, "key"))


def _near(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For positions ``left`` the positions among ``right`` whose sketches differ in ``radius`` bits at most."""
    if len(right) < PLANES_FROM:
        for i in left.tolist():
            yield i, right[np.bitwise_count(fps[right] ^ fps[i]) <= radius]
    else:
        for k, hits in within(fps[right], fps[left], radius):
            yield int(left[k]), right[hits]


def joined_roots(roots: np.ndarray, fps: np.ndarray, payloads: list[bytes], left: np.ndarray, right: np.ndarray, radius: int, judge: Judge) -> list[tuple[int, int]]:
    """Star edges (root, smaller root) between the groups of ``left`` and ``right`` members that the judge finds alike."""
    names, top = np.unique(roots, return_inverse=True)
    same = left is right
    for i, hits in _near(fps, left, right, radius):
        hits = hits[(top[hits] != top[i]) & ((hits > i) | (not same))]
        if len(hits):
            for j in hits[judge(payloads[i], [payloads[h] for h in hits])].tolist():
                low, high = sorted((int(top[i]), int(top[j])))
                if low != high:
                    top[top == high] = low
    return sorted({(int(r), int(names[t])) for r, t in zip(roots, top) if r != names[t]})


def mixed_links(members: DataFrame, payloads: DataFrame, judge: Judge, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links of roots for the buckets whose members(key, node, sketch, n, root) have several.

    A bucket of more than ``chunk`` nodes, or of many bytes, is dealt to chunks, and every two of them meet in a task of their own: nothing
    grows with the bucket but the number of tasks.  Pairs are judged where they meet and never listed.
    """
    # the two members of a bucket of two have been judged as a star
    mixed = members.where("n > 2").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    met = members.join(mixed, "key").select("key", "node", "sketch", "root", "n")
    bytes_ = met.select("key", "node").join(payloads.select("node", F.octet_length("payload").alias("size")), "node").groupBy("key").agg(F.sum("size").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    dealt = met.join(bytes_, "key").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "sketch", "root", "own")
    # payloads join last, so they move once to their nodes and once to the blocks
    blocks = dealt.join(payloads, "node").groupBy("key", "i", "j").agg(F.collect_list(F.struct("sketch", "root", "own", "payload")).alias("members")).where("size(members) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            values, offsets = column.values, column.offsets.to_numpy()
            sketches, roots, owners = (values.field(f).to_numpy(zero_copy_only=False) for f in ("sketch", "root", "own"))
            payload, links = values.field("payload"), []
            for low, high, first in zip(offsets[:-1], offsets[1:], batch.column("i").to_pylist()):
                own = owners[low:high] == first
                left = np.flatnonzero(own)
                right = left if own.all() else np.flatnonzero(~own)
                if (roots[low:high] != roots[low]).any():
                    links += joined_roots(roots[low:high], sketches[low:high].view(np.uint64), payload[low:high].to_pylist(), left, right, radius, judge)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return blocks.select("i", "members").mapInArrow(run, "a bigint, b bigint").distinct()


def alike_nodes(members: DataFrame, payloads: DataFrame, judge: Judge, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(node, root): components of the nodes which share a bucket and whose payloads(node, payload) the judge finds alike.

    ``members`` are ``crowded``; root is the smallest node.  Pairs whose sketches differ in more than ``radius`` bits are not judged.
    First every member is compared with one centre, drawn for each bucket; a group of near copies is in many buckets and so has
    many centres.  What these stars leave apart is compared in chunks of buckets, and whole groups are joined.
    """
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(judge(x, [y])[0]) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    centres = members.groupBy("key").agg(F.min_by(F.struct("node", "sketch"), F.xxhash64("node", "key")).alias("c"))
    stars = members.join(centres.selectExpr("key", "c.node AS centre", "c.sketch AS mark"), "key").where(
        f"node <> centre AND bit_count(sketch ^ mark) <= {radius}").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    pairs = stars.join(payloads.selectExpr("node AS a", "payload AS x"), "a").join(payloads.selectExpr("node AS b", "payload AS y"), "b")
    tops = checkpointed(components(pairs.select("a", "b", "x", "y").mapInArrow(judged, "a bigint, b bigint")))
    rooted = checkpointed(members.join(tops, "node", "left").select("key", "node", "sketch", "n", F.coalesce("root", "node").alias("root")))
    more = checkpointed(mixed_links(rooted, payloads, judge, radius, chunk))
    if more.isEmpty():
        return tops
    above = components(more).selectExpr("node AS root", "root AS top")
    return rooted.select("node", "root").distinct().join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
