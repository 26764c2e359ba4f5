"""Contour codes, contour clusters and edit fingerprints against brute force, on melodies and on awkward rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.functions import codes
from notewise.llm import bucket_links, edit_walks, shingle_join, simhash, value_blocks
from notewise.llm.contour_clusters import contour_clusters
from notewise.llm.contour_codes import contour_codes
from notewise.llm.edit_walks import edit_fingerprints
from notewise.sources.tables import melody_sequences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def contours(spark):
    """Pitch contours of melodies (64 steps around their mean), then awkward rows; with columns of clashing names."""
    pitches = F.expr("slice(transform(notes, n -> CAST(n.pitch AS DOUBLE)), 1, 64)")
    seqs = melody_sequences(spark, SF).limit(400).select(F.xxhash64("seq").alias("piece"), pitches.alias("p")).where("size(p) = 64")
    real = seqs.selectExpr("piece", "transform(p, x -> (x - p[0]) / 128) AS contour", "CAST(piece % 3 AS STRING) AS style")
    wave = [math.sin(i) / 3 for i in range(64)]
    odd = [(1, wave, "a"), (1, wave, "a"), (2, [-x for x in wave], None), (3, None, "a"), (4, [math.nan] * 64, "a"), (5, [math.inf] * 64, "b"),
           (6, [None] + wave[1:], "b"), (7, [], None), (8, wave[:10], "c"), (None, wave, "c"), (9, [1e30] * 64, "d"), (10, [-1e30] * 64, "d")]
    rows = real.unionByName(spark.createDataFrame(odd, "piece long, contour array<double>, style string"))
    return rows.withColumns({"code": F.lit("x"), "cluster": F.lit(1), "values": F.lit(2), "error": F.lit(3)}).repartition(5).cache()


def whole_numbers(x, scale, width):
    top = value_blocks.largest(width)
    return [int(min(top, max(-top, math.floor(scale * v)))) for v in [*x, *[0.0] * (width - len(x))]]


def kept_rows(rows):
    return [r for r in rows if r.contour is not None and all(v is not None and math.isfinite(v) for v in r.contour)]


def settle(vectors, entries, rounds):
    """Plain assignment and averaging; gives entries and (index, distance) of every vector."""
    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(entries)) for v in vectors]

    for _ in range(rounds):
        members = defaultdict(list)
        for v, (_, i) in zip(vectors, near()):
            members[i].append(v)
        entries = [[sum(c) // len(c) for c in zip(*members[i])] if i in members else e for i, e in enumerate(entries)]
    return entries, near()


def test_contour_codes(spark, contours):
    rows = sorted(kept_rows(contours.collect()), key=lambda r: (r.piece is None, r.piece or 0, r.contour))
    vectors = [whole_numbers(r.contour, 1024, 64) for r in rows]
    found = []
    for p in range(4):
        parts = [v[16 * p:16 * p + 16] for v in vectors]
        found.append(settle(parts, parts[:24], 3))
    digest = hashlib.sha256(",".join(str(c) for entries, _ in found for e in entries for c in e).encode()).hexdigest()
    want, by_style = [], defaultdict(int)
    for k, r in enumerate(rows):
        error = sum(near[k][0] for _, near in found)
        want.append([r.piece, "".join(f"{near[k][1]:02x}" for _, near in found), error, r.style])
        by_style[r.style] += error
    want = [(p, c, e, min(by_style[s], 2 ** 63 - 1), digest) for p, c, e, s in want]
    got = [tuple(r) for r in contour_codes(contours, entries=24, rounds=3).select("piece", "code", "error", "style_error", "codebooks_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert contour_codes(contours.where("false")).count() == 0
    few = contour_codes(contours.where("piece IN (1, 2)")).collect()
    assert {(r.code, r.error) for r in few} == {("00000000", 0), ("02020202", 0)}
    with pytest.raises(ValueError):
        contour_codes(contours, entries=257)


def test_contour_clusters(spark, contours):
    rows = [r for r in kept_rows(contours.collect()) if len(r.contour) == 64]
    draw = {id(r): "~" if r.piece is None else hashlib.sha256(f"2:{r.piece}".encode()).hexdigest() for r in rows}
    rows.sort(key=lambda r: (draw[id(r)], r.contour))
    vectors = [whole_numbers(r.contour, 256, 64) for r in rows]
    entries, near = settle(vectors, vectors[:7], 4)
    sums = defaultdict(int)
    for d, i in near:
        sums[i] += d
    want = [(r.piece, i, d, min(sums[i], 2 ** 63 - 1), min(sum(min(s, 2 ** 63 - 1) for s in sums.values()), 2 ** 63 - 1),
             hashlib.sha256(",".join(map(str, entries[i])).encode()).hexdigest()) for r, (d, i) in zip(rows, near)]
    got = [tuple(r) for r in contour_clusters(contours, centroids=7, rounds=4).select(
        "piece", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert contour_clusters(contours.where("false")).count() == 0
    same = contour_clusters(contours.where("piece = 1")).collect()
    assert [(r.cluster, r.distance) for r in same] == [(0, 0), (0, 0)]


def test_tables_equal_plain_distances(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(value_blocks, "SLICE_ROWS", 50)
    for reach in (40, 10 ** 6):
        x, entries = rng.integers(-reach, reach, (333, 12)), rng.integers(-reach, reach, (9, 5))
        entries[4] = entries[2]
        index, distance = value_blocks.nearest(value_blocks.encoded(x), entries, 3)
        plain = ((x[:, None, 3:8] - entries[None]) ** 2).sum(2)
        assert (index == plain.argmin(1)).all() and (distance == plain.min(1)).all()


def test_blocks_keep_every_row(spark, contours, monkeypatch):
    monkeypatch.setattr(value_blocks, "BLOCK_ROWS", 7)
    rows = value_blocks.usable_vectors(contours, "piece", "contour", "style")
    blocks = value_blocks.vector_blocks(rows, 64, 1024).collect()
    assert all(len(b.pieces) <= 7 for b in blocks) and sum(len(b.pieces) for b in blocks) == rows.count()
    want = sorted((str(r.piece), str(r.style), whole_numbers(r.contour, 1024, 64)) for r in rows.collect())
    got = []
    for b in blocks:
        block = value_blocks.decoded(b.asDict())
        got += [(str(p), str(s), [int(block.column(d)[k]) for d in range(64)]) for k, (p, s) in enumerate(zip(b.pieces, b.styles))]
    assert sorted(got) == want


# --- comparison of buckets ---

@pytest.mark.parametrize("radius", [0, 1, 2, 3, 12, 24, 63])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    near = base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (radius + 1, 150)).astype(np.uint64))
    fps = np.concatenate([base, near, base[:5]])
    probes = np.concatenate([fps[:40], rng.integers(0, 1 << 63, 10).astype(np.uint64)])
    got = {(k, int(h)) for k, hits in simhash.within(fps, probes, radius, block=128) for h in hits}
    assert got == {(k, i) for k, p in enumerate(probes) for i, f in enumerate(fps) if (int(p) ^ int(f)).bit_count() <= radius}
    for one in (fps[:1], np.repeat(fps[:1], 70)):
        got = {(k, int(h)) for k, hits in simhash.within(one, probes, radius) for h in hits}
        assert got == {(k, i) for k, p in enumerate(probes) for i, f in enumerate(one) if (int(p) ^ int(f)).bit_count() <= radius}


@pytest.mark.parametrize("chunk", [3, 4096])
def test_alike_nodes_connect_what_the_judge_accepts(spark, monkeypatch, chunk):
    """Nodes are numbers of one bucket (chains at distance 1 that the star does not see) and of small ones."""
    nodes = [10 * g + i for g in range(12) for i in range(5)]
    members = spark.createDataFrame([(0, v, 0) for v in nodes] + [(7, v, 0) for v in (1000, 1001, 2)] + [(8, 5000, 0)], "key long, node long, sketch long")
    payloads = members.select("node", F.col("node").cast("string").cast("binary").alias("payload")).distinct()

    def judge(one, others):
        return np.array([abs(int(one) - int(o)) <= 1 for o in others])

    found = bucket_links.alike_nodes(bucket_links.crowded(members), payloads, judge, 2, chunk)
    roots = {r.node: r.root for r in found.collect() if r.node != r.root}
    assert roots == {**{v: v // 10 * 10 for v in nodes if v % 10}, 1001: 1000}
    far = members.withColumn("sketch", F.when(F.col("node") % 2 == 0, 0).otherwise(-1).cast("long"))
    assert bucket_links.alike_nodes(bucket_links.crowded(far), payloads, judge, 2, chunk).where("node <> root").count() == 0
    monkeypatch.setattr(bucket_links, "CHUNK_BYTES", 40)
    monkeypatch.setattr(bucket_links, "PLANES_FROM", 1)
    found = bucket_links.alike_nodes(bucket_links.crowded(members), payloads, judge, 2, chunk)
    assert {r.node: r.root for r in found.collect() if r.node != r.root} == roots


def test_similar_sets_are_judged_exactly():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [np.unique(np.r_[base[:n], rng.integers(0, 1 << 63, m).astype(np.uint64)]) for n in (1, 100, 160, 178, 200) for m in (0, 10, 22, 50)]
    got = shingle_join.similar_to(0.8)(base.tobytes(), [s.tobytes() for s in sets])
    assert got.tolist() == [len(np.intersect1d(base, s)) * 5 >= 4 * len(np.union1d(base, s)) for s in sets] and got.any() and not got.all()


# --- edit fingerprints ---

def brute_walk(points):
    """The walk step by step: (symbol index at every time)."""
    period = 1 << edit_walks.PERIOD_BITS
    bits = np.random.default_rng(edit_walks.SEED).integers(0, 2, (edit_walks.CLASSES, period))
    at, path = 0, []
    while at < len(points):
        path.append(at)
        kind = int(points[at]) * 0x9E3779B1 % (1 << 32) >> 24
        at += int(bits[kind, (len(path) - 1) % period])
    return path


def test_walks_follow_the_shared_bits():
    rng = random.Random(1)
    lines = ["".join(rng.choices("abcd éß漢😀", k=rng.choice((0, 1, 5, 40, 700)))) for _ in range(60)] + ["x" * 5000, ""]
    points = [edit_walks.code_points(x) for x in lines]
    for p, left in zip(points, edit_walks.walked(points, [0] * len(points))):
        path = brute_walk(p)
        assert left.tolist() == [path.index(i + 1) if i + 1 < len(p) else len(path) for i in range(len(p))]
        fp = edit_walks.sampled(p, left)
        level, nibbles = edit_walks.samples_of(fp)
        times = [t for t in edit_walks._descended(level, 0).tolist() if t < len(path)]
        assert len(nibbles) == len(times) <= 256 and (level == 0 or len(path) > 256 << level - 1)
        want = [int(edit_walks._mixed(p[path[t]:path[t] + 1], np.array([t]))[0]) & 15 for t in times]
        assert nibbles.tolist() == want


def test_samples_are_nested():
    for level in range(1, 9):
        below = edit_walks._descended(level - 1, 0)
        at = edit_walks._descended(level, level - 1)
        inside = at < 256
        assert (edit_walks._descended(level, 0)[inside] == below[at[inside]]).all() and (np.diff(at) > 0).all()


def edited(rng, line, edits):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + rng.randrange(2)] = rng.choice("abcdefgh ") * rng.randrange(2)
    return "".join(out)


def test_likeness_follows_edits():
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefgh ", k=n)) for n in (300, 1000, 3000, 9000) for _ in range(25)]

    def mean(share):
        others = [edited(rng, x, int(len(x) * share)) for x in lines]
        points = [edit_walks.code_points(x) for x in lines + others]
        fps = [edit_walks.sampled(p, t) for p, t in zip(points, edit_walks.walked(points, [0] * len(points)))]
        return float(np.mean([edit_walks.likeness(a, b) for a, b in zip(fps[:len(lines)], fps[len(lines):])])), list(zip(fps[:len(lines)], fps[len(lines):]))

    (same, _), (few, pairs), (more, _), (many, _) = (mean(s) for s in (0, 0.002, 0.02, 0.5))
    assert same == 1 and 1 > few > 0.9 > more > many and many < 0.4
    alike = [(dict(edit_walks.bands(a)), dict(edit_walks.bands(b))) for a, b in pairs if edit_walks.likeness(a, b) >= 0.8]
    shared = [[(a[k] ^ b[k]).bit_count() for k in a.keys() & b.keys()] for a, b in alike]
    assert len(alike) > 80 and np.mean([any(d <= edit_walks.RADIUS for d in x) for x in shared]) > 0.95
    assert edit_walks.likeness(b"\x00", b"\x00") == 1 and edit_walks.likeness(b"\x00", pairs[0][0]) == 0


@pytest.mark.parametrize("bucket_bytes", [1 << 12, 1 << 24])
def test_edit_fingerprints(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(edit_walks, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(edit_walks, "LOT_LINES", 7)
    rng = random.Random(8)
    seqs = melody_sequences(spark, SF).limit(30).select(F.xxhash64("seq").alias("piece"), codes.token_line(F.col("notes"), F.col("bos")).alias("token_line")).collect()
    rows = [(r.piece, r.token_line) for r in seqs]
    rows += [(2000 + k, edited(rng, seqs[k].token_line, 1)) for k in range(5)] + [(3000, seqs[0].token_line)]
    rows += [(1, None), (2, ""), (3, "a"), (4, "ab"), (5, "é漢😀" * 400), (6, "x" * 30_000), (7, "twice"), (7, "twice"), (7, "other")]
    df = spark.createDataFrame(rows, "piece long, token_line string").withColumns({"fp": F.lit(1), "line": F.lit("n"), "node": F.lit(2), "void": F.lit(3)}).repartition(4)
    got = edit_fingerprints(df).collect()
    assert len(got) == len(rows)
    hashes = {(r.piece, r.token_line): r.h for r in df.select("piece", "token_line", F.xxhash64(F.coalesce("token_line", F.lit(""))).alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0], hashes[r]))
    texts = [t or "" for _, t in ordered]
    points = [edit_walks.code_points(t) for t in texts]
    prints = [edit_walks.sampled(p, t) for p, t in zip(points, edit_walks.walked(points, [0] * len(points)))]
    want = []
    for k, (piece, _) in enumerate(ordered):
        following = texts[(k + 1) % len(texts)]
        n = len(texts[k])
        other = texts[k][:n - n // 2] + following[:n // 2]
        p = edit_walks.code_points(other)
        fp = edit_walks.sampled(p, edit_walks.walked([p], [0])[0])
        want.append((piece, n, hashlib.sha256(other.encode()).hexdigest(), prints[k].hex(), fp.hex(),
                     edit_walks.likeness(prints[k], fp), edit_walks.likeness(prints[k], prints[(k + 1) % len(texts)])))
    assert sorted(tuple(r)[:7] for r in got) == sorted(want)
    root = {}
    for a, (p, _) in enumerate(ordered):
        for b in range(a):
            if edit_walks.likeness(prints[a], prints[b]) >= 0.8:
                root.setdefault(a, set()).add(b)
    group = {r.piece: r.component_id for r in got if r.piece != 7}
    assert group[1] == group[2] == 1 and all(group[p] <= p for p in group)
    for a, others in root.items():
        for b in others:
            if 7 not in (ordered[a][0], ordered[b][0]):
                assert group[ordered[a][0]] == group[ordered[b][0]]
    assert group[3000] == group[seqs[0].piece]


def test_edit_fingerprints_of_few_rows(spark):
    one = edit_fingerprints(spark.createDataFrame([(5, "abcdef")], "piece long, token_line string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1 and one.component_id == 5
    null = {r.n_chars: r for r in edit_fingerprints(spark.createDataFrame([(None, "abcd"), (3, "xy")], "piece long, token_line string")).collect()}
    assert null[2].edited_sha256 == hashlib.sha256(b"xa").hexdigest() and null[4].edited_sha256 == hashlib.sha256(b"abxy").hexdigest()
    assert null[4].component_id is None and null[2].component_id == 3
    assert edit_fingerprints(spark.createDataFrame([], "piece long, token_line string")).count() == 0
