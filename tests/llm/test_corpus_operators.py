"""Model, containment, archives, addresses, vectors, near copies and the pipeline against brute force."""

import hashlib
import io
import math
import random
import zipfile
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, same
from notewise.functions import codes
from notewise.llm import decontaminate, kneser_ney, queries, shingle_join, simhash, topk, url_templates, warc_zip
from notewise.llm.components import components
from notewise.sources.tables import melody_sequences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()) == "ok"


# --- quality model ---

def padded(text):
    """Every character with the three before it, as tuples; None stands before the text."""
    return list(zip([None, None, None, *text], [None, None, *text], [None, *text], text))


def brute_model(texts):
    """Interpolated modified Kneser-Ney over one style, written from its definition with dictionaries of character tuples."""
    orders = {kneser_ney.ORDER: Counter(g for t in texts for g in padded(t))}
    for k in range(kneser_ney.ORDER - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])

    def discount(c):
        n = Counter(c.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        return lambda k: max(0, min(min(k, 3), min(k, 3) - (min(k, 3) + 1) * y * n[min(k, 3) + 1] / n[min(k, 3)] if n[min(k, 3)] and n[1] else min(k, 3) * 0.5))

    discounts = {k: discount(c) for k, c in orders.items()}
    context = {}
    for k, c in orders.items():
        total, left = context[k] = defaultdict(int), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += discounts[k](n)

    def p(g):
        if not g:
            return 1 / (len(orders[1]) + 1)
        total, left = context[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        n = orders[len(g)].get(g, 0)
        return ((n - discounts[len(g)](n)) if n else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def brute_quality(rows, trusted, fold_of, quantile=kneser_ney.QUANTILE, margin=kneser_ney.MARGIN):
    """(perplexity, threshold) of every (piece, line, style), by the definition of the operator."""
    good = [r for r in rows if r[0] in trusted]
    size = Counter()
    for _, line, style in good:
        size[style] += len(line)
    named = lambda style: style if style is not None and size[style] >= kneser_ney.OWN_SYMBOLS else "*"
    surprise = lambda p, line: -sum(math.log(max(p(g), 1e-12)) for g in padded(line))
    out = {}
    for name in {named(r[2]) for r in rows}:
        mine = [r for r in good if name == "*" or r[2] == name]
        whole, *half = (brute_model([r[1] for r in mine if keep(fold_of[r[0]])]) for keep in (lambda f: True, lambda f: f == 0, lambda f: f == 1))
        crossed = [(surprise(half[1 - fold_of[r[0]]], r[1]), len(r[1])) for r in mine]
        mean = sum(t for t, _ in crossed) / max(1, sum(n for _, n in crossed))
        rate = lambda t, n: (t + kneser_ney.SHRINK * mean) / (n + kneser_ney.SHRINK)
        ordered = sorted(rate(t, n) for t, n in crossed)
        limit = math.exp(ordered[max(0, math.ceil(quantile * len(ordered)) - 1)]) * margin
        for piece, line, style in rows:
            if named(style) == name:
                out[piece] = (math.exp(rate(surprise(whole, line), len(line))), limit)
    return out


def test_ngrams_hold_the_last_characters():
    grams, lengths = kneser_ney.ngrams(["ab\0cde", "", "\U0001F600x"])
    code = lambda *points: sum(p << 16 * k for k, p in enumerate(reversed(points)))
    folded = 0xD800 + 0x1F600 % 2048
    want = [(97,), (97, 98), (97, 98, 1), (97, 98, 1, 99), (98, 1, 99, 100), (1, 99, 100, 101), (folded,), (folded, 120)]
    assert grams.view(np.uint64).tolist() == [code(*w) for w in want] and lengths.tolist() == [6, 0, 2]


def test_kneser_ney_probabilities(spark):
    texts = ["the cat and the hat", "a hat, a cat!", "on the mat 12"]
    asked = [*texts, "the dog and a hat", "zzz"]
    counts = Counter(kneser_ney.ngrams(texts)[0].tolist())
    rows = [("x", g, counts[g]) for g in set(kneser_ney.ngrams(asked)[0].tolist())]
    table = {r["gram"]: r["surprise"] for r in kneser_ney.kneser_ney(spark.createDataFrame(rows, "style string, gram long, n long")).collect()}
    p = brute_model(texts)
    assert len(table) == len(rows)
    for text in asked:
        for g, gram in zip(padded(text), kneser_ney.ngrams([text])[0].tolist()):
            assert math.isclose(table[gram], -math.log(max(p(g), 1e-12)), rel_tol=1e-9)


def test_quality_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "OWN_SYMBOLS", 400)
    monkeypatch.setattr(kneser_ney, "BLOCK_CHARS", 300)
    draw = random.Random(3)
    words = ["sol", "la", "ti", "fa", "réel", "漢字", "hornpipe", "ré"]
    rows = [(k, " ".join(draw.choices(words[:5] if k % 3 else words, k=draw.randrange(1, 30))), ("reel", "jig", "rare", None)[min(k % 5, 3)]) for k in range(60)]
    rows += [(60, "x" * 900, "jig"), (61, "", "reel"), (62, "qq zz " * 20, "reel")]
    trusted = {k for k in range(60) if k % 4}
    frame = spark.createDataFrame(rows, "piece long, token_line string, style string").repartition(3)
    keys = spark.createDataFrame([(k,) for k in trusted], "piece long")
    fold_of = {r[0]: r[1] for r in frame.select("piece", F.xxhash64("piece").bitwiseAND(F.lit(1))).collect()}
    want = brute_quality(rows, trusted, fold_of)
    got = kneser_ney.line_quality(frame, keys).collect()
    assert len(got) == len(rows) and not all(r["keep"] for r in got)
    for r in got:
        perplexity, limit = want[r["piece"]]
        assert (r["piece"], r["style"]) and math.isclose(r["perplexity"], perplexity, rel_tol=1e-5) and math.isclose(r["threshold"], limit, rel_tol=1e-5)
        assert r["keep"] == (r["perplexity"] <= r["threshold"])


def test_quality_keeps_good_lines_it_was_not_trained_on(spark):
    sf = "/root/testdata/sf0.01"
    good = queries.trusted_documents(spark, sf)
    out = kneser_ney.line_quality(spark.read.parquet(f"{sf}/documents.parquet"), good.where("doc_id % 7 < 4"), "doc_id", "text", "lang")
    assert out.join(good.where("doc_id % 7 >= 4"), "doc_id").agg(F.avg(F.col("keep").cast("int"))).first()[0] > 0.95


def test_quality_separates_junk_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, junk = out[out.quality == 1], out[out.quality == 0]
    assert good.keep.mean() > 0.98 and junk.keep.mean() < 0.5


def test_quality_of_melodies_and_awkward_rows(spark):
    seqs = melody_sequences(spark, SF).limit(30).select(F.xxhash64("seq").alias("piece"), codes.token_line(F.col("notes"), F.col("bos")).alias("token_line"), F.lit("tune").alias("style"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "tune"), (-2, "", "tune"), (None, "abc", "rare"), (-3, "漢字" * 2000, None)], "piece long, token_line string, style string")
    rows = seqs.unionByName(odd).withColumns({"n": F.lit(1), "line": F.lit("x"), "total": F.lit(2)})
    got = kneser_ney.line_quality(rows, seqs).toPandas()
    assert len(got) == rows.count() and got[got.piece.isin([-1, -2])].keep.all()
    kept = kneser_ney.kept_lines(rows, seqs)
    assert kept.columns == rows.columns and kept.count() == int(got.keep.sum())
    none = kneser_ney.line_quality(rows, seqs.where("false"))
    assert none.where("NOT keep").count() == 0
    assert kneser_ney.line_quality(rows.where("false"), seqs).count() == 0


# --- containment ---

def test_fragments_in_pieces(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(30)] + [(30, None), (None, "a b c d e f")]
    pieces = []
    for i in range(60):
        body = rng.choices(words, k=rng.randint(0, 300))
        if i % 2:
            cut = items[i % 30][1].split()
            cut = [w if rng.random() > 0.02 else "zz" for w in cut]
            body[len(body) // 2:len(body) // 2] = cut
        pieces.append((i, " ".join(body).upper()))
    pieces += [(60, None), (None, "x y z u v w"), (1, "extra words of a repeated key")]
    p = spark.createDataFrame(pieces, "piece long, token_line string").withColumns({"words": F.lit(1), "bits": F.lit(2), "fragment": F.lit(3)})
    f = spark.createDataFrame(items, "query_id long, token_line string")
    got = {(r.piece, r.query_id, r.n_shared) for r in decontaminate.contained_fragments(p, f).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    by_key = defaultdict(set)
    for k, t in pieces:
        by_key[k] |= shingles(t)
    want = {(k, i, len(s & shingles(t))) for k, s in by_key.items() if k is not None for i, t in items
            if i is not None and shingles(t) and len(s & shingles(t)) >= 0.8 * len(shingles(t)) - 1e-9}
    assert got == want and len(want) > 5
    clean = decontaminate.without_fragments(p, f)
    assert clean.columns == p.columns and clean.count() == sum(k not in {w[0] for w in want} for k, _ in pieces)
    assert decontaminate.contained_fragments(p, f.where("false")).count() == 0
    assert decontaminate.contained_fragments(p.where("false"), f).count() == 0


def test_candidates_come_from_sketches_alone(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    p = spark.createDataFrame([(1, "before " + text + " after")], "piece long, token_line string")
    f = spark.createDataFrame([(7, text)], "query_id long, token_line string")
    assert [(r.piece, r.query_id, r.n_shared) for r in decontaminate.contained_fragments(p, f).collect()] == [(1, 7, 36)]
    whole = decontaminate.shingled_fragments
    monkeypatch.setattr(decontaminate, "shingled_fragments", lambda *a: whole(*a).withColumn("in_sketch", F.lit(False)))
    assert decontaminate.contained_fragments(p, f).count() == 0


def test_membership_table_grows_with_the_fragments():
    assert [decontaminate.table_bits(n) for n in (0, 1, 65_536, 65_537, 1 << 20, 1 << 40)] == [20, 20, 20, 21, 24, 24]


# --- archives ---

class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    import zlib

    out = io.BytesIO()
    package = warc_zip.Package(out, zip64)
    members = {"archive/a": b"x" * 1000, "indexes/é": b"", "c": bytes(range(256))}
    for name, data in members.items():
        package.member(name, [data], len(data), zlib.crc32(data))
    package.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert {n: z.read(n) for n in z.namelist()} == members
    found = warc_zip.read_directory(Memory(raw), len(raw))
    assert {n: raw[a:a + s] for n, (a, s, _) in found.items()} == members
    with pytest.raises(ValueError):
        warc_zip.read_directory(Memory(b"no package" * 10), 100)


def test_compressed_members_and_comments_are_skipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("packed", b"a" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("stored", b"b" * 100, zipfile.ZIP_STORED)
        z.comment = b"a comment"
    raw = out.getvalue()
    found = warc_zip.read_directory(Memory(raw), len(raw))
    assert list(found) == ["stored"] and raw[found["stored"][0]:][:100] == b"b" * 100


def test_archive_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/ä b\r\nc", big), (2, None, big), (3, "u", big), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (None, "u", big)]
    df = spark.createDataFrame(rows, "piece long, source_file string, score string").withColumns({"digest": F.lit(1), "payload": F.lit(2)})
    got = warc_zip.archived(spark, df).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t or "" for k, _, t in rows if k == r.piece]
        assert r.payload_digest == hashlib.sha1(texts[0].encode()).hexdigest() and r.payload_bytes == len(texts[0].encode())
        refers = 3 if texts[0] == big and r.piece != 3 else None
        assert r.refers_to == refers and r.record_type == ("revisit" if refers else "response")
        assert r.source_file == [u for k, u, _ in rows if k == r.piece][0]
    assert warc_zip.archived(spark, df.where("false")).count() == 0


def test_long_archives_close_packages(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "RANGE_ENTRIES", 7)
    df = spark.range(50).selectExpr("id AS piece", "'u' AS source_file", "repeat(md5(CAST(id AS STRING)), 50) AS score").coalesce(1)
    assert warc_zip.archived(spark, df).select("payload_digest").distinct().count() == 50


# --- addresses ---

def test_rules_and_parts(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.com/de/1", "http://example.com/DE/1", "http://x.net", "http://x.net/", "http://notexample.com/de/", "ftp://a.org/fr/#x",
            "http://net/?a", "http://b.example.net/fr/1", "a://b://c/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "piece long, source_file string").withColumns({"host": F.lit(1), "n": F.lit(2), "uri": F.lit("x")})
    got = {r.piece: r for r in url_templates.url_verdicts(df, queries.RULES_BLOCK, queries.RULES_ALLOW).collect()}
    rules = [(h, "/" + p, "block") for h, p in queries.RULES_BLOCK] + [(h, "/" + p, "allow") for h, p in queries.RULES_ALLOW]
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want[0])
        assert got[i].verdict == (want[1] or got[i].verdict) and got[i].verdict in ("block", "allow")
    assert url_templates.url_verdicts(df.where("false"), queries.RULES_BLOCK, queries.RULES_ALLOW).count() == 0


def test_bad_branches_stand_apart_and_are_blocked(spark):
    rows = [(i, f"http://h.com/ads/banner/{i}.html") for i in range(60)] + [(100 + i, f"http://h.com/news/{i}/story") for i in range(60)]
    df = spark.createDataFrame(rows, "piece long, source_file string")
    block = [("h.com", f"ads/banner/{i}.html") for i in range(40)]
    allow = [("h.com", f"news/{i}/") for i in range(40)]
    got = {r.piece: r for r in url_templates.url_verdicts(df, block, allow, threshold=0.8).collect()}
    assert all(got[i].verdict == "block" for i in range(60)) and all(got[100 + i].verdict == "allow" for i in range(60))
    assert got[59].template.startswith("h.com/ads") and got[159].rule is None


def test_rules_do_not_reach_other_directories(spark):
    paths = [f"{top}{name}/p{i}.html" for top in ("", "a/") for name in ("de", "en", "fr") for i in range(40)] + [f"x/{name}/{i}" for name in ("bad", "worse", "free") for i in range(40)]
    df = spark.createDataFrame([(i, f"http://h.com/{x}") for i, x in enumerate(paths)], "piece long, source_file string")
    block = [("h.com", x) for x in ("de/", "a/de/", "x/bad/", "x/worse/")]
    got = {r.piece: r for r in url_templates.url_verdicts(df, block, []).collect()}
    for i, x in enumerate(paths):
        assert got[i].verdict == ("block" if any(x.startswith(p) for _, p in block) else "allow"), (x, got[i])


# --- vectors ---

def test_top_matches(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(24)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 3), (303, [float("inf")]), (304, []), (305, [0.5] * 5), (None, [1.0]), (7, rows[7][1]), (306, rows[0][1]), (307, [1e6] * 24)]
    df = spark.createDataFrame(rows, "piece long, contour array<double>").withColumns({"score": F.lit(1), "qb": F.lit(2)})
    q = df.where("piece % 20 = 0")
    got = defaultdict(list)
    for r in sorted(topk.top_matches(q, df, k=5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.piece, r.score))
    ok = {k: [math.floor(64 * x) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {k: sorted(((-sum(a * b for a, b in zip(ok[k], v)), i) for i, v in ok.items() if i != k))[:5] for k in ok if k % 20 == 0}
    assert got == {k: [(i, -s) for s, i in v] for k, v in want.items()}
    assert topk.top_matches(q.where("false"), df).count() == 0 and topk.top_matches(q, df.where("false")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id AS piece", "transform(sequence(1, 12), i -> CAST(hash(id, i) % 100 AS DOUBLE) / 100) AS contour")
    q = rows.where("piece % 10 = 0")
    one = sorted(map(tuple, topk.top_matches(q, rows, k=7).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 6)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 30)
    assert sorted(map(tuple, topk.top_matches(q, rows, k=7).collect())) == one


def test_segment_bound_holds():
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(50, 37))
    last = np.full((20, 50), np.inf)
    for parts in topk.RESOLUTIONS:
        bound = topk._segments(q, parts) @ topk._segments(x, parts).T
        assert (bound >= q @ x.T - 1e-9).all()
    assert (bound <= last).all()


# --- near copies ---

def brute_fingerprint(text):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(keyed):
    root = {k: k for k, _ in keyed}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(keyed):
        for b, y in keyed[:i]:
            if (x ^ y).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k, _ in keyed}


def test_near_copies(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts |= {1000: None, 1001: "", 1002: "one", 1003: "one two", 1004: "A\u00a0B c\x0bd", 1005: "É x y z", 1006: "x " * 40000}
    df = spark.createDataFrame(list(texts.items()), "piece long, token_line string").withColumns({"fp": F.lit(1), "root": F.lit(2), "line": F.lit("x")})
    keyed = [(k, brute_fingerprint(t)) for k, t in texts.items()]
    groups = brute_groups(keyed)
    got = {r.piece: (r.fingerprint, r.component_id) for r in simhash.near_copies(df).collect()}
    assert got == {k: (f"{x:016x}", groups[k]) for k, x in keyed}
    kept = simhash.one_of_each(df.unionAll(df), "piece", "token_line")
    assert kept.columns == df.columns and sorted(r.piece for r in kept.collect()) == sorted(set(groups.values()))
    assert simhash.near_copies(df.where("false")).count() == 0
    null = spark.createDataFrame([(None, "a b c d"), (5, "a b c d")], "piece long, token_line string")
    assert {r.component_id for r in simhash.near_copies(null).collect()} == {5}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_fingerprint_links(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(15)] + [0, (1 << 64) - 1]
    values = list({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for c in centres for _ in range(25)})
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius)
    roots = {r.node: r.root for r in components(edges).collect()}
    root = {s: s for s in signed}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a in signed:
        for b in signed:
            if a < b and (signed[a] ^ signed[b]).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert {s: roots.get(s, s) for s in signed} == {s: find(s) for s in signed}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(500, 500), (601, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}, 600: 600, 601: 600}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- similar shingle sets ---

def brute_similar(texts, similarity=0.8):
    sets = {}
    for k, t in texts.items():
        parts = (t or "").encode().lower().split()
        n = min(5, len(parts))
        sets[k] = {tuple(parts[i:i + n]) for i in range(len(parts) - n + 1)} if n else set()
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) * 5 >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def test_near_duplicates_stage_finds_all_similar_texts(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, key = {}, 0
    for size in (4, 6, 12, 30, 60, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.randrange(0, 2 + size // 25)):
                    copy[rng.randrange(len(copy))] = word()
                if rng.random() < 0.3:
                    copy += [word() for _ in range(rng.randrange(0, 1 + size // 6))]
                texts[key] = " ".join(copy)
                key += 1
    hot = " ".join(f"common{i}" for i in range(12))
    for _ in range(40):
        texts[key] = hot + " " + " ".join(word() for _ in range(rng.randrange(0, 12)))
        key += 1
    texts |= {key: None, key + 1: "", key + 2: "One", key + 3: "one", key + 4: " ONE two"}
    want = brute_similar(texts)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs.repartition(5), SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(simhash.near_copies(docs, "doc_id", "text").select("component_id").distinct().collect())
    groups = shingle_join.similar_groups(docs, "doc_id", "text").collect()
    assert {r.doc_id: r.component_id for r in groups} == want


# --- pipeline ---

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(after.columns) == sorted(corpus_pipeline.COLUMNS) and after.count() <= rows
            rows = after.count()
            if name == "near_duplicates":
                groups = brute_similar({r.doc_id: r.text for r in docs.collect()})
                assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))
        else:
            assert after.select("doc_id").distinct().count() == rows
        docs = after
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
