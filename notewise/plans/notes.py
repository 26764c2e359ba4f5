"""Note view, windows, clean-up and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions import codes, names
from notewise.functions.draws import stable_hash
from notewise.operators import notes as N
from notewise.operators import ordered
from notewise.operators import splits as S
from notewise.operators import stats as ST
from notewise.plans.oracle import NOTES, ROWS, ctes, hash_sql, stable_hash_sql
from notewise.plans.registry import query
from notewise.sources import manifests, tables


@query(ctes(NOTES) + "SELECT doc, idx, pitch, st, dur, en, dt FROM notes")
def note_view(spark, sf):
    return tables.melody_notes(spark, sf).select("doc", "idx", "pitch", "st", "dur", "en", "dt")


@query(ctes(NOTES) + "SELECT doc, idx, greatest(0, least(95, dur)) AS dur_code, greatest(-96, least(95, dt)) AS dt_code FROM notes")
def delta_time(spark, sf):
    n = tables.melody_notes(spark, sf)
    return n.select("doc", "idx", codes.dur_code(F.col("dur")).alias("dur_code"), codes.dt_code(F.col("dt")).alias("dt_code"))


@query(f"SELECT DISTINCT user_id AS doc, {stable_hash_sql('CAST(user_id AS VARCHAR)')} AS h FROM events")
def stable_hash_of_piece(spark, sf):
    e = tables.table(spark, sf, "events").select(F.col("user_id").alias("doc")).distinct()
    return e.selectExpr("doc", f"{stable_hash('CAST(doc AS STRING)')} AS h")


SHIP = """ship AS (
  SELECT l_suppkey AS supp, l_orderkey AS okey, l_linenumber AS line,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1 AS idx,
         count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM lineitem),
wins AS (
  SELECT supp, w, idx - 256 * w AS i, least(512, n - 256 * w) AS wlen, okey
  FROM (SELECT *, unnest([idx // 256, idx // 256 - 1]) AS w FROM ship)
  WHERE w >= 0 AND idx < 256 * w + 512 AND (w = 0 OR 256 * (w - 1) + 512 < n) AND least(512, n - 256 * w) >= 16)"""


@query(ctes(SHIP) + "SELECT supp, w, wlen, count(*) AS n_rows, CAST(sum(okey) AS BIGINT) AS okey_sum FROM wins GROUP BY ALL")
def seq_windows(spark, sf):
    rows = ordered.to_windows(tables.shipment_rows(spark, sf))
    return rows.groupBy("supp", "w", "wlen").agg(F.count("*").alias("n_rows"), F.sum("okey").alias("okey_sum"))


@query(ctes(NOTES) + """SELECT doc, count(*) AS n_notes, count(DISTINCT pitch) AS n_pitches FROM notes
GROUP BY doc HAVING count(*) >= 40 AND count(DISTINCT pitch) >= 5""")
def voice_admission(spark, sf):
    return N.admitted_voices(tables.melody_notes(spark, sf), ["doc"])


@query(ctes(NOTES) + """, v AS (SELECT doc, kind, count(*) AS n_notes, count(DISTINCT pitch) AS n_pitches FROM notes GROUP BY doc, kind)
SELECT CASE WHEN n_notes < 12 THEN 'too_few_notes' WHEN n_pitches < 10 THEN 'too_few_pitches' ELSE 'kept' END AS reason,
       count(*) AS voices, CAST(sum(n_notes) AS BIGINT) AS n_notes FROM v GROUP BY 1""")
def skip_reasons(spark, sf):
    v = N.voice_sizes(tables.melody_notes(spark, sf), ["doc", "kind"])
    reason = F.coalesce(N.skip_reason(F.col("n_notes"), F.col("n_pitches"), 12, 10), F.lit("kept"))
    return v.groupBy(reason.alias("reason")).agg(F.count("*").alias("voices"), F.sum("n_notes").alias("n_notes"))


QUANT = """SELECT l_orderkey AS okey, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS pkey,
  CAST(round_even(l_partkey * 37 * 12 / CAST(480 AS DOUBLE), 0) AS BIGINT) AS st0,
  CAST(round_even((l_partkey * 37 + l_quantity * 11) * 12 / CAST(480 AS DOUBLE), 0) AS BIGINT) AS en0,
  CAST(l_quantity * 3 AS BIGINT) AS pitch FROM lineitem"""


@query(f"""SELECT okey, line, pkey, pitch, st0 AS st, greatest(st0 + 1, least(en0, 65536)) AS en FROM ({QUANT})
WHERE pitch BETWEEN 0 AND 127 AND st0 < 65536""")
def quantise_and_filter(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    tick, tick_end = F.col("l_partkey") * 37, F.col("l_partkey") * 37 + F.col("l_quantity") * 11
    raw = li.select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("pkey"),
        codes.tick_to_pos(tick, F.lit(480.0)).alias("st"), codes.tick_to_pos(tick_end, F.lit(480.0)).alias("en"),
        (F.col("l_quantity") * 3).cast("int").alias("pitch"))
    return N.in_range(raw)


@query("""WITH RECURSIVE s AS (
  SELECT DISTINCT CAST(l_quantity AS BIGINT) * (1 + l_linenumber) AS num0, CAST(pow(2, l_orderkey % 9) AS BIGINT) AS den0 FROM lineitem),
h AS (SELECT num0, den0, num0 AS num, den0 AS den FROM s
  UNION ALL SELECT num0, den0, num // 2, den // 2 FROM h WHERE den > 64 AND den % 2 = 0 AND num % 2 = 0),
h2 AS (SELECT num0, den0, arg_min(num, den) AS num, min(den) AS den FROM h GROUP BY num0, den0),
d AS (SELECT * FROM h2 UNION ALL
  SELECT num0, den0, num // list_filter(range(2, num + 1), lambda x: num % x = 0)[1], den FROM d WHERE num > 2 * den)
SELECT num0, den0, min(num) AS num, min(den) AS den FROM d GROUP BY num0, den0""")
def signature_reduction(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    s = li.select(
        (F.col("l_quantity").cast("long") * (1 + F.col("l_linenumber"))).alias("num0"),
        F.pow(F.lit(2), F.col("l_orderkey") % 9).cast("long").alias("den0")).distinct()
    r = s.withColumn("r", N.reduced_signature(F.col("num0"), F.col("den0")))
    return r.select("num0", "den0", F.col("r.num").alias("num"), F.col("r.den").alias("den"))


SIGNS = """sig AS (
  SELECT doc, st AS pos, 2 + max(pitch) % 5 AS num, CAST(4 + 4 * (max(pitch) % 2) AS BIGINT) AS den FROM notes
  WHERE kind = 'signup' AND pitch % 4 = 0 GROUP BY doc, st),
ext AS (SELECT doc, max(en) + 1 AS max_pos FROM notes GROUP BY doc),
pts AS (SELECT * FROM sig UNION ALL SELECT doc, 0, 4, 4 FROM ext WHERE doc NOT IN (SELECT doc FROM sig WHERE pos = 0)),
seg AS (SELECT pts.*, lead(pos) OVER (PARTITION BY pts.doc ORDER BY pos) AS nxt, max_pos,
               CAST(round_even(num * 48 / CAST(den AS DOUBLE), 0) AS BIGINT) AS len FROM pts JOIN ext ON ext.doc = pts.doc),
bars AS (SELECT doc, num, den, m_start, least(m_start + len, coalesce(nxt, m_start + len)) AS m_end
  FROM (SELECT *, unnest(range(pos, least(coalesce(nxt, max_pos), max_pos), len)) AS m_start FROM seg WHERE pos < max_pos))"""


def _signature_bars(spark, sf):
    n = tables.melody_notes(spark, sf)
    sig = n.where("kind = 'signup' AND pitch % 4 = 0").groupBy("doc", F.col("st").alias("pos")).agg(F.max("pitch").alias("p")).select(
        "doc", "pos", F.lit(0).alias("seq_no"), (2 + F.col("p") % 5).alias("num"), (4 + 4 * (F.col("p") % 2)).alias("den"))
    ext = n.groupBy("doc").agg((F.max("en") + 1).alias("max_pos"))
    return n, sig, N.bar_grid(sig, ext, ["doc"])


@query(ctes(NOTES, SIGNS) + "SELECT doc, m_start, m_end FROM bars")
def bar_grid(spark, sf):
    return _signature_bars(spark, sf)[2]


@query(ctes(NOTES, SIGNS) + """, c AS (SELECT doc, num, den, count(*) AS bars FROM sig GROUP BY ALL)
SELECT doc, num, den, bars FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY bars DESC, num, den) AS r FROM c) WHERE r = 1""")
def dominant_signature(spark, sf):
    sig = _signature_bars(spark, sf)[1]
    return N.dominant_signature(sig.withColumn("bars", F.lit(1)), ["doc"])


EVEN_BARS = """ext AS (SELECT doc, max(en) AS max_pos FROM notes GROUP BY doc),
bars AS (SELECT doc, m_start, m_start + 48 AS m_end FROM (SELECT doc, unnest(range(0, max_pos, 48)) AS m_start FROM ext)),
empty AS (SELECT * FROM bars b WHERE NOT EXISTS (
  SELECT 1 FROM notes t WHERE t.doc = b.doc AND t.st < b.m_end AND t.en > b.m_start))"""


def _even_bars(n, keys=("doc",)):
    ext = n.groupBy(*keys).agg(F.max("en").alias("max_pos"))
    return N.even_bars(ext, list(keys))


@query(ctes(NOTES, EVEN_BARS) + """, sh AS (SELECT t.doc, t.idx, t.st, t.en, coalesce((SELECT sum(48) FROM empty e
  WHERE e.doc = t.doc AND e.m_end <= t.st), 0) AS removed FROM notes t)
SELECT doc, idx, st, en, CAST(st - removed AS BIGINT) AS new_st, CAST(greatest(en - removed, st - removed + 1) AS BIGINT) AS new_en FROM sh""")
def trim_empty_bars(spark, sf):
    n = tables.melody_notes(spark, sf)
    return N.trim_empty_bars(n, _even_bars(n), ["doc"]).select("doc", "idx", "st", "en", "new_st", "new_en")


@query(ctes(NOTES) + """, ext AS (SELECT doc, kind, max(en) AS max_pos FROM notes GROUP BY doc, kind),
bars AS (SELECT doc, kind, m_start, m_start + 48 AS m_end FROM (SELECT *, unnest(range(0, max_pos, 48)) AS m_start FROM ext)),
empty AS (SELECT * FROM bars b WHERE NOT EXISTS (SELECT 1 FROM notes t
  WHERE t.doc = b.doc AND t.kind = b.kind AND t.st < b.m_end AND t.en > b.m_start)),
isl AS (SELECT *, m_start - 48 * row_number() OVER (PARTITION BY doc, kind ORDER BY m_start) AS g FROM empty)
SELECT doc, kind, min(m_start) AS m_start, max(m_end) AS m_end FROM isl GROUP BY doc, kind, g""")
def empty_bar_islands(spark, sf):
    n = tables.melody_notes(spark, sf)
    return N.merge_islands(N.empty_bars(n, _even_bars(n, ("doc", "kind")), ["doc", "kind"]), ["doc", "kind"])


@query(ctes(NOTES) + """, two AS (SELECT * FROM notes WHERE kind IN ('purchase', 'signup')),
ext AS (SELECT doc, max(en) AS max_pos FROM two GROUP BY doc),
bars AS (SELECT doc, m_start, m_start + 48 AS m_end FROM (SELECT doc, unnest(range(0, max_pos, 48)) AS m_start FROM ext)),
empty AS (SELECT * FROM bars b WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.doc = b.doc AND t.st < b.m_end AND t.en > b.m_start)),
sh AS (SELECT t.*, coalesce((SELECT sum(48) FROM empty e WHERE e.doc = t.doc AND e.m_end <= t.st), 0) AS removed FROM two t)
SELECT doc, kind, idx, CAST(st - removed AS BIGINT) AS new_st, CAST(greatest(en - removed, st - removed + 1) AS BIGINT) AS new_en FROM sh""")
def trim_jointly_empty_bars(spark, sf):
    n = tables.melody_notes(spark, sf).where("kind IN ('purchase', 'signup')")
    return N.trim_empty_bars(n, _even_bars(n), ["doc", "kind"], ["doc"]).select("doc", "kind", "idx", "new_st", "new_en")


@query(ctes(NOTES) + f"""SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY st, {hash_sql('order', 7, 'doc', 'idx')}, idx) - 1 AS order_idx FROM notes""")
def note_order(spark, sf):
    return N.note_order(tables.melody_notes(spark, sf), ["doc"], 7, ["idx"]).select("doc", "idx", "order_idx")


@query(ctes(NOTES) + """SELECT doc, st, pitch, en, idx FROM (SELECT *, row_number() OVER (
  PARTITION BY doc, st ORDER BY pitch DESC, en DESC, idx) AS r FROM notes) WHERE r = 1""")
def monophonise(spark, sf):
    return N.monophonise(N.shift_to_zero(tables.melody_notes(spark, sf), ["doc"]), ["doc"])


PROFILE = """prof AS (SELECT doc, kind, count(*) AS n, median(pitch) AS median_pitch, max(pitch) AS max_pitch FROM notes GROUP BY doc, kind)"""


@query(ctes(NOTES, PROFILE) + """SELECT doc, n, median_pitch, max_pitch, kind FROM (SELECT *, row_number() OVER (
  PARTITION BY doc ORDER BY n DESC, median_pitch DESC, max_pitch DESC, ascii(kind) ASC) AS r FROM prof) WHERE r = 1""")
def primary_voice(spark, sf):
    prof = N.voice_profile(tables.melody_notes(spark, sf), "doc", "kind")
    return N.pick_voice(prof, "doc", "kind", F.ascii("kind"))


@query(ctes(NOTES, PROFILE) + """SELECT doc, median_pitch, n, kind FROM (SELECT *, row_number() OVER (
  PARTITION BY doc ORDER BY median_pitch DESC, n DESC, ascii(kind) ASC) AS r FROM prof) WHERE r = 1""")
def treble_voice(spark, sf):
    prof = N.voice_profile(tables.melody_notes(spark, sf), "doc", "kind")
    return N.pick_voice(prof, "doc", "kind", F.ascii("kind"), "treble")


@query(ctes(SHIP) + """, wt AS (SELECT DISTINCT supp % 7 AS file, supp, w, wlen FROM wins)
SELECT file, supp, w, wlen FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY supp, w) AS r FROM wt WHERE w < 2) WHERE r <= 9""")
def window_caps(spark, sf):
    sizes = tables.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.count("*").alias("n"))
    wt = ordered.window_table(sizes).withColumn("file", F.col("supp") % 7)
    return S.capped_windows(wt, "file", "supp", per_voice=2, per_file=9).select("file", "supp", "w", "wlen")


def _split_sql(seed, items):
    return f"""g AS (SELECT user_id % 40 AS grp, count(*) AS size FROM ({items}) GROUP BY 1),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
       sum(size) OVER () AS total FROM (SELECT *, {hash_sql('split', seed, 'grp')} AS h FROM g)),
t AS (SELECT coalesce(max(bef + size) FILTER (WHERE bef < round_even(total * CAST(0.8 AS DOUBLE), 0)), 0) AS tt FROM o),
sp AS (SELECT grp, CASE WHEN bef < round_even(total * CAST(0.8 AS DOUBLE), 0) THEN 'train'
   WHEN bef - tt < round_even(total * CAST(0.1 AS DOUBLE), 0) THEN 'valid' ELSE 'test' END AS split FROM o, t)"""


USERS = "SELECT DISTINCT user_id FROM events"


def split_pieces(spark, sf, seed=11):
    users = tables.table(spark, sf, "events").select(F.col("user_id").alias("doc")).distinct().withColumn("grp", F.col("doc") % 40)
    return S.group_split(users, "grp", seed, (0.8, 0.1, 0.1))


@query(ctes(_split_sql(11, USERS)) + f"SELECT user_id AS doc, grp, split FROM ({USERS}) JOIN sp ON grp = user_id % 40")
def group_split(spark, sf):
    return split_pieces(spark, sf).select("doc", "grp", "split")


@query(f"""SELECT doc_id, quality, rnk < q AS is_test FROM (
  SELECT *, CASE WHEN n < 2 THEN 0 ELSE least(greatest(round_even(n * CAST(0.1 AS DOUBLE), 0), 1), n - 1) END AS q FROM (
    SELECT doc_id, CAST(quality AS BIGINT) AS quality, count(*) OVER (PARTITION BY quality) AS n,
           row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('strata', 5, 'doc_id')}, doc_id) - 1 AS rnk FROM labels))""")
def stratified_split(spark, sf):
    return S.stratified_split(tables.table(spark, sf, "labels"), "quality", "doc_id", 5, 0.1).select("doc_id", "quality", "is_test")


@query(f"""SELECT doc_id, rnk < least(greatest(round_even(n * CAST(0.25 AS DOUBLE), 0), 1), n - 1) AS is_test FROM (
    SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY {hash_sql('strata', 6, 'doc_id')}, doc_id) - 1 AS rnk FROM labels)""")
def random_split(spark, sf):
    return S.stratified_split(tables.table(spark, sf, "labels"), None, "doc_id", 6, 0.25).select("doc_id", "is_test")


SPANS = """clock AS (SELECT seq, doc, i, wlen, dur, coalesce(sum(dur + greatest(dt, -dur)) OVER (
    PARTITION BY seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset FROM rows_),
spans AS (SELECT seq, doc, max(wlen) AS n, CAST(max(onset + dur) AS BIGINT) AS span FROM clock GROUP BY seq, doc)"""


@query(ctes(ROWS, SPANS, _split_sql(11, USERS)) + """SELECT coalesce(split, 'all') AS split, count(*) AS sequences,
  CAST(sum(n + 2) AS BIGINT) AS events_sum, CAST(sum(n) AS BIGINT) AS notes_sum, min(n) AS notes_min, max(n) AS notes_max, round(avg(n), 6) AS notes_mean,
  CAST(sum(span) AS BIGINT) AS span_sum, min(span) AS span_min, max(span) AS span_max, round(avg(span), 6) AS span_mean,
  round(sum(span) / CAST(12 AS DOUBLE) * (CAST(60 AS DOUBLE) / 120), 6) AS seconds_sum
FROM spans JOIN sp ON grp = doc % 40 GROUP BY ROLLUP (split)""")
def export_stats_rollup(spark, sf):
    seqs = tables.melody_sequences(spark, sf)
    return ST.export_stats(seqs.join(split_pieces(spark, sf).select("doc", "split"), "doc"))


@query(ctes(ROWS, _split_sql(11, "SELECT c_custkey AS user_id FROM customer")) + """SELECT split, count(*) AS assigned, count(*) FILTER (WHERE bad) AS error,
  count(*) FILTER (WHERE has AND NOT bad) AS with_sequences, count(*) FILTER (WHERE NOT has AND NOT bad) AS zero_sequences
FROM (SELECT c_custkey, c_custkey IN (SELECT doc FROM rows_) AS has, coalesce(c_acctbal < 0, false) AS bad FROM customer) JOIN sp ON grp = c_custkey % 40 GROUP BY split""")
def file_accounting(spark, sf):
    """Files in the red are those that could not be read."""
    files = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), "c_acctbal").withColumn("grp", F.col("doc") % 40)
    assigned = S.group_split(files, "grp", 11, (0.8, 0.1, 0.1))
    return ST.file_accounting(assigned, ordered.to_windows(tables.melody_notes(spark, sf)), "doc", "split", F.col("c_acctbal") < 0)


VOCAB = """vocab AS (SELECT g AS global_id, CASE
    WHEN g < 5 THEN ['<pad>', '<unk>', '<s>', '</s>', '<mask>'][g + 1]
    WHEN g < 133 THEN '<0-' || (g - 5) || '>' WHEN g < 229 THEN '<1-' || (g - 133) || '>'
    WHEN g < 325 THEN '<2-' || (g - 229) || '>' ELSE '<2-!' || (g - 324) || '>' END AS token
  FROM (SELECT unnest(range(0, 421)) AS g))"""
DT_ID = "CASE WHEN {0} >= 0 THEN 229 + {0} ELSE 324 - {0} END"


@query(ctes(ROWS, VOCAB) + f""", ids AS (
  SELECT unnest([pitch + 5, dur + 133, {DT_ID.format('dt')}]) AS g FROM rows_
  UNION ALL SELECT unnest([2, 2, {DT_ID.format('least(95, st)')}, 3, 3, 3]) FROM rows_ WHERE i = 0)
SELECT token, CAST(global_id AS BIGINT) AS global_id, count(ids.g) AS n FROM vocab LEFT JOIN ids ON g = global_id GROUP BY token, global_id""")
def token_counts(spark, sf):
    return ST.token_counts(tables.melody_sequences(spark, sf))


@query(ctes(ROWS) + f"""SELECT seq, wlen + 2 AS used, CAST(514 - wlen - 2 AS BIGINT) AS pads,
  CAST(sum(pitch + 5) AS BIGINT) + 2 + 3 AS pitch_sum, CAST(sum({DT_ID.format('dt')}) AS BIGINT) + 3 + max(CASE WHEN i = 0 THEN {DT_ID.format('least(95, st)')} END) AS dt_sum,
  CAST(sum((i + 1) * (pitch + 5)) AS BIGINT) + (wlen + 1) * 3 AS weighted
FROM rows_ GROUP BY seq, wlen""")
def padded_export(spark, sf):
    s = tables.melody_sequences(spark, sf).select("seq", codes.padded_events(F.col("notes"), F.col("bos")).alias("ev"))
    total = lambda f: F.aggregate(F.transform("ev", f), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select(
        "seq", codes.used_length(F.col("ev")).alias("used"), F.size(F.filter("ev", lambda e: e["pitch"] == 0)).alias("pads"),
        total(lambda e: e["pitch"]).alias("pitch_sum"), total(lambda e: e["dt"]).alias("dt_sum"),
        total(lambda e, j: e["pitch"] * j).alias("weighted"))


@query(ctes(ROWS) + "SELECT seq, i, pitch, dur, dt FROM rows_")
def decode_events(spark, sf):
    s = tables.melody_sequences(spark, sf).select("seq", codes.padded_events(F.col("notes"), F.col("bos")).alias("ev"))
    t = s.select("seq", F.posexplode(codes.decode_events(F.col("ev"), strict=True)).alias("i", "t"))
    return t.select("seq", "i", "t.*")


@query(ctes(ROWS) + """SELECT seq, '<s> <s> <2-' || least(95, max(st) FILTER (WHERE i = 0)) || '> ' || string_agg('<0-' || pitch || '> <1-' || dur || '> <2-' ||
  CASE WHEN dt < 0 THEN '!' || (-dt) ELSE CAST(dt AS VARCHAR) END || '>', ' ' ORDER BY i) || ' </s> </s> </s>' AS line FROM rows_ GROUP BY seq""")
def token_lines(spark, sf):
    return tables.melody_sequences(spark, sf).select("seq", codes.token_line(F.col("notes"), F.col("bos")).alias("line"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem,
  regexp_extract(url, '([^/]*)/[^/]*$', 1) || '/' || regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS parent_stem,
  CASE WHEN regexp_matches(url, '/(\\d+)') THEN regexp_extract(url, '/(\\d+)', 1) ELSE regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') END AS rx,
  regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1F]', '_', 'g'), '[. ]+$', '') AS safe
FROM pages""")
def group_keys(spark, sf):
    p, u = tables.table(spark, sf, "pages"), F.col("url")
    return p.select(
        "page_id", names.file_name(u).alias("file"), names.group_key(u, "stem").alias("stem"),
        names.group_key(u, "parent_stem").alias("parent_stem"), names.group_key(u, r"regex:/(\d+)").alias("rx"),
        names.safe_file_name(u).alias("safe"))


@query("""WITH v AS (SELECT page_id, regexp_replace(regexp_extract(url, '//([^/]*)/', 1), '[0-9_\\- ]', '', 'g') AS volume FROM pages)
SELECT page_id, volume, dense_rank() OVER (ORDER BY volume) - 1 AS label FROM v""")
def class_labels(spark, sf):
    p = tables.table(spark, sf, "pages").withColumn("folder", F.regexp_extract("url", "//([^/]*)/", 1))
    return manifests.class_labels(p, "folder").select("page_id", "volume", "label")
