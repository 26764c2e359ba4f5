"""Relation tokens, BM25 search and its evaluation."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from notewise.constants import WINDOW_STEP

from notewise.functions import relation as R
from notewise.functions.draws import uniform_int
from notewise.operators import corrupt as CO
from notewise.operators import retrieval as X
from notewise.operators import selectors as S
from notewise.operators import transforms as T
from notewise.operators.ordered import pack
from notewise.operators.transforms import cut_fragment
from notewise.plans.arrow_jobs import DELETE_RULE, MERGE_RULE, _fold_sql
from notewise.plans.metrics import LONGEST, labelled
from notewise.plans.noise import jittered_pitch_sql
from notewise.plans.oracle import NOTES, ROWS, ctes, uniform_int_sql, uniform_sql
from notewise.plans.pairs import member_corpus
from notewise.plans.registry import query
from notewise.session import checkpointed, shared_folder
from notewise.sources import tables

BIN = "list_count(list_filter([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64], lambda e: e < {0}))"
DP = "dp + 128"
COARSE = f"(dp + 128) * 65536 + {BIN.format('d0')} * 256 + {BIN.format('d1')}"
RATIO = "(dp + 128) * 65536 + (d1 // gcd(d0, d1)) * 256 + d0 // gcd(d0, d1)"


def _tok(expr, name="tok", source="rows_", keys="doc, w"):
    return f"""{name} AS (SELECT {keys}, i - 1 AS i, CAST({expr} AS BIGINT) AS t FROM (
  SELECT {keys}, i, pitch - lag(pitch) OVER q AS dp, lag(dur) OVER q AS d0, dur AS d1 FROM {source}
  WINDOW q AS (PARTITION BY {keys} ORDER BY i)) WHERE dp IS NOT NULL)"""


def _gram(name="gram", source="tok", keys="doc, w", n=2):
    term = " || ',' || ".join(["t", "lead(t) OVER q", "lead(t, 2) OVER q"][:n])
    return f"""{name} AS (SELECT * FROM (SELECT {keys}, {term} AS term FROM {source}
  WINDOW q AS (PARTITION BY {keys} ORDER BY i)) WHERE term IS NOT NULL)"""


def _tokens(spark, sf, mode):
    s = tables.melody_sequences(spark, sf)
    return s.select("seq", F.posexplode_outer(F.expr(R.relation_tokens("notes", mode))).alias("i", "token")).where("i IS NOT NULL")


@query(ctes(ROWS, _tok(DP)) + "SELECT doc || '#' || w AS seq, i, t AS token FROM tok")
def rel_tokens_dp(spark, sf):
    return _tokens(spark, sf, "dp_only")


@query(ctes(ROWS, _tok(COARSE)) + "SELECT doc || '#' || w AS seq, i, t AS token FROM tok")
def rel_tokens_coarse(spark, sf):
    return _tokens(spark, sf, "dp_coarse_dur")


@query(ctes(ROWS, _tok(RATIO)) + """SELECT doc || '#' || w AS seq, i, t AS token, t // 65536 - 128 AS dp, (t // 256) % 256 AS num, t % 256 AS den FROM tok""")
def rel_tokens_ratio(spark, sf):
    t = _tokens(spark, sf, "dp_dur_ratio").withColumn("u", R.unpack_token(F.col("token"), "dp_dur_ratio"))
    return t.select("seq", "i", "token", F.col("u.dp").alias("dp"), F.col("u.a").alias("num"), F.col("u.b").alias("den"))


MODE, N = "dp_only", 3
FRAGMENT_NOTES = (8, 64)


def melody_docs(seqs, mode=MODE, n=N):
    return seqs.selectExpr("doc", "w", f"greatest(size(notes) - {n}, 0) AS dl", f"{R.ngram_keys(R.relation_tokens('notes', mode), n, mode)} AS terms")


def drawn_fragments(seqs, seed=51):
    """One fragment of each sequence: length, then start, drawn uniformly over the whole sequence."""
    low, high = FRAGMENT_NOTES
    sized = seqs.selectExpr("doc", "w", "notes", f"{uniform_int('frag.len', seed, low, f'least({high}, size(notes))', 'doc', 'w')} AS flen")
    placed = sized.selectExpr("*", f"{uniform_int('frag.start', seed, 0, 'size(notes) - flen', 'doc', 'w')} AS fstart")
    return cut_fragment(placed, "fstart", "flen").select("doc", "w", "notes")


def as_queries(fragments, mode=MODE, n=N):
    """Query terms, with the fragment's own sequence as the target."""
    return fragments.selectExpr("doc AS q_doc", "w AS q_w", "doc AS t_doc", "w AS t_w", f"{R.ngram_keys(R.relation_tokens('notes', mode), n, mode)} AS terms")


TF = "tf AS (SELECT doc, w, term, count(*) AS tf FROM gram GROUP BY ALL)"


@query(ctes(ROWS, _tok(COARSE), _gram(n=3), TF) + """SELECT doc || '#' || w AS seq, (c[1] * 65536 + c[2]) * 65536 + c[3] AS term, tf
FROM (SELECT *, list_transform(string_split(term, ','), lambda s: (CAST(s AS BIGINT) // 65536) * 256 + (CAST(s AS BIGINT) // 256) % 256 * 16 + CAST(s AS BIGINT) % 256) AS c FROM tf)""")
def ngrams(spark, sf):
    tf = X.term_frequencies(melody_docs(tables.melody_sequences(spark, sf), "dp_coarse_dur", 3), ["doc", "w"])
    return tf.select(F.concat_ws("#", "doc", "w").alias("seq"), "term", "tf")


def _stats(source="rows_", n=N):
    return f"""dl AS (SELECT doc, w, greatest(0, count(*) - {n}) AS dl FROM {source} GROUP BY doc, w),
cs AS (SELECT CAST(count(*) AS DOUBLE) AS nd, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((nd - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, cs)"""


@query(ctes(ROWS, _tok(DP), _gram(), TF, _stats(n=2)) + "SELECT CAST(string_split(term, ',')[1] AS BIGINT) * 256 + CAST(string_split(term, ',')[2] AS BIGINT) AS term, df, round(idf, 9) AS idf FROM idf")
def postings_idf(spark, sf):
    index = X.build_index(melody_docs(tables.melody_sequences(spark, sf), n=2), ["doc", "w"])
    return X.idf_table(index).select("term", "df", F.round("idf", 9).alias("idf"))


def _frag(source="rows_", seed=51):
    """Drawn fragments of (doc, w) rows that are numbered from 0 without gaps, renumbered from 0."""
    low, high = FRAGMENT_NOTES
    return f"""fl AS (SELECT doc, w, n, {uniform_int_sql('frag.len', seed, low, f'least({high}, n)', 'doc', 'w')} AS flen FROM (SELECT doc, w, count(*) AS n FROM {source} GROUP BY doc, w)),
fs AS (SELECT *, {uniform_int_sql('frag.start', seed, 0, 'n - flen', 'doc', 'w')} AS fstart FROM fl),
frag AS (SELECT r.doc, r.w, CAST(r.i - fstart AS BIGINT) AS i, flen AS n, pitch, dur, dt FROM {source} r JOIN fs ON fs.doc = r.doc AND fs.w = r.w WHERE r.i >= fstart AND r.i < fstart + flen)"""


def _asked(source="frag"):
    """Query terms of (doc, w, i, pitch, dur) rows."""
    return f"""asked AS (SELECT doc AS q_doc, w AS q_w, i, pitch, dur FROM {source}),
{_tok(DP, "qtok", "asked", "q_doc, q_w")},
{_gram("qgram", "qtok", "q_doc, q_w", N)}"""


def _bm25(keys, m):
    return f"""qf AS (SELECT {keys}, term, count(*) AS qf FROM qgram GROUP BY ALL),
sc AS (SELECT {keys}, doc, w, round(sum(idf * (CAST(tf AS DOUBLE) * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) * qf), 9) AS score
  FROM qf JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc, w), cs GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc, w) AS rank FROM sc) WHERE rank <= {m})"""


BASE = (ROWS, _tok(DP), _gram(n=N), TF, _stats(), _frag(), _asked(), _bm25("q_doc, q_w", 50))


def _search(spark, sf):
    seqs = tables.melody_corpus(spark, sf)
    queries = as_queries(drawn_fragments(seqs))
    return queries, X.search(X.build_index(melody_docs(seqs), ["doc", "w"]), queries, ["q_doc", "q_w"], 50)


def _recall(queries, hits):
    return X.recall_mrr(X.target_ranks(queries, hits, ["q_doc", "q_w"], {"doc": "t_doc", "w": "t_w"}))


@query(ctes(*BASE) + "SELECT q_doc, q_w, doc, w, round(score, 6) AS score, rank FROM top")
def bm25_topm(spark, sf):
    return _search(spark, sf)[1].select("q_doc", "q_w", "doc", "w", F.round("score", 6).alias("score"), "rank")


RECALL = """SELECT count(*) AS n_queries, {cols}, round(avg(coalesce(1 / CAST(rank AS DOUBLE), 0)), 9) AS mrr FROM rk""".format(
    cols=", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 9) AS recall_{k}" for k in (1, 5, 10, 20)))


RANKS = "rk AS (SELECT d.doc, d.w, t.rank FROM dl d LEFT JOIN top t ON t.q_doc = d.doc AND t.q_w = d.w AND t.doc = d.doc AND t.w = d.w)"


@query(ctes(*BASE, RANKS) + RECALL)
def bm25_recall_mrr(spark, sf):
    return _recall(*_search(spark, sf))


@query(ctes(*BASE) + "SELECT q_doc, q_w, doc, w, round(score, 6) AS score, rank FROM top")
def bm25_stored_index(spark, sf):
    """The same search over an index that is written once, bucketed by term and block, and read back."""
    seqs = tables.melody_corpus(spark, sf)
    table = f"melody_index_{uuid4().hex}"
    X.store_index(X.build_index(melody_docs(seqs), ["doc", "w"]), table, f"{shared_folder(spark)}/{table}", 8)
    hits = X.search(X.stored_index(spark, table, ["doc", "w"]), as_queries(drawn_fragments(seqs)), ["q_doc", "q_w"], 50)
    return hits.select("q_doc", "q_w", "doc", "w", F.round("score", 6).alias("score"), "rank")


NOISE_SEED = 52
NOISY = f"""src AS (SELECT doc, w, i, n, pitch, greatest(1, least(95, dur)) AS dur, CASE WHEN i = n - 1 AND n > 1 THEN 0 ELSE dt END AS dt,
  {uniform_sql('merge', NOISE_SEED, 'doc', 'w', 'i')} AS u, {uniform_sql('delete', NOISE_SEED, 'doc', 'w', 'i')} AS v FROM frag),
""" + _fold_sql("fm", "src", *MERGE_RULE) + ",\n" + _fold_sql("fd", "fm_out", *DELETE_RULE) + f""",
noisy AS (SELECT doc, w, i, {jittered_pitch_sql(NOISE_SEED)} AS pitch, dur FROM fd_out)"""


@query("WITH RECURSIVE " + ctes(ROWS, _tok(DP), _gram(n=N), TF, _stats(), _frag(), NOISY, _asked("noisy"), _bm25("q_doc, q_w", 50), RANKS)[5:] + RECALL)
def bm25_noisy_recall(spark, sf):
    """Fragments with merged, lost and mistaken notes against the whole sequences."""
    seqs = tables.melody_corpus(spark, sf)
    lossy = CO.structural(drawn_fragments(seqs), ["doc", "w"], NOISE_SEED)
    queries = as_queries(T.pitch_jitter(lossy, ["doc", "w"], NOISE_SEED))
    return _recall(queries, X.search(X.build_index(melody_docs(seqs), ["doc", "w"]), queries, ["q_doc", "q_w"], 50))


SKELETON = "sk AS (SELECT doc, w, row_number() OVER (PARTITION BY doc, w ORDER BY i) - 1 AS i, pitch, dur, dt FROM sc_l WHERE hard AND k >= 8)"


@query(ctes(LONGEST.replace("sc AS (", "sc_l AS ("), SKELETON, _tok(DP, source="sk"), _gram(n=N), TF, _stats("sk"), _frag("sk"), _asked(), _bm25("q_doc, q_w", 50), RANKS) + RECALL)
def bm25_skeleton_recall(spark, sf):
    """Skeletons (the longest notes, as many as the sequence has gold ones) as documents, fragments of them as queries."""
    rows = labelled(spark, sf).where("k >= 8")
    hard = S.longest_k(rows, ["doc", "w"]).where("hard").select("doc", "w", "i")
    seqs = checkpointed(pack(rows.join(hard, ["doc", "w", "i"]), ["doc", "w"], ["pitch", "dur", "dt"]))
    queries = as_queries(drawn_fragments(seqs))
    return _recall(queries, X.search(X.build_index(melody_docs(seqs), ["doc", "w"]), queries, ["q_doc", "q_w"], 50))


MEMBER_SEARCH = (NOTES, "nt AS (SELECT doc, idx AS i, pitch, dur FROM notes)", _tok(DP, "tok", "nt", "doc"), _gram("gr", "tok", "doc", N), """
sz AS (SELECT doc AS piece, count(*) AS n FROM notes GROUP BY doc),
mr AS (SELECT piece AS member, min(piece) OVER (PARTITION BY piece % 30) AS reference, n AS mn FROM sz),
ok AS (SELECT member, reference FROM mr JOIN sz ON piece = reference WHERE member <> reference AND n >= 60 AND mn >= 65),
dl AS (SELECT piece AS doc, greatest(0, n - 3) AS dl FROM sz WHERE piece IN (SELECT reference FROM ok)),
cs AS (SELECT CAST(count(*) AS DOUBLE) AS nd, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM dl),
tf AS (SELECT doc, term, count(*) AS tf FROM gr JOIN dl USING (doc) GROUP BY ALL),
idf AS (SELECT term, ln((nd - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, cs GROUP BY term, nd),
qf AS (SELECT member, term, count(*) AS qf FROM ok JOIN gr ON gr.doc = member GROUP BY ALL),
sc AS (SELECT member, doc, round(sum(idf * (CAST(tf AS DOUBLE) * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) * qf), 9) AS score
  FROM qf JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc), cs GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= 50),
rk AS (SELECT ok.member, t.rank FROM ok LEFT JOIN top t ON t.member = ok.member AND t.doc = ok.reference)""")


def piece_terms(spark, sf):
    """(piece, term) for every n-gram of whole pieces, from their windows: each gram once, in the window that owns its first note."""
    seqs = tables.melody_sequences(spark, sf)
    last = seqs.groupBy("doc").agg(F.max("w").alias("last"))
    grams = seqs.join(last, "doc").selectExpr("doc AS piece", "w = last AS open_end", f"posexplode({R.ngram_keys(R.relation_tokens('notes', MODE), N, MODE)}) AS (at, term)")
    return grams.where(f"open_end OR at < {WINDOW_STEP}").select("piece", "term")


@query(ctes(*MEMBER_SEARCH) + RECALL)
def member_reference_recall(spark, sf):
    """Whole members of a tune family search for their family's reference among all references; pieces have no bound, so terms are rows."""
    docs, queries, _ = member_corpus(spark, sf)
    terms = checkpointed(piece_terms(spark, sf))
    sizes = terms.groupBy("piece").agg(F.count("*").alias("dl"))
    lengths = docs.select(F.col("reference").alias("piece")).join(sizes, "piece", "left").selectExpr("piece", "coalesce(dl, 0L) AS dl")
    index = X.build_index(lengths, ["piece"], occurrences=terms.join(lengths, "piece").select("piece", "dl", "term"))
    targets = checkpointed(queries.select("member", F.col("reference").alias("target")))
    asked = targets.join(terms.withColumnRenamed("piece", "member"), "member").select("member", "term")
    return X.recall_mrr(X.target_ranks(targets, X.search(index, asked, ["member"], 50), ["member"], {"piece": "target"}))


LENGTHS = (12, 24, 48)
SPANS = """spans AS (SELECT DISTINCT doc, w, len, s FROM (
   SELECT doc, w, n, len, unnest(list_append(range(0, n - len + 1, len // 2), n - len)) AS s
   FROM (SELECT doc, w, max(i) + 1 AS n FROM rows_ GROUP BY doc, w), (SELECT unnest([12, 24, 48]) AS len) WHERE n >= len))"""


def _spans(seqs):
    spans = X.fragment_spans("size(notes)", LENGTHS, fallback_full=True)
    return seqs.selectExpr("doc AS q_doc", "w AS q_w", "notes", f"explode({spans}) AS f")


@query(ctes(ROWS, SPANS) + "SELECT doc AS q_doc, w AS q_w, s AS start, CAST(len AS BIGINT) AS len FROM spans")
def fragments_multi_len(spark, sf):
    return _spans(tables.melody_sequences(spark, sf)).select("q_doc", "q_w", "f.start", "f.len")


def _qtoks(n):
    return (ROWS, _tok(DP), _gram(n=n), TF, _stats(n=n), SPANS, f"""frag AS (
  SELECT s.doc AS q_doc, s.w AS q_w, s.s AS fs, s.len AS fl, r.i, r.pitch, r.dur FROM spans s JOIN rows_ r
  ON r.doc = s.doc AND r.w = s.w AND r.i >= s.s AND r.i < s.s + s.len)""",
            _tok(DP, "qtok", "frag", "q_doc, q_w, fs, fl"), _gram("qgram", "qtok", "q_doc, q_w, fs, fl", n), _bm25("q_doc, q_w, fs, fl", 20))


def _grouped(spark, sf, pooling, norm, n=N):
    seqs = tables.melody_corpus(spark, sf)
    index = X.build_index(melody_docs(seqs, n=n), ["doc", "w"])
    terms = R.ngram_keys(R.relation_tokens("slice(notes, f.start + 1, f.len)", MODE), n, MODE)
    frags = _spans(seqs).selectExpr("q_doc", "q_w", "f.start AS fs", "f.len AS fl", "f.len AS n_notes", f"{terms} AS terms")
    return seqs, X.grouped_search(index, frags, ["q_doc", "q_w"], ["fs", "fl"], 20, pooling, 2.0, norm)


@query(ctes(*_qtoks(2)) + """, p AS (SELECT q_doc, q_w, doc, w, round(max(score / fl), 9) AS score FROM top GROUP BY ALL)
SELECT q_doc, q_w, doc, w, round(score, 6) AS score, row_number() OVER (PARTITION BY q_doc, q_w ORDER BY score DESC, doc, w) AS rank FROM p""")
def bm25_pool_max(spark, sf):
    """Fragments of three lengths, searched by pairs of intervals; the best score a note of each document."""
    p = _grouped(spark, sf, "max", "notes", 2)[1]
    return p.select("q_doc", "q_w", "doc", "w", F.round("score", 6).alias("score"), "rank")


@query(ctes(*_qtoks(N)) + """, p AS (SELECT q_doc, q_w, doc, w, round(2 * (max(y) + ln(sum(exp(y - m)))), 9) AS score
  FROM (SELECT *, score / 2 AS y, max(score / 2) OVER (PARTITION BY q_doc, q_w, doc, w) AS m FROM top) GROUP BY ALL)
SELECT q_doc, q_w, doc, w, round(score, 6) AS score, row_number() OVER (PARTITION BY q_doc, q_w ORDER BY score DESC, doc, w) AS rank FROM p""")
def bm25_pool_lse(spark, sf):
    p = _grouped(spark, sf, "lse", "none")[1]
    return p.select("q_doc", "q_w", "doc", "w", F.round("score", 6).alias("score"), "rank")


COUNTS = """cnt AS (SELECT CAST((SELECT count(*) FROM documents) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS q,
  CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS v FROM labels),
hm AS (SELECT sum(1 / CAST(r AS DOUBLE)) AS h, sum(1 / (CAST(r AS DOUBLE) * r)) AS h2
       FROM (SELECT unnest(range(1, CAST(least(50, n) AS BIGINT) + 1)) AS r FROM cnt))"""


def _rank_counts(spark, sf):
    n_docs = tables.table(spark, sf, "documents").count()
    return tables.table(spark, sf, "labels").agg(
        F.count("*").alias("n_queries"), F.count_if(F.col("quality") == 1).alias("n_valid")).withColumn("n_docs", F.lit(n_docs).cast("long"))


@query(ctes(COUNTS) + """, m AS (
  SELECT 'recall_' || k AS metric, v / q * (k / n) AS mean, sqrt(v * (k / n) * (1 - k / n) / (q * q)) AS std FROM cnt, (SELECT unnest([1, 5, 10, 20]) AS k)
  UNION ALL SELECT 'mrr', v / q * h / n, sqrt(v * greatest(h2 / n - (h / n) * (h / n), 0) / (q * q)) FROM cnt, hm)
SELECT metric, round(mean, 9) AS mean, round(std, 9) AS std, round(mean - CAST(1.96 AS DOUBLE) * std, 9) AS low, round(mean + CAST(1.96 AS DOUBLE) * std, 9) AS high FROM m""")
def random_rank(spark, sf):
    return X.random_rank_expected(_rank_counts(spark, sf))


@query(ctes(COUNTS) + f""", d AS (SELECT trial, {uniform_int_sql('random_rank', 3, '1', 'n', 'trial', 'doc_id')} AS rank, q
  FROM labels, cnt, (SELECT unnest(range(0, 20)) AS trial) WHERE quality = 1),
p AS (SELECT trial, {", ".join(f"count(*) FILTER (WHERE rank <= {k}) / max(q) AS r{k}" for k in (1, 5, 10, 20))},
  sum(CASE WHEN rank <= 50 THEN 1 / CAST(rank AS DOUBLE) ELSE 0 END) / max(q) AS rr FROM d GROUP BY trial)
{" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS std FROM p"
                    for m, c in [(f'recall_{k}', f'r{k}') for k in (1, 5, 10, 20)] + [('mrr', 'rr')])}""")
def random_rank_sampled(spark, sf):
    c = _rank_counts(spark, sf).first()
    valid = tables.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return X.random_rank_sampled(valid, ["doc_id"], c["n_docs"], c["n_queries"], 20, 3)


WORDS = """wd AS (SELECT {key} AS doc_id, string_split(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))), ' ') AS ws FROM {table}),"""


@query("WITH " + WORDS.format(key="doc_id", table="documents") + """
dl AS (SELECT doc_id, greatest(0, len(ws) - 2) AS dl, ws FROM wd),
g AS (SELECT doc_id, dl, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS term FROM (SELECT *, unnest(range(1, dl + 1)) AS p FROM dl)),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM g GROUP BY ALL),
cs AS (SELECT CAST(count(*) AS DOUBLE) AS nd, avg(dl) AS avgdl FROM dl),
idf AS (SELECT term, ln((nd - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, cs GROUP BY term, nd),
qw AS (SELECT item_id, string_split(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))), ' ') AS ws FROM benchmark),
qg AS (SELECT item_id, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS term FROM (SELECT *, unnest(range(1, greatest(0, len(ws) - 2) + 1)) AS p FROM qw)),
qf AS (SELECT item_id, term, count(*) AS qf FROM qg GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(idf * (CAST(tf AS DOUBLE) * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) * qf), 9) AS score
  FROM qf JOIN tf USING (term) JOIN idf USING (term), cs GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20""")
def word_bm25_topm(spark, sf):
    docs = tables.document_words(spark, sf).selectExpr("doc_id", "greatest(size(words) - 2, 0) AS dl", f"{R.word_ngrams('words', 3)} AS terms")
    items = tables.document_words(spark, sf, "benchmark", "item_id").selectExpr("doc_id AS item_id", f"{R.word_ngrams('words', 3)} AS terms")
    return X.search(X.build_index(docs, ["doc_id"]), items, ["item_id"], 20).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")
