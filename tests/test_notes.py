"""Hand-worked note fixtures."""

import pytest
from pyspark.sql import functions as F

from notewise.functions import codes, names, relation
from notewise.operators import closure, metrics, notes, ordered, pairing, splits, stats


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def notes_of(spark, items):
    return spark.createDataFrame([(1, i, *x) for i, x in enumerate(items)], "piece int, idx int, pitch int, st long, en long")


def bars_of(spark, spans):
    return spark.createDataFrame([(1, a, b) for a, b in spans], "piece int, m_start long, m_end long")


def test_trim_removes_resting_bar(spark):
    n = notes_of(spark, [(60, 0, 12), (62, 96, 108)])
    out = notes.trim_empty_bars(n, bars_of(spark, [(0, 48), (48, 96), (96, 144)]), ["piece"])
    assert rows(out, "pitch", "new_st", "new_en") == [(60, 0, 12), (62, 48, 60)]


def test_bar_touched_only_at_its_edges_is_empty(spark):
    n = notes_of(spark, [(60, 0, 48), (62, 96, 100)])
    out = notes.empty_bars(n, bars_of(spark, [(0, 48), (48, 96), (96, 144)]), ["piece"])
    assert rows(out, "m_start", "m_end") == [(48, 96)]


def test_joint_trim_needs_all_voices_to_rest(spark):
    n = spark.createDataFrame([(1, "a", 0, 12), (1, "a", 96, 100), (1, "b", 48, 60)], "piece int, voice string, st long, en long")
    out = notes.trim_empty_bars(n, bars_of(spark, [(0, 48), (48, 96), (96, 144), (144, 192)]), ["piece", "voice"], ["piece"])
    assert rows(out, "voice", "new_st") == [("a", 0), ("a", 96), ("b", 48)]


def test_islands(spark):
    out = notes.merge_islands(bars_of(spark, [(0, 10), (10, 20), (30, 40), (35, 50)]), ["piece"])
    assert rows(out, "m_start", "m_end") == [(0, 20), (30, 50)]


def test_bar_grid_is_cut_by_a_change(spark):
    sig = spark.createDataFrame([(1, 60, 0, 3, 4)], "piece int, pos long, seq_no int, num int, den int")
    ext = spark.createDataFrame([(1, 130)], "piece int, max_pos long")
    assert rows(notes.bar_grid(sig, ext, ["piece"]), "m_start", "m_end") == [(0, 48), (48, 60), (60, 96), (96, 132)]


@pytest.mark.parametrize("n,wins", [(512, 1), (513, 2), (768, 2), (769, 3), (15, 0), (16, 1), (1024, 3)])
def test_window_edges(spark, n, wins):
    voice = spark.createDataFrame([(1, n)], "piece int, n long")
    table = ordered.window_table(voice)
    assert table.count() == wins
    long = ordered.to_windows(spark.range(n).selectExpr("id AS idx", f"{n}L AS n"))
    assert rows(long.groupBy("w", "wlen").agg(F.count("*").alias("c")), "w", "wlen", "c") == [
        (r["w"], r["wlen"], r["wlen"]) for r in table.orderBy("w").collect()]


def test_dense_index_over_uneven_buckets(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id * 7919 % 1000 AS v", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 10 END AS noise")
    out = ordered.dense_index(df, ["k"], ["v"], "v div 400", total="n", first_of=("v", "lo"), next_of=("v", "nxt"))
    for k in (0, 1):
        got = sorted((r.v, r.idx, r.n, r.lo, r.nxt) for r in out.where(F.col("k") == k).collect())
        vs = [g[0] for g in got]
        assert [g[1] for g in got] == list(range(500))
        assert all(g[2] == 500 and g[3] == vs[0] for g in got)
        assert [g[4] for g in got] == vs[1:] + [None]


def test_clip_and_ids(spark):
    df = spark.createDataFrame([(200, -150), (0, 130), (5, -1)], "d int, t int")
    out = df.select(codes.dur_code(F.col("d")).alias("d"), codes.dt_code(F.col("t")).alias("t"))
    assert rows(out, "d", "t") == [(0, 95), (5, -1), (95, -96)]
    ids = out.select(codes.dur_id(F.col("d")).alias("d"), codes.dt_id(F.col("t")).alias("t"))
    back = ids.select(codes.dur_of(F.col("d"), True).alias("d"), codes.dt_of(F.col("t"), True).alias("t"))
    assert rows(back, "d", "t") == rows(out, "d", "t")
    with pytest.raises(Exception):
        df.select(codes.dur_code(F.lit(-1))).collect()


def test_vocabulary_layout(spark):
    v = {r.token: r for r in codes.vocabulary(spark).collect()}
    assert len(v) == 421
    assert [v[t].global_id for t in ("<pad>", "<mask>", "<0-0>", "<1-0>", "<2-0>", "<2-!1>", "<2-!96>")] == [0, 4, 5, 133, 229, 325, 420]
    assert v["<2-!1>"].code == -1 and v["<2-!1>"].local_id == 101
    loc = codes.vocabulary(spark).where("attr <> 'special'").select(
        F.when(F.col("attr") == "pitch", codes.to_local(F.col("global_id"), "pitch")).when(
            F.col("attr") == "dur", codes.to_local(F.col("global_id"), "dur")).otherwise(codes.to_local(F.col("global_id"), "dt")).alias("a"), "local_id")
    assert loc.where("a <> local_id").count() == 0


def test_events_round_trip_and_lengths(spark):
    df = spark.createDataFrame([([(60, 5, -3), (61, 7, 0)], 4)], "notes array<struct<pitch:int,dur:int,dt:int>>, bos int")
    ev = df.select("notes", codes.padded_events(F.col("notes"), F.col("bos"), 8).alias("ev"))
    out = ev.select(
        codes.used_length(F.col("ev")).alias("u"), codes.bos_anchor(F.col("ev")).alias("b"), F.size("ev").alias("n"),
        (codes.decode_events(F.col("ev")) == F.col("notes")).alias("same"),
        codes.resolved_length(F.col("ev"), F.lit(3), "auto").alias("auto"), codes.length_mismatch(F.col("ev"), F.lit(3)).alias("bad")).first()
    assert tuple(out) == (4, 4, 8, True, 3, True)
    cut = df.select(codes.padded_events(F.col("notes"), F.col("bos"), 3).alias("ev")).first().ev
    assert [e.pitch for e in cut] == [2, 65, 3]


def test_local_position_tables(spark):
    df = spark.range(-96, 96).select(F.col("id").cast("int").alias("t"))
    assert df.where(codes.local_dt_to_pos(codes.pos_to_local_dt(F.col("t"))) != F.col("t")).count() == 0
    r = spark.range(1).select(codes.pos_to_local_dur(F.lit(0)).alias("a"), codes.local_dur_to_pos(F.lit(2)).alias("b")).first()
    assert (r.a, r.b) == (6, 0)


def test_half_even_quantising(spark):
    r = spark.range(1).select(codes.tick_to_pos(F.lit(5), F.lit(24.0)).alias("a"), codes.tick_to_pos(F.lit(7), F.lit(24.0)).alias("b")).first()
    assert (r.a, r.b) == (2, 4)


def test_relation_token_with_gcd(spark):
    df = spark.createDataFrame([([(60, 12, 0), (62, 18, 0)],)], "notes array<struct<pitch:int,dur:int,dt:int>>")
    t = df.selectExpr(f"{relation.relation_tokens('notes')} AS t", f"{relation.relation_tokens('notes', 'dp_coarse_dur')} AS c").first()
    assert t.t == [(130 << 16) | (3 << 8) | 2]
    assert t.c == [(130 << 16) | (6 << 8) | 8]
    u = df.select(relation.unpack_token(F.lit(t.t[0]), "dp_dur_ratio").alias("u")).first().u
    assert tuple(u) == (2, 3, 2)


def test_closure_absorbs_the_dropped_note(spark):
    df = spark.createDataFrame(
        [(1, 0, 60, 4, 0, 0, True), (1, 1, 61, 2, 0, 4, False), (1, 2, 62, 6, 0, 6, True)], "s int, i int, pitch int, dur int, dt int, onset long, keep boolean")
    assert rows(closure.rhythm_closure(df, ["s"]), "i", "new_dur", "new_dt") == [(0, 6, 0), (2, 6, 0)]
    assert rows(closure.relink(df, ["s"]), "i", "new_dt") == [(0, 2), (2, 0)]


def test_negative_times_move_up_by_whole_notes(spark):
    df = spark.createDataFrame([(1, 0, 60, 4, -3), (1, 1, 61, 4, 5)], "s int, i int, pitch int, dur int, onset long")
    assert rows(closure.note_times(df, ["s"]), "start_pos", "end_pos") == [(45, 49), (53, 57)]


def test_suffix_mapping(spark):
    dense = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 5)], "piece int, idx long, st long")
    sparse = spark.createDataFrame([(1, 0, 5), (1, 1, 5)], "piece int, idx long, st long")
    assert rows(pairing.onset_mapping(dense, sparse, "piece"), "idx", "pi") == [(0, -1), (1, 0), (2, 1)]
    assert pairing.broken_alignments(pairing.onset_mapping(dense, sparse, "piece"), "piece").count() == 0


def test_out_of_order_alignment_is_found(spark):
    bad = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 1)], "piece int, idx long, pi long")
    assert rows(pairing.out_of_order(bad, "piece"), "piece") == [(1,)]


def test_ap_and_ndcg(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 1), (1, 1, 0.8, 0), (1, 2, 0.7, 1)], "s int, i int, score double, label int")
    r = metrics.pair_metrics(df, ["s"]).first()
    assert r.ap_soft == pytest.approx((1 + 2 / 3) / 2)
    assert r.ndcg_soft == pytest.approx(1 / (1 + 1 / 1.584962500721156))
    assert r.f1_hard is None and r.gap_f1 is None


def test_no_positives_gives_null_and_gold_scores_are_perfect(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0), (1, 1, 0.8, 0), (2, 0, 1.0, 1), (2, 1, 0.0, 0)], "s int, i int, score double, label int")
    a, b = metrics.pair_metrics(df, ["s"]).orderBy("s").collect()
    assert a.ap_soft is None and a.ndcg_soft is None and a.cut_f1_auc is None and a.ins_mass_soft == pytest.approx(1.0)
    assert b.ap_soft == b.ndcg_soft == b.f1_hard_topk == 1.0 and b.ins_mass_soft == 0.0


def test_graded_gold_scores_are_perfect(spark):
    df = spark.range(30).selectExpr("1 AS s", "CAST(id AS INT) AS i", "exp(-(id * 7 % 30) / 5D) AS gold").withColumn("score", F.col("gold"))
    r = metrics.graded_metrics(df, ["s"]).first()
    for v in (r.ap_soft, r.ndcg_soft, r.ndcg_full, r.spearman, r.mean_ndcg_cut, r.cut_f1_auc_norm):
        assert v == pytest.approx(1.0)


def test_group_split_keeps_groups_together(spark):
    items = spark.range(10).selectExpr("id AS item", "id AS g")
    out = splits.group_split(items, "g", 3, (0.8, 0.1, 0.1))
    assert rows(out.groupBy("split").count(), "split", "count") == [("test", 1), ("train", 8), ("valid", 1)]
    big = spark.range(300).selectExpr("id AS item", "CASE WHEN id < 100 THEN 0 ELSE id END AS g")
    out = splits.group_split(big, "g", 3, (0.8, 0.1, 0.1))
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.count() == 300


def test_stratified_quota(spark):
    items = spark.range(23).selectExpr("id", "CASE WHEN id < 1 THEN 'a' WHEN id < 3 THEN 'b' ELSE 'c' END AS label")
    out = splits.stratified_split(items, "label", "id", 1, 0.10)
    got = {r.label: r.n for r in out.groupBy("label").agg(F.count_if("is_test").alias("n")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_duration_text(spark):
    got = [r[0] for r in spark.createDataFrame([(93784.0,), (3600.0,), (61.0,), (5.0,)], "s double").select(stats.duration_text(F.col("s"))).collect()]
    assert got == ["1d02h03m04s", "1h00m00s", "1m01s", "5s"]


def test_names(spark):
    f = spark.createDataFrame([("/d/vol_1/012_ A b（x）.mid",)], "p string").select(
        names.group_key(F.col("p"), "anthology_style").alias("a"), names.group_key(F.col("p"), "stem").alias("s"),
        names.relative_path(F.col("p"), "/d").alias("r")).first()
    assert tuple(f) == ("vol_1/Ab", "012_ A b（x）", "vol_1/012_ A b（x）.mid")
    c = spark.createDataFrame([("M613_V08_022_score.krn",), ("B063_01_2_score.krn",), ("x.krn",)], "n string").select(
        names.catalogue_parts(F.col("n")).alias("c")).selectExpr("c.opus", "c.var_id", "c.phrase").collect()
    assert [tuple(r) for r in c] == [("M613", "08", "022"), ("B063", "01", "2"), (None, None, None)]
    b = spark.createDataFrame([("022",), ("2",), ("e",)], "p string").select(names.phrase_base(F.col("p"))).collect()
    assert [r[0] for r in b] == ["02", "02", None]


def test_tree_depth_flags_cycles(spark):
    arcs = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 5, 4), (1, 4, 5)], "s int, head int, dep int")
    nodes = spark.createDataFrame([(1, k) for k in range(1, 6)], "s int, node int")
    assert rows(pairing.tree_depth(arcs, nodes, ["s"]).fillna({"depth": -9}), "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, -9), (5, -9)]


def test_dense_ids_follow_the_order_over_range_partitions(spark):
    rows = [(f"name{(i * 7919) % 5000:05d}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "name string, v int").repartition(7)
    got = {r.name: r.doc_id for r in splits.dense_ids(df, ["name"]).collect()}
    assert got == {name: k for k, name in enumerate(sorted(n for n, _ in rows))}
    same = splits.dense_ids(df.selectExpr("v % 3 AS g", "v").where("v < 100"), ["g", "v"]).collect()
    assert [r.doc_id for r in sorted(same, key=lambda r: (r.g, r.v))] == list(range(100))
    assert splits.dense_ids(df.where("false"), ["name"]).count() == 0
