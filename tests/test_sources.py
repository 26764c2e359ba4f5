"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from notewise.sources import manifests, sinks


def test_manifests(spark, tmp_path):
    for name in ("vol_1/01_a.MID", "vol_1/b.txt", "other-2/c.krn", "other-2/d.mid"):
        p = tmp_path / "scores" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    root = str(tmp_path / "scores")
    assert manifests.score_files(spark, root).count() == 3
    assert manifests.midi_files(spark, root).count() == 2
    m = {r.path.rsplit("/", 1)[1]: (r.label, r.group) for r in manifests.folder_manifest(spark, root).collect()}
    assert m == {"01_a.MID": (1, "vol/a"), "d.mid": (0, "other/d")}


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a/x.mid", "label": 1}\n\n{"path": "/abs/y.mid", "label": 0, "group": "g"}\n')
    got = sorted(tuple(r) for r in manifests.labelled_manifest(spark, str(tmp_path / "m.jsonl"), "/base").collect())
    assert got == [("/abs/y.mid", 0, "g"), ("/base/a/x.mid", 1, "x")]
    (tmp_path / "t.csv").write_text("﻿s1 , f1\n\n s2,f2 \n,f3\n", encoding="utf-8")
    assert sorted(tuple(r) for r in manifests.two_column_csv(spark, str(tmp_path / "t.csv"), "song", "family").collect()) == [("s1", "f1"), ("s2", "f2")]
    (tmp_path / "p.jsonl").write_text('{"piece": "a", "time_signature": [3, 4]}\n{"piece": "b", "row_idx": 9}\n')
    got = sorted(tuple(r)[:3] for r in manifests.benchmark_pieces(spark, str(tmp_path / "p.jsonl")).collect())
    assert got == [("a", 0, 3), ("b", 9, None)]
    (tmp_path / "q.jsonl").write_text('{"query_id": 3, "target_doc_id": 4}\n')
    assert manifests.query_metadata(spark, str(tmp_path / "q.jsonl")).first().target_doc_id == 4
    (tmp_path / "c.jsonl").write_text('{"split": "train", "source_file": "f", "voice_id": "v", "window_idx": 0}\n{"split": "test"}\n')
    assert [r.seq_id for r in manifests.corpus_metadata(spark, str(tmp_path / "c.jsonl"), "train").collect()] == ["f#v#0"]


def test_metric_records(spark, tmp_path):
    for seed, v in ((1, 0.5), (2, 0.7)):
        d = tmp_path / f"seed{seed}" / "def"
        d.mkdir(parents=True)
        (d / "m.json").write_text(json.dumps({"f1": v, "f1_n": 3.0}))
    r = manifests.metric_records(spark, str(tmp_path / "seed*" / "*" / "m.json"))
    got = {(x.seed, x.variant, x.metric): x.value for x in r.collect()}
    assert got[("1", "def", "f1")] == 0.5 and len(got) == 4
    (tmp_path / "s.jsonl").write_text('{"track": "notes", "count": 2, "sum": 10.0, "min": 4.0, "max": 6.0}\nbroken\n{"track": "notes", "count": 1, "sum": 5.0, "min": 5.0, "max": 5.0}\n')
    s = manifests.split_statistics(spark, str(tmp_path / "s.jsonl")).first()
    assert (s["count"], s["sum"], s["min"], s["max"], s["mean"]) == (3, 15.0, 4.0, 6.0, 5.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", "s1", [(60, 5, 0)]), ("test", "s2", [(61, 5, 0)])], "split string, seq string, notes array<struct<pitch:int,dur:int,dt:int>>")
    out = str(tmp_path / "corpus")
    sinks.write_corpus(df, out)
    assert spark.read.parquet(out).where("split = 'test'").first().seq == "s2"
    try:
        sinks.write_corpus(df, out)
        raise AssertionError("must refuse an existing folder")
    except Exception as exc:
        assert "exist" in str(exc).lower()
    sinks.write_corpus(df, out, overwrite=True)
    bad = df.withColumn("skip_reason", F.when(F.col("split") == "test", "short"))
    assert sinks.write_with_rejects(bad, str(tmp_path / "good"), str(tmp_path / "bad")) == {"good": 1, "rejected": 1}
    assert sinks.write_with_rejects(bad.where("false"), str(tmp_path / "none"), str(tmp_path / "none_bad")) == {"good": 0, "rejected": 0}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.json(str(tmp_path / "bad")).count() == 1
    sinks.write_counts(spark.createDataFrame([("<s>", 4)], "token string, n long"), str(tmp_path / "dict"))
    assert [r.value for r in spark.read.text(str(tmp_path / "dict")).collect()] == ["<s> 4"]
    words = sinks.keywords(spark.createDataFrame([("a/red fox.mid",), ("b/fox.mid",)], "path string"), "path")
    assert [r.word for r in words.collect()] == ["fox", "red"]
    sinks.write_split_lists(spark.createDataFrame([("train", "b"), ("train", "a")], "split string, path string"), "path", str(tmp_path / "lists"))
    assert sorted(r.path for r in spark.read.json(str(tmp_path / "lists")).where("split = 'train'").collect()) == ["a", "b"]


def test_one_split_is_replaced_and_pruned(spark, tmp_path):
    from notewise.sources import corpora

    df = spark.createDataFrame([("train", "s1", 1), ("test", "s2", 2), ("valid", "s3", 3)], "split string, seq string, v int")
    out = str(tmp_path / "corpus")
    sinks.write_corpus(df, out)
    sinks.replace_split(df.selectExpr("split", "seq", "v + 10 AS v"), out, "test")
    assert {r.seq: r.v for r in corpora.read_corpus(spark, out).collect()} == {"s1": 1, "s2": 12, "s3": 3}
    plan = corpora.read_corpus(spark, out, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "= test" in plan


def test_corpus_and_pair_readers(spark, tmp_path):
    from notewise.operators.ornament import Ornaments
    from notewise.sources import corpora

    df = spark.createDataFrame(
        [("train", "a", [(60, 5, 0)]), ("train", "b", [(61, 5, -2)]), ("test", "c", [(62, 5, 0)])], "split string, seq string, notes array<struct<pitch:int,dur:int,dt:int>>")
    sinks.write_corpus(df, str(tmp_path / "c"))
    got = corpora.with_local_ids(corpora.read_corpus(spark, str(tmp_path / "c"), "train", low="b")).collect()
    assert [(r.seq, [tuple(x) for x in r.local]) for r in got] == [("b", [(66, 10, 102)])]
    note = "array<struct<pitch:int,dur:int,dt:int>>"
    spark.createDataFrame([("p", [(60, 5, 0)], [(60, 2, 0), (60, 3, 0)], [0, -1])], f"pair_id string, x {note}, x_orn {note}, pi array<int>").write.parquet(str(tmp_path / "p"))
    p = corpora.read_pairs(spark, str(tmp_path / "p"))
    assert (p.first().len_x, p.first().len_x_orn, p.first().rho) == (3, 4, 0.75)
    assert [(r.i, r.label) for r in corpora.pair_rows(p, ["pair_id"]).orderBy("i").collect()] == [(0, 1), (1, 0)]
    spark.createDataFrame([("g", 0, 0), ("g", 1, -1)], "piece string, note_idx int, depth int").write.parquet(str(tmp_path / "g"))
    assert [(r.i, r.gold) for r in corpora.read_gold(spark, str(tmp_path / "g")).collect()] == [(0, 1.0)]
    cfg = corpora.configured(Ornaments(), {"p_trill": 0.5, "unknown": 1, "steps": [1, 3]})
    assert cfg.p_trill == 0.5 and cfg.steps == (1, 3)


def test_padded_writer_and_json(spark, tmp_path):
    df = spark.createDataFrame([("s", 4, [(60, 5, 0)])], "seq string, bos int, notes array<struct<pitch:int,dur:int,dt:int>>")
    sinks.write_padded(df, str(tmp_path / "e"), 6)
    assert [e.pitch for e in spark.read.parquet(str(tmp_path / "e")).first().events] == [2, 65, 3, 0, 0, 0]
    sinks.write_token_lines(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "<s> <s> <2-4> <0-60> <1-5> <2-0> </s> </s> </s>"
    sinks.write_json(df.select("seq"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.write_keywords(spark.createDataFrame([("x/blue sky.mid",)], "path string"), "path", str(tmp_path / "k"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "k")).collect()) == ["blue", "sky"]
