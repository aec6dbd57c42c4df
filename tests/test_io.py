"""Readers, writers, the stream, the command line and the driver contract."""

import importlib
import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill import cli, schema
from segmill.plans import pipelines, queries
from segmill.sources import readers, writers
from segmill.streaming import arrivals


def feature_rows(spark, n=3, creator="CR0001"):
    df = spark.range(n).select(
        F.format_string(f"{creator}_S%d", "id").alias("segment_id"), F.format_string(f"{creator}_v%d", F.col("id") % 2).alias("video_id"), F.lit(creator).alias("creator_id"),
        F.lit("tech").alias("category"), F.col("id").cast("int").alias("segment_index"), (F.col("id") % 2).cast("int").alias("label"),
        *[(F.col("id") * (k % 7 + 1)).cast("double").alias(c) for k, c in enumerate(schema.FEATURE_COLUMNS)], F.lit("v\n\"2\"").alias("features_version"), F.lit("2024-01-01 00:00:00").alias("extracted_at"),
    )
    return df


def write_csv(df, path):
    df.toPandas().to_csv(path, index=False)


def test_feature_files(spark, tmp_path):
    for c in ("CR0001", "CR0002"):
        write_csv(feature_rows(spark, 3, c), tmp_path / f"{c}_features.csv")
    df = readers.features(spark, str(tmp_path))
    assert df.count() == 6 and df.columns == schema.OUTPUT_COLUMNS
    assert {r["features_version"] for r in df.collect()} == {'v\n"2"'}
    report = readers.file_report(readers.csv(spark, str(tmp_path), schema.SCHEMAS["features"], extra=True)).collect()
    assert sorted(r["n_rows"] for r in report) == [3, 3]
    write_csv(feature_rows(spark, 1, "CR0001"), tmp_path / "CR0003_features.csv")
    with pytest.raises(ValueError):
        readers.features(spark, str(tmp_path))
    bad = tmp_path / "bad"
    bad.mkdir()
    write_csv(feature_rows(spark).drop("word_count"), bad / "CR0001_features.csv")
    with pytest.raises(ValueError):
        readers.features(spark, str(bad))


def test_pairs_take_the_creator_from_the_file(spark, tmp_path):
    cols = [c.split()[0] for c in schema.SCHEMAS["whisper_pairs"].split(", ")]
    (tmp_path / "CR0007_pairs.csv").write_text(",".join(cols) + "\n" + "s,l,3,95.0,single,high" + ",0" * (len(cols) - 9) + ",true,false,1\n")
    r = readers.pairs(spark, str(tmp_path)).collect()[0]
    assert (r["creator_id"], r["matched_segment_index"], r["label"]) == ("CR0007", 3, 1)


def test_embeddings(spark, tmp_path):
    for name, v in (("a", 1.0), ("b", 2.0)):
        np.savez(tmp_path / f"{name}.npz", segment_keys=np.array(["v|x|3", "w|0" if name == "a" else "u|1"]), embeddings=np.array([[v, v], [v, v]], np.float32))
    got = {(r["video_id"], r["segment_index"]): list(r["embedding"]) for r in readers.npz_embeddings(spark, f"{tmp_path}/*.npz").collect()}
    assert got == {("v|x", 3): [2.0, 2.0], ("w", 0): [1.0, 1.0], ("u", 1): [2.0, 2.0]}
    e = spark.createDataFrame([("v", 1, [1.0, 2.0]), ("v", 0, [3.0, 4.0])], "video_id string, segment_index int, embedding array<float>")
    writers.embeddings(e, f"{tmp_path}/e")
    assert {(r["video_id"], r["segment_index"]): list(r["embedding"]) for r in readers.embeddings(spark, f"{tmp_path}/e", 2).collect()} == {("v", 1): [1.0, 2.0], ("v", 0): [3.0, 4.0]}
    with pytest.raises(Exception):
        readers.embeddings(spark, f"{tmp_path}/e", 3).collect()


def test_transcripts_and_captions(spark, tmp_path):
    d = tmp_path / "v1"
    d.mkdir()
    (d / "segment_003.json").write_text(json.dumps({"text": "hi", "words": [{"word": "hi", "start": 0.0, "end": 0.4}]}))
    (d / "segment_004.json").write_text(json.dumps({"text": "  ", "words": []}))
    (d / "segment_005.json").write_text("{broken")
    got = readers.transcripts(spark, f"{tmp_path}/*/*.json").collect()
    assert [(r["video_id"], r["segment_index"], r["text"]) for r in got] == [("v1", 3, "hi")]
    (tmp_path / "abc.en.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nx\n")
    assert readers.captions(spark, f"{tmp_path}/*.vtt").collect()[0]["video_id"] == "abc"


def test_results(spark, tmp_path):
    (tmp_path / "rf_test.json").write_text(json.dumps({"auc_roc": 0.6, "ndcg_at_k": {"10": 0.1}}))
    (tmp_path / "gbt_test_aggregated.json").write_text(json.dumps({"metrics": {"auc_roc": {"mean": 0.7, "std": 0.01}}}))
    got = {(r["model"], r["metric"]): (r["value"], r["std"]) for r in readers.results(spark, str(tmp_path)).collect()}
    assert got == {("rf", "auc_roc"): (0.6, None), ("rf", "ndcg_at_10"): (0.1, None), ("gbt", "auc_roc"): (0.7, 0.01)}


def test_writers(spark, tmp_path):
    df = feature_rows(spark).withColumn("other", F.lit(1)).drop("brightness_mean").withColumn("split", F.lit("train"))
    assert writers.ordered(df).columns == schema.OUTPUT_COLUMNS
    writers.by_creator(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 3
    writers.matrix(df, f"{tmp_path}/m")
    assert "brightness_mean" not in spark.read.parquet(f"{tmp_path}/m").columns
    assert writers.markdown(spark.createDataFrame([("a", 0.5)], "m string, v double")) == "| m | v |\n|---|---|\n| a | 0.5000 |"


def test_stream(spark, tmp_path):
    ddl = "segment_id string, creator_id string, extracted_at timestamp"
    row = lambda *x: spark.createDataFrame(list(x), "segment_id string, creator_id string, t string").select("segment_id", "creator_id", F.to_timestamp("t").alias("extracted_at"))
    row(("a", "c", "2024-01-01 00:00:00"), ("a", "c", "2024-01-01 00:10:00")).write.parquet(f"{tmp_path}/in/1")
    stream = lambda: arrivals.first_seen(arrivals.arrivals(spark, f"{tmp_path}/in/*", ddl))
    arrivals.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    row(("a", "c", "2024-01-01 00:20:00"), ("b", "c", "2024-01-01 00:30:00")).write.parquet(f"{tmp_path}/in/2")
    arrivals.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r["segment_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "f"
    src.mkdir()
    for c in ("CR0001", "CR0002", "CR0003", "CR0004"):
        write_csv(feature_rows(spark, 30, c), src / f"{c}_features.csv")
    cli.main(["merge", str(src), "--out", f"{tmp_path}/m"])
    cli.main(["split", f"{tmp_path}/m", "--exact", "--out", f"{tmp_path}/s"])
    cli.main(["normalise", f"{tmp_path}/s", "--out", f"{tmp_path}/n"])
    cli.main(["model", f"{tmp_path}/n", "--model", "rules", "--out", f"{tmp_path}/r"])
    assert spark.read.parquet(f"{tmp_path}/r").filter("metric = 'auc_roc'").count() == 1
    cli.main(["verify", str(src)])
    assert "CR0002_features.csv" in capsys.readouterr().out


def test_post_extraction(spark):
    f = feature_rows(spark, 60)
    pairs = spark.createDataFrame([("CR0001_v1", 3, 1), ("CR0001_v0", 2, 0)], "long_id string, matched_segment_index int, label int")
    got = pipelines.post_extraction(f, pairs).collect()
    assert len(got) == 60 and sum(r["label"] for r in got) == 1 and {r["split"] for r in got} <= set(schema.SPLITS)


def test_queries_have_names_and_sql():
    assert set(queries.ORACLE) <= set(queries.QUERIES) and len(queries.QUERIES) >= 60


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "segmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "segmill.llm.queries", raising=False)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert "rank_metrics" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_core_never_imports_the_subpackage():
    from pathlib import Path

    root = Path(cli.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "segmill.llm" not in p.read_text(), p


def test_named_files_and_captions(spark, tmp_path):
    x = spark.createDataFrame([(1, "a\nb"), (2, "c")], "id int, value string")
    writers.named_files(x, f"file://{tmp_path}/v", ["id"], "{id}.en.vtt", "text")
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if p.suffix == ".vtt") == ["1.en.vtt", "2.en.vtt"]
    assert {tuple(r) for r in readers.captions(spark, f"file://{tmp_path}/v").collect()} == {("1", "a\nb\n"), ("2", "c\n")}


def test_report_has_all_rows(spark):
    x = spark.range(1500).select("id", (F.col("id") / 4).alias("v"), F.when(F.col("id") > 0, "x").alias("n"))
    lines = [r["line"] for r in writers.report(x, [F.col("id")], 2).orderBy("number").collect()]
    assert len(lines) == 1502 and lines[:4] == ["| id | v | n |", "|---|---|---|", "| 0 | 0.00 |  |", "| 1 | 0.25 | x |"]
    assert writers.markdown(x).count("\n") == 1501


def test_named_files_of_a_failed_task(spark, tmp_path):
    """A task that fails leaves nothing behind, and the files of the others have no other names beside them."""
    import os

    x = spark.range(40).select((F.col("id") % 5).alias("g"), F.col("id").alias("v"), F.when(F.col("id") % 4 == 0, 'a "b"\nc').alias("t"))
    writers.named_files(x, f"file://{tmp_path}/a", ["g"], "sub{g}/part-{g}.csv", header=True, escape='"')
    assert sorted(os.listdir(f"{tmp_path}/a")) == [f"sub{k}" for k in range(5)] and os.listdir(f"{tmp_path}/a/sub3") == ["part-3.csv"]
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/a/*")
    assert sorted((int(r["v"]), r["t"]) for r in got.collect()) == [(k, None if k % 4 else 'a "b"\nc') for k in range(40)]
    writers.named_files(x, f"file://{tmp_path}/a", ["g"], "sub{g}/part-{g}.csv", header=True, escape='"')  # again: the same files
    assert os.listdir(f"{tmp_path}/a/sub3") == ["part-3.csv"]
    bad = x.withColumn("t", F.when(F.col("v") == 38, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string"))
    with pytest.raises(Exception):
        writers.named_files(bad.coalesce(1), f"file://{tmp_path}/b", ["g"], "{g}.csv")
    assert not os.path.exists(f"{tmp_path}/b") or not any(f.endswith(".csv") and f.startswith("_") for f in os.listdir(f"{tmp_path}/b"))


def test_named_files_writer_cleans_up(tmp_path):
    import os

    import pyarrow as pa

    from segmill.sources.named import NamedFilesWriter

    def rows():
        yield pa.RecordBatch.from_arrays([pa.array(["a.txt", "b.txt"]), pa.array(["1", "2"])], names=["name", "line"])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        NamedFilesWriter(f"file://{tmp_path}/w", "").write(rows())
    assert os.listdir(f"{tmp_path}/w") == []


def test_named_files_writer_needs_no_order(tmp_path, monkeypatch):
    """Rows of names in turns, more than a task holds at once."""
    import pyarrow as pa

    from segmill.sources import named

    monkeypatch.setattr(named, "HELD", 64, raising=False)
    rows = [(f"d{k % 3}/f{k % 7}.txt", None if k % 5 == 0 else f"ü{k}") for k in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 90])], names=["name", "line"]) for i in range(0, 400, 90)]
    assert named.NamedFilesWriter(f"file://{tmp_path}/w", "h").write(iter(batches)).files == 21
    for name in {n for n, _ in rows}:
        assert (tmp_path / "w" / name).read_text() == "h\n" + "".join(f"{x or ''}\n" for n, x in rows if n == name)


def test_partitions_grow_with_the_table(spark, tmp_path):
    """Line items meet in as many tasks as the table asks for, whatever the set number of partitions."""
    from segmill.plans import queries, tables

    spark.range(60000).select((F.col("id") / 3).cast("long").alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity")).repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        splits = spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions()
        for df in (queries.early_exit(spark, str(tmp_path)), tables.pairs(spark, str(tmp_path))):
            assert splits > 4 and df.rdd.getNumPartitions() >= 8 * splits
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_whole_files_are_listed_by_tasks(spark, tmp_path):
    """Wildcards, braces, single files, hidden names and folders below folders; the driver has no list of files."""
    for name in ("a/1.en.vtt", "a/2.txt", "a/_3.txt", "a/.4.txt", "a/deep/5.txt", "b c/6.txt", "_c/7.txt", "8.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"ü{name}")
    want = {"*": ["1", "2", "6", "8"], "": ["8"], "a": ["1", "2"], "*/*.txt": ["2", "6"], "{a,b c}/*": ["1", "2", "5", "6"], "8.txt": ["8"], "?/1*": ["1"]}
    for path, ids in want.items():
        got = readers.captions(spark, f"file://{tmp_path}/{path}".rstrip("/"))
        assert got.inputFiles() == []
        rows = got.collect()
        assert sorted(r["video_id"] for r in rows) == ids, path
        assert all(r["vtt"].startswith("ü") and f"{r['video_id']}." in r["vtt"] for r in rows)
