import json
import os
import subprocess
import sys

import pytest
from scoutline.operators import commit
from scoutline.sources import tables, versions
from scoutline.sources.nested import json_elements
from scoutline.streaming.commit import last_batch, stream_commit, winners


def test_validation_of_typed_entries(spark):
    entries = ["12.5", "0", "100", "-1", "-1.0", "100.01", "-3", "abc", "", "nan", None]
    df = spark.createDataFrame(list(enumerate(entries)), "row_id bigint, entry string")
    got = [r["status"] for r in commit.validate_results(df).orderBy("row_id").collect()]
    assert got == ["accepted"] * 3 + ["skipped"] * 2 + ["rejected"] * 6


def test_history_updates_every_match_and_later_entries_win(spark):
    space = spark.createDataFrame([(0, "a", "x", -1.0), (1, "a", "x", 5.0), (2, None, "x", 7.0), (3, "b", "y", 9.0)],
                                  "row_id bigint, c_0 string, c_1 string, yield double")
    history = spark.createDataFrame([("a", "x", 1, 10.0), ("a", "x", 2, 0.0), (None, "x", 3, 50.0), ("zz", "x", 4, 1.0)],
                                    "c_0 string, c_1 string, seq bigint, yield double")
    once = commit.apply_history(space, history, ["c_0", "c_1"], ["seq"])
    assert [r["yield"] for r in once.orderBy("row_id").collect()] == [0.0, 0.0, 7.0, 9.0]
    twice = commit.apply_history(once, history, ["c_0", "c_1"], ["seq"])
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    edits = spark.createDataFrame([(1, 1, None), (2, 1, -1.0), (3, 1, 4.0), (0, 1, float("nan"))], "row_id bigint, seq bigint, yield double")
    assert [r["yield"] for r in commit.commit_by_id(space, edits, ["seq"]).orderBy("row_id").collect()] == [-1.0, 5.0, 7.0, 4.0]
    assert commit.count_known(once).first()[0] == 4


def test_history_files(spark, tmp_path):
    assert tables.read_history(spark, str(tmp_path / "absent"), ["a", "b"]).count() == 0
    doc = {"iterations": [{"date": "2024-05-01 10:00:00", "reaction": {"a": "x", "b": "y", "Yield": 3.5}},
                          {"date": "2024-05-02 10:00:00", "reaction": {"a": "x", "b": "z", "Yield": 4.0}}]}
    (tmp_path / "h.json").write_text(json.dumps(doc, indent=2))
    nested = tables.read_history(spark, str(tmp_path / "h.json"), ["a", "b"], nested=True)
    assert [(r["a"], r["b"], r["Yield"]) for r in nested.orderBy("ts").collect()] == [("x", "y", 3.5), ("x", "z", 4.0)]
    rows = spark.createDataFrame([("x", "y", 1.0)], "a string, b string, yield double")
    for ts in ("2024-05-03 00:00:00", "2024-05-04 00:00:00"):
        tables.append_history(rows, str(tmp_path / "lines"), ["a", "b"], ts)
    assert tables.read_history(spark, str(tmp_path / "lines"), ["a", "b"]).count() == 2


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    names = ["plain", "}", "{", 'a "quoted" }', "back\\", '"}{', "", 'ends \\"', "[{]}"]
    items = [{"date": "2024-05-01 10:00:00", "reaction": {"a": names[i % len(names)], "b": str(i), "Yield": i / 2}} for i in range(400)]
    (tmp_path / "h.json").write_text(json.dumps({"iterations": items}, indent=1))
    (tmp_path / "none.json").write_text('{"iterations": []}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "other.json").write_text('{"meta": [{"x": 1}]}')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("2500b", "128m"):
            for k in before:
                spark.conf.set(k, size)
            found = json_elements(spark, str(tmp_path / "h.json"), "iterations").orderBy("element").collect()
            assert [json.loads(r["json"]) for r in found] == items
            got = tables.read_history(spark, str(tmp_path / "h.json"), ["a", "b"], nested=True).collect()
            assert sorted((int(r["b"]), r["a"], r["Yield"]) for r in got) == [(i, x["reaction"]["a"], i / 2) for i, x in enumerate(items)]
            tasks = spark.read.option("lineSep", "}").text(str(tmp_path / "h.json")).rdd.getNumPartitions()
            assert tasks > 8 if size == "2500b" else tasks == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert json_elements(spark, str(tmp_path / "none.json"), "iterations").count() == json_elements(spark, str(tmp_path / "empty.json"), "iterations").count() == 0
    with pytest.raises(Exception, match="not an object of the array"):
        json_elements(spark, str(tmp_path / "other.json"), "iterations").collect()


def test_queries_run_in_a_session_started_elsewhere(tmp_path):
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2") \\
    .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.queries()["f2_neighbor_counts"](spark, "/root/testdata/sf0.001").count())
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows" in out.stdout, out.stderr[-2000:]


def test_versions_share_the_buckets_that_a_commit_leaves(spark, tmp_path):
    root = str(tmp_path / "t")
    space = spark.range(500).selectExpr("id AS row_id", "CAST(id % 100 AS STRING) AS c", "-1.0D AS yield", "1 AS bucket", "'x' AS commit")
    versions.create(space, root, ["c"], n_buckets=64)
    files = lambda: {f for folder, _, names in os.walk(f"{root}/data") for f in (os.path.join(folder, n) for n in names) if f.endswith(".parquet")}
    first = files()
    versions.tag(spark, root, "start")
    assert files() == first  # a snapshot copies nothing
    with pytest.raises(Exception, match="exist"):
        versions.tag(spark, root, "start")
    with pytest.raises(ValueError, match="table already"):
        versions.create(space, root, ["c"])
    edits = spark.createDataFrame([("7", 1, 10.0), ("7", 2, 20.0), ("9", 1, 30.0), ("none", 1, 1.0), (None, 1, 2.0)], "c string, seq int, yield double")
    assert [versions.commit_edits(spark, root, edits, ["seq"], batch="b") for _ in range(2)] == [1, 1]  # repeated, committed once
    assert len({os.path.dirname(f) for f in files() - first}) <= 4 and first <= files()
    assert versions.commit_edits(spark, root, edits.limit(0), ["seq"]) == 1
    assert versions.commit_edits(spark, root, edits.where("c = '9'").withColumn("yield", edits["yield"] + 1), ["seq"]) == 2
    got = {v: {(r.row_id, r["yield"]) for r in versions.read_version(spark, root, v).collect()} for v in ("start", 0, 1, 2, None)}
    want = [{(i, new.get(i % 100, -1.0)) for i in range(500)} for new in ({}, {7: 20.0, 9: 30.0}, {7: 20.0, 9: 31.0})]
    assert [got[v] for v in ("start", 0, 1, 2, None)] == [want[0], *want, want[2]]
    assert versions.read_version(spark, root).columns == space.columns
    with pytest.raises(ValueError, match="no version 9"):
        versions.read_version(spark, root, 9)
    versions.create(space.limit(0), str(tmp_path / "empty"), ["c"])
    assert versions.read_version(spark, str(tmp_path / "empty")).count() == 0


def test_snapshots_and_views(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0], 2.0, "train"), (1, [3.0], 4.0, "test")], "row_id bigint, features array<double>, label double, split string")
    tables.snapshot(df, str(tmp_path / "s"), "t1")
    with pytest.raises(Exception, match="exist"):
        tables.snapshot(df, str(tmp_path / "s"), "t1")
    for rep, dim in (("fp", 512), ("fp", 2048), ("desc", None)):
        for _ in range(2):  # written twice, stored once
            tables.write_view(df, str(tmp_path / "v"), "d", rep, dim, 1)
    assert tables.read_view(spark, str(tmp_path / "v"), "d", "fp", 512, 1, "test").count() == 1
    assert tables.read_view(spark, str(tmp_path / "v"), "d", "desc", None, 1).count() == 2
    plan = tables.read_view(spark, str(tmp_path / "v"), "d", "fp", 512, 1, "test")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


@pytest.mark.parametrize("compact_every", [50, 2])
def test_late_measurements_do_not_overwrite_newer_ones(spark, tmp_path, monkeypatch, compact_every):
    monkeypatch.setattr("scoutline.streaming.commit.COMPACT_EVERY", compact_every)
    batches = [[(1, 10, 5, "40"), (2, 10, 6, "abc"), (3, 12, 7, "9")], [(1, 9, 8, "99"), (2, 11, 9, "0"), (3, 12, 10, "8")], [(1, 10, 4, "1")]]
    schema = "row_id bigint, ts bigint, event_id bigint, entry string"
    source = str(tmp_path / "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    keys, seq = {"row_id": "bigint"}, {"ts": "bigint", "event_id": "bigint"}
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream_commit(feed, str(tmp_path / "state"), keys, seq, str(tmp_path / "cp"))
    run.awaitTermination()
    last = winners(spark, str(tmp_path / "state"), keys, seq, last_batch(run))
    assert run.lastProgress["batchId"] == 2
    assert sorted((r["row_id"], r["yield"]) for r in last.collect()) == [(1, 40.0), (2, 0.0), (3, 8.0)]
    whole = commit.latest(commit.accepted(spark.read.schema(schema).parquet(source)), ["row_id"], ["ts", "event_id"])
    assert sorted((r["row_id"], r["_new"]) for r in whole.collect()) == [(1, 40.0), (2, 0.0), (3, 8.0)]
    spark.createDataFrame([(3, 99, 11, "77")], schema).coalesce(1).write.mode("append").parquet(source)
    again = stream_commit(feed, str(tmp_path / "state"), keys, seq, str(tmp_path / "cp"))
    again.awaitTermination()
    last = winners(spark, str(tmp_path / "state"), keys, seq, last_batch(again))
    assert {r["row_id"]: r["yield"] for r in last.collect()} == {1: 40.0, 2: 0.0, 3: 77.0}


def test_summary_is_numbered_in_append_order(spark):
    rows = spark.sql("SELECT timestamp'2024-01-02 03:04:05' + make_interval(0,0,0,0,0,0,id div 2) AS ts, id AS event_id, id * 1.0D AS yield FROM range(50)")
    got = commit.history_summary(rows.repartition(7)).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(1, 51)) and [r["yield"] for r in got] == [float(i) for i in range(50)]
    assert got[0]["date"] == "2024-01-02 03:04:05"
