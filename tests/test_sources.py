"""Sources and sinks on written files."""

import json
import os

import pytest

from relweave.sources.tables import export_tables_csv, find_json, read_csv_folder, read_entries, to_json_text, write_csv, write_json
from relweave.streaming.incremental import process_pending


def _entry(i):
    return {"text": f"t{i}", "ground_truth_entities": ["a"], "ground_truth_key_value": {"a": [["1", f"v{i}"], ["2", "w"]]}, "domain": "d", "difficulty": None}


def test_read_entries_ids_and_exact_n(spark, tmp_path):
    for name, ids in (("b.json", range(3, 7)), ("a.json", range(3))):
        (tmp_path / name).write_text(json.dumps([_entry(i) for i in ids], indent=1))
    got = {r.entry_id: r for r in read_entries(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(7)] == [f"t{i}" for i in range(7)]
    assert [tuple(p) for p in got[4].ground_truth_key_value["a"]] == [("1", "v4"), ("2", "w")]
    assert sorted(r.entry_id for r in read_entries(spark, str(tmp_path), 4).collect()) == [0, 1, 2, 3]


def test_read_csv_folder_keeps_each_header(spark, tmp_path):
    files = {"a/data.csv": "id,name\n1,x\n2,y\n", "b/c/more_data.csv": "city,zip,extra\nRome,001,e\n", "skip/data.csv": "q\n1\n", "a/other.txt": "no", "d/data.csv": ""}
    for f, t in files.items():
        os.makedirs(tmp_path / os.path.dirname(f), exist_ok=True)
        (tmp_path / f).write_text(t)
    os.makedirs(tmp_path / "e")
    (tmp_path / "e" / "data.csv.gz").write_bytes(b"not gzip")
    got = read_csv_folder(spark, str(tmp_path), skip_folders=("skip",))
    assert set(got) == {"a_data", "b_c_more_data"}
    assert got["a_data"].columns == ["id", "name"] and [r.id for r in got["a_data"].orderBy("id").collect()] == [1, 2]
    assert got["b_c_more_data"].columns == ["city", "zip", "extra"] and got["b_c_more_data"].first().city == "Rome"
    bad = read_csv_folder(spark, str(tmp_path), suffix=".gz")
    assert bad == {}


def test_csv_file_that_breaks_off_is_left_out(spark, tmp_path):
    import gzip
    import random

    rng = random.Random(1)
    whole = gzip.compress("\n".join(["id,name", *(f"{i},{rng.random()}" for i in range(200_000))]).encode())
    for name, data in (("a", whole), ("b", whole[:len(whole) // 2]), ("c", whole)):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "data.csv.gz").write_bytes(data)
    got = read_csv_folder(spark, str(tmp_path), suffix="data.csv.gz")
    assert set(got) == {"a_data.csv", "c_data.csv"} and got["c_data.csv"].dtypes == [("id", "int"), ("name", "double")]


def test_find_json_and_sinks(spark, tmp_path):
    for d, v in (("x", 1), ("x/y", 2)):
        os.makedirs(tmp_path / d, exist_ok=True)
        (tmp_path / d / "result.json").write_text(json.dumps({"v": v}))
        (tmp_path / d / "other.json").write_text(json.dumps({"v": 9}))
    assert sorted(r.v for r in find_json(spark, str(tmp_path), "result.json").collect()) == [1, 2]
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, t string")
    write_csv(df, str(tmp_path / "csv"))
    assert sorted((r.k, r.t) for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv")).collect()) == [(1, "a,b"), (2, None)]
    write_json(df, str(tmp_path / "json"))
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "json")).collect()) == [1, 2]
    assert sorted(r.json for r in to_json_text(df).collect()) == ['{"k":1,"t":"a,b"}', '{"k":2}']


def test_export_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS relweave_t LOCATION '{tmp_path}/db'")
    try:
        spark.createDataFrame([(1, "x")], "k int, t string").write.mode("overwrite").saveAsTable("relweave_t.one")
        written = export_tables_csv(spark, "relweave_t", str(tmp_path / "out"))
        assert written == [f"{tmp_path}/out/one"] and spark.read.option("header", True).csv(written[0]).first().t == "x"
    finally:
        spark.sql("DROP DATABASE relweave_t CASCADE")


def test_unreadable_results_stop_the_job(spark, tmp_path):
    os.makedirs(tmp_path / "results")
    (tmp_path / "results" / "part-0.parquet").write_text("not parquet")
    entries = spark.createDataFrame([(1,)], "entry_id long")
    with pytest.raises(Exception):
        process_pending(spark, entries, str(tmp_path / "results"), lambda df: df)
    assert os.listdir(tmp_path / "results") == ["part-0.parquet"]
