import json

import pandas as pd
import pytest
from data import dirty, to_spark
from pyspark.sql import functions as F

import tableaudit as A
from tableaudit.plans.materialise import ensure_checkpoint_dir
from tableaudit.sources import readers as S
from tableaudit.sources.sampling import sample_rows
from tableaudit.sources.sinks import run_path


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,x,flag,day,phone,name\n1,1.5,True,2024-01-01,+15550100,N/A\n2,NA,False,,+15550101,Bo\n")
    df = A.read_table(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "day": "string", "phone": "bigint", "name": "string"}
    first, second = df.orderBy("id").collect()
    assert first["name"] is None and second["x"] is None and second["day"] is None
    assert first["phone"] == 15550100


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'id,t\n1,"two\nlines"\n2,"say ""hi"", ok"\n')
    got = {r["id"]: r["t"] for r in A.read_table(spark, path).collect()}
    assert got == {1: "two\nlines", 2: 'say "hi", ok'}


def test_csv_falls_back_to_latin1(spark, tmp_path):
    path = write(tmp_path, "l.csv", "id,name\n1,Jos\xe9\n2,Zo\xeb\n", "latin-1")
    assert {r["name"] for r in A.read_table(spark, path).collect()} == {"José", "Zoë"}
    path = write(tmp_path, "u.csv", "id,name\n1,José\n")
    assert A.read_table(spark, path).first()["name"] == "José"


def test_types_need_every_value(spark):
    df = spark.createDataFrame([("1", "1e3", "inf", "1d"), ("2", ".5", "-2.", "2"), (None, "-7", "3", "x")], "a string, b string, c string, d string")
    assert dict(A.infer_types(df).dtypes) == {"a": "bigint", "b": "double", "c": "double", "d": "string"}


def test_integers_beyond_64_bits_become_doubles(spark):
    df = spark.createDataFrame([("9223372036854775808",), ("1",)], "a string")
    assert dict(A.infer_types(df).dtypes) == {"a": "double"}


def test_json_records_of_the_first_list(spark, tmp_path):
    doc = {"meta": {"n": 2}, "rows": [{"id": 1, "at": {"x": 1.5, "y": {"z": "q"}}, "tags": ["a"]}, {"id": 2, "at": {"x": 2.5, "y": {"z": "r"}}, "tags": []}], "also": [{"id": 9}]}
    path = write(tmp_path, "d.json", json.dumps(doc))
    df = A.read_table(spark, path)
    assert df.columns == ["at.x", "at.y.z", "id", "tags"]
    assert sorted(r["id"] for r in df.collect()) == [1, 2]
    assert sorted(r["tags"] for r in df.collect()) == ['["a"]', "[]"]
    assert S.read_json(spark, path, records_key="also").first()["id"] == 9


def test_json_list_and_lines(spark, tmp_path):
    path = write(tmp_path, "list.json", json.dumps([{"a": 1, "v": [1, 2]}, {"a": 2, "v": []}]))
    assert A.read_table(spark, path).count() == 2
    path = write(tmp_path, "rows.jsonl", '{"a": {"b": 1}}\n{"a": {"b": 2}}\n')
    assert sorted(r["a.b"] for r in A.read_table(spark, path).collect()) == [1, 2]


def test_dotted_columns_are_audited(spark, tmp_path):
    path = write(tmp_path, "rows.jsonl", "\n".join(json.dumps({"a": {"b": i, "c": "x" if i % 2 else "y"}}) for i in range(20)))
    df = A.read_table(spark, path)
    assert {r["column"] for r in A.column_quality(df).collect()} == {"a.b", "a.c"}
    assert A.group_tests(df).count() == 1
    assert A.clean(df).data.count() == 20
    assert A.correlations(df.withColumn("twice.b", F.col("`a.b`") * 2)).first()["pair"] == "a.b & twice.b"


def test_parquet_orc_and_unknown(spark, tmp_path):
    df = to_spark(spark, dirty())
    for fmt in ("parquet", "orc"):
        path = A.write_run(df, str(tmp_path), "r1", f"t.{fmt}", fmt)
        assert A.read_table(spark, path).count() == 10
        assert A.read_table(spark, path, fmt="something", ).count() == 10  # by extension
    with pytest.raises(ValueError):
        A.read_table(spark, None, fmt="something")


def test_empty_and_missing_sources(spark, tmp_path):
    with pytest.raises(S.EmptyDatasetError):
        A.read_table(spark, write(tmp_path, "e.csv", "a,b\n"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        A.read_table(spark, str(tmp_path / "none.parquet"))


def test_runs_are_separate_and_replaced(spark, tmp_path):
    a = A.write_run(spark.range(3), str(tmp_path), "one", "t")
    b = A.write_run(spark.range(5), str(tmp_path), "two", "t")
    assert a != b
    A.write_run(spark.range(4), str(tmp_path), "one", "t")
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (4, 5)
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            run_path(str(tmp_path), bad, "t")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "d", 2.5)], "id bigint, t string, x double")
    back = A.read_table(spark, A.write_run(df, str(tmp_path), "r", "t.csv", "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_jdbc_options():
    options = S.jdbc_options("sales", "shop", host="db", username="u", password="p", partition_column="id", bounds=(1, 900), partitions=9)
    assert options["url"] == "jdbc:mysql://db:3306/shop" and options["dbtable"] == "sales"
    assert (options["partitionColumn"], options["lowerBound"], options["numPartitions"]) == ("id", "1", "9")
    assert "user" not in S.jdbc_options("t", "d")


def _parts(spark):
    cover = to_spark(spark, pd.DataFrame({"Title": ["Report"], "Date": ["2024"]}))
    data = to_spark(spark, pd.DataFrame({"Age": [1.0] * 100, "Income": [2.0] * 100, "Category": ["A", "B"] * 50, "Target": [0, 1] * 50}))
    return cover, data


def test_parts(spark):
    cover, data = _parts(spark)
    best = A.resolve_parts({"Cover": cover, "Data": data})
    assert (best.count(), len(best.columns)) == (100, 4)
    assert A.resolve_parts({"Cover": cover, "Data": data}, "Cover").count() == 1
    assert A.resolve_parts({"Cover": cover, "Data": data}, 1).count() == 100
    assert A.resolve_parts({"Cover": cover, "Data": data}, "unknown").count() == 100
    assert A.resolve_parts({"a": data, "b": data.select(*reversed(data.columns))}).count() == 200
    assert A.resolve_parts({"a": data.limit(0), "b": cover}).columns == ["Title", "Date"]
    tie = A.resolve_parts({"x": cover.select("Title"), "y": cover.select("Date")})
    assert tie.columns == ["Title"]
    with pytest.raises(S.EmptyDatasetError):
        A.resolve_parts({"a": data.limit(0), "b": cover.limit(0)})


def test_parts_with_differing_types_widen(spark):
    a, b = spark.createDataFrame([(1, "x")], "n bigint, t string"), spark.createDataFrame([(2.5, 3)], "n double, t bigint")
    got = A.resolve_parts({"a": a, "b": b})
    assert dict(got.dtypes) == {"n": "double", "t": "string"} and got.count() == 2


def test_samples_are_stable(spark, monkeypatch):
    df = spark.range(10_000).withColumn("v", F.col("id") * 2)
    one = {r["id"] for r in sample_rows(df, 500).collect()}
    two = {r["id"] for r in sample_rows(df.repartition(13), 500).collect()}
    assert len(one) == 500 and one == two
    assert {r["id"] for r in sample_rows(df, 500, seed=7).collect()} != one
    monkeypatch.setattr("tableaudit.sources.sampling.SAMPLE_DIRECT_ROWS", 100)
    assert {r["id"] for r in sample_rows(df, 500).collect()} == one
    copies = df.limit(1).crossJoin(spark.range(1000).select())
    assert sample_rows(copies, 50).count() == 50


def test_checkpoint_dir_comes_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert A.materialise(spark.range(5)).count() == 5
