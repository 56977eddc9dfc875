import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faresight.sources import files as FS
from faresight.streaming.ingest import ingest_csv_stream

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()),
                       T.StructField("c", T.StringType())])


def _csv(spark, parts: int):
    d = tempfile.mkdtemp(prefix="faresight-csv-")
    rows = [(i, float(i), "cat" if i < 500 else "dog") for i in range(1000)]
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("overwrite").option("header", True).csv(d + "/in")
    return d


def test_scan_and_count(spark):
    d = _csv(spark, 4)
    df = FS.read_csv(spark, d + "/in", SCHEMA)
    assert FS.row_count(df).first()[0] == 1000
    assert FS.read_csv(spark, d + "/in").count() == 1000   # inferred schema path


def test_streaming_batches(spark):
    d = _csv(spark, 4)
    out = ingest_csv_stream(spark, d + "/in", SCHEMA, d + "/table", d + "/ckpt", max_files_per_trigger=1)
    ledger = spark.read.parquet(out["ledger"]).collect()
    assert len(ledger) >= 3 and sum(r.rows for r in ledger) == 1000
    assert all(r.n_columns == 3 for r in ledger)
    table = spark.read.parquet(out["table"])
    assert table.count() == 1000 and {"a", "b", "c"} <= set(table.columns)


def test_concat_with_schema_drift(spark):
    d = tempfile.mkdtemp(prefix="faresight-drift-")
    spark.createDataFrame([(1, 2.0)], "a bigint, b double").write.option("header", True).csv(d + "/x")
    spark.createDataFrame([(3, "z")], "a bigint, c string").write.option("header", True).csv(d + "/y")
    out = FS.concat_files(spark, [d + "/y", d + "/x"])
    assert out.count() == 2 and set(out.columns) == {"a", "b", "c"}


def test_json_maps_roundtrip_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="faresight-json-")
    imp = spark.createDataFrame([("gbt", "x", 0.7), ("gbt", "y", 0.3), ("ridge", "x", 1.0)],
                                "model string, feature string, importance double")
    FS.write_json_maps(imp, d + "/imp", "model", "feature", "importance")
    back = {(r.model, r.feature): r.importance for r in FS.read_json_maps(spark, d + "/imp").collect()}
    assert back == {("gbt", "x"): 0.7, ("gbt", "y"): 0.3, ("ridge", "x"): 1.0}
    with open(os.path.join(d, "xgb_feature_importance.json"), "w") as f:
        f.write('{"a": 1.5,\n "b": 2.5}')
    stem = FS.read_json_maps(spark, os.path.join(d, "*_feature_importance.json")).collect()
    assert {r.model for r in stem} == {"xgb"} and len(stem) == 2
    man = FS.file_manifest(spark, d + "/imp").collect()
    whole, = [r for r in man if r.path is None]
    assert whole.total_files == len(man) - 1 >= 2 and whole.total_size_bytes == sum(r.total_size_bytes for r in man if r.path)
    assert all(r.total_files == 1 and r.path.endswith(r.file) and r.dataset == "imp" for r in man if r.path)


def test_recursive_discovery_and_file_summary(spark):
    d = tempfile.mkdtemp(prefix="faresight-rec-")
    spark.createDataFrame([(1, 2.0, "x")], SCHEMA).write.option("header", True).csv(d + "/a/b")
    spark.createDataFrame([(2, 3.0, "y"), (3, 4.0, "z")], SCHEMA).write.option("header", True).csv(d + "/c")
    df = FS.read_csv(spark, d, SCHEMA, recursive=True)
    assert df.count() == 3
    summ = FS.file_summary(df, d).collect()
    assert sum(r.row_count for r in summ) == 3 and all(r.size_bytes > 0 and r.column_count == 3 for r in summ)


def test_streaming_restart_processes_only_new_files(spark):
    d = tempfile.mkdtemp(prefix="faresight-restart-")
    first = [(i, float(i), "a") for i in range(100)]
    spark.createDataFrame(first, SCHEMA).repartition(2).write.option("header", True).csv(d + "/in")
    out = ingest_csv_stream(spark, d + "/in", SCHEMA, d + "/table", d + "/ckpt", max_files_per_trigger=1)
    assert spark.read.parquet(out["table"]).count() == 100
    # new files arrive; the same checkpoint resumes after the committed batches
    more = [(i, float(i), "b") for i in range(100, 250)]
    spark.createDataFrame(more, SCHEMA).repartition(3).write.mode("append").option("header", True).csv(d + "/in")
    ingest_csv_stream(spark, d + "/in", SCHEMA, d + "/table", d + "/ckpt", max_files_per_trigger=1)
    table = spark.read.parquet(out["table"])
    assert table.count() == 250 and table.select("a").distinct().count() == 250
    ledger = spark.read.parquet(out["ledger"]).collect()
    assert sum(r.rows for r in ledger) == 250


def test_concat_of_many_files_is_one_scan(spark, tmp_path):
    """2,000 files of four layouts; types widen over all files, blank lines and quoted names are read."""
    heads = [["a", "b", "n, m"], ["n, m", "a"], ["b", "x", "a"], ["x"]]
    want = []
    for k in range(2000):
        names = heads[k % 4]
        row = {"a": k, "b": k / 2, "n, m": "word" if k == 1001 else str(k), "x": k if k % 3 else None}
        with open(tmp_path / f"f{k:04d}.csv", "w") as f:
            f.write("\n" * (k % 2) + ",".join(f'"{c}"' for c in names) + "\n")
            f.write(",".join("" if row[c] is None else str(row[c]) for c in names) + "\n" * (names != ["x"] or row["x"] is not None))
        if names != ["x"] or row["x"] is not None:  # a blank line is no row
            want.append(tuple(row[c] if c in names else None for c in ("a", "b", "n, m", "x")))
    out = FS.concat_files(spark, [str(tmp_path)])
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "n, m": "string", "x": "bigint"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" csv") == 1 and "Union" not in plan
    assert sorted(map(tuple, out.select("a", "b", "`n, m`", "x").collect()), key=repr) == sorted(want, key=repr)


def test_concat_edge_cases(spark, tmp_path):
    for name, body in {"a": "k,k,,v\n1,2,3,9999999999999999999\n", "b": "v\n", "c": "", "d": "v,extra\n007,1e3\n"}.items():
        (tmp_path / f"{name}.csv").write_text(body)
    out = FS.concat_files(spark, [str(tmp_path / f"{n}.csv") for n in "abcd"])
    assert out.dtypes == [("k0", "bigint"), ("k1", "bigint"), ("_c2", "bigint"), ("v", "string"), ("extra", "double")]
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, 2, 3, "9999999999999999999", None), (None, None, None, "007", 1000.0)]
    assert FS.concat_files(spark, [str(tmp_path / "c.csv")]).count() == 0
    plain = FS.concat_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "d.csv")], header=False)
    assert plain.columns == ["_c0", "_c1", "_c2", "_c3"] and plain.count() == 4
