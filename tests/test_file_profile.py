"""Stored per-file profiles, and ingest batches bounded in rows and bytes."""

import glob
import math
import os
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from faresight.operators import file_profile as FP
from faresight.operators import profile as P
from faresight.plans import registry
from faresight.sources import files as FS
from faresight.streaming.ingest import ingest_csv_stream


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_only_new_files_are_read_and_merged_profiles_equal_the_whole(spark):
    d = tempfile.mkdtemp(prefix="faresight-fp-")
    src, store = d + "/src", d + "/store"
    a = [(i, i * 0.5, f"u{i % 40}") for i in range(500)]
    b = [(i, 1000.0 + i, f"u{i % 70}") for i in range(300)]
    _write(src + "/a.csv", ["k,x,s"] + [f"{k},{x},{s}" for k, x, s in a] + [",,"])
    assert FP.update_profiles(spark, src, store) == 1
    _write(src + "/sub/a.csv", ["k,x,s"] + [f"{k}.5,{x},{s}" for k, x, s in b] + ["7,NaN,zz"])   # same name, other folder
    assert FP.update_profiles(spark, src, store) == 1
    assert FP.update_profiles(spark, src, store) == 0
    rows = FP.stored_profiles(spark, store)
    kinds = {(r.path.endswith("sub/a.csv"), r.column): (r.dtype, r.row_count, r.null_count) for r in rows.collect()}
    assert kinds[False, "k"] == ("bigint", 501, 1) and kinds[True, "k"] == ("double", 301, 0) and kinds[False, "s"] == ("string", 501, 1)
    got = {r.column: r for r in FP.merge_profiles(rows).collect()}
    xs = [x for _, x, _ in a + b]
    assert got["k"].dtype == "double" and got["s"].dtype == "string" and got["x"].row_count == 802 and got["x"].null_count == 1
    assert math.isclose(got["x"].mean, statistics.fmean(xs)) and math.isclose(got["x"].std, statistics.stdev(xs))
    assert (got["x"].min, got["x"].max) == (0.0, 1299.0) and got["s"].mean is None and got["s"].p50 is None
    assert abs(got["s"].approx_distinct - 71) <= 4
    rank = sum(x <= got["x"].p50 for x in xs) / len(xs)
    assert abs(rank - 0.5) < 0.03


def test_a_changed_file_counts_once(spark):
    d = tempfile.mkdtemp(prefix="faresight-fp-")
    src, store = d + "/src", d + "/store"
    _write(src + "/a.csv", ["k", "1", "2"])
    FP.update_profiles(spark, src, store)
    _write(src + "/a.csv", ["k", "1", "2", "3", "x"])
    os.utime(src + "/a.csv", (2e9, 2e9))
    assert FP.update_profiles(spark, src, store) == 1
    r, = FP.merge_profiles(FP.stored_profiles(spark, store)).collect()
    assert (r.row_count, r.dtype, r.n_numeric) == (4, "string", 3)


def test_void_columns(spark):
    d = tempfile.mkdtemp(prefix="faresight-fp-")
    _write(d + "/a.csv", ["k,v", "1,", "2,"])
    rows = {r.column: r for r in FP.profile_files(spark.read.option("header", True).csv(d)).collect()}
    assert rows["v"].dtype == "void" and rows["v"].null_count == 2 and rows["v"].mean is None


def test_describe_all(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, None), (4, "a", None)], "n int, s string, z string")
    r = {x.column: x for x in P.describe_all(df).collect()}
    assert (r["s"]["count"], r["s"].null_count, r["s"].min_text, r["s"].max_text, r["s"].mean) == (2, 1, "a", "b", None)
    assert (r["z"]["count"], r["z"].min_text) == (0, None) and (r["n"].p50, r["n"].max, r["n"].min_text) == (2.0, 4.0, None)
    assert P.describe_all(df.select("n")).count() == 1


@pytest.mark.parametrize("how", ["files", "bytes"])
def test_one_large_file_is_ingested_in_bounded_chunks(spark, how):
    d = tempfile.mkdtemp(prefix="faresight-in-")
    src = d + "/src"
    _write(src + "/big.csv", ["k,v"] + [f"{i},{i % 7}" for i in range(25_000)])
    for k in range(3):
        _write(f"{src}/s{k}.csv", ["k,v"] + [f"{i},0" for i in range(100)])
    schema = spark.createDataFrame([], "k long, v int").schema
    kw = {"max_bytes_per_trigger": 20_000} if how == "bytes" else {"max_files_per_trigger": 2}
    out = ingest_csv_stream(spark, src, schema, d + "/table", d + "/ckpt", max_rows=4_000, **kw)
    ledger = spark.read.parquet(out["ledger"]).collect()
    assert sum(r.rows for r in ledger) == 25_300 and max(r.largest_chunk for r in ledger) <= 4_000
    assert len(ledger) >= 2 and sum(r.n_chunks for r in ledger) >= 7
    _write(src + "/late.csv", ["k,v", "1,1"])
    ingest_csv_stream(spark, src, schema, d + "/table", d + "/ckpt", max_rows=4_000, **kw)     # a restart reads the new file only
    assert spark.read.parquet(out["table"]).count() == 25_301
    assert spark.read.parquet(out["table"]).select("k").distinct().count() == 25_000


def test_profiles_merge_by_group(spark, tmp_path):
    """Files of one group count together, others and the null group apart."""
    _write(f"{tmp_path}/g=1/a.csv", ["k,x", "1,0.5", "2,"])
    _write(f"{tmp_path}/g=1/b.csv", ["k,x", "3.5,4"])
    _write(f"{tmp_path}/g=2/a.csv", ["k,x", "7,1"])
    _write(f"{tmp_path}/other.csv", ["k,x", "9,NaN"])
    rows = FP.profile_files(spark.read.option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path)))
    rows = rows.withColumn("g", F.nullif(F.regexp_extract("path", "g=([0-9]+)", 1), F.lit("")))
    got = {(r.g, r.column): r for r in FP.merge_profiles(rows, ["g"]).collect()}
    assert len(got) == 6 and rows.count() == 8
    k, x = got["1", "k"], got["1", "x"]
    assert (k.dtype, k.row_count, k.null_count, k.min, k.max) == ("double", 3, 0, 1.0, 3.5)
    assert math.isclose(k.mean, 6.5 / 3) and math.isclose(k.std, statistics.stdev([1, 2, 3.5]))
    assert (x.row_count, x.null_count, x.mean) == (3, 1, 2.25) and got["2", "k"].dtype == "bigint"
    assert (got[None, "k"].row_count, got[None, "x"].mean) == (1, None)


def test_folders_are_written_without_shuffle_or_sort(spark, tmp_path):
    """Every task writes to every folder, and the session's setting comes back."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    df = spark.range(0, 60, 1, 3).selectExpr("id", "cast(id % 4 as int) line")
    FS.write_csv_folders(df.withColumn("line", F.when(F.col("line") > 0, F.col("line"))), f"{tmp_path}/t", "line", compression="gzip")
    assert spark.conf.get(key) == before
    files = glob.glob(f"{tmp_path}/t/line=*/*.csv.gz")
    assert len(files) == 12 and len({os.path.dirname(f) for f in files}) == 4      # three tasks, three values and null
    back = spark.read.option("header", True).csv(f"{tmp_path}/t")
    assert sorted((int(r.id), r.line) for r in back.collect()) == [(i, i % 4 or None) for i in range(60)]


def test_line_files_spread_over_tasks(spark):
    """The rows of one line number are not gathered in one file by one task."""
    parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = registry._market_files(spark, "/root/testdata/sf0.001")
        lines = [f.split("line=")[1].split("/")[0] for f in df.inputFiles()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
    assert len(set(lines)) == 7 and len(lines) > 7
