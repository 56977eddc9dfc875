"""CSV copies of whole tables are packed, and read back whole."""
import __spark_entry__ as E
from faresight.sources import files as FS
from faresight.sources.market import market

SF = "/root/testdata/sf0.001"


def test_copies_are_packed(spark):
    queries = E.queries()
    export, nested = queries["csv_export"](spark, SF), queries["scan_csv_recursive"](spark, SF)
    for df in (export, nested):
        assert df.inputFiles() and all(f.endswith(".csv.gz") for f in df.inputFiles())
    assert nested.count() == market(spark, SF).count()
    assert queries["concat_files"](spark, SF).count() == market(spark, SF).count()


def test_plain_and_packed_files_are_read_together(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"x')], "k bigint, v string")
    FS.write_csv(df, f"{tmp_path}/t/plain")
    FS.write_csv(df, f"{tmp_path}/t/packed", compression="gzip")
    got = FS.read_csv(spark, f"{tmp_path}/t", df.schema, recursive=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([tuple(r) for r in df.collect()] * 2, key=str)
    both = FS.concat_files(spark, [f"{tmp_path}/t/plain", f"{tmp_path}/t/packed"])
    assert both.dtypes == df.dtypes and both.count() == 6
