"""Tables written as files are cut into more of them as they grow, so that no task takes a fixed share."""
import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_file_count_follows_the_scan(spark):
    queries = E.queries()
    assert queries["file_profile"](spark, SF).count() == 4
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = queries["file_profile"](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) > 4
