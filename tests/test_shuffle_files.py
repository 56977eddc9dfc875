"""Written intermediate tables leave no shuffle files behind."""
import time

from pyspark.sql import functions as F

from faresight.llm.common import materialize
from faresight.session import FREE_SHUFFLES, shuffles_freed
from faresight.sources import market as M

SF = "/root/testdata/sf0.001"


def _left(spark, before: set[str]) -> set[str]:
    """New shuffle files; removal is asked for, not waited for."""
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    return _shuffle_files(spark) - before


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_a_written_table_frees_its_shuffles(spark):
    df = spark.range(5000).repartition(7).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    before = _shuffle_files(spark)
    got = materialize(df.join(df.withColumnRenamed("n", "m").hint("merge"), "k"), "freed")
    assert not _left(spark, before)
    assert got.count() == 1000 and got.agg(F.sum("n"), F.sum("m")).first()[:] == (5000, 5000)
    # the frame itself is as good as before, and the session keeps shuffles elsewhere
    assert df.count() == 1000 and df.collect() and spark.conf.get(FREE_SHUFFLES, None) in (None, "false")


def test_the_market_build_frees_its_shuffles(spark, monkeypatch):
    monkeypatch.setattr(M, "_MATERIALIZED", {})
    before = _shuffle_files(spark)
    m = M.market(spark, SF)
    assert not _left(spark, before)
    assert m.count() == M.market_view(spark, SF).count()


def test_a_failed_write_restores_the_setting(spark):
    before = spark.conf.get(FREE_SHUFFLES, None)
    try:
        with shuffles_freed(spark):
            raise RuntimeError
    except RuntimeError:
        pass
    assert spark.conf.get(FREE_SHUFFLES, None) == before
