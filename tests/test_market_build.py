"""The market table: shares against a plain computation, and what its build shuffles."""
from pyspark.sql import functions as F

from faresight.sources import market as M

SF = "/root/testdata/sf0.001"


def test_shares_with_null_keys_and_demand(spark):
    rows = [(1, "A", 3), (1, "A", 1), (1, "B", 4), (1, None, 2), (None, "A", 5), (2, "A", None), (3, "A", None), (3, "B", 6)]
    df = spark.createDataFrame(rows, "ODPairID bigint, Carrier string, Pax bigint")
    got = sorted(((r.ODPairID, r.Carrier, r.Pax, r.Market_share, r.Market_HHI) for r in M.with_market_shares(df).collect()), key=str)
    hhi = 10000.0 * (16 + 16 + 4) / 100.0
    want = [(1, "A", 3, 0.4, hhi), (1, "A", 1, 0.4, hhi), (1, "B", 4, 0.4, hhi), (1, None, 2, None, None),
            (None, "A", 5, None, None), (2, "A", None, None, None), (3, "A", None, None, 10000.0), (3, "B", 6, 1.0, 10000.0)]
    assert got == sorted(want, key=str)


def test_rows_are_scanned_once_and_no_carrier_table_is_joined(spark):
    plan = M.market_view(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") > 0 and plan.count("Join ") == 4 and "Aggregate" not in plan
    assert sum("RepartitionByExpression" in line for line in plan.splitlines()) == 1


def test_market_columns_survive(spark):
    base = M.market_base(spark, SF)
    full = M.market_view(spark, SF)
    assert full.count() == base.count()
    assert full.agg(F.sum("Pax")).first() == base.agg(F.sum("Pax")).first()
