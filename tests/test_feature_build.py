"""The feature build: one shuffle of the rows by route, no table of routes, carriers broadcast."""
from pyspark.sql import functions as F

from faresight.operators import features as FE
from faresight.plans.jobs import build_features

ROUTE_COLUMNS = ["route_avg_fare", "route_std_fare", "route_carrier_count", "route_total_pax", "route_avg_market_share",
                 "route_hhi", "route_competition_level"]


def _rows(df):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in df.collect()), key=str)


def _odd(spark):
    rows = [(1, "A", 10.0, 3, 0.5, 7.0, 1), (1, "A", 20.0, None, 0.25, 8.0, 2), (1, None, None, 1, None, 9.0, 3), (1, "B", 5.0, 2, 0.1, 6.0, 4),
            (None, "A", 4.0, 2, 0.5, 1.0, 5), (None, "B", 8.0, 2, 0.5, 2.0, 6), (2, None, None, None, None, None, 7), (3, "C", 1.0, 1, 1.0, 3.0, 8),
            (3, "C", 1.0, 1, 1.0, 3.0, 8)]
    return spark.createDataFrame(rows, "ODPairID bigint, Carrier string, Average_Fare double, Pax bigint, Market_share double, "
                                       "Market_HHI double, rid bigint")


def test_route_windows_equal_the_joined_table(spark):
    df = _odd(spark)
    for leave_one_out in (False, True):
        old = FE.build_route_features(df, order_cols=["rid"], leave_one_out=leave_one_out).select(*df.columns, *ROUTE_COLUMNS)
        new = FE.with_route_windows(df, order_cols=["rid"], leave_one_out=leave_one_out).select(*df.columns, *ROUTE_COLUMNS)
        assert _rows(new) == _rows(old)
    freq = FE.frequency_encode(df, ["ODPairID"]).select("rid", "ODPairID_freq_enc")
    assert _rows(FE.with_route_windows(df, freq="ODPairID_freq_enc").select("rid", "ODPairID_freq_enc")) == _rows(freq)


def test_rows_are_not_shuffled_by_carrier_and_no_route_table_is_built(spark, sample_df):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as if every table were large
    try:
        out = build_features(sample_df, order_cols=["rid"], key_cols=["rid"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [ODPairID" not in plan
        assert plan.count("strategy=broadcast") == 2               # carriers, carriers by fold
        assert out.count() == sample_df.count()
        assert out.where(F.col("ODPairID_freq_enc").isNull()).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
