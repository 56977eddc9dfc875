"""Stacked baselines: right means, each from an aggregate of its own."""
from faresight.operators import models as MD


def test_means_with_null_groups_and_fares(spark):
    cols = "rid bigint, c string, r bigint, Average_Fare double"
    train = spark.createDataFrame([(1, "A", 1, 10.0), (2, "A", 2, 20.0), (3, None, 1, 60.0), (4, "B", None, None), (5, "B", 3, None)], cols)
    test = spark.createDataFrame([(6, "A", 1, 1.0), (7, "B", 3, 2.0), (8, None, None, 3.0)], cols)
    got = {(r.rid, r.model): r.prediction for r in MD.stacked_baselines(train, test, ["rid"], {"by_c": "c", "by_r": "r"}).collect()}
    assert got == {(6, "global_mean"): 30.0, (6, "by_c"): 15.0, (6, "by_r"): 35.0, (7, "global_mean"): 30.0, (7, "by_c"): 30.0,
                   (7, "by_r"): 30.0, (8, "global_mean"): 30.0, (8, "by_c"): 30.0, (8, "by_r"): 30.0}


def test_no_aggregate_over_all_groups_together(spark, sample_df):
    df = MD.stacked_baselines(sample_df, sample_df, ["rid"], {"carrier_mean": "Carrier", "route_mean": "ODPairID"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [Carrier" in plan and "Aggregate [ODPairID" in plan
    assert not any("Aggregate [" in line and "Carrier" in line and "ODPairID" in line for line in plan.splitlines())
