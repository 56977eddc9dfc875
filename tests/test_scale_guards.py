"""Skew and plan-shape guards: a key holding a third of all rows, no cross
joins in any registered plan, bounded per-group work before shuffles."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from faresight.operators import features as FE
from faresight.operators.quantiles import quantile_table
from faresight.operators.sequences import route_sequences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    # 3000 rows; route 7 holds one third of them
    rows = [((7 if i % 3 == 0 else 100000 + i), "C%d" % (i % 5), float(i % 97) + 0.25, 1 + i % 4, 0.5, 100.0, i)
            for i in range(3000)]
    return spark.createDataFrame(rows, "ODPairID bigint, Carrier string, Average_Fare double, Pax bigint, "
                                       "Market_share double, Market_HHI double, rid bigint")


def test_hot_route_statistics_exact(skewed):
    out = FE.build_route_features(skewed).filter("ODPairID = 7").select("route_avg_fare", "route_total_pax").first()
    pdf = skewed.filter("ODPairID = 7").toPandas()
    assert abs(out.route_avg_fare - pdf.Average_Fare.mean()) < 1e-9
    assert out.route_total_pax == pdf.Pax.sum()


def test_hot_key_target_encoding_and_sequences(skewed):
    enc = FE.target_encode_cv(skewed, "Carrier", key_cols=["rid"])
    assert enc.count() == 3000 and enc.filter(F.col("Carrier_target_enc").isNull()).count() == 0
    seqs = route_sequences(skewed, ["Average_Fare"], ["rid"], seq_len=4)
    hot = seqs.filter("ODPairID = 7").first()
    assert hot.length == 4 and [v[0] for v in hot.features] == [0.25, 3.25, 6.25, 9.25]


def test_hot_group_quantiles_exact(skewed):
    got = {r.ODPairID: r.q0 for r in quantile_table(skewed, ["Average_Fare"], [0.5], ["ODPairID"], accuracy=50)
           .filter("ODPairID = 7").collect()}
    ref = skewed.filter("ODPairID = 7").agg(F.percentile("Average_Fare", 0.5)).first()[0]
    assert abs(got[7] - ref) < 1e-9


PLAN_QUERIES = ["route_features", "carrier_features", "market_features", "frequency_encode", "target_encode",
                "build_features", "validate_market", "clean_strict", "profile_columns", "describe_numeric",
                "cardinality_top", "correlation_matrix", "fare_histogram", "carrier_fare_box", "binary_fare_box",
                "top_routes", "hash_sample", "revenue_scenarios", "revenue_ranking", "price_grid",
                "route_scenarios", "route_summary", "route_sequences", "regression_metrics", "model_comparison"]


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_cross_join_in_plan(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sequence_plan_limits_before_shuffle(spark):
    df = E.queries()["route_sequences"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2   # partial (before the exchange) and final


def test_sequences_are_padded_behind_the_join(spark):
    """No sort or list aggregation holds padded groups: rows are listed in the window's order, targets joined, then padded."""
    plan = E.queries()["route_sequences_nested"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    lines = plan.splitlines()
    padded = [i for i, x in enumerate(lines) if "array_repeat" in x]
    assert padded and max(padded) < min(i for i, x in enumerate(lines) if "Join" in x)


def test_market_scan_is_pruned(spark):
    df = E.queries()["top_routes"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = [l for l in plan.splitlines() if "ReadSchema" in l]
    assert schemas and all("Carrier" not in l and "Market_HHI" not in l for l in schemas)
