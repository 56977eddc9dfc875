"""The route summary against plain Python, and what it shuffles."""
import math
import statistics

from pyspark.sql import functions as F

import __spark_entry__ as E
from faresight.operators.exports import route_summary

SF = "/root/testdata/sf0.001"


def test_summary_with_nulls_nans_and_a_hot_route(spark):
    nan = float("nan")
    rows = [(7 if i % 3 == 0 else 100 + i % 40, "C%d" % (i % 4) if i % 9 else None, float(i * 37 % 101), i % 5, float(i), 100.0 + i, i)
            for i in range(900)]
    rows += [(1, None, None, None, 5.0, 1.0, 901), (2, "A", nan, 3, 6.0, None, 902), (2, "A", 4.0, 2, 7.0, 2.0, 903),
             (3, "A", 2.0, 1, 8.0, 3.0, 905), (3, "B", 3.0, 1, 9.0, 4.0, 904), (None, "A", 1.0, 1, 1.0, 1.0, 906), (4, "A", 5.0, 1, 1.0, 1.0, 907)]
    df = spark.createDataFrame(rows, "ODPairID bigint, Carrier string, Average_Fare double, Pax bigint, NonStopMiles double, "
                                     "Market_HHI double, rid bigint").repartition(5)
    out = route_summary(df, order_cols=[F.col("rid") * 2])
    got = {r.ODPairID: r for r in out.collect()}
    assert [r.total_pax for r in out.collect()] == sorted((r.total_pax for r in got.values()), reverse=True)
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        own = sorted((x for x in rows if x[0] == k), key=lambda x: x[-1])
        fares = [x[2] for x in own if x[2] is not None and not math.isnan(x[2])]
        assert r.n_records == len(own) and r.total_pax == sum(x[3] or 0 for x in own)
        assert r.distance == own[0][4] and r.hhi == own[0][5] and r.n_carriers == len({x[1] for x in own})
        if k is None or not fares:
            assert r.median_fare is None
        else:
            assert r.median_fare == statistics.median(fares)
        if k != 2:
            assert fares and math.isclose(r.avg_fare, statistics.fmean(fares)) or r.avg_fare is None


def test_rows_are_shuffled_once_before_the_sort(spark):
    plan = E.queries()["route_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "percentile" not in plan and "Join" not in plan   # by route, then for the order
