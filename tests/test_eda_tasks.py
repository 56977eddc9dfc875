"""Reports over all rows: no task holds the rows of a whole group or of the table."""
from faresight.operators import profile as P
from faresight.plans.jobs import one_part


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_box_stats_bring_the_few_groups_to_the_rows(spark, sample_df):
    # brackets, cells with a rank and fences (for carriers also the 15 names) are broadcast
    assert _plan(P.binary_fare_box(sample_df)).count("strategy=broadcast") >= 3
    assert _plan(P.carrier_fare_box(sample_df)).count("strategy=broadcast") >= 4
    assert _plan(P.profile_columns(sample_df)).count("strategy=broadcast") >= 2


def test_groups_of_any_number_are_not_broadcast(sample_df):
    assert "strategy=broadcast" not in _plan(P.box_stats(sample_df, ["ODPairID"]))


def test_a_report_is_gathered_behind_its_own_stage(spark, sample_df):
    rep = one_part(sample_df.groupBy("Carrier").count())
    assert rep.rdd.getNumPartitions() == 1 and "Repartition 1, true" in _plan(rep)
    assert rep.count() == sample_df.select("Carrier").distinct().count()
