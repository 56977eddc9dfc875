from pyspark.sql import functions as F

from faresight.operators.clean import clean, clean_and_validate, clean_strict, downcast, downcast_plan, validate
from faresight.schema import FREQ_ENCODED_COLUMNS


def _v(spark, data, schema):
    return validate(spark.createDataFrame(data, schema)).first()


def test_clean_table_validates(sample_df):
    r = validate(sample_df.drop("rid")).first()
    assert r["total_rows"] == 200
    assert r["negative_fares"] == 0


def test_negative_fare_detected(spark):
    r = _v(spark, [(-10.0, 500.0, 500.0), (100.0, 800.0, 800.0), (200.0, 1200.0, 1200.0)],
           "Average_Fare double, NonStopMiles double, MktMilesFlown double")
    assert r["negative_fares"] == 1
    assert r["is_clean"] is False
    assert r["issues"] == ["1 rows with negative Average_Fare"]


def test_negative_distance_detected(spark):
    r = _v(spark, [(100.0, -500.0, 500.0), (200.0, 800.0, 800.0)],
           "Average_Fare double, NonStopMiles double, MktMilesFlown double")
    assert r["negative_distances"] == 1


def test_duplicates_and_missing_counted(spark):
    r = _v(spark, [(1.0, 2.0), (1.0, 2.0), (None, 3.0), (0.0, 0.3)], "Average_Fare double, Circuity double")
    assert (r["duplicate_rows"], r["missing_target"], r["zero_fares"], r["impossible_circuity"]) == (1, 1, 1, 1)
    assert len(r["issues"]) == 4


def test_drop_invalid_target(spark):
    df = spark.createDataFrame([(-10.0, 500.0, 500.0), (0.0, 800.0, 800.0), (100.0, 1000.0, 1000.0),
                                (200.0, 1200.0, 1200.0)],
                               "Average_Fare double, NonStopMiles double, MktMilesFlown double")
    assert clean(df).count() == 2


def test_drop_encoded_columns(spark):
    df = spark.createDataFrame([(100.0, 0.5, 0.1), (200.0, 0.3, 0.2)],
                               "Average_Fare double, Carrier_freq double, ODPairID_freq double")
    out = clean(df)
    assert "Carrier_freq" not in out.columns and "ODPairID_freq" not in out.columns


def test_dedup(spark):
    df = spark.createDataFrame([(100.0, 500.0), (100.0, 500.0), (200.0, 800.0)],
                               "Average_Fare double, NonStopMiles double")
    assert clean(df).count() == 2


def test_null_distance_dropped_and_nan_fare_kept(spark):
    df = spark.createDataFrame([(100.0, None), (float("nan"), 10.0), (5.0, 1.0)],
                               "Average_Fare double, NonStopMiles double")
    out = clean(df, narrow=False).collect()
    assert len(out) == 2  # NULL miles fail ">= 0"; NaN > 0 is true in Spark


def test_downcast_guards_range(spark):
    df = spark.createDataFrame([(1, 2 ** 40, 1.5, None), (2, 3, 2.5, None)], "a bigint, b bigint, c double, d bigint")
    plan = downcast_plan(df)
    assert plan == {"a": "int", "c": "float"}
    out = downcast(df)
    assert dict(out.dtypes) == {"a": "int", "b": "bigint", "c": "float", "d": "bigint"}


def test_clean_strict(spark):
    df = spark.createDataFrame([(0.5, 100.0), (None, 100.0), (10.0, 0.0), (10.0, 100.0), (10.0, 100.0)],
                               "Average_Fare double, NonStopMiles double")
    assert clean_strict(df).count() == 1


def test_validation_within_the_write(spark, sample_df, tmp_path):
    """One scan: the record equals ``validate``, the table equals ``clean``; also with dropped columns and clashing names."""
    base = sample_df.drop("rid")
    some = base.limit(20)
    damaged = (base.unionByName(some).unionByName(some.withColumn("Average_Fare", -F.col("Average_Fare")))
               .unionByName(some.withColumn("NonStopMiles", F.lit(-1.0))).unionByName(some.withColumn("Average_Fare", F.lit(None).cast("double")))
               .unionByName(some.withColumn("Circuity", F.lit(0.1))))
    encoded = FREQ_ENCODED_COLUMNS[0]
    cases = {"plain": damaged, "dropped": damaged.withColumn(encoded, (F.col("Pax") % 3).cast("double")).withColumn("copies", F.lit(1)),
             "twice": damaged.crossJoin(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], f"{encoded} double")),
             "narrow": damaged.drop("Average_Fare", "Circuity", "NonStopMiles"), "empty": damaged.limit(0)}
    for name, df in cases.items():
        df.write.parquet(f"{tmp_path}/in-{name}")
        raw = spark.read.parquet(f"{tmp_path}/in-{name}")
        plans = []

        def write(out):
            plans.append(out._jdf.queryExecution().optimizedPlan().toString())
            out.write.parquet(f"{tmp_path}/out-{name}")

        record = clean_and_validate(raw, write)
        assert record.collect() == validate(raw).collect(), name
        assert plans[0].count(" parquet") == 1
        got = spark.read.parquet(f"{tmp_path}/out-{name}")
        want = clean(raw, narrow=False)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), name
