from pyspark.sql import functions as F

from faresight.operators import profile as P
from faresight.operators import sampling as S


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, None)], "a double, c double, b double")
    r = {(x.col_a, x.col_b): x.corr for x in P.correlation_matrix(df, ["a", "c", "b"]).collect()}
    assert r[("a", "c")] is None and r[("c", "c")] is None
    assert abs(r[("a", "b")] - 1.0) < 1e-12 and abs(r[("a", "a")] - 1.0) < 1e-12


def test_histogram_closed_last_bin(spark):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [0, 1, 2, 3, 4, 10, None]], "x double")
    h = P.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 1, 0, 1]
    assert h[-1].bin_hi == 10.0 and h[0].bin_lo == 0.0


def test_describe_and_profile(sample_df):
    d = {r.statistic: r for r in P.describe(sample_df.drop("Carrier")).collect()}
    assert d["count"].Pax == 200 and d["min"].Pax <= d["25%"].Pax <= d["50%"].Pax <= d["75%"].Pax <= d["max"].Pax
    prof = P.profile_columns(sample_df).collect()
    assert len(prof) == len(sample_df.columns)


def test_null_counts_missing_and_cardinality(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, "b"), (None, "b")], "x int, s string")
    nc = {r.column: r.null_count for r in P.null_counts(df).collect()}
    assert nc == {"x": 1, "s": 1}
    mp = {r.column: r.missing_pct for r in P.missing_pct(df).collect()}
    assert mp == {"x": 25.0, "s": 25.0}
    card = {r.column: r.n_unique for r in P.cardinality(df).collect()}
    assert card == {"x": 3, "s": 3}  # NULL counts as a value


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, Average_Fare double")
    r = P.box_stats(df, ["g"]).first()
    assert (r.q1, r.median, r.q3) == (2.0, 3.0, 4.0)
    assert r.whisker_lo == 1.0 and r.whisker_hi == 4.0  # 100 is beyond q3 + 1.5 IQR


def test_top_routes_min_records(spark):
    df = spark.createDataFrame([(1, 10.0)] * 3 + [(2, 50.0)] * 1, "ODPairID bigint, Average_Fare double")
    assert [r.ODPairID for r in P.top_routes(df, min_records=2).collect()] == [1]


def test_hash_sample_exact_and_deterministic(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("k"))
    a = S.hash_sample(df, 123, key_cols=["k"])
    ids = sorted(r.k for r in a.collect())
    assert len(ids) == 123 and ids == sorted(r.k for r in S.hash_sample(df, 123, key_cols=["k"]).collect())
    h = S.row_hash(["k"], S.SEED)
    brute = sorted(r.k for r in df.withColumn("h", h).orderBy("h", "k").limit(123).collect())
    assert ids == brute
    assert S.hash_sample(df, 10_000, key_cols=["k"]).count() == 5000


def test_splits_and_folds(spark):
    df = spark.range(0, 20000).select(F.col("id").alias("k"))
    sp = {r.split: r["count"] for r in S.train_val_test_split(df, ["k"]).groupBy("split").count().collect()}
    assert sum(sp.values()) == 20000 and sp["train"] > sp["val"] and sp["train"] > sp["test"]
    folds = S.assign_folds(df, 5, ["k"]).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3, 4]
    frac = S.fraction_sample(df, 0.2, ["k"]).count()
    assert 3000 < frac < 5000


def test_exact_quantiles_match_percentile(spark):
    from faresight.operators import quantiles as Q
    rows = [(i % 7, float((i * 37) % 1001) / 7.0, float(i % 13)) for i in range(3000)] + [(0, None, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    ref = df.agg(F.percentile("x", [0.1, 0.5, 0.9]).alias("x"),
                 F.percentile(F.when(~F.isnan("y"), F.col("y")), [0.1, 0.5, 0.9]).alias("y")).first()
    got = {r.column: (r.q0, r.q1, r.q2) for r in Q.quantile_table(df, ["x", "y"], [0.1, 0.5, 0.9], accuracy=50).collect()}
    for c in ["x", "y"]:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[c], ref[c]))
    gref = {r.g: tuple(r.p) for r in df.groupBy("g").agg(F.percentile("x", [0.1, 0.5, 0.9]).alias("p")).collect()}
    gg = {r.g: (r.q0, r.q1, r.q2) for r in Q.quantile_table(df, ["x"], [0.1, 0.5, 0.9], ["g"], accuracy=50).collect()}
    assert all(all(abs(a - b) < 1e-9 for a, b in zip(gg[k], gref[k])) for k in gref)


def test_hash_sample_is_uniform_over_every_key(spark):
    """The sample's mean of each key column lies within a few standard errors of the population's."""
    n, m = 20_000, 2_000
    df = spark.range(n).select(F.col("id").alias("a"), (F.col("id") % 97).alias("b"), (F.col("id") % 7).alias("c"))
    got = S.hash_sample(df, m, ["a", "b", "c"]).agg(*[F.avg(c).alias(c) for c in "abc"]).first()
    pop = df.agg(*[F.avg(c).alias(c) for c in "abc"], *[F.stddev_samp(c).alias(f"s{c}") for c in "abc"]).first()
    for c in "abc":
        assert abs(got[c] - pop[c]) < 4 * pop[f"s{c}"] / m ** 0.5


def test_row_hash_takes_huge_keys(spark):
    df = spark.createDataFrame([(10 ** 18,), (-10 ** 18,), (None,)], "k bigint")
    assert all(0 <= r.h < 2 ** 60 for r in df.select(S.row_hash(["k"], 1).alias("h")).collect())


def test_null_is_no_carrier(spark):
    from faresight.operators import profile as P
    df = spark.createDataFrame([(None, 1.0)] * 5 + [("X", 2.0)] * 3 + [("Y", 4.0)] * 2, "Carrier string, Average_Fare double")
    assert [r.Carrier for r in P.top_by_count(df, n=2).collect()] == ["X", "Y"]
    assert sorted(r.Carrier for r in P.carrier_fare_box(df, top=2).collect()) == ["X", "Y"]


def test_market_share_squares_do_not_overflow(spark):
    from faresight.sources.market import with_market_shares
    df = spark.createDataFrame([(1, "A", 4_000_000_000), (1, "B", 4_000_000_000)], "ODPairID int, Carrier string, Pax bigint")
    assert {r.Market_HHI for r in with_market_shares(df).collect()} == {5000.0}
