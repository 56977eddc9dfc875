import math

from pyspark.sql import functions as F

from faresight.operators import models as MD
from faresight.operators.sequences import flatten_sequences, route_sequences
from faresight.schema import BoostParams


def test_global_mean(sample_df):
    out = MD.predict_global_mean(sample_df, sample_df)
    mean = sample_df.agg(F.avg("Average_Fare")).first()[0]
    assert out.count() == 200
    assert all(abs(r[0] - mean) < 0.01 for r in out.select("prediction").collect())


def test_group_mean_with_fallback(sample_df):
    train = sample_df.filter("Carrier != 'AA'")
    out = MD.predict_group_mean(train, sample_df, "Carrier")
    vals = [r[0] for r in out.select("prediction").collect()]
    assert len(vals) == 200 and all(math.isfinite(v) for v in vals)


def test_ridge(sample_df, feature_cols):
    model = MD.fit_ridge(sample_df, feature_cols)
    vals = [r[0] for r in model.transform(sample_df).select("prediction").collect()]
    assert len(vals) == 200 and all(math.isfinite(v) for v in vals)


def test_ridge_matches_closed_form(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [10, 3]
    y = 5 + x @ [2.0, -1.0] + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    model = MD.fit_ridge(df, ["a", "b"], "y", alpha=5.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(2), xc.T @ yc)
    got = model.stages[-1].coefficients.toArray()
    assert np.allclose(got, w, rtol=1e-4)


def test_gbt_smoke(sample_df, feature_cols):
    train = sample_df.filter("rid < 150")
    test = sample_df.filter("rid >= 150")
    model = MD.fit_gbt(train, feature_cols, params=BoostParams(max_iter=10, max_depth=3))
    vals = [r[0] for r in model.transform(test).select("prediction").collect()]
    assert len(vals) == 50 and all(math.isfinite(v) for v in vals)
    imp = MD.importances(model, feature_cols, train, "gbt")
    assert imp.count() == len(feature_cols)
    assert MD.top_features(imp, 3).count() == 3


def test_unknown_model_rejected(sample_df, feature_cols):
    try:
        MD.fit_model("nope", sample_df, feature_cols)
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_sequences(sample_df, feature_cols):
    seqs = route_sequences(sample_df, feature_cols, ["rid"], seq_len=5)
    assert seqs.count() > 0
    row = seqs.first()
    assert len(row.features) == 5 and all(len(v) == len(feature_cols) for v in row.features)
    assert len(row.mask) == 5 and math.isfinite(row.target)
    sizes = {r.ODPairID: r.n for r in sample_df.groupBy("ODPairID").agg(F.count("*").alias("n")).collect()}
    for r in seqs.collect():
        assert sum(r.mask) == min(sizes[r.ODPairID], 5)
    flat = flatten_sequences(seqs, feature_cols)
    assert flat.count() == seqs.count() * 5


def test_sequences_edges(spark):
    df = spark.createDataFrame([(1, 1, float("nan"), 10.0), (1, 2, 2.0, 20.0), (1, 3, 3.0, 30.0),
                                (2, 4, 1.0, None)], "ODPairID bigint, rid bigint, x double, Average_Fare double")
    rows = route_sequences(df, ["x"], ["rid"], seq_len=2).collect()
    assert len(rows) == 1                                   # route 2 has a NULL mean target -> skipped
    r = rows[0]
    assert [v[0] for v in r.features] == [0.0, 2.0]         # NaN -> 0, truncated to seq_len in key order
    assert r.target == 20.0                                 # mean over all rows, not only the first seq_len


def test_permutation_importance_and_attributions(sample_df, feature_cols):
    model = MD.fit_gbt(sample_df, feature_cols, params=BoostParams(max_iter=5, max_depth=3))
    pi = MD.permutation_importance(model, sample_df, feature_cols, n_repeats=2, key_cols=["rid"])
    assert pi.count() == len(feature_cols)
    ridge = MD.fit_ridge(sample_df, feature_cols)
    att = MD.linear_attributions(ridge, sample_df, feature_cols)
    assert att.count() == len(feature_cols)
    assert all(r.mean_abs_attribution >= 0 for r in att.collect())
