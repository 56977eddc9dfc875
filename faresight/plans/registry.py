"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables (through the market view) and runs one
operator or job over all of it. Results are rounded to 6 decimals only here,
at the presentation edge, so that cross-engine comparison is stable; the
operators themselves keep full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faresight.functions.expressions import round_doubles
from faresight.operators import clean as C
from faresight.operators import features as FE
from faresight.sources.market import ROW_KEY, market, market_dirty

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def row_order() -> list:
    """The row key as one number, for "first" of a group."""
    return [F.col("l_orderkey") * 16 + F.col("l_linenumber")]



def register(name: str, rounded: bool = True):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df, 6) if rounded else df
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---------------------------------------------------------------- features
@register("route_features")
def q_route_features(spark, sf):
    """G1 + J1 + C11: route aggregates attached to every market row."""
    m = market(spark, sf)
    out = FE.build_route_features(m, order_cols=row_order())
    return out.select(*ROW_KEY, "ODPairID", "route_avg_fare", "route_std_fare",
                      "route_carrier_count", "route_total_pax", "route_avg_market_share",
                      "route_hhi", "route_competition_level")


@register("carrier_features")
def q_carrier_features(spark, sf):
    """G2 + J2: carrier aggregates (share of all passengers) on every row."""
    out = FE.build_carrier_features(market(spark, sf))
    return out.select(*ROW_KEY, "Carrier", "carrier_avg_fare", "carrier_route_count",
                      "carrier_avg_distance", "carrier_pax_share")


@register("market_features")
def q_market_features(spark, sf):
    """G3 + C9 + G4: fare per mile, circuity premium and hub flags."""
    out = FE.build_market_features(market(spark, sf))
    return out.select(*ROW_KEY, "fare_per_mile", "circuity_premium", "is_hub_origin", "is_hub_dest")


@register("hub_flags")
def q_hub_flags(spark, sf):
    """G4 + J5: airports at/above the 95th percentile of airport frequency."""
    m = market(spark, sf)
    out = FE.hub_flags(m)
    return out.groupBy("is_hub_origin", "is_hub_dest").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("OriginAirportID").alias("n_origins"),
        F.count_distinct("DestAirportID").alias("n_dests"))


@register("frequency_encode")
def q_frequency_encode(spark, sf):
    """G5 + J3: frequency encoding of the five id columns."""
    from faresight.schema import ID_COLUMNS
    out = FE.frequency_encode(market(spark, sf), ID_COLUMNS)
    return out.select(*ROW_KEY, *[f"{c}_freq_enc" for c in ID_COLUMNS])


@register("target_encode")
def q_target_encode(spark, sf):
    """G6 + J4 + S10: 5-fold out-of-fold smoothed target encoding of Carrier."""
    out = FE.target_encode_cv(market(spark, sf), "Carrier")
    return out.select(*ROW_KEY, "Carrier", "Carrier_target_enc")


@register("target_encode_unsmoothed")
def q_target_encode_unsmoothed(spark, sf):
    """The unsmoothed variant (plain other-fold mean, global-mean fallback)."""
    out = FE.target_encode_cv(market(spark, sf), "Carrier", smoothing=0.0)
    return out.select(*ROW_KEY, "Carrier", "Carrier_target_enc")


@register("route_mean_std")
def q_route_mean_std(spark, sf):
    """Route mean / std (single-row routes get std 0), joined back."""
    out = FE.route_mean_std(market(spark, sf))
    return out.select(*ROW_KEY, "ODPairID", "route_avg_fare", "route_std_fare")


@register("fare_per_mile_safe")
def q_fare_per_mile_safe(spark, sf):
    """Fare / miles with ±inf -> 0, on the damaged table (negative miles)."""
    out = FE.fare_per_mile_safe(market_dirty(spark, sf))
    return out.select(*ROW_KEY, "Average_Fare", "NonStopMiles", "fare_per_mile")


# ---------------------------------------------------------------- cleaning
def _dirty_table(spark, sf):
    """Damaged market rows without the row key (as raw files would hold)."""
    return market_dirty(spark, sf).drop(*ROW_KEY)


@register("validate_market")
def q_validate_market(spark, sf):
    """Validation counters and issue list on the damaged table."""
    v = C.validate(_dirty_table(spark, sf))
    return v.withColumn("issues", F.concat_ws("; ", "issues"))


@register("clean_market", rounded=False)
def q_clean_market(spark, sf):
    """Drop encodings, drop bad targets/distances, de-dup, narrow types."""
    return C.clean(_dirty_table(spark, sf))


@register("clean_strict")
def q_clean_strict(spark, sf):
    """Strict cleaning (fare >= 1, miles > 0, no NULL target, de-dup)."""
    return C.clean_strict(_dirty_table(spark, sf))


@register("downcast", rounded=False)
def q_downcast(spark, sf):
    """float64 -> float32, int64 -> int32 where the range fits."""
    return C.downcast(market(spark, sf, with_key=False))


@register("dedup")
def q_dedup(spark, sf):
    """Exact duplicate removal over all columns."""
    return _dirty_table(spark, sf).distinct()


@register("build_features")
def q_build_features(spark, sf):
    """The full feature chain on the market table (flagship)."""
    from faresight.plans.jobs import build_features
    return build_features(market(spark, sf), order_cols=row_order())


# ---------------------------------------------------------------- profiling / EDA
from faresight.operators import profile as P  # noqa: E402


@register("profile_columns")
def q_profile_columns(spark, sf):
    """B1: per-column dtype, counts and numeric stats of the raw (damaged) table."""
    return P.profile_columns(_dirty_table(spark, sf))


@register("null_counts")
def q_null_counts(spark, sf):
    """B2: full-scan null count per column."""
    return P.null_counts(_dirty_table(spark, sf))


@register("null_counts_head")
def q_null_counts_head(spark, sf):
    """Null counts over the first 1000 rows in row-key order."""
    return P.null_counts_head(market_dirty(spark, sf), ROW_KEY, 1000)


@register("missing_pct")
def q_missing_pct(spark, sf):
    """Percent missing for the columns that have NULLs."""
    return P.missing_pct(_dirty_table(spark, sf))


@register("describe_numeric")
def q_describe_numeric(spark, sf):
    """describe() of every numeric market column."""
    return P.describe(market(spark, sf, with_key=False))


@register("cardinality_top")
def q_cardinality_top(spark, sf):
    """20 columns with the most distinct values (NULL counts as one)."""
    return P.cardinality(market(spark, sf, with_key=False), top=20)


@register("cardinality_approx")
def q_cardinality_approx(spark, sf):
    """B6 (bounded-memory variant): HyperLogLog distinct counts."""
    return P.cardinality(market(spark, sf, with_key=False), top=20, approx=True)


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    """Pearson matrix of the 8 numeric features and the target."""
    return P.correlation_matrix(market(spark, sf))


@register("fare_histogram")
def q_fare_histogram(spark, sf):
    """100-bin fare histogram."""
    return P.histogram(market(spark, sf), "Average_Fare", 100)


@register("log_histogram")
def q_log_histogram(spark, sf):
    """G11 + C13: 100-bin histogram of log1p(fare)."""
    return P.histogram(market(spark, sf), P.log_target(), 100)


@register("hhi_histogram")
def q_hhi_histogram(spark, sf):
    """50-bin HHI histogram."""
    return P.histogram(market(spark, sf), "Market_HHI", 50)


@register("hhi_concentration")
def q_hhi_concentration(spark, sf):
    """Rows and routes above the HHI 2500 marker."""
    return P.hhi_concentration(market(spark, sf))


@register("carrier_fare_box")
def q_carrier_fare_box(spark, sf):
    """G13 + S2 + J6: fare box stats of the 15 most frequent carriers."""
    return P.carrier_fare_box(market(spark, sf))


@register("binary_fare_box")
def q_binary_fare_box(spark, sf):
    """Fare box stats by each binary flag."""
    return P.binary_fare_box(market(spark, sf))


@register("overview_metrics")
def q_overview_metrics(spark, sf):
    """Headline metric cards."""
    return P.overview_metrics(market(spark, sf))


@register("top_routes")
def q_top_routes(spark, sf):
    """Top 20 routes by mean fare with at least 10 records."""
    return P.top_routes(market(spark, sf))


@register("top_carriers")
def q_top_carriers(spark, sf):
    """15 most frequent carriers."""
    return P.top_by_count(market(spark, sf), "Carrier", 15)


@register("preview")
def q_preview(spark, sf):
    """First 100 rows in row-key order."""
    return P.preview(market(spark, sf), ROW_KEY, 100)


# ---------------------------------------------------------------- sampling / splits
from faresight.operators import sampling as S  # noqa: E402


@register("hash_sample")
def q_hash_sample(spark, sf):
    """Seeded uniform sample of exactly 10,000 rows (hash order)."""
    return S.hash_sample(market(spark, sf), 10_000, order_cols=ROW_KEY)


@register("fraction_sample")
def q_fraction_sample(spark, sf):
    """Seeded 20 % sample by hash bucket."""
    return S.fraction_sample(market(spark, sf), 0.2)


@register("train_val_test_split")
def q_train_val_test_split(spark, sf):
    """70/15/15 split label per row."""
    return S.train_val_test_split(market(spark, sf)).select(*ROW_KEY, "split")


@register("fold_assignment")
def q_fold_assignment(spark, sf):
    """5-fold id per row."""
    return S.assign_folds(market(spark, sf)).select(*ROW_KEY, "fold")


# ---------------------------------------------------------------- scenarios / exports
from faresight.operators import scenarios as R  # noqa: E402


@register("revenue_scenarios")
def q_revenue_scenarios(spark, sf):
    """Seven price scenarios per route at elasticity -1.2."""
    return R.revenue_scenarios(market(spark, sf))


@register("revenue_ranking")
def q_revenue_ranking(spark, sf):
    """Every route, ranked by uplift of its best scenario."""
    return R.revenue_ranking(R.revenue_scenarios(market(spark, sf)))


@register("price_grid")
def q_price_grid(spark, sf):
    """-20 %..+20 % grid in 5 % steps for every route."""
    return R.price_grid(market(spark, sf))


@register("route_scenarios")
def q_route_scenarios(spark, sf):
    """Scenarios of the route with the largest demand."""
    return R.route_scenarios(R.revenue_scenarios(market(spark, sf)))


@register("route_summary")
def q_route_summary(spark, sf):
    """G9 + S4: per-route summary export, sorted by total passengers."""
    from faresight.operators.exports import route_summary
    return route_summary(market(spark, sf), order_cols=row_order())


# ---------------------------------------------------------------- sequences
from faresight.operators import sequences as L  # noqa: E402
from faresight.schema import MODEL_FEATURES  # noqa: E402


@register("route_sequences")
def q_route_sequences(spark, sf):
    """L1: per-route padded sequences (seq_len 10), flattened per position."""
    seqs = L.route_sequences(market(spark, sf), MODEL_FEATURES, ROW_KEY, seq_len=10)
    return L.flatten_sequences(seqs, MODEL_FEATURES)


@register("route_sequences_nested", rounded=False)
def q_route_sequences_nested(spark, sf):
    """L1 in its model-input shape: features (seq_len x 13), mask, target."""
    return L.route_sequences(market(spark, sf), MODEL_FEATURES, ROW_KEY, seq_len=10)


# ---------------------------------------------------------------- baselines / metrics
from faresight.operators import metrics as MT  # noqa: E402
from faresight.operators import models as MD  # noqa: E402


def _split(spark, sf):
    return S.train_val_test_split(market(spark, sf))


def _baseline_preds(spark, sf, kind: str):
    df = _split(spark, sf)
    train = df.filter(F.col("split") == "train")
    test = df.filter(F.col("split") == "test")
    if kind == "global_mean":
        p = MD.predict_global_mean(train, test)
    else:
        p = MD.predict_group_mean(train, test, kind)
    return p.select(*ROW_KEY, F.col("Average_Fare").alias("y"), "prediction")


@register("baseline_global_mean")
def q_baseline_global_mean(spark, sf):
    """M1: train-split mean fare predicted for every test row."""
    return _baseline_preds(spark, sf, "global_mean")


@register("baseline_carrier_mean")
def q_baseline_carrier_mean(spark, sf):
    """M2: per-carrier train mean, global-mean fallback."""
    return _baseline_preds(spark, sf, "Carrier")


@register("baseline_route_mean")
def q_baseline_route_mean(spark, sf):
    """M2: per-route train mean, global-mean fallback."""
    return _baseline_preds(spark, sf, "ODPairID")


def _baseline_long(spark, sf):
    df = _split(spark, sf)
    return MD.stacked_baselines(df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test"), ROW_KEY,
                                {"carrier_mean": "Carrier", "route_mean": "ODPairID"})


@register("regression_metrics")
def q_regression_metrics(spark, sf):
    """M5: MAE, RMSE, MAPE, SMAPE, R² per baseline on the test split."""
    return MT.regression_metrics(_baseline_long(spark, sf), "y", "prediction", ["model"])


@register("model_comparison")
def q_model_comparison(spark, sf):
    """M6: metrics ranked by RMSE with best-per-metric flags."""
    return MT.compare_models(MT.regression_metrics(_baseline_long(spark, sf), "y", "prediction", ["model"]))


# ---------------------------------------------------------------- pyspark.ml models
from faresight.operators import boosting as BO  # noqa: E402
from faresight.operators.target_stats import ordered_target_statistic  # noqa: E402
from faresight.schema import LEAF_WISE, SEED, SYMMETRIC, BoostParams  # noqa: E402

# The library defaults: up to 1000 rounds, patience of 50 rounds on the validation split.
QUERY_BOOST = BoostParams()
_MODELS: dict[tuple, object] = {}


def _fitted(spark, sf, name: str):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MODELS:
        df = _split(spark, sf)
        if name == "ridge":
            train = df.filter(F.col("split") == "train")
            _MODELS[key] = MD.fit_ridge(train, MODEL_FEATURES)
        else:
            tv = df.filter(F.col("split") != "test").withColumn("_is_val", F.col("split") == "val")
            _MODELS[key] = MD.fit_gbt(tv, MODEL_FEATURES, params=QUERY_BOOST, validation_col="_is_val")
    return _MODELS[key]


def _model_preds(spark, sf, name: str):
    test = _split(spark, sf).filter(F.col("split") == "test")
    return (_fitted(spark, sf, name).transform(test)
            .select(*ROW_KEY, F.col("Average_Fare").alias("y"), "prediction"))


@register("ridge")
def q_ridge(spark, sf):
    """M3: ridge regression (alpha 1) on the 13 features; test predictions."""
    return _model_preds(spark, sf, "ridge")


@register("gbt")
def q_gbt(spark, sf):
    """M4: boosted regression trees (depth 6, lr 0.05, subsample 0.8, patience 50); test predictions."""
    return _model_preds(spark, sf, "gbt")


@register("model_metrics")
def q_model_metrics(spark, sf):
    """M5 + M6 over all five models (three baselines, ridge, trees) on the test split."""
    preds = _baseline_long(spark, sf)
    for name in ["ridge", "gbt"]:
        preds = preds.unionByName(_model_preds(spark, sf, name).withColumn("model", F.lit(name)))
    return MT.compare_models(MT.regression_metrics(preds, "y", "prediction", ["model"]))


def _importances(spark, sf):
    train = _split(spark, sf).filter(F.col("split") == "train")
    imp = MD.importances(_fitted(spark, sf, "gbt"), MODEL_FEATURES, train, "gbt")
    return imp.unionByName(MD.importances(_fitted(spark, sf, "ridge"), MODEL_FEATURES, train, "ridge"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    """M8: shares in the gain of all splits and ridge standardized |coefficients|."""
    return _importances(spark, sf)


@register("top_features")
def q_top_features(spark, sf):
    """S3: top 5 features per model."""
    return MD.top_features(_importances(spark, sf), 5)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """M9: permutation importance of the trees on all test rows, 5 repeats."""
    test = _split(spark, sf).filter(F.col("split") == "test")
    return MD.permutation_importance(_fitted(spark, sf, "gbt"), test, MODEL_FEATURES)


@register("linear_attributions")
def q_linear_attributions(spark, sf):
    """Closed-form additive attributions of the ridge model on the test split."""
    test = _split(spark, sf).filter(F.col("split") == "test")
    return MD.linear_attributions(_fitted(spark, sf, "ridge"), test, MODEL_FEATURES)


@register("gbt_curve")
def q_gbt_curve(spark, sf):
    """M4: train and validation error after every round, and which rounds the model keeps."""
    return _fitted(spark, sf, "gbt").curve(spark)


@register("tree_attributions")
def q_tree_attributions(spark, sf):
    """Exact additive attributions of the boosted trees on the test split, mean size per feature."""
    test = _split(spark, sf).filter(F.col("split") == "test")
    return MD.tree_attributions(_fitted(spark, sf, "gbt"), test)


FIRST_SPLIT_BINS = 32


@register("boost_first_split")
def q_boost_first_split(spark, sf):
    """M4: the split of the first tree's root over bins of equal width, all rows and features;
    the gain as a share of the squared error."""
    train = _split(spark, sf).filter(F.col("split") == "train")
    s, edges, total = BO.first_split(train, MODEL_FEATURES, "Average_Fare", FIRST_SPLIT_BINS, QUERY_BOOST)
    row = (MODEL_FEATURES[s.feature], float(edges[s.feature][s.at]), int(s.left[1]), int(s.right[1]), 2 * s.gain / total)
    return spark.createDataFrame([row], "feature string, threshold double, left_rows bigint, right_rows bigint, gain_share double")


def _one_tree(spark, sf, params):
    import dataclasses
    p = dataclasses.replace(params, max_iter=1, step_size=1.0, subsampling_rate=1.0, feature_subset="1.0")
    train = _split(spark, sf).filter(F.col("split") == "train")
    return BO.fit_boosted(train, MODEL_FEATURES, "Average_Fare", p).tree_table(spark)


@register("leafwise_tree")
def q_leafwise_tree(spark, sf):
    """M4: the nodes of one tree grown best first to 63 leaves."""
    return _one_tree(spark, sf, LEAF_WISE)


@register("symmetric_tree")
def q_symmetric_tree(spark, sf):
    """M4: the nodes of one symmetric tree (one split per level)."""
    return _one_tree(spark, sf, SYMMETRIC)


@register("ordered_target_stat")
def q_ordered_target_stat(spark, sf):
    """M4: each row's carrier encoded by the fares of the rows before it in a seeded order."""
    out = ordered_target_statistic(market(spark, sf), "Carrier", "Average_Fare", FE.FOLD_KEY, seed=SEED)
    return out.select(*ROW_KEY, "Carrier_ordered_te")


# ---------------------------------------------------------------- sources / sinks
from faresight.schema import MARKET_SCHEMA  # noqa: E402
from faresight.operators import file_profile as FP  # noqa: E402
from faresight.session import scratch_path, shuffles_freed  # noqa: E402
from faresight.sources import files as FS  # noqa: E402

def _files(df, least: int) -> int:
    """How many files to write a table as: ``least``, or a file for each part of its scan once there are more."""
    return max(least, df.rdd.getNumPartitions())


def _keyed_schema():
    from pyspark.sql import types as T
    key = [T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
           T.StructField("l_partkey", T.LongType()), T.StructField("l_suppkey", T.LongType()),
           T.StructField("l_shipdate", T.TimestampNTZType())]
    return T.StructType(key + MARKET_SCHEMA.fields)


@register("scan_csv")
def q_scan_csv(spark, sf):
    """A1: the market table written as CSV, scanned back with a declared schema."""
    path = scratch_path(spark, "market-csv")
    FS.write_csv(market(spark, sf), path)
    return FS.read_csv(spark, path, _keyed_schema())


@register("concat_files")
def q_concat_files(spark, sf):
    """A2 + U1: two CSV inputs (round-trip / one-way rows) concatenated by name."""
    m = market(spark, sf)
    a, b = scratch_path(spark, "part-rt"), scratch_path(spark, "part-ow")
    FS.write_csv(m.filter(F.col("RoundTrip") == 1), a, compression="gzip")
    FS.write_csv(m.filter(F.col("RoundTrip") != 1), b, compression="gzip")
    return FS.concat_files(spark, [a, b]).select(*[F.col(f.name).cast(f.dataType) for f in _keyed_schema().fields])


@register("concat_files_drift")
def q_concat_files_drift(spark, sf):
    """A2 + U1: many CSV files of two layouts (other columns, other order), matched by name in one scan."""
    m = market(spark, sf)
    n = _files(m, 6)
    a, b = scratch_path(spark, "drift-rt"), scratch_path(spark, "drift-ow")
    FS.write_csv(m.filter(F.col("RoundTrip") == 1).drop("Slot").repartition(n), a)
    FS.write_csv(m.filter(F.col("RoundTrip") != 1).select(*reversed(m.columns)).drop("Circuity").repartition(n), b)
    return FS.concat_files(spark, [a, b]).select(*[F.col(f.name).cast(f.dataType) for f in _keyed_schema().fields])


@register("ingest_validated")
def q_ingest_validated(spark, sf):
    """C1 within the write: the record observed while the cleaned table is written (one scan of the raw files)."""
    from faresight.plans.jobs import ingest_validated
    raw, out = scratch_path(spark, "raw-parquet"), scratch_path(spark, "validated")
    FS.write_parquet(_dirty_table(spark, sf), raw)
    record = ingest_validated(spark.read.parquet(raw), out)
    return record.withColumn("issues", F.concat_ws("; ", "issues"))


@register("row_count")
def q_row_count(spark, sf):
    """A5: row count of the market table."""
    return FS.row_count(market(spark, sf))


@register("parquet_roundtrip")
def q_parquet_roundtrip(spark, sf):
    """A6 + A7: snappy Parquet write of the cleaned table, read back."""
    path = scratch_path(spark, "clean-parquet")
    FS.write_parquet(C.clean(_dirty_table(spark, sf), narrow=False), path)
    return spark.read.parquet(path)


@register("csv_export")
def q_csv_export(spark, sf):
    """A8 + R6: revenue scenarios exported as CSV and read back."""
    path = scratch_path(spark, "scenarios-csv")
    scen = R.revenue_scenarios(market(spark, sf))
    FS.write_csv(scen, path, compression="gzip")
    return FS.read_csv(spark, path, scen.schema)


@register("incremental_ingest")
def q_incremental_ingest(spark, sf):
    """A4: CSV files ingested as bounded micro-batches (availableNow), read back."""
    from faresight.streaming.ingest import ingest_csv_stream
    src = scratch_path(spark, "ingest-src")
    m = market(spark, sf)
    files = _files(m, 6)
    with shuffles_freed(spark):   # a scan of as many parts needs no shuffle; files stay unpacked, as a batch has two and splits them
        FS.write_csv(m if files == m.rdd.getNumPartitions() else m.repartition(files), src)
    out = ingest_csv_stream(spark, src, _keyed_schema(), scratch_path(spark, "ingest-table"),
                            scratch_path(spark, "ingest-ckpt"), max_files_per_trigger=2)
    return spark.read.parquet(out["table"]).drop("batch_id")


@register("json_metrics_union")
def q_json_metrics_union(spark, sf):
    """A10 + A11: per-model metric JSON files written and unioned back."""
    mets = MT.regression_metrics(_baseline_long(spark, sf), "y", "prediction", ["model"])
    long = mets.select("model", F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in MT.METRIC_NAMES]),
        F.array(*[F.col(m).cast("double") for m in MT.METRIC_NAMES]))).alias("metric", "value"))
    path = scratch_path(spark, "metrics-json")
    FS.write_json_maps(long, path, "model", "metric", "value")
    return FS.read_json_maps(spark, path, "model", "metric", "value")


@register("importance_export")
def q_importance_export(spark, sf):
    """Importances written as one JSON map per model, read back and exported as CSV."""
    path = scratch_path(spark, "importance-json")
    FS.write_json_maps(_importances(spark, sf), path, "model", "feature", "importance")
    back = FS.read_json_maps(spark, path)
    out = scratch_path(spark, "importance-csv")
    FS.write_csv(back, out, single_file=True)
    return FS.read_csv(spark, out, back.schema)


@register("file_manifest")
def q_file_manifest(spark, sf):
    """Manifest of the input folder from file metadata: a row per file and one for all."""
    return FS.file_manifest(spark, sf, "market-source")


@register("eda_bundle")
def q_eda_bundle(spark, sf):
    """All EDA reports written as CSV; returns their file manifest per report."""
    from faresight.plans.jobs import run_eda
    out = scratch_path(spark, "eda")
    run_eda(market(spark, sf), out)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out)
                  .where(F.col("path").endswith(".csv")).select("path", "length"))
    return files.groupBy(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("report")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


@register("export_bundle")
def q_export_bundle(spark, sf):
    """Route summary, importances and scenarios exported; the route
    summary export read back."""
    from faresight.plans.jobs import export_all
    out = scratch_path(spark, "exports")
    m = market(spark, sf)
    export_all(m, out, _importances(spark, sf), R.revenue_scenarios(m), order_cols=row_order())
    from faresight.operators.exports import route_summary
    return FS.read_csv(spark, f"{out}/route_summary", route_summary(m).schema)


def _market_files(spark, sf):
    """The damaged market as CSV text files, one folder per line number.

    Each task writes its rows to the folders as it reads them: nothing is shuffled or sorted, and as a folder holds a packed
    file of every task, reading spreads as writing does."""
    path = scratch_path(spark, "market-by-line")
    FS.write_csv_folders(market_dirty(spark, sf).withColumn("line", F.col("l_linenumber")), path, "line", compression="gzip")
    return spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)


@register("file_profiles")
def q_file_profiles(spark, sf):
    """B1: type, nulls and numeric statistics of every column of every line number's files: each file profiled, then merged."""
    cols = [f.name for f in MARKET_SCHEMA.fields]
    rows = FP.profile_files(_market_files(spark, sf), cols)
    rows = rows.withColumn("line", F.regexp_extract("path", "line=([0-9]+)", 1).cast("int"))
    return FP.merge_profiles(rows, ["line"]).select("line", "column", "dtype", "row_count", "null_count", "mean", "std", "min", "max")


@register("file_profiles_merged")
def q_file_profiles_merged(spark, sf):
    """B1: the profile of all files from the stored rows of each (sketches left out: they are estimates)."""
    cols = [f.name for f in MARKET_SCHEMA.fields]
    store = scratch_path(spark, "profile-store")
    FP.profile_files(_market_files(spark, sf), cols).write.parquet(store)
    return FP.merge_profiles(spark.read.parquet(store)).select("column", "dtype", "row_count", "null_count", "mean", "std", "min", "max")


@register("describe_all")
def q_describe_all(spark, sf):
    """Describe of every column; text columns have counts and extremes."""
    return P.describe_all(market_dirty(spark, sf).select(*[f.name for f in MARKET_SCHEMA.fields]))


@register("file_profile", rounded=False)
def q_file_profile(spark, sf):
    """B1 (per-file part): the market table as several CSV files; per file
    its name, size, rows and columns."""
    path = scratch_path(spark, "market-files")
    m = market(spark, sf)
    FS.write_csv(m.repartition(_files(m, 4)), path)
    return FS.file_summary(FS.read_csv(spark, path, _keyed_schema()), path)


# ---------------------------------------------------------------- further parameters of the operators above
@register("split_80_20")
def q_split_80_20(spark, sf):
    """80/20 split label per row."""
    out = S.train_val_test_split(market(spark, sf), ratios=(0.8, 0.0, 0.2))
    return out.select(*ROW_KEY, "split")


@register("scenarios_carrier_demand")
def q_scenarios_carrier_demand(spark, sf):
    """R2: the price scenarios with the carrier's passengers as demand."""
    return R.revenue_scenarios(market(spark, sf), demand="CarrierPax")


@register("scan_csv_recursive")
def q_scan_csv_recursive(spark, sf):
    """A3: CSV files in nested folders scanned as one table."""
    path = scratch_path(spark, "market-nested")
    m = market(spark, sf)
    FS.write_csv(m.filter(F.col("RoundTrip") == 1), f"{path}/a", compression="gzip")
    FS.write_csv(m.filter(F.col("RoundTrip") != 1), f"{path}/b/c", compression="gzip")
    return FS.read_csv(spark, path, _keyed_schema(), recursive=True)


@register("preview_routes")
def q_preview_routes(spark, sf):
    """The first 50 distinct routes."""
    return market(spark, sf).select("ODPairID").distinct().orderBy("ODPairID").limit(50)
