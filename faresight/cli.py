"""Command-line verbs over the job functions (``python -m faresight <verb>``
locally, or the same module through ``spark-submit`` on a cluster).

Verbs: ``inspect``, ``build-parquet``, ``build-features``, ``eda``,
``train``, ``compare``, ``explain``, ``export``, ``revenue-sim``. Inputs and
outputs are paths (local, HDFS or object store); every verb is one or a few
Spark jobs, and only small summaries are printed.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faresight.schema import MARKET_SCHEMA, MODEL_FEATURES, SEED, SPLIT_RATIOS, TARGET, Settings

ROW_HASH = "_row_hash"


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        from faresight.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(active)
        return active
    from faresight.session import build_session
    return build_session(master="local[*]")


def row_hash_column(columns, seed: int = SEED) -> F.Column:
    """63 bits of a seeded hash over all columns, non-negative."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).bitwiseAND(F.lit((1 << 63) - 1))


def with_row_hash(df: DataFrame, seed: int = SEED) -> DataFrame:
    """A deterministic per-row hash over all columns, for tables that carry
    no row key (splits and folds need one)."""
    return df.withColumn(ROW_HASH, row_hash_column(df.columns, seed))


def split_frame(df: DataFrame, seed: int = SEED, ratios=SPLIT_RATIOS) -> DataFrame:
    from faresight.operators.sampling import train_val_test_split
    return train_val_test_split(with_row_hash(df, seed), [ROW_HASH], ratios, seed)


def cmd_inspect(a, spark):
    from faresight.operators.profile import profile_columns
    from faresight.sources.files import file_summary, read_csv
    df = read_csv(spark, a.input, None, recursive=True)
    for r in file_summary(df, a.input).orderBy("path").collect():
        print(r.file_name, r.size_mb, "MB", r.row_count, "rows", r.column_count, "columns")
    prof = profile_columns(df)
    prof.coalesce(1).write.mode("overwrite").json(a.output)
    for r in spark.read.json(a.output).select("column", "dtype", "row_count", "null_count").collect():
        print(r.column, r.dtype, r.row_count, r.null_count)


def cmd_build_parquet(a, spark):
    from faresight.plans.jobs import ingest
    from faresight.sources.files import read_csv
    df = read_csv(spark, a.input, None if a.infer else MARKET_SCHEMA, recursive=True)
    ingest(df, a.output, a.report, a.target, mode="overwrite" if a.overwrite else "ignore")
    print(a.output)


def cmd_build_features(a, spark):
    from faresight.plans.jobs import build_features, write_parquet
    df = with_row_hash(spark.read.parquet(a.input))
    out = build_features(df, target=a.target, key_cols=[ROW_HASH]).drop(ROW_HASH)
    write_parquet(out, a.output, mode="overwrite" if a.overwrite else "ignore")
    print(a.output)


def cmd_eda(a, spark):
    from faresight.plans.jobs import run_eda
    for p in run_eda(spark.read.parquet(a.input), a.output, a.target):
        print(p)


def _fit_and_score(name, df, features, target):
    from faresight.operators import models as MD
    from faresight.operators.metrics import regression_metrics
    train = df.filter(F.col("split") == "train")
    test = df.filter(F.col("split") == "test")
    model = None
    if name == "global_mean":
        pred = MD.predict_global_mean(train, test, target)
    elif name in ("carrier_mean", "route_mean"):
        pred = MD.predict_group_mean(train, test, "Carrier" if name == "carrier_mean" else "ODPairID", target)
    else:
        fit_on = df.filter(F.col("split") != "test").withColumn("_is_val", F.col("split") == "val")
        kw = {"validation_col": "_is_val"} if name == "gbt" else {}
        model = MD.fit_model(name, fit_on if name == "gbt" else train, features, target, **kw)
        pred = model.transform(test)
    mets = regression_metrics(pred.select(F.col(target).alias("y"), "prediction"), group_cols=[]).first()
    return model, {k: mets[k] for k in ["mae", "rmse", "mape", "smape", "r2"]}, train


def cmd_train(a, spark):
    from faresight.operators import models as MD
    df = split_frame(spark.read.parquet(a.input), a.seed)
    features = a.features.split(",") if a.features else [c for c in MODEL_FEATURES if c in df.columns]
    model, mets, train = _fit_and_score(a.model, df, features, a.target)
    rows = [(a.model, json.dumps(mets))]
    if model is not None:
        model.write().overwrite().save(f"{a.output}/{a.model}_model")
        imp = MD.importances(model, features, train, a.model)
        rows.append((f"{a.model}_importance", json.dumps({r.feature: r.importance for r in imp.collect()})))
    # each model replaces only its own report partitions
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite") \
         .option("partitionOverwriteMode", "dynamic").partitionBy("name").text(f"{a.output}/reports")
    print(json.dumps({"model": a.model, **mets}))


def _reports(spark, models_dir: str, suffix: str) -> DataFrame:
    from faresight.sources.files import read_json_maps
    raw = read_json_maps(spark, f"{models_dir}/reports", "name", "key", "value")
    if suffix:
        return raw.filter(F.col("name").endswith(suffix)) \
                  .withColumn("name", F.regexp_replace("name", suffix + "$", ""))
    return raw.filter(~F.col("name").endswith("_importance"))


def cmd_compare(a, spark):
    from faresight.operators.metrics import compare_models
    long = _reports(spark, a.models_dir, "")
    wide = long.groupBy(F.col("name").alias("model")).pivot("key", ["mae", "rmse", "mape", "smape", "r2"]) \
               .agg(F.first("value"))
    for r in compare_models(wide).orderBy("rank_rmse").collect():
        print(r.model, round(r.rmse, 4), round(r.mae, 4), round(r.r2, 4))


def cmd_explain(a, spark):
    from faresight.operators.models import top_features
    imp = _reports(spark, a.models_dir, "_importance").select(
        F.col("name").alias("model"), F.col("key").alias("feature"), F.col("value").alias("importance"))
    for r in top_features(imp, a.top).orderBy("model", "rank").collect():
        print(r.model, r.rank, r.feature, round(r.importance, 6))


def cmd_export(a, spark):
    from faresight.plans.jobs import export_all
    imp = None
    if a.models_dir:
        imp = _reports(spark, a.models_dir, "_importance").select(
            F.col("name").alias("model"), F.col("key").alias("feature"), F.col("value").alias("importance"))
    scen = spark.read.parquet(a.scenarios) if a.scenarios else None
    for p in export_all(spark.read.parquet(a.input), a.output, imp, scen):
        print(p)


def cmd_revenue_sim(a, spark):
    from faresight.operators.scenarios import revenue_ranking, revenue_scenarios
    s = Settings()
    scen = revenue_scenarios(spark.read.parquet(a.input), a.elasticity, s.price_scenarios,
                             demand=a.demand_column, target=a.target)
    scen.write.mode("overwrite").parquet(f"{a.output}/scenarios")
    scen = spark.read.parquet(f"{a.output}/scenarios")
    rank = revenue_ranking(scen, a.top)
    rank.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output}/ranking")
    for r in rank.collect():
        print(r.ODPairID, r.best_price_change, round(r.uplift, 2))


def parser() -> argparse.ArgumentParser:
    s = Settings()
    p = argparse.ArgumentParser(prog="faresight")
    sub = p.add_subparsers(dest="verb", required=True)

    def add(name, fn, *args):
        sp = sub.add_parser(name)
        sp.set_defaults(fn=fn)
        sp.add_argument("--target", default=s.target)
        for arg in args:
            sp.add_argument(arg[0], **arg[1])
        return sp

    req = {"required": True}
    add("inspect", cmd_inspect, ("--input", req), ("--output", req))
    add("build-parquet", cmd_build_parquet, ("--input", req), ("--output", req), ("--report", {}),
        ("--infer", {"action": "store_true"}), ("--overwrite", {"action": "store_true"}))
    add("build-features", cmd_build_features, ("--input", req), ("--output", req),
        ("--overwrite", {"action": "store_true"}))
    add("eda", cmd_eda, ("--input", req), ("--output", req))
    add("train", cmd_train, ("--input", req), ("--output", req),
        ("--model", {"default": "gbt", "choices": ["global_mean", "carrier_mean", "route_mean", "ridge", "gbt"]}),
        ("--features", {}), ("--seed", {"type": int, "default": s.seed}))
    add("compare", cmd_compare, ("--models-dir", req))
    add("explain", cmd_explain, ("--models-dir", req), ("--top", {"type": int, "default": 20}))
    add("export", cmd_export, ("--input", req), ("--output", req), ("--models-dir", {}), ("--scenarios", {}))
    add("revenue-sim", cmd_revenue_sim, ("--input", req), ("--output", req),
        ("--elasticity", {"type": float, "default": s.elasticity}),
        ("--demand-column", {"default": s.demand_column}), ("--top", {"type": int, "default": 20}))
    return p


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    a.fn(a, _session())
    return 0


if __name__ == "__main__":
    sys.exit(main())
