"""Baselines and ``pyspark.ml`` models, with explanation helpers.

Baselines are aggregates joined back (global / group means fitted on the
train split, global-mean fallback for unseen groups). Linear models are
``pyspark.ml`` estimators over a ``VectorAssembler``; boosted trees come
from ``boosting``. Explanations stay distributed too:
permutation importance scores every (feature, repeat) permutation in one
batch job, and linear attributions are a closed-form projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.functions.expressions import portable_bucket
from faresight.operators.boosting import BoostedModel, fit_boosted
from faresight.operators.features import FOLD_KEY
from faresight.operators.metrics import regression_metrics
from faresight.schema import RIDGE_ALPHA, SEED, TARGET, BoostParams


# ---------------------------------------------------------------- baselines
def predict_global_mean(train: DataFrame, df: DataFrame, target: str = TARGET,
                        out: str = "prediction") -> DataFrame:
    g = train.select(F.avg(target)).scalar()
    return df.withColumn(out, g)


def predict_group_mean(train: DataFrame, df: DataFrame, group_col: str, target: str = TARGET,
                       out: str = "prediction") -> DataFrame:
    g = train.select(F.avg(target)).scalar()
    means = train.groupBy(group_col).agg(F.avg(target).alias("_gm")).filter(F.col(group_col).isNotNull())
    return df.join(means, group_col, "left").withColumn(out, F.coalesce(F.col("_gm"), g)).drop("_gm")


# ---------------------------------------------------------------- pyspark.ml
def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def ridge_reg_param(train: DataFrame, target: str, alpha: float) -> float:
    """Spark's objective scales the penalty by n and the label std; this
    makes ``regParam`` equivalent to ``||y - Xw||² + alpha·||w||²``."""
    row = train.agg(F.count(target).alias("n"), F.stddev_samp(target).alias("s")).first()
    n, s = row["n"], row["s"]
    if not n or not s:
        return 0.0
    return float(alpha) * float(s) / float(n)


def fit_ridge(train: DataFrame, features: Sequence[str], target: str = TARGET,
              alpha: float = RIDGE_ALPHA, elastic_net: float = 0.0) -> PipelineModel:
    lr = LinearRegression(featuresCol="features", labelCol=target, predictionCol="prediction",
                          regParam=ridge_reg_param(train, target, alpha), elasticNetParam=elastic_net,
                          standardization=False, solver="normal" if elastic_net == 0 else "auto")
    return Pipeline(stages=[assembler(features), lr]).fit(train.filter(F.col(target).isNotNull()))


def fit_gbt(train: DataFrame, features: Sequence[str], target: str = TARGET, params: BoostParams = BoostParams(),
            validation_col: str | None = None) -> BoostedModel:
    """Boosted regression trees (depth or leaves, learning rate, row and feature sampling from ``params``). With
    ``validation_col``, boosting ends after ``params.patience`` rounds without a better validation error, and the model
    keeps the trees up to the best round."""
    return fit_boosted(train, features, target, params, validation_col)


MODEL_FACTORIES: dict[str, Callable] = {
    "ridge": fit_ridge,
    "gbt": fit_gbt,
}


def fit_model(name: str, train: DataFrame, features: Sequence[str], target: str = TARGET, **kw):
    """Model dispatch by name; unknown names raise ``ValueError``."""
    if name not in MODEL_FACTORIES:
        raise ValueError(f"unknown model {name!r}; choose from {sorted(MODEL_FACTORIES)}")
    return MODEL_FACTORIES[name](train, features, target, **kw)


def importances(model: PipelineModel | BoostedModel, features: Sequence[str], train: DataFrame | None = None,
                model_name: str = "model") -> DataFrame:
    """``(model, feature, importance)``: shares in the gain of a tree model's splits, or for a
    linear model ``|β_j|·std(x_j)`` (needs ``train``)."""
    spark = train.sparkSession if train is not None else None
    if isinstance(model, BoostedModel):
        rows = [(model_name, f, float(v)) for f, v in zip(model.features, model.importances())]
        spark = spark or _active()
        return spark.createDataFrame(rows, "model string, feature string, importance double")
    last = model.stages[-1]
    coefs = [float(c) for c in last.coefficients.toArray()]
    stds = train.agg(*[F.stddev_samp(f).alias(f) for f in features])
    return stds.select(F.inline(F.array(*[
        F.struct(F.lit(model_name).alias("model"), F.lit(f).alias("feature"),
                 (F.lit(abs(c)) * F.coalesce(F.col(f), F.lit(0.0))).alias("importance"))
        for f, c in zip(features, coefs)])))


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def top_features(imp: DataFrame, n: int = 20, model_col: str = "model") -> DataFrame:
    """Top ``n`` features per model by importance (ties by feature name)."""
    w = Window.partitionBy(model_col).orderBy(F.col("importance").desc(), F.col("feature").asc())
    return imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def permutation_importance(model: PipelineModel | BoostedModel, df: DataFrame, features: Sequence[str],
                           target: str = TARGET, n_repeats: int = 5, seed: int = SEED,
                           key_cols: Sequence[str] = FOLD_KEY, block_rows: int = 50_000) -> DataFrame:
    """Mean drop in R² when one feature's values are permuted among rows.

    All rows of ``df`` are scored (pass a sample to score fewer). Rows fall
    into random blocks of about ``block_rows`` by their hash, and values are
    permuted within a block, so no step orders all rows in one task; a
    random block has the distribution of the whole. A row meets its donor once
    per repeat (the row at its place in the repeat's order); only then, without
    another shuffle, is the pair spread over the features, one of which comes
    from the donor. All permutations are scored in one batch.
    """
    s = df.filter(F.col(target).isNotNull()).select(*key_cols, target, *features)
    order = [F.col(k) for k in key_cols]
    blocks = max(1, round(s.count() / block_rows))
    base = s.withColumn("_b", portable_bucket(list(key_cols), blocks, seed))
    donors = (base.select(F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("_r"), "_b", *key_cols, *features)
                  .withColumn("_i", F.row_number().over(
                      Window.partitionBy("_r", "_b").orderBy(
                          F.xxhash64(F.col("_r"), F.lit(seed), *order), *order)))
                  .select("_r", "_b", "_i", *[F.col(f).alias(f"_d_{f}") for f in features]))
    base = base.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    turns = base.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    joined = turns.join(donors, ["_r", "_b", "_i"]).withColumn("_f", F.explode(F.array(*[F.lit(f) for f in features])))
    permuted = joined.select(target, "_f", "_r", *[
        F.when(F.col("_f") == F.lit(f), F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    scored = model.transform(permuted).select("_f", "_r", F.col(target).alias("y"), "prediction")
    per = regression_metrics(scored, "y", "prediction", ["_f", "_r"]).select("_f", "_r", "r2")
    # the unpermuted score is a single number (one small aggregate job)
    base_r2 = regression_metrics(model.transform(s).select(F.col(target).alias("y"), "prediction"),
                                 "y", "prediction", []).first()["r2"]
    drop = F.lit(base_r2).cast("double") - F.col("r2")
    return (per.groupBy("_f").agg(F.avg(drop).alias("importance"),
                                  F.stddev_samp(drop).alias("importance_std"))
               .withColumnRenamed("_f", "feature"))


def linear_attributions(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Closed-form additive attributions of a linear model,
    ``φ_j = β_j·(x_j − mean x_j)``, summarised as mean |φ_j| per feature."""
    coefs = [float(c) for c in model.stages[-1].coefficients.toArray()]
    # one aggregate row: the k feature means
    mrow = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    means = {f: F.lit(mrow[f] if mrow[f] is not None else 0.0) for f in features}
    phi = df.select(*[(F.lit(c) * (F.col(f).cast("double") - means[f])).alias(f)
                      for f, c in zip(features, coefs)])
    row = phi.agg(*[F.avg(F.abs(f)).alias(f) for f in features])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(c).alias("coefficient"), F.col(f).alias("mean_abs_attribution"))
        for f, c in zip(features, coefs)])))


def tree_attributions(model: BoostedModel, df: DataFrame) -> DataFrame:
    """Mean size of each feature's exact additive share in the predictions of a tree model: (feature, mean_abs_attribution)."""
    phi = model.attributions(df.select(*model.features))
    row = phi.agg(*[F.avg(F.abs(F.col(f"phi_{f}"))).alias(f) for f in model.features])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_attribution")) for f in model.features])))


def stacked_baselines(train: DataFrame, df: DataFrame, keys: Sequence[str], groups: dict[str, str], target: str = TARGET) -> DataFrame:
    """(*keys, model, y, prediction): the global mean and the mean per each of ``groups`` (name -> column), an aggregate of
    ``train`` each, and one pass over ``df``. One aggregate over all group columns together would hardly be smaller than the rows,
    and be shuffled for each of its uses."""
    g = train.select(F.avg(target)).scalar()
    out = df.select(*keys, *groups.values(), F.col(target).alias("y"))
    for name, col in groups.items():
        means = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.avg(target).alias(f"_m_{name}"))
        out = out.join(means, col, "left")
    rows = [F.struct(F.lit("global_mean").alias("model"), g.alias("prediction"))]
    rows += [F.struct(F.lit(name).alias("model"), F.coalesce(F.col(f"_m_{name}"), g).alias("prediction")) for name in groups]
    return out.select(*keys, "y", F.explode(F.array(*rows)).alias("_r")).select(*keys, "y", "_r.model", "_r.prediction")
