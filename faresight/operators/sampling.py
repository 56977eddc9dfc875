"""Reproducible samples, splits and fold ids from a mixed, portable row hash.

Everything is a per-row projection or filter on ``portable_bucket`` (no
shuffle) except the fixed-size sample, which first narrows the candidates
with a hash-bucket histogram so that its final top-n merge handles about
``n + N/65536`` rows instead of ``n`` per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.functions.expressions import portable_bucket, row_hash
from faresight.operators.features import FOLD_KEY
from faresight.schema import SEED, SPLIT_RATIOS, TARGET_ENC_FOLDS

HASH_BITS = 60
BUCKET_BITS = 16  # 65,536 coarse buckets of the hash


def hash_sample(df: DataFrame, n: int, key_cols: Sequence[str] = FOLD_KEY, seed: int = SEED,
                order_cols: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest (hash, key).

    Deterministic for a given seed, uniform over keys, and distributed: a
    65,536-bucket histogram of the hash (partial-aggregated) locates the
    bucket where the running count reaches ``n``; only rows up to that
    bucket go through the final ordered top-n.
    """
    order_cols = list(order_cols or key_cols)
    h = row_hash(key_cols, seed)
    tagged = df.withColumn("_h", h).withColumn("_hb", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    hist = tagged.groupBy("_hb").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (hist.withColumn("_cum", F.sum("_m").over(w))
               .filter(F.col("_cum") >= F.lit(n)).select(F.min("_hb")).scalar())
    last = F.lit((1 << BUCKET_BITS) - 1)
    cand = tagged.filter(F.col("_hb") <= F.coalesce(cut, last))
    return cand.orderBy("_h", *order_cols).limit(n).drop("_h", "_hb")


def fraction_sample(df: DataFrame, fraction: float, key_cols: Sequence[str] = FOLD_KEY,
                    seed: int = SEED) -> DataFrame:
    """Rows whose hash bucket (of 100) is below ``fraction·100``: a pure filter."""
    return df.filter(portable_bucket(key_cols, 100, seed) < F.lit(int(round(fraction * 100))))


def split_label(key_cols: Sequence[str] = FOLD_KEY, ratios: Sequence[float] = SPLIT_RATIOS,
                seed: int = SEED, names: Sequence[str] = ("train", "val", "test")) -> F.Column:
    """``train``/``val``/``test`` by hash bucket in [0, 100) and cumulative ratios, looked up by bucket: the row's hash, which
    costs more than the rest of a scan, stands in the expression once."""
    labels, acc = [], 0.0
    for name, r in zip(names[:-1], ratios[:-1]):
        acc += r
        labels += [name] * (min(100, int(round(acc * 100))) - len(labels))
    labels += [names[-1]] * (100 - len(labels))
    return F.get(F.array(*map(F.lit, labels)), portable_bucket(key_cols, 100, seed).cast("int"))


def train_val_test_split(df: DataFrame, key_cols: Sequence[str] = FOLD_KEY,
                         ratios: Sequence[float] = SPLIT_RATIOS, seed: int = SEED,
                         col: str = "split") -> DataFrame:
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    return df.withColumn(col, split_label(key_cols, ratios, seed))


def assign_folds(df: DataFrame, n_folds: int = TARGET_ENC_FOLDS, key_cols: Sequence[str] = FOLD_KEY,
                 seed: int = SEED, col: str = "fold") -> DataFrame:
    return df.withColumn(col, portable_bucket(key_cols, n_folds, seed).cast("int"))
