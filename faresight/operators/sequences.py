"""Fixed-length padded per-group sequences (model input builder).

One row per group: the first ``seq_len`` rows' feature vectors in key order
(NULL/NaN/±inf -> 0, float), zero-padded; a 1/0 mask; and the group's mean
target over *all* its rows (groups with a NULL mean are skipped).

``row_number() <= seq_len`` lets Spark insert a partial window-group limit
before the shuffle, so every map task forwards at most ``seq_len`` rows per
group: a hot group never ships more than ``seq_len × map tasks`` rows, and
the ``collect_list`` that follows is bounded by ``seq_len``. It is a window over
the same order, so the rows are sorted once on each side of one shuffle; the
targets join the groups while these are short, and the padding comes last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.schema import ROUTE, TARGET


def _clean_float(c: str) -> F.Column:
    v = F.col(c).cast("float")
    bad = v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0).cast("float")).otherwise(v)


def route_sequences(df: DataFrame, feature_cols: Sequence[str], order_cols: Sequence[str],
                    target: str = TARGET, group_col: str = ROUTE, seq_len: int = 10) -> DataFrame:
    k = len(feature_cols)
    w = Window.partitionBy(group_col).orderBy(*order_cols)
    ranked = (df.select(group_col, *order_cols, F.array(*[_clean_float(c) for c in feature_cols]).alias("_vec"))
                .withColumn("_pos", F.row_number().over(w))
                .filter(F.col("_pos") <= seq_len))
    seqs = (ranked.withColumn("_items", F.collect_list("_vec").over(w.rowsBetween(Window.currentRow, seq_len - 1)))
                  .filter(F.col("_pos") == 1).select(group_col, "_items"))
    targets = (df.groupBy(group_col).agg(F.avg(target).alias("target"))
                 .filter(F.col("target").isNotNull()))
    n = F.size("_items")
    zero_vec = F.array_repeat(F.lit(0.0).cast("float"), k)
    pad = F.lit(seq_len) - n
    return seqs.join(targets, group_col, "inner").select(
        group_col,
        F.concat("_items", F.array_repeat(zero_vec, pad)).alias("features"),
        F.concat(F.array_repeat(F.lit(1.0).cast("float"), n),
                 F.array_repeat(F.lit(0.0).cast("float"), pad)).alias("mask"),
        n.alias("length"), "target")


def flatten_sequences(seqs: DataFrame, feature_cols: Sequence[str], group_col: str = ROUTE) -> DataFrame:
    """One row per (group, position): mask, target and one column per feature."""
    ex = seqs.select(group_col, "target", F.posexplode(F.arrays_zip("features", "mask")).alias("_p", "_e"))
    return ex.select(group_col, (F.col("_p") + 1).alias("pos"), "target",
                     F.col("_e.mask").alias("mask"),
                     *[F.col("_e.features")[i].alias(f"f_{c}") for i, c in enumerate(feature_cols)])
