"""Ordered target statistics of a categorical column.

A row's category is encoded by the targets of the rows of that category that come before it in a seeded random
order, smoothed by a prior: no row sees its own target. The order is a hash of the row key. Per category it is cut into buckets by
the hash's first bits, so that a category that holds a third of all rows is not ordered in one task: sums per
(category, bucket) are accumulated over the at most ``BUCKETS`` buckets of a category, and rows are ordered within a bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.functions.expressions import row_hash
from faresight.schema import SEED, TARGET

BUCKETS = 4096
HASH_BITS = 60        # of row_hash


def ordered_target_statistic(df: DataFrame, column: str, target: str = TARGET, key_cols: Sequence[str] = (), prior_weight: float = 1.0,
                             seed: int = SEED, out: str | None = None) -> DataFrame:
    """``df`` with ``<column>_ordered_te``: (sum of the targets before + prior_weight * mean) / (their number + prior_weight).

    NULL categories are a category of their own; rows without a target are encoded and do not count. Rows with equal
    keys are ordered by their target.
    """
    out = out or f"{column}_ordered_te"
    t = F.col(target).cast("double")
    prior = df.select(F.avg(t)).scalar()
    rows = df.withColumn("_h", row_hash(key_cols, seed)).withColumn("_bucket", F.shiftright("_h", HASH_BITS - 12).cast("int"))
    per = rows.groupBy(column, "_bucket").agg(F.sum(t).alias("_s"), F.count(t).alias("_n"))
    before = Window.partitionBy(column).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(column).alias("_c"), F.col("_bucket").alias("_b"),
                     F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    rows = rows.join(per, F.col(column).eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    own = Window.partitionBy(column, "_bucket").orderBy("_h", t).rowsBetween(Window.unboundedPreceding, -1)
    s = F.col("_s0") + F.coalesce(F.sum(t).over(own), F.lit(0.0))
    n = F.col("_n0") + F.count(t).over(own)
    return rows.withColumn(out, (s + F.lit(prior_weight) * prior) / (n + F.lit(prior_weight))).select(*df.columns, out)
