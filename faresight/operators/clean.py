"""Validation and cleaning of the market table.

Validation is one conditional-aggregate pass plus one distinct count (a
scalar subquery); cleaning is one lazy plan ``drop -> filter -> distinct
-> cast``. The only extra action is the min/max scan that decides which
64-bit integer columns can be narrowed, since the output schema depends on
it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faresight.schema import DISTANCE_COLUMNS, FREQ_ENCODED_COLUMNS, MIN_CIRCUITY, TARGET

INT32_MIN, INT32_MAX = -(2 ** 31), 2 ** 31


def _count_if(cond, rows) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, rows).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def _counters(cols: set, rows: F.Column, target: str, distance_cols: Sequence[str], circuity: str,
              min_circuity: float) -> list[F.Column]:
    """The counting checks as aggregates, where one row stands for ``rows`` rows; checks without their column count 0."""
    t = F.col(target) if target in cols else F.lit(0.5)
    c = F.col(circuity) if circuity in cols else F.lit(min_circuity)
    return [F.coalesce(F.sum(rows), F.lit(0)).cast("bigint").alias("total_rows"),
            _count_if(t < 0, rows).alias("negative_fares"), _count_if(t == 0, rows).alias("zero_fares"),
            _count_if(t.isNull(), rows).alias("missing_target"),
            *[_count_if(F.col(d) < 0, rows).alias(f"_neg_{d}") for d in distance_cols if d in cols],
            _count_if(c < min_circuity, rows).alias("impossible_circuity")]


def _record(rec: DataFrame, target: str, circuity: str) -> DataFrame:
    """The validation record of one row of counters (with ``n_distinct``)."""
    far = [c for c in rec.columns if c.startswith("_neg_")]
    total = F.lit(0).cast("bigint")
    for c in far:
        total = total + F.col(c)
    rec = (rec.withColumn("negative_distances", total.cast("bigint"))
              .withColumn("duplicate_rows", (F.col("total_rows") - F.col("n_distinct")).cast("bigint")))
    checks = [("negative_fares", f"rows with negative {target}"), ("zero_fares", f"rows with zero {target}"),
              ("missing_target", f"rows with missing {target}"),
              *[(c, f"rows with negative {c[len('_neg_'):]}") for c in far],
              ("impossible_circuity", f"rows with impossibly low {circuity}"), ("duplicate_rows", "duplicate rows")]
    issues = [F.when(F.col(c) > 0, F.format_string(f"%d {text}", F.col(c))) for c, text in checks]
    rec = rec.withColumn("issues", F.filter(F.array(*issues), lambda x: x.isNotNull()))
    rec = rec.withColumn("is_clean", F.size("issues") == 0)
    return rec.select("total_rows", "negative_fares", "zero_fares", "missing_target",
                      "negative_distances", "impossible_circuity", "duplicate_rows",
                      "issues", "is_clean")


def validate(df: DataFrame, target: str = TARGET, distance_cols: Sequence[str] = DISTANCE_COLUMNS,
             circuity: str = "Circuity", min_circuity: float = MIN_CIRCUITY) -> DataFrame:
    """One-row validation record.

    Columns: total_rows, negative_fares, zero_fares, missing_target,
    negative_distances (summed over distance columns), impossible_circuity,
    duplicate_rows, issues (array<string>, in check order), is_clean.
    Checks whose column is absent count 0 and add no issue.
    """
    n_distinct = df.distinct().select(F.count(F.lit(1))).scalar()
    rec = df.agg(*_counters(set(df.columns), F.lit(1), target, distance_cols, circuity, min_circuity))
    return _record(rec.withColumn("n_distinct", n_distinct), target, circuity)


def clean_and_validate(df: DataFrame, write: Callable[[DataFrame], None], target: str = TARGET,
                       drop_freq_encoded: bool = True, distance_cols: Sequence[str] = DISTANCE_COLUMNS,
                       circuity: str = "Circuity", min_circuity: float = MIN_CIRCUITY) -> DataFrame:
    """Hand the cleaned rows (not narrowed) to ``write``, which runs one job, and return the record of ``validate(df)``.

    The input is read once: rows are grouped by the columns that stay, with
    their number and that of the distinct whole rows among them, and the checks are
    observed on those groups. They are observed behind the last shuffle, in the stage that writes, whose
    tasks Spark counts once each, also after executors were lost.
    """
    stay = drop_columns(df, FREQ_ENCODED_COLUMNS if drop_freq_encoded else [])
    gone = [F.col(c) for c in df.columns if c not in stay.columns]
    copies, whole = (_free(name, df.columns) for name in ("copies", "whole"))
    groups = stay.columns
    counted = df.groupBy(*groups).agg(F.count(F.lit(1)).alias(copies),
                                      (F.count_distinct(F.struct(*gone)) if gone else F.lit(1).cast("bigint")).alias(whole))
    seen = Observation()
    counted = counted.observe(seen, *_counters(set(groups), F.col(copies), target, distance_cols, circuity, min_circuity),
                              F.coalesce(F.sum(whole), F.lit(0)).alias("n_distinct"))
    write(_valid(counted, target, distance_cols).select(*groups))
    got = seen.get
    schema = T.StructType([T.StructField(k, T.LongType()) for k in got])
    return _record(df.sparkSession.createDataFrame([tuple(got.values())], schema), target, circuity)


def _free(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns that exist (duplicates in the list are fine)."""
    present = [c for c in dict.fromkeys(columns) if c in df.columns]
    return df.drop(*present) if present else df


def downcast_plan(df: DataFrame) -> dict[str, str]:
    """Decide casts: double -> float always; bigint -> int only if the
    column's min and max fit in 32 bits (all-NULL columns stay bigint).

    One aggregate pass computes every bigint column's min/max together.
    """
    casts: dict[str, str] = {}
    longs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            casts[f.name] = "float"
        elif isinstance(f.dataType, T.LongType):
            longs.append(f.name)
    if longs:
        aggs = []
        for c in longs:
            aggs += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
        row = df.agg(*aggs).first()
        for c in longs:
            mn, mx = row[f"mn_{c}"], row[f"mx_{c}"]
            if mn is not None and mx is not None and mn >= INT32_MIN and mx < INT32_MAX:
                casts[c] = "int"
    return casts


def downcast(df: DataFrame, casts: dict[str, str] | None = None) -> DataFrame:
    casts = downcast_plan(df) if casts is None else casts
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c)
                       for c in df.columns])


def clean(df: DataFrame, target: str = TARGET, drop_freq_encoded: bool = True,
          extra_drop: Sequence[str] | None = None,
          distance_cols: Sequence[str] = DISTANCE_COLUMNS, narrow: bool = True) -> DataFrame:
    """Drop encoded/listed columns, keep ``target > 0`` (not NULL), keep
    distances ``>= 0`` (NULL distances drop), remove exact duplicates, then
    narrow numeric types."""
    to_drop = (list(FREQ_ENCODED_COLUMNS) if drop_freq_encoded else []) + list(extra_drop or [])
    out = drop_columns(df, to_drop)
    out = _valid(out, target, distance_cols).distinct()
    return downcast(out) if narrow else out


def _valid(df: DataFrame, target: str, distance_cols: Sequence[str]) -> DataFrame:
    if target in df.columns:
        df = df.filter(F.col(target).isNotNull() & (F.col(target) > 0))
    for c in distance_cols:
        if c in df.columns:
            df = df.filter(F.col(c) >= 0)
    return df


def clean_strict(df: DataFrame, target: str = TARGET, miles: str = "NonStopMiles",
                 min_fare: float = 1.0) -> DataFrame:
    """Stricter variant: target present and ``>= min_fare``, miles ``> 0``,
    exact duplicates removed."""
    return (df.filter(F.col(target).isNotNull())
              .filter(F.col(target) >= min_fare)
              .filter(F.col(miles) > 0)
              .distinct())
