"""Profiling and exploratory summaries: the data behind every EDA chart.

All statistics are one aggregate pass (or one pass per chart) over the full
table; only the small aggregated result leaves Spark. Quantiles are exact
(``percentile``, linear interpolation as in numpy) or approximate
(``percentile_approx``, bounded memory) by a ``method`` switch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faresight.functions.expressions import n_unique
from faresight.operators.quantiles import quantile_table
from faresight.schema import BINARY_COLUMNS, CARRIER, HHI_CONCENTRATED, NUMERIC_FEATURE_COLUMNS, ROUTE, TARGET

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


QUARTILES = [0.25, 0.5, 0.75]


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float] = QUARTILES,
              group_cols: Sequence[str] = (), names: Sequence[str] = ("p25", "p50", "p75"),
              method: str = "exact", accuracy: int = 10000, few: bool = False) -> DataFrame:
    """``(*group_cols, column, <names>)``: exact (bounded-memory, see
    ``quantiles.exact_quantiles``) or approximate (``percentile_approx``)."""
    if method == "approx":
        long = df.select(*group_cols, F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns])).alias("_s")
        ).select(*group_cols, "_s.column", "_s._x").where(~F.isnan("_x"))
        arr = F.percentile_approx("_x", [float(q) for q in qs], accuracy)
        return long.groupBy(*group_cols, "column").agg(arr.alias("_p")).select(
            *group_cols, "column", *[F.col("_p")[j].alias(n) for j, n in enumerate(names)])
    return quantile_table(df, columns, qs, group_cols, names, accuracy, few)


def _finite(c: F.Column) -> F.Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


# ------------------------------------------------------------------ B1-B5
def column_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column, in ONE pass: ``position, column, dtype, row_count,
    null_count, count`` (non-NULL) and, for numeric columns, ``mean, std,
    min, max`` (doubles; NULL for other types).

    The columns are stacked into long form ``(position, x, is_null)`` and
    aggregated by a narrow keyed aggregate: every map task emits one
    partial row per column, and the buffer stays small enough for
    whole-stage code generation however many columns there are."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if columns is None or f.name in columns]
    num = set(numeric_columns(df))
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"),
                 (F.col(f.name).cast("double") if f.name in num else F.lit(None).cast("double")).alias("x"),
                 F.col(f.name).isNull().alias("is_null"))
        for i, f in fields])).alias("_s")).select("_s.*")
    agg = stacked.groupBy("position").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("is_null").cast("bigint")).alias("null_count"),
        F.count("x").alias("_nx"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    names = F.create_map(*[a for i, f in fields for a in (F.lit(i), F.lit(f.name))])
    types = F.create_map(*[a for i, f in fields for a in (F.lit(i), F.lit(f.dataType.simpleString()))])
    return agg.select("position", names[F.col("position")].alias("column"), types[F.col("position")].alias("dtype"),
                      "row_count", "null_count", (F.col("row_count") - F.col("null_count")).alias("count"),
                      "mean", "std", "min", "max")


def profile_columns(df: DataFrame, method: str = "exact") -> DataFrame:
    """Long-form profile: one row per column with dtype, row/null counts and,
    for numeric columns, mean, std, min, quartiles and max (all double).
    Moments are one stacked pass; quartiles one bounded-memory quantile job
    over all numeric columns."""
    num = numeric_columns(df)
    stats = column_moments(df)
    if not num:
        return stats.select("position", "column", "dtype", "row_count", "null_count", "mean", "std", "min",
                            *[F.lit(None).cast("double").alias(n) for n in ("p25", "p50", "p75")], "max")
    q = quantiles(df, num, method=method)
    return (stats.join(q, "column", "left")
                 .select("position", "column", "dtype", "row_count", "null_count", "mean", "std", "min",
                         "p25", "p50", "p75", "max"))


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, null_count)`` for every column, one scan."""
    row = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(f"n{i}")
                   for i, c in enumerate(df.columns)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("null_count"))
        for i, c in enumerate(df.columns)])))


def null_counts_head(df: DataFrame, order_cols: Sequence[str], n: int = 1000) -> DataFrame:
    """Null counts over the first ``n`` rows in ``order_cols`` order (a
    top-n: each task keeps its n smallest rows before one small merge)."""
    return null_counts(df.orderBy(*order_cols).limit(n))


def missing_pct(df: DataFrame) -> DataFrame:
    """``(column, missing_pct)`` for columns that have NULLs, in percent."""
    n = df.select(F.count(F.lit(1))).scalar()
    return (null_counts(df).filter(F.col("null_count") > 0)
            .select("column", (F.col("null_count").cast("double") * F.lit(100.0) / n.cast("double"))
                    .alias("missing_pct")))


DESCRIBE_STATS = ["count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, columns: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """Wide describe: a ``statistic`` column (count, null_count, mean, std,
    min, 25%, 50%, 75%, max) and one double column per numeric column.

    Built as a long per-column table (one stacked moments pass + quartiles),
    then reshaped: stacked to ``(column, statistic, value)`` and pivoted on
    the known column list, so the result is 9 rows whatever the data size."""
    cols = list(columns) if columns else numeric_columns(df)
    moments = column_moments(df.select(*cols))
    long = moments.join(quantiles(df, cols, method=method), "column", "left")
    names = {"25%": "p25", "50%": "p50", "75%": "p75"}
    stacked = long.select("column", F.explode(F.array(*[
        F.struct(F.lit(st).alias("statistic"), F.lit(i).alias("_o"),
                 F.col(names.get(st, st)).cast("double").alias("value"))
        for i, st in enumerate(DESCRIBE_STATS)])).alias("_s")).select("column", "_s.*")
    wide = stacked.groupBy("statistic", "_o").pivot("column", cols).agg(F.first("value"))
    return wide.orderBy("_o").select("statistic", *cols)


def describe_all(df: DataFrame) -> DataFrame:
    """Long describe of every column: (column, dtype, count, null_count, mean, std, min, p25, p50, p75, max, min_text, max_text).

    Numbers have moments and quartiles; other columns the extremes of their text."""
    num = set(numeric_columns(df))
    other = [c for c in df.columns if c not in num]
    out = profile_columns(df).select("column", "dtype", (F.col("row_count") - F.col("null_count")).alias("count"), "null_count", "mean", "std", "min",
                                     "p25", "p50", "p75", "max")
    if not other:
        return out.select("*", *[F.lit(None).cast("string").alias(c) for c in ("min_text", "max_text")])
    row = df.agg(*[g(F.col(c).cast("string")).alias(f"{n}{k}") for k, c in enumerate(other) for n, g in (("a", F.min), ("b", F.max))])
    texts = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{k}").alias("min_text"), F.col(f"b{k}").alias("max_text"))
                                          for k, c in enumerate(other)])))
    return out.join(F.broadcast(texts), "column", "left")     # one row per column


# ------------------------------------------------------------------ B6
def cardinality(df: DataFrame, top: int | None = 20, approx: bool = False) -> DataFrame:
    """Distinct values per column (NULL counts as a value), largest first,
    ties in column order; ``top`` keeps the first rows of that order.

    Exact mode reshapes to long form ``(column, value)`` and de-duplicates
    once: one shuffle with map-side de-duplication instead of one
    distinct-expansion per column.
    """
    cols = df.columns
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(cols)])
        long = row.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").cast("bigint").alias("n_unique"))
            for i, c in enumerate(cols)])))
    else:
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("position"), F.col(c).cast("string").alias("value"))
            for i, c in enumerate(cols)])).alias("p")).select("p.position", "p.value")
        long = (pairs.distinct()
                     .groupBy("position").agg(F.count(F.lit(1)).cast("bigint").alias("n_unique")))
        names = F.array(*[F.lit(c) for c in cols])
        long = long.select("position", F.element_at(names, F.col("position") + 1).alias("column"), "n_unique")
    ordered = long.orderBy(F.col("n_unique").desc(), F.col("position").asc())
    return (ordered.limit(top) if top else ordered).select("column", "n_unique", "position")


# ------------------------------------------------------------------ G10
def _gram_partials(cols: list[str], shifts: list[float]):
    """Per Arrow batch: masked moment matrices as long rows (a, b, ...)."""
    import numpy as np
    import pandas as pd

    k = len(cols)
    shift = np.asarray(shifts, dtype="float64")

    def run(batches):
        acc = None
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64", na_value=np.nan)
            valid = ~np.isnan(x)
            m = valid.astype("float64")
            xz = np.where(valid, x - shift, 0.0)
            parts = (m.T @ m, xz.T @ m, (xz * xz).T @ m, xz.T @ xz)
            acc = parts if acc is None else tuple(a + b for a, b in zip(acc, parts))
        if acc is None:
            return
        n, sx, sxx, sxy = acc
        ia, ib = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        yield pd.DataFrame({
            "a": ia.ravel().astype("int32"), "b": ib.ravel().astype("int32"),
            "n": n.ravel(), "sx": sx.ravel(), "sy": sx.T.ravel(),
            "sxx": sxx.ravel(), "syy": sxx.T.ravel(), "sxy": sxy.ravel()})
    return run


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over pairwise-complete rows,
    long form ``(col_a, col_b, corr)``; NULL where a column is constant.

    A very wide one-row aggregate (six moments for each of k² pairs) falls
    out of whole-stage codegen, so the moments are computed as matrices:
    each task turns its Arrow batches into numpy arrays and accumulates
    ``MᵀM``, ``XᵀM``, ``(X²)ᵀM`` and ``XᵀX`` (M = validity mask, X = values
    shifted by the column mean, NULL/NaN -> 0), emitting k² partial rows per
    task; one small ``groupBy(a, b).sum`` combines them. Work and data stay
    distributed; only k² numbers per task are shuffled.
    """
    cols = list(columns) if columns else (
        [c for c in NUMERIC_FEATURE_COLUMNS if c in df.columns] + ([TARGET] if TARGET in df.columns else []))
    mean_row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    shifts = [float(mean_row[c]) if mean_row[c] is not None else 0.0 for c in cols]
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    schema = "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = x.mapInPandas(_gram_partials(cols, shifts), schema)
    tot = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])
    n = F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.when((n < 2) | (cxx <= 0) | (cyy <= 0), F.lit(None).cast("double")).otherwise(
        F.try_divide(cxy, F.sqrt(cxx) * F.sqrt(cyy)))
    names = F.array(*[F.lit(c) for c in cols])
    return tot.select(F.element_at(names, F.col("a") + 1).alias("col_a"),
                      F.element_at(names, F.col("b") + 1).alias("col_b"), r.alias("corr"))


# ------------------------------------------------------------------ G11-G12
def histogram(df: DataFrame, value, bins: int = 100) -> DataFrame:
    """Equi-width histogram of a column or expression, NULL/NaN dropped.

    ``(bin, bin_lo, bin_hi, count)`` for all ``bins`` bins (empty ones too);
    the last bin is closed. The range is one scalar subquery pair (min, max
    of the same aggregate, merged by the optimizer) projected once into
    columns; bucketing is a per-row projection and the counts a
    partial-aggregated group-by.
    """
    spark = df.sparkSession
    v0 = F.col(value) if isinstance(value, str) else value
    v = df.select(v0.cast("double").alias("_v")).where(_finite(F.col("_v")))
    rng = v.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    nb = F.lit(float(bins))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) * nb / width) + F.lit(1), F.lit(bins)))
    counts = (v.select("_v", lo.alias("_lo"), hi.alias("_hi"))
               .groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), lo.alias("_lo"), hi.alias("_hi"))
    return (grid.where(F.col("_lo").isNotNull()).join(counts, "bin", "left")
                .select("bin",
                        (F.col("_lo") + width * (F.col("bin") - 1).cast("double") / nb).alias("bin_lo"),
                        (F.col("_lo") + width * F.col("bin").cast("double") / nb).alias("bin_hi"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def hhi_concentration(df: DataFrame, hhi: str = "Market_HHI", route: str = ROUTE,
                      threshold: float = HHI_CONCENTRATED) -> DataFrame:
    """Rows / routes above the highly-concentrated HHI marker and their share."""
    above = F.col(hhi) > F.lit(threshold)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(above.cast("bigint")).alias("concentrated_rows"),
        F.count_distinct(route).alias("n_routes"),
        F.count_distinct(F.when(above, F.col(route))).alias("concentrated_routes"),
    ).select("*", F.try_divide(F.col("concentrated_rows").cast("double"), F.col("n_rows").cast("double"))
             .alias("concentrated_share"))


# ------------------------------------------------------------------ G13
def box_stats(df: DataFrame, group_cols: Sequence[str], value: str = TARGET,
              method: str = "exact", few: bool = False) -> DataFrame:
    """Box-plot statistics per group: n, q1, median, q3 and the whiskers
    (most extreme values within 1.5·IQR of the box), outliers not listed.

    Quartiles are a grouped aggregate; whiskers need the fences, so the
    small per-group quartile table is joined back once and a second
    conditional min/max aggregate finishes the job. ``few``: there are few
    groups, so that table is broadcast and no group's rows meet in one task."""
    g = list(group_cols)
    v = df.where(_finite(F.col(value)))
    counts = v.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    q = (quantiles(v, [value], QUARTILES, g, ("q1", "median", "q3"), method, few=few).drop("column")
         .join(counts, g))
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - F.lit(1.5) * iqr
    hi_f = F.col("q3") + F.lit(1.5) * iqr
    x = F.col(value).cast("double")
    # the box goes along as part of the group, so that its table is computed once
    return (v.join(F.broadcast(q) if few else q, g, "inner")
             .groupBy(*g, "q1", "median", "q3", "n")
             .agg(F.min(F.when(x >= lo_f, x)).alias("whisker_lo"),
                  F.max(F.when(x <= hi_f, x)).alias("whisker_hi")))


def top_by_count(df: DataFrame, col: str = CARRIER, n: int = 15) -> DataFrame:
    """The ``n`` most frequent values (ties by value), with their counts. NULL is no value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
              .orderBy(F.col("n_rows").desc(), F.col(col).asc_nulls_last()).limit(n))


def carrier_fare_box(df: DataFrame, carrier: str = CARRIER, value: str = TARGET,
                     top: int = 15, method: str = "exact") -> DataFrame:
    """Fare box stats for the ``top`` most frequent carriers (semi-join)."""
    keep = top_by_count(df, carrier, top).select(carrier)
    return box_stats(df.join(F.broadcast(keep), carrier, "left_semi"), [carrier], value, method, few=True)


def binary_fare_box(df: DataFrame, flags: Sequence[str] = BINARY_COLUMNS, value: str = TARGET,
                    method: str = "exact") -> DataFrame:
    """Fare box stats by each binary flag's value, long form
    ``(feature, flag_value, ...)``; one scan for all flags."""
    present = [c for c in flags if c in df.columns]
    long = df.select(F.col(value), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("flag_value")) for c in present
    ])).alias("_f")).select("_f.feature", "_f.flag_value", value)
    return box_stats(long, ["feature", "flag_value"], value, method, few=True)


# ------------------------------------------------------------------ G14, S1, S5
def overview_metrics(df: DataFrame, target: str = TARGET, route: str = ROUTE,
                     carrier: str = CARRIER, demand: str = "Pax") -> DataFrame:
    """Headline cards: rows, mean fare, total passengers, routes, carriers."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(target).alias("avg_fare"),
                  F.coalesce(F.sum(demand), F.lit(0)).cast("bigint").alias("total_pax"),
                  n_unique(route).alias("n_routes"), n_unique(carrier).alias("n_carriers"))


def top_routes(df: DataFrame, route: str = ROUTE, target: str = TARGET, min_records: int = 10,
               n: int = 20) -> DataFrame:
    """Routes with at least ``min_records`` fares, highest mean fare first."""
    return (df.groupBy(route).agg(F.avg(target).alias("avg_fare"), F.count(target).alias("n_records"))
              .filter(F.col("n_records") >= min_records)
              .orderBy(F.col("avg_fare").desc(), F.col(route).asc()).limit(n))


def preview(df: DataFrame, order_cols: Sequence[str], n: int = 100) -> DataFrame:
    """First ``n`` rows in key order (top-n per task, one small merge)."""
    return df.orderBy(*order_cols).limit(n)


def log_target(target: str = TARGET) -> F.Column:
    return F.log1p(F.col(target))

