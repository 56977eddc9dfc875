"""Route, carrier and market features; frequency and target encoding.

Shape of every "aggregate then attach" operator: a partial-aggregated
``groupBy`` (map-side combine, so a hot key only costs one partial row per
map task) followed by a left join back on the key. AQE broadcasts the stats
side when its measured size is small and otherwise keeps a sort-merge join,
splitting skewed key partitions. Scalars (totals, global means, thresholds)
stay in the plan as scalar subqueries: nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faresight.functions.expressions import (
    clip_lower, first_by_key, n_unique, portable_bucket, safe_div,
)
from faresight.schema import (
    CARRIER, HUB_QUANTILE, ROUTE, SEED, TARGET, TARGET_ENC_FOLDS,
    TARGET_ENC_SMOOTHING,
)

FOLD_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def competition_level(carrier_count) -> F.Column:
    """1 carrier -> 0 (monopoly), 2-3 -> 1 (oligopoly), else 2 (competitive)."""
    c = F.col(carrier_count) if isinstance(carrier_count, str) else carrier_count
    return (F.when(c == 1, F.lit(0)).when(c <= 3, F.lit(1)).otherwise(F.lit(2)))


def route_stats(df: DataFrame, route: str = ROUTE, target: str = TARGET,
                carrier: str = CARRIER, demand: str = "Pax",
                share: str = "Market_share", hhi: str = "Market_HHI",
                order_cols: Sequence[str] | None = None) -> DataFrame:
    """One row per route (``_s``/``_n``: target sum and count, for the
    leave-one-out option; dropped on attach)."""
    return df.groupBy(route).agg(
        F.sum(target).alias("_s"), F.count(target).alias("_n"),
        F.avg(target).alias("route_avg_fare"),
        F.stddev_samp(target).alias("route_std_fare"),
        n_unique(carrier).alias("route_carrier_count"),
        F.coalesce(F.sum(demand), F.lit(0)).cast("bigint").alias("route_total_pax"),
        F.avg(share).alias("route_avg_market_share"),
        first_by_key(hhi, order_cols).alias("route_hhi"),
    )


def build_route_features(df: DataFrame, route: str = ROUTE, target: str = TARGET,
                         carrier: str = CARRIER, demand: str = "Pax",
                         share: str = "Market_share", hhi: str = "Market_HHI",
                         order_cols: Sequence[str] | None = None,
                         leave_one_out: bool = False) -> DataFrame:
    """Per-route fare mean/std, carrier count, Σ demand, mean share, HHI,
    and the competition bin, attached to every row (7 columns).

    ``leave_one_out=True`` replaces ``route_avg_fare`` by the mean of the
    *other* rows of the route, which keeps the row's own target out.
    """
    stats = route_stats(df, route, target, carrier, demand, share, hhi, order_cols)
    return attach_route_features(df, stats, route, target, leave_one_out)


def with_route_windows(df: DataFrame, route: str = ROUTE, target: str = TARGET, carrier: str = CARRIER,
                       demand: str = "Pax", share: str = "Market_share", hhi: str = "Market_HHI",
                       order_cols: Sequence[str] | None = None, leave_one_out: bool = False,
                       freq: str | None = None) -> DataFrame:
    """``build_route_features`` (and the route's row frequency as ``freq``) as windows: the rows are
    shuffled once, by route, and no table of routes is, which pays where routes are nearly as many as rows.
    The rows of a group are buffered by Spark and spill; rows without a route get NULLs, as in the join."""
    by, known, own = Window.partitionBy(route), F.col(route).isNotNull(), F.col(target)
    over = lambda agg: F.when(known, agg.over(by))
    carriers = F.size(F.collect_set(carrier).over(by)) + F.max(F.col(carrier).isNull().cast("int")).over(by)
    fare = over(F.avg(target))
    if leave_one_out:
        others = safe_div(over(F.sum(target)) - own, over(F.count(target)) - F.lit(1))
        fare = F.when(own.isNull(), fare).otherwise(others)
    cols = {
        "route_avg_fare": fare,
        "route_std_fare": over(F.stddev_samp(target)),
        "route_carrier_count": F.when(known, carriers.cast("bigint")),
        "route_total_pax": F.when(known, F.coalesce(F.sum(demand).over(by), F.lit(0)).cast("bigint")),
        "route_avg_market_share": over(F.avg(share)),
        "route_hhi": over(first_by_key(hhi, order_cols)),
    }
    if freq:
        n = df.select(F.count(F.lit(1))).scalar()
        cols[freq] = over(F.count(F.lit(1))).cast("double") / n.cast("double")
    return df.withColumns(cols).withColumn("route_competition_level", competition_level("route_carrier_count"))


def attach_route_features(df: DataFrame, stats: DataFrame, route: str = ROUTE,
                          target: str = TARGET, leave_one_out: bool = False) -> DataFrame:
    """Join route stats (from ``route_stats``, with ``_s``/``_n`` target
    sums when ``leave_one_out``) onto ``df`` and add the competition bin."""
    out = df.join(stats, route, "left")
    if leave_one_out:
        own = F.col(target)
        out = out.withColumn(
            "route_avg_fare",
            F.when(own.isNull(), F.col("route_avg_fare"))
             .otherwise(safe_div(F.col("_s") - own, F.col("_n") - F.lit(1))))
    return out.drop("_s", "_n").withColumn("route_competition_level",
                          competition_level("route_carrier_count"))


def build_carrier_features(df: DataFrame, carrier: str = CARRIER, target: str = TARGET,
                           route: str = ROUTE, miles: str = "NonStopMiles",
                           demand: str = "Pax", carrier_demand: str = "CarrierPax") -> DataFrame:
    """Per-carrier mean fare, distinct routes, mean distance and passenger
    share (Σ carrier demand / Σ all demand), attached to every row."""
    return df.join(carrier_stats(df, carrier, target, route, miles, demand, carrier_demand),
                   carrier, "left")


def carrier_stats(df: DataFrame, carrier: str = CARRIER, target: str = TARGET,
                  route: str = ROUTE, miles: str = "NonStopMiles",
                  demand: str = "Pax", carrier_demand: str = "CarrierPax") -> DataFrame:
    total = df.select(F.sum(demand)).scalar()
    return df.groupBy(carrier).agg(
        F.avg(target).alias("carrier_avg_fare"),
        n_unique(route).alias("carrier_route_count"),
        F.avg(miles).alias("carrier_avg_distance"),
        F.sum(carrier_demand).alias("_cpax"),
    ).select(carrier, "carrier_avg_fare", "carrier_route_count", "carrier_avg_distance",
             safe_div(F.col("_cpax").cast("double"), total.cast("double")).alias("carrier_pax_share"))


def nearest_rank_threshold(counts: DataFrame, count_col: str, q: float) -> F.Column:
    """Scalar subquery: the ``q`` quantile of ``count_col`` by nearest rank
    (sorted position ``round(q·(n-1))``, half away from zero).

    Exact and distributed: counts are first reduced to a histogram
    (distinct value -> multiplicity). A column of n integer counts summing
    to N has at most sqrt(2N) distinct values, so the running sum over that
    histogram is small even at very large scale.
    """
    n_rows = counts.select(F.count(F.lit(1))).scalar()
    target_idx = F.floor(F.lit(q) * (n_rows - F.lit(1)) + F.lit(0.5))  # 0-based
    hist = counts.groupBy(count_col).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.orderBy(count_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_cum", F.sum("_m").over(w))
    return cum.filter(F.col("_cum") > target_idx).select(F.min(count_col)).scalar()


def attach_value_encodings(out: DataFrame, base: DataFrame, freq_columns: Sequence[str] = (),
                           hub_columns: dict[str, str] | None = None, suffix: str = "_freq_enc",
                           q: float = HUB_QUANTILE) -> DataFrame:
    """Frequency encodings (``count / rows``) and hub flags (``count >=``
    the ``q`` nearest-rank quantile of the column's value counts) computed
    on ``base`` from one value count per column and joined onto ``out``,
    one left join per column. NULL values get NULL."""
    for c, table in value_encoding_tables(base, freq_columns, hub_columns, suffix, q).items():
        out = out.join(table, c, "left")
    return out


def value_encoding_tables(base: DataFrame, freq_columns: Sequence[str] = (),
                          hub_columns: dict[str, str] | None = None, suffix: str = "_freq_enc",
                          q: float = HUB_QUANTILE) -> dict[str, DataFrame]:
    """Per column, a keyed table ``(value, [freq], [hub flag])`` from a scan of
    that column alone and one partial-aggregated count; the hub threshold
    reuses that count's exchange. Callers join the tables (or first merge
    tables that share a key, so the row side is shuffled once per key)."""
    hub_columns = dict(hub_columns or {})
    cols = [c for c in dict.fromkeys(list(freq_columns) + list(hub_columns)) if c in base.columns]
    if not cols:
        return {}
    n = base.select(F.count(F.lit(1))).scalar()
    tables = {}
    for c in cols:
        t = base.groupBy(c).agg(F.count(F.lit(1)).alias("_cnt"))
        sel = [F.col(c)]
        if c in freq_columns:
            sel.append((F.col("_cnt").cast("double") / n.cast("double")).alias(f"{c}{suffix}"))
        if c in hub_columns:
            thr = nearest_rank_threshold(t, "_cnt", q)
            sel.append((F.col("_cnt") >= thr).cast("tinyint").alias(hub_columns[c]))
        tables[c] = t.filter(F.col(c).isNotNull()).select(*sel)
    return tables


HUB_COLUMNS = {"OriginAirportID": "is_hub_origin", "DestAirportID": "is_hub_dest"}


def hub_flags(df: DataFrame, columns: Sequence[tuple[str, str]] = tuple(HUB_COLUMNS.items()),
              q: float = HUB_QUANTILE) -> DataFrame:
    """Flag values whose row frequency is at or above the ``q`` quantile of
    all value frequencies (nearest rank). Flag is tinyint 0/1, NULL for NULL."""
    return attach_value_encodings(df, df, (), dict(columns), q=q)


def attach_hub_flags(out: DataFrame, base: DataFrame, columns: Sequence[tuple[str, str]] = tuple(
        HUB_COLUMNS.items()), q: float = HUB_QUANTILE) -> DataFrame:
    """Hub flags computed on ``base`` joined onto ``out``."""
    return attach_value_encodings(out, base, (), dict(columns), q=q)


def build_market_features(df: DataFrame, target: str = TARGET, miles: str = "NonStopMiles",
                          circuity: str = "Circuity", hubs: bool = True) -> DataFrame:
    """``fare_per_mile = fare / max(miles, 1)``, ``circuity_premium =
    max(circuity - 1, 0)`` (NULL-preserving) and the two hub flags."""
    out = add_market_ratios(df, target, miles, circuity)
    return attach_hub_flags(out, df) if hubs else out


def add_market_ratios(df: DataFrame, target: str = TARGET, miles: str = "NonStopMiles",
                      circuity: str = "Circuity") -> DataFrame:
    return df.withColumns({
        "fare_per_mile": safe_div(F.col(target), clip_lower(miles, 1.0)),
        "circuity_premium": clip_lower(F.col(circuity) - F.lit(1.0), 0.0),
    })


def fare_per_mile_safe(df: DataFrame, target: str = TARGET, miles: str = "NonStopMiles",
                       out: str = "fare_per_mile") -> DataFrame:
    """Kernel variant: plain ratio, division by zero (±inf) mapped to 0."""
    fare, m = F.col(target), F.col(miles)
    # x/0 is ±inf (-> 0) for x != 0 and NaN for 0/0, as in float arithmetic
    val = (F.when(m == 0, F.when(fare == 0, F.lit(float("nan"))).otherwise(F.lit(0.0)))
            .otherwise(F.try_divide(fare, m)))
    return df.withColumn(out, val)


def frequency_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_freq_enc") -> DataFrame:
    """``value count / row count`` per listed column, attached by left join.
    NULL values get NULL (a NULL key never matches)."""
    return attach_value_encodings(df, df, [c for c in columns if c in df.columns], None, suffix)


def attach_frequency_encoding(out: DataFrame, base: DataFrame, columns: Sequence[str],
                              suffix: str = "_freq_enc") -> DataFrame:
    return attach_value_encodings(out, base, [c for c in columns if c in base.columns], None, suffix)


def fold_column(key_cols: Sequence[str] = FOLD_KEY, n_folds: int = TARGET_ENC_FOLDS,
                seed: int = SEED) -> F.Column:
    return portable_bucket(key_cols, n_folds, seed).cast("int")


def target_encode_cv(df: DataFrame, column: str = CARRIER, target: str = TARGET,
                     n_folds: int = TARGET_ENC_FOLDS, smoothing: float = TARGET_ENC_SMOOTHING,
                     seed: int = SEED, suffix: str = "_target_enc",
                     key_cols: Sequence[str] = FOLD_KEY) -> DataFrame:
    """Out-of-fold target encoding with Bayesian smoothing.

    Each row gets ``(S' + m·g) / (n' + m)`` where ``S'``/``n'`` are the target
    sum/count of its category over the *other* folds, ``m`` the smoothing and
    ``g`` the global target mean; ``g`` when ``n' = 0`` or the category is
    NULL. One ``groupBy(category, fold)`` gives every fold's partial sums;
    other-fold sums are category total minus own fold, so the k filtered
    passes of a loop collapse into one shuffle of partial aggregates.
    """
    return attach_target_encoding(df, df, column, target, n_folds, smoothing, seed, suffix, key_cols)


def attach_target_encoding(out: DataFrame, df: DataFrame, column: str = CARRIER,
                           target: str = TARGET, n_folds: int = TARGET_ENC_FOLDS,
                           smoothing: float = TARGET_ENC_SMOOTHING, seed: int = SEED,
                           suffix: str = "_target_enc",
                           key_cols: Sequence[str] = FOLD_KEY, few: bool = False) -> DataFrame:
    """Encoding table computed on ``df``, attached to ``out`` (same rows, more columns).
    ``few``: the column has few values, so the table is broadcast and ``out`` is never shuffled for it."""
    fold = "_fold"
    g = df.select(F.avg(target)).scalar()
    base = df.withColumn(fold, fold_column(key_cols, n_folds, seed))
    cf = base.groupBy(column, fold).agg(F.sum(target).alias("_S"), F.count(target).alias("_n"))
    ct = cf.groupBy(column).agg(F.sum("_S").alias("_St"), F.sum("_n").alias("_nt"))
    s_other = F.coalesce(F.col("_St"), F.lit(0.0)) - F.coalesce(F.col("_S"), F.lit(0.0))
    n_other = F.col("_nt") - F.col("_n")
    enc = F.when(n_other > 0,
                 (s_other + F.lit(smoothing) * g) / (n_other.cast("double") + F.lit(smoothing)))
    table = cf.join(ct, column).select(column, fold, enc.alias("_enc"))
    out = out.withColumn(fold, fold_column(key_cols, n_folds, seed))
    table = table.filter(F.col(column).isNotNull())
    out = out.join(F.broadcast(table) if few else table, [column, fold], "left")
    return out.withColumn(f"{column}{suffix}", F.coalesce(F.col("_enc"), g.cast("double"))) \
              .drop("_enc", fold)


def route_mean_std(df: DataFrame, route: str = ROUTE, target: str = TARGET) -> DataFrame:
    """Kernel route aggregates: mean and sample std (NULL std -> 0), joined back."""
    stats = df.groupBy(route).agg(
        F.avg(target).alias("route_avg_fare"),
        F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("route_std_fare"))
    return df.join(stats, route, "left")
