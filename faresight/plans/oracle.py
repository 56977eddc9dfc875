"""DuckDB-runnable SQL for every oracle-checked query in the registry."""

from __future__ import annotations

from faresight.plans.oracle_market import with_dirty, with_market, with_market_extra

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
ROW_HASH = ("CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, {seed})), 1, 15) AS BIGINT)")
FOLD_EXPR = "(" + ROW_HASH + " % {k})"

ORACLE: dict[str, str] = {}


def nunique(c: str) -> str:
    return f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)"


def rnd(expr: str) -> str:
    """Same rounding as ``round_half_up`` (floor(x*1e6 + 0.5) / 1e6)."""
    x = f"CAST(({expr}) AS DOUBLE)"
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) >= CAST(1e12 AS DOUBLE) THEN {x} "
            f"ELSE CAST(floor({x} * CAST(1000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST(1000000.0 AS DOUBLE) END)")


def r4(expr: str, alias: str) -> str:
    return f"{rnd(expr)} AS {alias}"



ORACLE["route_features"] = with_market_extra("""
rs AS (
  SELECT ODPairID,
    avg(Average_Fare) AS route_avg_fare,
    stddev_samp(Average_Fare) AS route_std_fare,
    CAST(count(DISTINCT Carrier) + max(CASE WHEN Carrier IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS route_carrier_count,
    CAST(coalesce(sum(Pax), 0) AS BIGINT) AS route_total_pax,
    avg(Market_share) AS route_avg_market_share,
    arg_min(Market_HHI, l_orderkey * 16 + l_linenumber) AS route_hhi
  FROM market GROUP BY ODPairID
)""", f"""
SELECT {KEY}, m.ODPairID,
  {r4('route_avg_fare', 'route_avg_fare')}, {r4('route_std_fare', 'route_std_fare')},
  route_carrier_count, route_total_pax,
  {r4('route_avg_market_share', 'route_avg_market_share')}, {r4('route_hhi', 'route_hhi')},
  CASE WHEN route_carrier_count = 1 THEN 0 WHEN route_carrier_count <= 3 THEN 1 ELSE 2 END AS route_competition_level
FROM market m LEFT JOIN rs ON m.ODPairID = rs.ODPairID
""")


CARRIER_CTE = f"""
cs AS (
  SELECT Carrier, avg(Average_Fare) AS carrier_avg_fare, {nunique('ODPairID')} AS carrier_route_count,
    avg(NonStopMiles) AS carrier_avg_distance,
    CAST(sum(CarrierPax) AS DOUBLE) / (SELECT CAST(sum(Pax) AS DOUBLE) FROM market) AS carrier_pax_share
  FROM market GROUP BY Carrier
)"""

ORACLE["carrier_features"] = with_market_extra(CARRIER_CTE, f"""
SELECT {KEY}, m.Carrier, {r4('carrier_avg_fare', 'carrier_avg_fare')}, carrier_route_count,
  {r4('carrier_avg_distance', 'carrier_avg_distance')}, {r4('carrier_pax_share', 'carrier_pax_share')}
FROM market m LEFT JOIN cs ON m.Carrier = cs.Carrier""")


def hub_cte(col: str, tag: str, src: str = "market") -> str:
    return f"""
f{tag} AS (SELECT {col} AS v, count(*) AS cnt FROM {src} GROUP BY {col}),
t{tag} AS (
  SELECT min(cnt) AS thr FROM (
    SELECT cnt, sum(m) OVER (ORDER BY cnt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM (SELECT cnt, count(*) AS m FROM f{tag} GROUP BY cnt))
  WHERE cum > (SELECT floor(CAST(0.95 AS DOUBLE) * (count(*) - 1) + CAST(0.5 AS DOUBLE)) FROM f{tag})
),
h{tag} AS (SELECT v FROM f{tag}, t{tag} WHERE cnt >= thr)"""


def hub_flag(col: str, tag: str, alias: str) -> str:
    return (f"CAST(CASE WHEN m.{col} IS NULL THEN NULL WHEN h{tag}.v IS NOT NULL THEN 1 ELSE 0 END AS TINYINT) AS {alias}")


HUB_CTES = hub_cte("OriginAirportID", "org") + "," + hub_cte("DestAirportID", "dst")
HUB_JOINS = ("LEFT JOIN horg ON m.OriginAirportID = horg.v LEFT JOIN hdst ON m.DestAirportID = hdst.v")

ORACLE["market_features"] = with_market_extra(HUB_CTES, f"""
SELECT {KEY},
  {r4('Average_Fare / CASE WHEN NonStopMiles IS NULL THEN NULL ELSE greatest(NonStopMiles, CAST(1.0 AS DOUBLE)) END', 'fare_per_mile')},
  {r4('CASE WHEN Circuity IS NULL THEN NULL ELSE greatest(Circuity - CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)) END', 'circuity_premium')},
  {hub_flag('OriginAirportID', 'org', 'is_hub_origin')}, {hub_flag('DestAirportID', 'dst', 'is_hub_dest')}
FROM market m {HUB_JOINS}""")

ORACLE["hub_flags"] = with_market_extra(HUB_CTES, f"""
SELECT is_hub_origin, is_hub_dest, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(DISTINCT OriginAirportID) AS BIGINT) AS n_origins, CAST(count(DISTINCT DestAirportID) AS BIGINT) AS n_dests
FROM (SELECT m.OriginAirportID, m.DestAirportID, {hub_flag('OriginAirportID', 'org', 'is_hub_origin')},
        {hub_flag('DestAirportID', 'dst', 'is_hub_dest')} FROM market m {HUB_JOINS})
GROUP BY is_hub_origin, is_hub_dest""")

ID_COLS = ["OriginCityMarketID", "DestCityMarketID", "OriginAirportID", "DestAirportID", "ODPairID"]


def freq_ctes(src: str = "market") -> str:
    return ",".join(f"""
fq_{c} AS (SELECT {c} AS v, CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM {src}) AS e
           FROM {src} GROUP BY {c})""" for c in ID_COLS)


FREQ_JOINS = " ".join(f"LEFT JOIN fq_{c} ON m.{c} = fq_{c}.v" for c in ID_COLS)

ORACLE["frequency_encode"] = with_market_extra(freq_ctes(), f"""
SELECT {KEY}, {', '.join(r4(f'fq_{c}.e', f'{c}_freq_enc') for c in ID_COLS)}
FROM market m {FREQ_JOINS}""")


def target_enc_ctes(smoothing: float, src: str = "market", col: str = "Carrier") -> str:
    fold = FOLD_EXPR.format(seed=42, k=5)
    return f"""
tb AS (SELECT *, CAST({fold} AS INTEGER) AS fold FROM {src}),
tg AS (SELECT avg(Average_Fare) AS g FROM {src}),
tcf AS (SELECT {col} AS cat, fold, sum(Average_Fare) AS S, CAST(count(Average_Fare) AS BIGINT) AS n FROM tb GROUP BY {col}, fold),
tct AS (SELECT cat, sum(S) AS St, CAST(sum(n) AS BIGINT) AS nt FROM tcf GROUP BY cat),
tenc AS (
  SELECT tcf.cat, tcf.fold,
    CASE WHEN nt - n > 0 THEN (coalesce(St, 0) - coalesce(S, 0) + CAST({smoothing} AS DOUBLE) * g)
                                / (CAST(nt - n AS DOUBLE) + CAST({smoothing} AS DOUBLE)) END AS e
  FROM tcf JOIN tct ON tcf.cat = tct.cat, tg
)"""


TENC_SELECT = f"""
SELECT {KEY}, tb.Carrier, {r4('coalesce(tenc.e, tg.g)', 'Carrier_target_enc')}
FROM tb LEFT JOIN tenc ON tb.Carrier = tenc.cat AND tb.fold = tenc.fold, tg"""

ORACLE["target_encode"] = with_market_extra(target_enc_ctes(10.0), TENC_SELECT)
ORACLE["target_encode_unsmoothed"] = with_market_extra(target_enc_ctes(0.0), TENC_SELECT)

ORACLE["route_mean_std"] = with_market_extra("""
rs AS (SELECT ODPairID, avg(Average_Fare) AS a, coalesce(stddev_samp(Average_Fare), 0) AS s FROM market GROUP BY ODPairID)""",
f"""SELECT {KEY}, m.ODPairID, {r4('a', 'route_avg_fare')}, {r4('s', 'route_std_fare')}
FROM market m LEFT JOIN rs ON m.ODPairID = rs.ODPairID""")

ORACLE["fare_per_mile_safe"] = with_dirty(f"""
SELECT {KEY}, {r4('Average_Fare', 'Average_Fare')}, {r4('NonStopMiles', 'NonStopMiles')},
  {r4("CASE WHEN NonStopMiles = 0 THEN (CASE WHEN Average_Fare = 0 THEN CAST('nan' AS DOUBLE) ELSE 0.0 END) ELSE Average_Fare / NonStopMiles END", 'fare_per_mile')}
FROM market_dirty""")

MARKET_COLS = ["MktCoupons", "OriginCityMarketID", "DestCityMarketID", "OriginAirportID",
               "DestAirportID", "Carrier", "NonStopMiles", "RoundTrip", "ODPairID", "Pax",
               "CarrierPax", "Average_Fare", "Market_share", "Market_HHI", "LCC_Comp",
               "Multi_Airport", "Circuity", "Slot", "Non_Stop", "MktMilesFlown"]
DOUBLE_COLS = {"NonStopMiles", "Average_Fare", "Market_share", "Market_HHI", "Circuity", "MktMilesFlown"}
DIRTY_COLS = MARKET_COLS + ["Carrier_freq", "ODPairID_freq"]


def rounded_cols(cols, prefix: str = "") -> str:
    return ", ".join(r4(prefix + c, c) if c in DOUBLE_COLS or c.endswith("_freq") else prefix + c
                     for c in cols)


ORACLE["validate_market"] = with_dirty("""
SELECT total_rows, negative_fares, zero_fares, missing_target, negative_distances, impossible_circuity,
  duplicate_rows,
  concat_ws('; ',
    CASE WHEN negative_fares > 0 THEN CAST(negative_fares AS VARCHAR) || ' rows with negative Average_Fare' END,
    CASE WHEN zero_fares > 0 THEN CAST(zero_fares AS VARCHAR) || ' rows with zero Average_Fare' END,
    CASE WHEN missing_target > 0 THEN CAST(missing_target AS VARCHAR) || ' rows with missing Average_Fare' END,
    CASE WHEN neg_a > 0 THEN CAST(neg_a AS VARCHAR) || ' rows with negative NonStopMiles' END,
    CASE WHEN neg_b > 0 THEN CAST(neg_b AS VARCHAR) || ' rows with negative MktMilesFlown' END,
    CASE WHEN impossible_circuity > 0 THEN CAST(impossible_circuity AS VARCHAR) || ' rows with impossibly low Circuity' END,
    CASE WHEN duplicate_rows > 0 THEN CAST(duplicate_rows AS VARCHAR) || ' duplicate rows' END) AS issues,
  (negative_fares + zero_fares + missing_target + negative_distances + impossible_circuity + duplicate_rows) = 0 AS is_clean
FROM (
  SELECT CAST(count(*) AS BIGINT) AS total_rows,
    CAST(sum(CASE WHEN Average_Fare < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_fares,
    CAST(sum(CASE WHEN Average_Fare = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_fares,
    CAST(sum(CASE WHEN Average_Fare IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_target,
    CAST(sum(CASE WHEN NonStopMiles < 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg_a,
    CAST(sum(CASE WHEN MktMilesFlown < 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg_b,
    CAST(sum(CASE WHEN NonStopMiles < 0 THEN 1 ELSE 0 END) + sum(CASE WHEN MktMilesFlown < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_distances,
    CAST(sum(CASE WHEN Circuity < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS impossible_circuity,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT """ + ", ".join(DIRTY_COLS) + """ FROM market_dirty)) AS BIGINT) AS duplicate_rows
  FROM market_dirty)""")

_clean_casts = ", ".join(
    f"CAST({c} AS FLOAT) AS {c}" if c in DOUBLE_COLS else (c if c == "Carrier" else f"CAST({c} AS INTEGER) AS {c}")
    for c in MARKET_COLS)
ORACLE["clean_market"] = with_dirty(f"""
SELECT {_clean_casts} FROM (
  SELECT DISTINCT {', '.join(MARKET_COLS)} FROM market_dirty
  WHERE Average_Fare IS NOT NULL AND Average_Fare > 0 AND NonStopMiles >= 0 AND MktMilesFlown >= 0)""")

ORACLE["downcast"] = with_market(f"SELECT {_clean_casts} FROM market")

ORACLE["clean_strict"] = with_dirty(f"""
SELECT {rounded_cols(DIRTY_COLS)} FROM (
  SELECT DISTINCT {', '.join(DIRTY_COLS)} FROM market_dirty
  WHERE Average_Fare IS NOT NULL AND Average_Fare >= 1.0 AND NonStopMiles > 0)""")

ORACLE["dedup"] = with_dirty(f"""
SELECT {rounded_cols(DIRTY_COLS)} FROM (SELECT DISTINCT {', '.join(DIRTY_COLS)} FROM market_dirty)""")

_ROUTE_STATS = f"""
rs AS (
  SELECT ODPairID, avg(Average_Fare) AS route_avg_fare, stddev_samp(Average_Fare) AS route_std_fare,
    {nunique('Carrier')} AS route_carrier_count, CAST(coalesce(sum(Pax), 0) AS BIGINT) AS route_total_pax,
    avg(Market_share) AS route_avg_market_share,
    arg_min(Market_HHI, l_orderkey * 16 + l_linenumber) AS route_hhi
  FROM market GROUP BY ODPairID
)"""

ORACLE["build_features"] = with_market_extra(
    _ROUTE_STATS + "," + CARRIER_CTE + "," + HUB_CTES + "," + freq_ctes() + "," + target_enc_ctes(10.0),
    f"""
SELECT {KEY}, {rounded_cols(MARKET_COLS, 'm.')},
  {r4('rs.route_avg_fare', 'route_avg_fare')}, {r4('rs.route_std_fare', 'route_std_fare')},
  rs.route_carrier_count, rs.route_total_pax, {r4('rs.route_avg_market_share', 'route_avg_market_share')},
  {r4('rs.route_hhi', 'route_hhi')},
  CASE WHEN rs.route_carrier_count = 1 THEN 0 WHEN rs.route_carrier_count <= 3 THEN 1 ELSE 2 END AS route_competition_level,
  {r4('carrier_avg_fare', 'carrier_avg_fare')}, carrier_route_count,
  {r4('carrier_avg_distance', 'carrier_avg_distance')}, {r4('carrier_pax_share', 'carrier_pax_share')},
  {r4('m.Average_Fare / CASE WHEN m.NonStopMiles IS NULL THEN NULL ELSE greatest(m.NonStopMiles, CAST(1.0 AS DOUBLE)) END', 'fare_per_mile')},
  {r4('CASE WHEN m.Circuity IS NULL THEN NULL ELSE greatest(m.Circuity - CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)) END', 'circuity_premium')},
  {hub_flag('OriginAirportID', 'org', 'is_hub_origin')}, {hub_flag('DestAirportID', 'dst', 'is_hub_dest')},
  {', '.join(r4(f'fq_{c}.e', f'{c}_freq_enc') for c in ID_COLS)},
  {r4('coalesce(tenc.e, tg.g)', 'Carrier_target_enc')}
FROM market m
LEFT JOIN rs ON m.ODPairID = rs.ODPairID
LEFT JOIN cs ON m.Carrier = cs.Carrier
{HUB_JOINS} {FREQ_JOINS}
JOIN tb ON tb.l_orderkey = m.l_orderkey AND tb.l_linenumber = m.l_linenumber AND tb.l_partkey = m.l_partkey
   AND tb.l_suppkey = m.l_suppkey AND tb.l_shipdate = m.l_shipdate
LEFT JOIN tenc ON m.Carrier = tenc.cat AND tb.fold = tenc.fold
CROSS JOIN tg""".replace(f"SELECT {KEY},", "SELECT " + ", ".join("m." + k.strip() for k in KEY.split(",")) + ",", 1))

# ---------------------------------------------------------------- profiling
DIRTY_TYPES = [(c, "string" if c == "Carrier" else ("double" if (c in DOUBLE_COLS or c.endswith("_freq")) else "bigint"))
               for c in DIRTY_COLS]


def _profile_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(DIRTY_TYPES):
        if t == "string":
            stats = ", ".join(f"CAST(NULL AS DOUBLE) AS {a}" for a in ["mean", "std", "min", "p25", "p50", "p75", "max"])
        else:
            x = f"CAST({c} AS DOUBLE)"
            stats = ", ".join([r4(f"avg({x})", "mean"), r4(f"stddev_samp({x})", "std"), r4(f"min({x})", "min"),
                               r4(f"quantile_cont({x}, 0.25)", "p25"), r4(f"quantile_cont({x}, 0.5)", "p50"),
                               r4(f"quantile_cont({x}, 0.75)", "p75"), r4(f"max({x})", "max")])
        parts.append(f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, CAST(count(*) AS BIGINT) AS row_count, "
                     f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, {stats} FROM market_dirty")
    return "\nUNION ALL\n".join(parts)


ORACLE["profile_columns"] = with_dirty(_profile_sql())

ORACLE["null_counts"] = with_dirty("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count FROM market_dirty"
    for c in DIRTY_COLS))

_KEY_COLS = [k.strip() for k in KEY.split(",")]
ORACLE["null_counts_head"] = with_dirty("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(coalesce(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS null_count FROM h"
    for c in _KEY_COLS + DIRTY_COLS), ctes=f"h AS (SELECT * FROM market_dirty ORDER BY {KEY} LIMIT 1000)")

ORACLE["missing_pct"] = with_dirty('SELECT "column", ' + r4("CAST(nc AS DOUBLE) * 100.0 / CAST(n AS DOUBLE)", "missing_pct")
                                   + " FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS nc, count(*) AS n FROM market_dirty"
    for c in DIRTY_COLS) + ") WHERE nc > 0")

NUMERIC_MARKET = [c for c in MARKET_COLS if c != "Carrier"]


def _describe_sql() -> str:
    stats = [("count", "count({c})"), ("null_count", "sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"),
             ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
             ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
             ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})")]
    parts = []
    for label, f in stats:
        cols = ", ".join(r4(f.format(c=f"CAST({c} AS DOUBLE)"), c) for c in NUMERIC_MARKET)
        parts.append(f"SELECT '{label}' AS statistic, {cols} FROM market")
    return "\nUNION ALL\n".join(parts)


ORACLE["describe_numeric"] = with_market(_describe_sql())

ORACLE["cardinality_top"] = with_market(
    'SELECT "column", n_unique, position FROM (' + "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS column, {nunique(c)} AS n_unique FROM market"
        for i, c in enumerate(MARKET_COLS)) + ") ORDER BY n_unique DESC, position ASC LIMIT 20")

CORR_COLS = ["MktCoupons", "NonStopMiles", "Pax", "CarrierPax", "Market_share", "Market_HHI", "Circuity",
             "MktMilesFlown", "Average_Fare"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j in range(i, len(CORR_COLS)):
            b = CORR_COLS[j]
            x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            r = f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r4(r, 'corr')} FROM market")
            if i != j:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {r4(r, 'corr')} FROM market")
    return "\nUNION ALL\n".join(parts)


ORACLE["correlation_matrix"] = with_market(_corr_sql())


def _hist_sql(expr: str, bins: int) -> str:
    nb = f"CAST({bins}.0 AS DOUBLE)"
    return with_market_extra(f"""
hv AS (SELECT CAST({expr} AS DOUBLE) AS v FROM market),
hv2 AS (SELECT v FROM hv WHERE v IS NOT NULL AND NOT isnan(v)),
hr AS (SELECT min(v) AS lo, max(v) AS hi FROM hv2),
hc AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 1 ELSE least(floor((v - lo) * {nb} / (hi - lo)) + 1, {bins}) END AS INTEGER) AS bin,
              count(*) AS cnt FROM hv2, hr GROUP BY 1),
hg AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1}))""", f"""
SELECT hg.bin, {r4(f'lo + (hi - lo) * CAST(hg.bin - 1 AS DOUBLE) / {nb}', 'bin_lo')},
  {r4(f'lo + (hi - lo) * CAST(hg.bin AS DOUBLE) / {nb}', 'bin_hi')}, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM hg CROSS JOIN hr LEFT JOIN hc ON hg.bin = hc.bin WHERE lo IS NOT NULL""")


ORACLE["fare_histogram"] = _hist_sql("Average_Fare", 100)
ORACLE["log_histogram"] = _hist_sql("ln(1 + Average_Fare)", 100)
ORACLE["hhi_histogram"] = _hist_sql("Market_HHI", 50)

ORACLE["hhi_concentration"] = with_market(f"""
SELECT n_rows, concentrated_rows, n_routes, concentrated_routes,
  {r4('CAST(concentrated_rows AS DOUBLE) / CAST(n_rows AS DOUBLE)', 'concentrated_share')}
FROM (SELECT CAST(count(*) AS BIGINT) AS n_rows,
        CAST(sum(CASE WHEN Market_HHI > 2500 THEN 1 ELSE 0 END) AS BIGINT) AS concentrated_rows,
        CAST(count(DISTINCT ODPairID) AS BIGINT) AS n_routes,
        CAST(count(DISTINCT CASE WHEN Market_HHI > 2500 THEN ODPairID END) AS BIGINT) AS concentrated_routes
      FROM market)""")


def _box_sql(src_cte: str, group_cols: list[str]) -> str:
    g = ", ".join(group_cols)
    gq = ", ".join(f"bq.{c}" for c in group_cols)
    on = " AND ".join(f"bq.{c} = bv.{c}" for c in group_cols)
    return with_market_extra(src_cte + f""",
bq AS (SELECT {g}, CAST(count(*) AS BIGINT) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
              quantile_cont(x, 0.75) AS q3 FROM bv GROUP BY {g})""", f"""
SELECT {gq}, bq.n, {r4('bq.q1', 'q1')}, {r4('bq.median', 'median')}, {r4('bq.q3', 'q3')},
  {r4('min(CASE WHEN x >= bq.q1 - 1.5 * (bq.q3 - bq.q1) THEN x END)', 'whisker_lo')},
  {r4('max(CASE WHEN x <= bq.q3 + 1.5 * (bq.q3 - bq.q1) THEN x END)', 'whisker_hi')}
FROM bq JOIN bv ON {on}
GROUP BY {gq}, bq.n, bq.q1, bq.median, bq.q3""")


ORACLE["carrier_fare_box"] = _box_sql("""
btop AS (SELECT Carrier FROM market WHERE Carrier IS NOT NULL GROUP BY Carrier ORDER BY count(*) DESC, Carrier ASC LIMIT 15),
bv AS (SELECT Carrier, CAST(Average_Fare AS DOUBLE) AS x FROM market
       WHERE Carrier IN (SELECT Carrier FROM btop) AND Average_Fare IS NOT NULL AND NOT isnan(Average_Fare))""",
                                      ["Carrier"])

BIN_COLS = ["RoundTrip", "LCC_Comp", "Multi_Airport", "Slot", "Non_Stop"]
ORACLE["binary_fare_box"] = _box_sql("bv AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS BIGINT) AS flag_value, CAST(Average_Fare AS DOUBLE) AS x FROM market "
    f"WHERE Average_Fare IS NOT NULL AND NOT isnan(Average_Fare)" for c in BIN_COLS) + ")", ["feature", "flag_value"])

ORACLE["overview_metrics"] = with_market(f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, {r4('avg(Average_Fare)', 'avg_fare')},
  CAST(coalesce(sum(Pax), 0) AS BIGINT) AS total_pax, {nunique('ODPairID')} AS n_routes, {nunique('Carrier')} AS n_carriers
FROM market""")

ORACLE["top_routes"] = with_market(f"""
SELECT ODPairID, {r4('avg_fare', 'avg_fare')}, n_records FROM (
  SELECT ODPairID, avg(Average_Fare) AS avg_fare, CAST(count(Average_Fare) AS BIGINT) AS n_records
  FROM market GROUP BY ODPairID HAVING count(Average_Fare) >= 10
  ORDER BY avg_fare DESC, ODPairID ASC LIMIT 20)""")

ORACLE["top_carriers"] = with_market("""
SELECT Carrier, CAST(count(*) AS BIGINT) AS n_rows FROM market WHERE Carrier IS NOT NULL GROUP BY Carrier
ORDER BY n_rows DESC, Carrier ASC LIMIT 15""")

ORACLE["preview"] = with_market(f"""
SELECT {KEY}, {rounded_cols(MARKET_COLS)} FROM market ORDER BY {KEY} LIMIT 100""")

# ---------------------------------------------------------------- sampling / splits
HASH_EXPR = ROW_HASH.format(seed=42)
BUCKET100 = FOLD_EXPR.format(seed=42, k=100)

ORACLE["hash_sample"] = with_market(f"""
SELECT {KEY}, {rounded_cols(MARKET_COLS)} FROM market ORDER BY {HASH_EXPR}, {KEY} LIMIT 10000""")

ORACLE["fraction_sample"] = with_market(f"""
SELECT {KEY}, {rounded_cols(MARKET_COLS)} FROM market WHERE {BUCKET100} < 20""")

SPLIT_EXPR = f"CASE WHEN {BUCKET100} < 70 THEN 'train' WHEN {BUCKET100} < 85 THEN 'val' ELSE 'test' END"
ORACLE["train_val_test_split"] = with_market(f"SELECT {KEY}, {SPLIT_EXPR} AS split FROM market")
ORACLE["fold_assignment"] = with_market(f"SELECT {KEY}, CAST({FOLD_EXPR.format(seed=42, k=5)} AS INTEGER) AS fold FROM market")

# ---------------------------------------------------------------- scenarios
SCEN_BASE = """
rb AS (SELECT ODPairID, avg(Average_Fare) AS base_fare, CAST(coalesce(sum(Pax), 0) AS DOUBLE) AS base_demand
       FROM market GROUP BY ODPairID)"""


def _scen_cte(values_sql: str, e: float = -1.2) -> str:
    return SCEN_BASE + f""",
rp AS (SELECT p FROM ({values_sql}) t(p)),
rsc AS (
  SELECT ODPairID, p AS price_change, printf('%+.0f%%', p * CAST(100.0 AS DOUBLE)) AS scenario,
    base_fare, base_demand, base_fare * base_demand AS base_revenue,
    base_fare * (CAST(1.0 AS DOUBLE) + p) AS new_fare,
    CASE WHEN base_demand * (CAST(1.0 AS DOUBLE) + CAST({e} AS DOUBLE) * p) IS NULL THEN NULL
         ELSE greatest(base_demand * (CAST(1.0 AS DOUBLE) + CAST({e} AS DOUBLE) * p), CAST(0.0 AS DOUBLE)) END AS new_demand
  FROM rb CROSS JOIN rp
),
rsv AS (SELECT *, new_fare * new_demand AS new_revenue, new_fare * new_demand - base_revenue AS revenue_change FROM rsc)"""


SCEN_VALUES = "VALUES " + ", ".join(f"(CAST({v} AS DOUBLE))" for v in [-0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2])
GRID_VALUES = "SELECT CAST(range AS DOUBLE) / CAST(20.0 AS DOUBLE) FROM range(-4, 5)"
SCEN_OUT = ("ODPairID, " + r4("price_change", "price_change") + ", scenario, " +
            ", ".join(r4(c, c) for c in ["base_fare", "base_demand", "base_revenue", "new_fare", "new_demand",
                                         "new_revenue", "revenue_change"]))

ORACLE["revenue_scenarios"] = with_market_extra(_scen_cte(SCEN_VALUES), f"SELECT {SCEN_OUT} FROM rsv")
ORACLE["price_grid"] = with_market_extra(_scen_cte(GRID_VALUES), f"SELECT {SCEN_OUT} FROM rsv")
ORACLE["route_scenarios"] = with_market_extra(_scen_cte(SCEN_VALUES), f"""
SELECT {SCEN_OUT} FROM rsv WHERE ODPairID = (
  SELECT ODPairID FROM rb ORDER BY base_demand DESC, ODPairID ASC LIMIT 1)""")
ORACLE["revenue_ranking"] = with_market_extra(_scen_cte(SCEN_VALUES) + """,
rbest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ODPairID ORDER BY new_revenue DESC, abs(price_change) ASC) AS rn
                 FROM rsv) WHERE rn = 1)""", f"""
SELECT ODPairID, {r4('price_change', 'best_price_change')}, {r4('new_fare', 'best_fare')}, {r4('new_demand', 'best_demand')},
  {r4('new_revenue', 'best_revenue')}, {r4('base_revenue', 'base_revenue')}, {r4('new_revenue - base_revenue', 'uplift')}
FROM rbest""")

ORACLE["route_summary"] = with_market(f"""
SELECT ODPairID, {r4('avg(Average_Fare)', 'avg_fare')}, {r4('stddev_samp(Average_Fare)', 'std_fare')},
  {r4('quantile_cont(Average_Fare, 0.5)', 'median_fare')}, CAST(coalesce(sum(Pax), 0) AS BIGINT) AS total_pax,
  {nunique('Carrier')} AS n_carriers,
  {r4("arg_min(NonStopMiles, l_orderkey * 16 + l_linenumber)", 'distance')},
  {r4("arg_min(Market_HHI, l_orderkey * 16 + l_linenumber)", 'hhi')},
  CAST(count(*) AS BIGINT) AS n_records
FROM market GROUP BY ODPairID""")

# ---------------------------------------------------------------- sequences
SEQ_FEATURES = ["MktCoupons", "NonStopMiles", "RoundTrip", "Pax", "CarrierPax", "Market_share", "Market_HHI",
                "LCC_Comp", "Multi_Airport", "Circuity", "Slot", "Non_Stop", "MktMilesFlown"]


def _f32(c: str) -> str:
    x = f"CAST({c} AS FLOAT)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN CAST(0.0 AS FLOAT) ELSE {x} END"


ORACLE["route_sequences"] = with_market_extra(f"""
sq AS (SELECT ODPairID, row_number() OVER (PARTITION BY ODPairID ORDER BY {KEY}) AS pos,
              {', '.join(_f32(c) + ' AS ' + c for c in SEQ_FEATURES)} FROM market),
st AS (SELECT ODPairID, avg(Average_Fare) AS target FROM market GROUP BY ODPairID HAVING avg(Average_Fare) IS NOT NULL),
sg AS (SELECT st.ODPairID, st.target, CAST(g.range AS INTEGER) AS pos FROM st CROSS JOIN range(1, 11) g)""", f"""
SELECT sg.ODPairID, sg.pos, {r4('sg.target', 'target')},
  {r4('CASE WHEN sq.pos IS NULL THEN 0.0 ELSE 1.0 END', 'mask')},
  {', '.join(r4(f'coalesce(sq.{c}, CAST(0.0 AS FLOAT))', 'f_' + c) for c in SEQ_FEATURES)}
FROM sg LEFT JOIN sq ON sg.ODPairID = sq.ODPairID AND sg.pos = sq.pos""")

# ---------------------------------------------------------------- baselines / metrics
_SPLIT_CTE = f"""
sp AS (SELECT *, {SPLIT_EXPR} AS split FROM market),
trn AS (SELECT * FROM sp WHERE split = 'train'),
tst AS (SELECT * FROM sp WHERE split = 'test'),
gm AS (SELECT avg(Average_Fare) AS g FROM trn),
cm AS (SELECT Carrier, avg(Average_Fare) AS m FROM trn WHERE Carrier IS NOT NULL GROUP BY Carrier),
rm AS (SELECT ODPairID, avg(Average_Fare) AS m FROM trn WHERE ODPairID IS NOT NULL GROUP BY ODPairID),
preds AS (
  SELECT 'global_mean' AS model, {KEY}, Average_Fare AS y, g AS prediction FROM tst, gm
  UNION ALL
  SELECT 'carrier_mean', {', '.join('t.' + k for k in _KEY_COLS)}, t.Average_Fare, coalesce(cm.m, gm.g)
  FROM tst t LEFT JOIN cm ON t.Carrier = cm.Carrier CROSS JOIN gm
  UNION ALL
  SELECT 'route_mean', {', '.join('t.' + k for k in _KEY_COLS)}, t.Average_Fare, coalesce(rm.m, gm.g)
  FROM tst t LEFT JOIN rm ON t.ODPairID = rm.ODPairID CROSS JOIN gm
)"""

for _name, _model in [("baseline_global_mean", "global_mean"), ("baseline_carrier_mean", "carrier_mean"),
                      ("baseline_route_mean", "route_mean")]:
    ORACLE[_name] = with_market_extra(_SPLIT_CTE, f"""
SELECT {KEY}, {r4('y', 'y')}, {r4('prediction', 'prediction')} FROM preds WHERE model = '{_model}'""")

_METRICS_CTE = _SPLIT_CTE + """,
mets AS (
  SELECT model, CAST(count(y - prediction) AS BIGINT) AS n,
    avg(abs(y - prediction)) AS mae,
    sqrt(avg((y - prediction) * (y - prediction))) AS rmse,
    100.0 * avg(CASE WHEN y IS NOT NULL AND prediction IS NOT NULL AND y <> 0 THEN abs(y - prediction) / abs(y) END) AS mape,
    100.0 * avg(CASE WHEN y IS NOT NULL AND prediction IS NOT NULL THEN
                  (CASE WHEN abs(y) + abs(prediction) = 0 THEN 0.0 ELSE 2.0 * abs(y - prediction) / (abs(y) + abs(prediction)) END) END) AS smape,
    CASE WHEN var_pop(CASE WHEN prediction IS NOT NULL THEN y END) * count(y - prediction) > 0
         THEN 1.0 - sum((y - prediction) * (y - prediction))
                    / (var_pop(CASE WHEN prediction IS NOT NULL THEN y END) * count(y - prediction)) END AS r2
  FROM preds GROUP BY model
)"""
_MET_OUT = "model, n, " + ", ".join(r4(m, m) for m in ["mae", "rmse", "mape", "smape", "r2"])
ORACLE["regression_metrics"] = with_market_extra(_METRICS_CTE, f"SELECT {_MET_OUT} FROM mets")
ORACLE["model_comparison"] = with_market_extra(_METRICS_CTE, f"""
SELECT {_MET_OUT}, CAST(row_number() OVER (ORDER BY rmse ASC NULLS LAST, model ASC) AS INTEGER) AS rank_rmse,
  mae = min(mae) OVER () AS best_mae, rmse = min(rmse) OVER () AS best_rmse, mape = min(mape) OVER () AS best_mape,
  smape = min(smape) OVER () AS best_smape, r2 = max(r2) OVER () AS best_r2
FROM mets""")

# ---------------------------------------------------------------- sources / sinks
_MARKET_KEYED = f"SELECT {KEY}, {rounded_cols(MARKET_COLS)} FROM market"
ORACLE["scan_csv"] = with_market(_MARKET_KEYED)
ORACLE["concat_files"] = with_market(_MARKET_KEYED)
ORACLE["concat_files_drift"] = with_market(f"""
SELECT {KEY}, {rounded_cols(MARKET_COLS)} FROM (
  SELECT * REPLACE (CASE WHEN RoundTrip <> 1 THEN Slot END AS Slot, CASE WHEN RoundTrip = 1 THEN Circuity END AS Circuity)
  FROM market)""")
ORACLE["ingest_validated"] = ORACLE["validate_market"]
ORACLE["incremental_ingest"] = with_market(_MARKET_KEYED)
ORACLE["row_count"] = with_market("SELECT CAST(count(*) AS BIGINT) AS row_count FROM market")
ORACLE["parquet_roundtrip"] = with_dirty(f"""
SELECT {rounded_cols(MARKET_COLS)} FROM (
  SELECT DISTINCT {', '.join(MARKET_COLS)} FROM market_dirty
  WHERE Average_Fare IS NOT NULL AND Average_Fare > 0 AND NonStopMiles >= 0 AND MktMilesFlown >= 0)""")
ORACLE["csv_export"] = ORACLE["revenue_scenarios"]
ORACLE["export_bundle"] = ORACLE["route_summary"]
ORACLE["json_metrics_union"] = with_market_extra(_METRICS_CTE, "\nUNION ALL\n".join(
    f"SELECT model, '{m}' AS metric, {rnd(m)} AS value FROM mets" for m in ["mae", "rmse", "mape", "smape", "r2"]))


# ---------------------------------------------------------------- further parameters of the operators above
ORACLE["split_80_20"] = with_market(f"""
SELECT {KEY}, CASE WHEN {BUCKET100} < 80 THEN 'train' ELSE 'test' END AS split FROM market""")
ORACLE["scenarios_carrier_demand"] = with_market_extra(
    _scen_cte(SCEN_VALUES).replace("sum(Pax)", "sum(CarrierPax)"), f"SELECT {SCEN_OUT} FROM rsv")
ORACLE["scan_csv_recursive"] = ORACLE["scan_csv"]
ORACLE["preview_routes"] = with_market("SELECT DISTINCT ODPairID FROM market ORDER BY ODPairID LIMIT 50")

# ---------------------------------------------------------------- boosted trees
MODEL_COLS = ["MktCoupons", "NonStopMiles", "RoundTrip", "Pax", "CarrierPax", "Market_share", "Market_HHI",
              "LCC_Comp", "Multi_Airport", "Circuity", "Slot", "Non_Stop", "MktMilesFlown"]
_LONG = " UNION ALL ".join(f"SELECT {k} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, g FROM t" for k, c in enumerate(MODEL_COLS))
ORACLE["boost_first_split"] = with_market(f"""
SELECT feature, floor(threshold * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS threshold, left_rows, right_rows,
       floor(gain_share * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS gain_share
FROM (
  WITH s AS (SELECT *, CAST(Average_Fare AS DOUBLE) AS y FROM market WHERE {BUCKET100} < 70 AND Average_Fare IS NOT NULL),
  t AS (SELECT s.*, (SELECT avg(y) FROM s) - y AS g FROM s),
  l AS ({_LONG}),
  r AS (SELECT f, min(x) AS lo, max(x) AS hi, sum(g) AS sg, count(*) AS n FROM l GROUP BY f),
  e AS (SELECT DISTINCT f, lo + (hi - lo) * k / 32.0::DOUBLE AS edge FROM r, range(1, 32) u(k)),
  b AS (SELECT l.f, l.feature, l.x, sum(l.g) AS g, count(*) AS n FROM l GROUP BY ALL),
  c AS (SELECT b.f, any_value(b.feature) AS feature, e.edge AS threshold, sum(b.g) AS gl, sum(b.n)::BIGINT AS nl
        FROM b JOIN e ON b.f = e.f AND b.x <= e.edge GROUP BY b.f, e.edge)
  SELECT c.f, c.feature, c.threshold, c.nl AS left_rows, (r.n - c.nl)::BIGINT AS right_rows,
         (gl * gl / (nl + 1) + (sg - gl) * (sg - gl) / (n - nl + 1) - sg * sg / (n + 1)) / (SELECT sum(g * g) FROM t) AS gain_share
  FROM c JOIN r ON c.f = r.f WHERE r.n - c.nl >= 1
) ORDER BY gain_share DESC, f, threshold LIMIT 1""")

ORACLE["ordered_target_stat"] = with_market(f"""
SELECT {KEY}, floor(te * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS Carrier_ordered_te
FROM (
  SELECT {KEY}, (coalesce(sum(Average_Fare) OVER w, 0) + (SELECT avg(Average_Fare) FROM market)) / (count(Average_Fare) OVER w + 1) AS te
  FROM market
  WINDOW w AS (PARTITION BY Carrier ORDER BY {ROW_HASH.format(seed=42)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")


# ---------------------------------------------------------------- profiles of files and of all columns
_BIGINT_COLS = ["MktCoupons", "OriginCityMarketID", "DestCityMarketID", "OriginAirportID", "DestAirportID", "RoundTrip", "ODPairID", "Pax",
                "CarrierPax", "LCC_Comp", "Multi_Airport", "Slot", "Non_Stop"]


def _file_profile_sql(group: str, label: str) -> str:
    six = lambda e, a: f"floor(({e}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS {a}"
    parts = []
    for c in MARKET_COLS:
        x = "CAST(NULL AS DOUBLE)" if c == "Carrier" else f"CAST({c} AS DOUBLE)"
        kind = "string" if c == "Carrier" else "bigint" if c in _BIGINT_COLS else "double"
        parts.append(f"SELECT {label}'{c}' AS column, '{kind}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count, "
                     f"{six(f'avg({x})', 'mean')}, {six(f'stddev_samp({x})', 'std')}, {six(f'min({x})', 'min')}, {six(f'max({x})', 'max')} "
                     f"FROM market_dirty {group}")
    return "\nUNION ALL\n".join(parts)


ORACLE["file_profiles"] = with_dirty(_file_profile_sql("GROUP BY l_linenumber", "CAST(l_linenumber AS INTEGER) AS line, "))
ORACLE["file_profiles_merged"] = with_dirty(_file_profile_sql("", ""))


def _describe_all_sql() -> str:
    six = lambda e, a: f"floor(({e}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS {a}"
    parts = []
    for c in MARKET_COLS:
        x = "CAST(NULL AS DOUBLE)" if c == "Carrier" else f"CAST({c} AS DOUBLE)"
        kind = "string" if c == "Carrier" else "bigint" if c in _BIGINT_COLS else "double"
        text = (f"min({c}) AS min_text, max({c}) AS max_text" if c == "Carrier" else "CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text")
        parts.append(f"SELECT '{c}' AS column, '{kind}' AS dtype, count({c}) AS count, count(*) - count({c}) AS null_count, "
                     + ", ".join([six(f"avg({x})", "mean"), six(f"stddev_samp({x})", "std"), six(f"min({x})", "min"),
                                  *(six(f"quantile_cont({x}, {q})", f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)), six(f"max({x})", "max")])
                     + f", {text} FROM market_dirty")
    return "\nUNION ALL\n".join(parts)


ORACLE["describe_all"] = with_dirty(_describe_all_sql())
