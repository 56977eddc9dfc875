"""The market view in plain ANSI SQL, for DuckDB oracle queries.

Mirrors ``faresight.sources.market``: same expressions, same integer-only
share/HHI arithmetic, so both engines produce identical doubles.
"""

MARKET_BASE_CTE = """
mbase AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate,
    CAST(1 + l.l_linenumber % 3 AS BIGINT) AS MktCoupons,
    CAST(c.c_nationkey AS BIGINT) AS OriginCityMarketID,
    CAST(s.s_nationkey AS BIGINT) AS DestCityMarketID,
    CAST(o.o_custkey AS BIGINT) AS OriginAirportID,
    CAST(l.l_suppkey AS BIGINT) AS DestAirportID,
    p.p_brand AS Carrier,
    CAST(100.0 AS DOUBLE) * (1 + abs(c.c_nationkey - s.s_nationkey)) AS NonStopMiles,
    CAST(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS RoundTrip,
    CAST(o.o_custkey * 100 + s.s_nationkey AS BIGINT) AS ODPairID,
    CAST(floor(l.l_quantity) AS BIGINT) AS Pax,
    CAST(floor(l.l_quantity * (CAST(1.0 AS DOUBLE) - l.l_discount)) AS BIGINT) AS CarrierPax,
    CAST(floor(l.l_extendedprice * CAST(100.0 AS DOUBLE) / l.l_quantity + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST(100.0 AS DOUBLE) AS Average_Fare,
    CAST(CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS BIGINT) AS LCC_Comp,
    CAST(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS BIGINT) AS Multi_Airport,
    CAST(1.0 AS DOUBLE) + l.l_discount AS Circuity,
    CAST(CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS Slot,
    CAST(CASE WHEN l.l_linenumber = 1 THEN 1 ELSE 0 END AS BIGINT) AS Non_Stop,
    (CAST(100.0 AS DOUBLE) * (1 + abs(c.c_nationkey - s.s_nationkey))) * (CAST(1.0 AS DOUBLE) + l.l_discount) AS MktMilesFlown
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
mrc AS (
  SELECT ODPairID, Carrier, CAST(sum(Pax) AS BIGINT) AS rc_d FROM mbase GROUP BY ODPairID, Carrier
),
mr AS (
  SELECT ODPairID, CAST(sum(rc_d) AS BIGINT) AS r_d, CAST(sum(rc_d * rc_d) AS BIGINT) AS r_d2 FROM mrc GROUP BY ODPairID
),
mshare AS (
  SELECT mrc.ODPairID, mrc.Carrier,
    CAST(rc_d AS DOUBLE) / CAST(r_d AS DOUBLE) AS Market_share,
    CAST(10000.0 AS DOUBLE) * CAST(r_d2 AS DOUBLE) / (CAST(r_d AS DOUBLE) * CAST(r_d AS DOUBLE)) AS Market_HHI
  FROM mrc JOIN mr ON mrc.ODPairID = mr.ODPairID
),
market AS (
  SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey, b.l_shipdate,
    b.MktCoupons, b.OriginCityMarketID, b.DestCityMarketID, b.OriginAirportID, b.DestAirportID,
    b.Carrier, b.NonStopMiles, b.RoundTrip, b.ODPairID, b.Pax, b.CarrierPax, b.Average_Fare,
    s.Market_share, s.Market_HHI, b.LCC_Comp, b.Multi_Airport, b.Circuity, b.Slot, b.Non_Stop,
    b.MktMilesFlown
  FROM mbase b LEFT JOIN mshare s ON b.ODPairID = s.ODPairID AND b.Carrier = s.Carrier
)"""

MARKET_DIRTY_CTE = MARKET_BASE_CTE + """,
mdirty0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    MktCoupons, OriginCityMarketID, DestCityMarketID, OriginAirportID, DestAirportID, Carrier,
    CASE WHEN l_partkey % 101 = 0 THEN -NonStopMiles ELSE NonStopMiles END AS NonStopMiles,
    RoundTrip, ODPairID, Pax, CarrierPax,
    CASE WHEN l_orderkey % 97 = 0 THEN -Average_Fare
         WHEN l_orderkey % 89 = 0 THEN CAST(0.0 AS DOUBLE)
         WHEN l_orderkey % 83 = 0 THEN CAST(NULL AS DOUBLE)
         ELSE Average_Fare END AS Average_Fare,
    Market_share, Market_HHI, LCC_Comp, Multi_Airport, Circuity, Slot, Non_Stop, MktMilesFlown,
    Market_share AS Carrier_freq,
    Circuity - CAST(1.0 AS DOUBLE) AS ODPairID_freq
  FROM market
),
market_dirty AS (
  SELECT * FROM mdirty0
  UNION ALL
  SELECT * FROM mdirty0 WHERE l_orderkey % 50 = 0
)"""


def with_market(sql: str) -> str:
    return "WITH " + MARKET_BASE_CTE + "\n" + sql


def with_market_extra(ctes: str, sql: str) -> str:
    return "WITH " + MARKET_BASE_CTE + ",\n" + ctes + "\n" + sql


def with_dirty(sql: str, ctes: str | None = None) -> str:
    head = "WITH " + MARKET_DIRTY_CTE
    if ctes:
        head += ",\n" + ctes
    return head + "\n" + sql
