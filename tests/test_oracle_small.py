"""Registered queries against their DuckDB oracle on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
CHECK = ["route_features", "carrier_features", "market_features", "target_encode", "validate_market",
         "clean_market", "describe_numeric", "correlation_matrix", "fare_histogram", "carrier_fare_box",
         "top_routes", "hash_sample", "revenue_ranking", "route_sequences", "model_comparison", "build_features",
         "concat_files", "concat_files_drift", "ingest_validated"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return ("n",) if math.isnan(v) else round(v, 4)
    if isinstance(v, (int, bool)):
        return round(float(v), 4)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", CHECK)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    si = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    s = sorted((tuple(_norm(r[i]) for i in si) for r in sdf.collect()), key=repr)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in cur.fetchall()), key=repr)
    assert len(s) == len(d)
    assert s == d
