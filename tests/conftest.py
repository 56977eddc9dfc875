import os
import sys
import tempfile

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

FEATURES = ["MktCoupons", "NonStopMiles", "RoundTrip", "Pax", "CarrierPax", "Market_share", "Market_HHI",
            "LCC_Comp", "Multi_Airport", "Circuity", "Slot", "Non_Stop", "MktMilesFlown"]


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").appName("faresight-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faresight-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sample_df(spark):
    """200-row market table in the ranges of the original fixture (seed 42)."""
    rng = np.random.default_rng(42)
    n = 200
    carriers = np.array(["AA", "UA", "DL", "WN", "B6"])
    rows = []
    for i in range(n):
        rows.append((
            int(rng.integers(1, 4)), int(rng.integers(30000, 30010)), int(rng.integers(30000, 30010)),
            int(rng.integers(10000, 10005)), int(rng.integers(10000, 10005)), str(carriers[rng.integers(0, 5)]),
            float(np.float32(rng.uniform(100, 3000))), int(rng.integers(0, 2)), int(rng.integers(1, 20)),
            int(rng.integers(100, 50000)), int(rng.integers(50, 25000)), float(np.float32(rng.uniform(50, 800))),
            float(np.float32(rng.uniform(0, 1))), float(np.float32(rng.uniform(1000, 10000))),
            int(rng.integers(0, 2)), int(rng.integers(0, 2)), float(np.float32(rng.uniform(1.0, 2.0))),
            int(rng.integers(0, 2)), int(rng.integers(0, 2)), float(np.float32(rng.uniform(100, 5000))), i))
    schema = ("MktCoupons int, OriginCityMarketID int, DestCityMarketID int, OriginAirportID int, "
              "DestAirportID int, Carrier string, NonStopMiles double, RoundTrip int, ODPairID bigint, Pax int, "
              "CarrierPax int, Average_Fare double, Market_share double, Market_HHI double, LCC_Comp int, "
              "Multi_Airport int, Circuity double, Slot int, Non_Stop int, MktMilesFlown double, rid bigint")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def feature_cols():
    return list(FEATURES)
