"""Column roles, the base-table schema and job defaults.

Fixed values that must equal the original pipeline's for equal results
(column names, role lists, thresholds, model and scenario defaults).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---- fixed values: column roles -------------------------------------------
TARGET = "Average_Fare"
ROUTE = "ODPairID"
CARRIER = "Carrier"

FREQ_ENCODED_COLUMNS = [
    "OriginCityMarketID_freq",
    "DestCityMarketID_freq",
    "OriginAirportID_freq",
    "DestAirportID_freq",
    "Carrier_freq",
    "ODPairID_freq",
]
CATEGORICAL_COLUMNS = ["Carrier"]
ID_COLUMNS = [
    "OriginCityMarketID",
    "DestCityMarketID",
    "OriginAirportID",
    "DestAirportID",
    "ODPairID",
]
BINARY_COLUMNS = ["RoundTrip", "LCC_Comp", "Multi_Airport", "Slot", "Non_Stop"]
NUMERIC_FEATURE_COLUMNS = [
    "MktCoupons",
    "NonStopMiles",
    "Pax",
    "CarrierPax",
    "Market_share",
    "Market_HHI",
    "Circuity",
    "MktMilesFlown",
]
DISTANCE_COLUMNS = ["NonStopMiles", "MktMilesFlown"]
DEMAND_PROXY_COLUMNS = ["Pax", "CarrierPax"]
# the 13 model features used by the original tests
MODEL_FEATURES = [
    "MktCoupons", "NonStopMiles", "RoundTrip", "Pax", "CarrierPax",
    "Market_share", "Market_HHI", "LCC_Comp", "Multi_Airport", "Circuity",
    "Slot", "Non_Stop", "MktMilesFlown",
]
MARKET_COLUMNS = [
    "MktCoupons", "OriginCityMarketID", "DestCityMarketID", "OriginAirportID",
    "DestAirportID", "Carrier", "NonStopMiles", "RoundTrip", "ODPairID", "Pax",
    "CarrierPax", "Average_Fare", "Market_share", "Market_HHI", "LCC_Comp",
    "Multi_Airport", "Circuity", "Slot", "Non_Stop", "MktMilesFlown",
]

# ---- fixed values: thresholds and defaults ---------------------------------
MIN_CIRCUITY = 0.5            # rows below are "impossible circuity"
HHI_CONCENTRATED = 2500.0     # highly concentrated market marker
HUB_QUANTILE = 0.95           # airports at/above this frequency quantile are hubs
TARGET_ENC_FOLDS = 5
TARGET_ENC_SMOOTHING = 10.0
SEED = 42
SPLIT_RATIOS = (0.70, 0.15, 0.15)
CHUNK_SIZE = 100_000
MEMORY_LIMIT_GB = 5.0
ELASTICITY = -1.2
PRICE_SCENARIOS = [-0.20, -0.10, -0.05, 0.0, 0.05, 0.10, 0.20]
DEMAND_COLUMN = "Pax"
RIDGE_ALPHA = 1.0


@dataclass(frozen=True)
class BoostParams:
    """Boosted-tree defaults (depth 6, lr 0.05, subsample 0.8, 1000 rounds, patience 50)."""
    max_iter: int = 1000
    max_depth: int = 6
    step_size: float = 0.05
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    max_bins: int = 255
    patience: int = 50
    growth: str = "level"          # "level", "leaf" or "symmetric"
    max_leaves: int = 63
    l2: float = 1.0
    min_child: float = 1.0         # rows on either side of a split
    seed: int = SEED


# the three growing strategies with the regularisation each is known for
LEAF_WISE = BoostParams(growth="leaf", l2=0.0, min_child=20.0)
SYMMETRIC = BoostParams(growth="symmetric", subsampling_rate=1.0, feature_subset="1.0", l2=3.0)


@dataclass(frozen=True)
class Settings:
    target: str = TARGET
    memory_limit_gb: float = MEMORY_LIMIT_GB
    seed: int = SEED
    split_ratios: tuple = SPLIT_RATIOS
    chunk_size: int = CHUNK_SIZE
    drop_columns: tuple = tuple(FREQ_ENCODED_COLUMNS)
    elasticity: float = ELASTICITY
    price_scenarios: tuple = tuple(PRICE_SCENARIOS)
    demand_column: str = DEMAND_COLUMN
    boost: BoostParams = field(default_factory=BoostParams)


# Spark schema of the base market table as it arrives in raw files
# (CSV inference would give bigint/double/string; declared here instead).
MARKET_SCHEMA = T.StructType([
    T.StructField("MktCoupons", T.LongType()),
    T.StructField("OriginCityMarketID", T.LongType()),
    T.StructField("DestCityMarketID", T.LongType()),
    T.StructField("OriginAirportID", T.LongType()),
    T.StructField("DestAirportID", T.LongType()),
    T.StructField("Carrier", T.StringType()),
    T.StructField("NonStopMiles", T.DoubleType()),
    T.StructField("RoundTrip", T.LongType()),
    T.StructField("ODPairID", T.LongType()),
    T.StructField("Pax", T.LongType()),
    T.StructField("CarrierPax", T.LongType()),
    T.StructField("Average_Fare", T.DoubleType()),
    T.StructField("Market_share", T.DoubleType()),
    T.StructField("Market_HHI", T.DoubleType()),
    T.StructField("LCC_Comp", T.LongType()),
    T.StructField("Multi_Airport", T.LongType()),
    T.StructField("Circuity", T.DoubleType()),
    T.StructField("Slot", T.LongType()),
    T.StructField("Non_Stop", T.LongType()),
    T.StructField("MktMilesFlown", T.DoubleType()),
])
