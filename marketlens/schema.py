"""Column names, keys, schemas and the quality vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind(), True) for name, kind in fields.items()])


S, D = T.StringType, T.DoubleType

#: Raw source 1, one file a year. Dates are read as text: a bad one must become null, not an error.
RAW_DAILY = _struct(State=S, District=S, Market=S, Commodity=S, Variety=S, Grade=S, Arrival_Date=S, Min_Price=D, Max_Price=D, Modal_Price=D, Commodity_Code=T.IntegerType)
#: Raw source 2, one file a commodity; bound by position, as two spellings of its header exist.
RAW_MANDI = _struct(State_Name=S, District_Name=S, Market_Name=S, Variety=S, Group=S, Arrivals=D, Min_Price=D, Max_Price=D, Modal_Price=D, Reported_Date=S)
CANONICAL = _struct(
    state=S, district=S, market=S, commodity=S, variety=S, grade=S, arrival_date=T.DateType, min_price=D, max_price=D, modal_price=D,
    arrivals_tonnes=D, commodity_group=S, source_dataset=S, data_source=S,
)
STREAM_EVENT = _struct(state=S, district=S, market=S, commodity=S, variety=S, arrival_date=S, min_price=D, max_price=D, modal_price=D)

DAILY, MANDI = "daily_market_prices", "india_mandi"
ENTITY = ["state", "district", "market", "commodity", "variety"]
JOIN_KEY = [*ENTITY, "arrival_date"]
BUSINESS_KEY = ["source_dataset", *JOIN_KEY]
DIMENSIONS = ["state", "district", "market", "commodity", "variety", "grade"]

VALID = "VALID"
FEATURES = [
    "previous_modal_price", "price_change", "price_change_pct", "price_range", "relative_price_range", "previous_to_current_ratio",
    "rolling_7_observation_avg", "rolling_7_observation_stddev", "z_score",
]
