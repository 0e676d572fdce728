"""Schemas of what the engine reads and returns."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of a raw on-time record, by name, and the event's fields that each becomes.
RAW_INT = {"YEAR": "year", "MONTH": "month", "DAY_OF_MONTH": "day_of_month", "ORIGIN_AIRPORT_ID": "origin_airport_id", "DEST_AIRPORT_ID": "dest_airport_id", "CRS_DEP_TIME": "crs_dep_time"}
RAW_DOUBLE = {
    "DEP_DELAY": "dep_delay", "ARR_DELAY": "arr_delay", "CANCELLED": "cancelled", "DIVERTED": "diverted", "CARRIER_DELAY": "carrier_delay",
    "WEATHER_DELAY": "weather_delay", "NAS_DELAY": "nas_delay", "SECURITY_DELAY": "security_delay", "LATE_AIRCRAFT_DELAY": "late_aircraft_delay",
}
RAW_TEXT = {"OP_UNIQUE_CARRIER": "airline"}
RAW = [*RAW_INT, *RAW_DOUBLE, *RAW_TEXT]

#: An event as it is streamed.
FLIGHT = T.StructType(
    [T.StructField("event_time", T.LongType(), False)]
    + [T.StructField(n, T.IntegerType()) for n in ("year", "month", "day_of_month")]
    + [T.StructField("airline", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("origin_airport_id", "dest_airport_id", "crs_dep_time")]
    + [T.StructField(n, T.DoubleType()) for n in RAW_DOUBLE.values()]
)

#: What the two queries read of it, with its rowtime.
VIEW = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("rowtime", T.TimestampType()), T.StructField("airline", T.StringType()), T.StructField("origin_airport_id", T.IntegerType()), T.StructField("dest_airport_id", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("dep_delay", "cancelled", "diverted")]
)

Q1 = T.StructType(
    [T.StructField(n, T.TimestampNTZType()) for n in ("window_start", "window_end")]
    + [T.StructField("airline", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("num_flights", "completed", "cancelled", "diverted")]
    + [T.StructField(n, T.DoubleType()) for n in ("dep_delay_mean", "cancellation_rate", "late_departure_rate")]
)

Q2 = T.StructType(
    [T.StructField("ts", T.TimestampNTZType()), T.StructField("airport_rank", T.LongType()), T.StructField("origin_airport_id", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("num_flights", "severe_delays")]
    + [T.StructField(n, T.DoubleType()) for n in ("dep_delay_mean", "dep_delay_max")]
    + [T.StructField("delayed_flights", T.StringType())]
)
