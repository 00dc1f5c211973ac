"""Date, time and place expressions; times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in km, and how fast nearness fades.
EARTH_KM, TIME_SCALE_HOURS, PLACE_SCALE_KM = 6371.0, 6.0, 10.0


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    a1, o1, a2, o2 = (F.radians(_column(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def location_decay(km: Column | str) -> Column:
    return F.exp(-_column(km) / F.lit(PLACE_SCALE_KM))


def time_decay(a: Column | str, b: Column | str) -> Column:
    """exp(-hours apart / 6)."""
    seconds = (F.unix_micros(_column(a).cast("timestamp")) - F.unix_micros(_column(b).cast("timestamp"))) / F.lit(1e6)
    return F.exp(-F.abs(seconds) / F.lit(3600 * TIME_SCALE_HOURS))


def observation_time(*texts: Column | str) -> Column:
    """The first filled text as a time: numbers are epoch seconds, others ISO 8601; NULL if it can't be read."""
    filled = F.coalesce(*(F.when(F.trim(_column(t)) != "", F.trim(_column(t))) for t in texts))
    number = filled.try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("long"))).otherwise(filled.try_cast("timestamp"))


def observation_date(time: Column | str) -> Column:
    return F.date_format(_column(time), "yyyy-MM-dd")


def exif_time(c: Column | str) -> Column:
    """``2024:01:02 03:04:05`` as ISO 8601."""
    return F.concat(F.regexp_replace(F.regexp_replace(_column(c), r"^([^:]*):([^:]*):", "$1-$2-"), " ", "T"), F.lit("Z"))


def dms_to_degrees(degrees: Column | str, minutes: Column | str, seconds: Column | str, side: Column | str) -> Column:
    value = _column(degrees) + _column(minutes) / 60 + _column(seconds) / 3600
    return F.round(F.when(F.upper(_column(side)).isin("S", "W"), -value).otherwise(value), 6)
