"""Unit conversions and daily weather expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgrid.functions import constants as K


def kelvin_to_celsius(t: Column) -> Column:
    return t - K.KELVIN_OFFSET


def celsius_to_kelvin(t: Column) -> Column:
    return t + K.KELVIN_OFFSET


def ms_to_kmh(v: Column) -> Column:
    return v * 3.6


def metres_to_mm(v: Column) -> Column:
    return v * K.MM_PER_METRE


def _vapour_pressure_factor(kelvin: Column) -> Column:
    c = kelvin_to_celsius(kelvin)
    return F.exp(c * 17.625 / (c + 243.04))


def relative_humidity(t2m: Column, d2m: Column) -> Column:
    """Magnus formula on Kelvin inputs, in percent and not clipped."""
    return _vapour_pressure_factor(d2m) * 100.0 / _vapour_pressure_factor(t2m)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction_part(component: Column, speed: Column) -> Column:
    """Component over speed; 0 for calm or unknown wind."""
    return F.coalesce(F.when(speed > 0, component / speed), F.lit(0.0))


def season_filter(date: Column, start: str = K.SEASON_START, end: str = K.SEASON_END) -> Column:
    """True inside the season window of any year, both ends ("MM-dd") included.

    Compared as numbers: formatting each date costs more than reading its row."""
    first, last = (int(day[:2]) * 100 + int(day[3:]) for day in (start, end))
    return (F.month(date) * 100 + F.dayofmonth(date)).between(first, last)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
