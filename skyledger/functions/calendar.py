"""Dates, day-of-year axes and item identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days before each month in a common year.
DAYS_BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def is_leap_day(day: Column) -> Column:
    return (F.month(day) == 2) & (F.dayofmonth(day) == 29)


def common_year_index(day: Column) -> Column:
    """0-based position in a 365-day year; 29 February has no position (NULL)."""
    before = F.element_at(F.array(*[F.lit(d) for d in DAYS_BEFORE_MONTH]), F.month(day))
    return F.when(~is_leap_day(day), (before + F.dayofmonth(day) - 1).cast("bigint"))


def composite_start(day: Column) -> Column:
    """First day-of-year of the 8-day composite period that covers ``day``."""
    return (F.floor((F.dayofyear(day) - 1) / 8) * 8 + 1).cast("bigint")


def item_year(item: Column) -> Column:
    return F.substring(F.split_part(item, F.lit("."), F.lit(2)), 2, 4).cast("bigint")


def item_doy(item: Column) -> Column:
    return F.substring(F.split_part(item, F.lit("."), F.lit(2)), 6, 3).cast("bigint")


def item_day(item: Column) -> Column:
    """Acquisition date from an item id ``product.AYYYYDDD.tile.collection.stamp``."""
    return F.date_add(F.make_date(item_year(item), F.lit(1), F.lit(1)), (item_doy(item) - 1).cast("int"))


def item_tile(item: Column) -> Column:
    return F.split_part(item, F.lit("."), F.lit(3))


def overpass_hour_utc(view_local_h: Column, lon: Column | float) -> Column:
    """Hour of day in UTC of a local solar overpass time."""
    return F.pmod(F.bround(view_local_h - F.lit(lon) / 15.0), F.lit(24.0)).cast("bigint")


def months_between_calendar(a: Column, b: Column) -> Column:
    """Calendar months from ``a`` to ``b``, ignoring the day of month."""
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
