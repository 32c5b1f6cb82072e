"""Holidays as events (name, start, duration, decay)."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

# fixed values: name, month and day, duration in days, kernel
FIXED = [
    ("new-year", (1, 1), 1, "box"),
    ("valentines", (2, 14), 3, "gaussian"),
    ("juneteenth", (6, 19), 1, "box"),
    ("us-independence", (7, 4), 1, "box"),
    ("halloween", (10, 31), 3, "triangular"),
    ("veterans-day", (11, 11), 1, "box"),
    ("christmas", (12, 25), 3, "box"),
    ("new-years-eve", (12, 31), 2, "triangular"),
]
# fixed values: name, month, weekday (Monday 0), which (-1: last), days added, duration, kernel
FLOATING = [
    ("mlk-day", 1, 0, 3, 0, 1, "box"),
    ("presidents-day", 2, 0, 3, 0, 1, "box"),
    ("memorial-day", 5, 0, -1, 0, 1, "box"),
    ("labor-day", 9, 0, 1, 0, 1, "box"),
    ("columbus-day", 10, 0, 2, 0, 1, "box"),
    ("thanksgiving", 11, 3, 4, 0, 2, "triangular"),
    ("black-friday", 11, 3, 4, 1, 3, "triangular"),
    ("cyber-monday", 11, 3, 4, 4, 4, "exponential"),
]


def easter(year: int) -> date:
    """Western Easter: the Sunday after the paschal full moon, whose date follows from the golden number and the century's corrections."""
    century, golden = year // 100 + 1, year % 19 + 1
    solar, lunar = 3 * century // 4 - 12, (8 * century + 5) // 25 - 5
    epact = (11 * golden + 20 + lunar - solar) % 30
    if epact == 24 or (epact == 25 and golden > 11):
        epact += 1
    moon = date(year, 3, 1) + timedelta(days=(44 - epact if epact < 24 else 74 - epact) - 1)
    return moon + timedelta(days=6 - moon.weekday() if moon.weekday() < 6 else 7)


def nth_weekday(year: int, month: int, weekday: int, which: int) -> date:
    days = [d for d in range(1, calendar.monthrange(year, month)[1] + 1) if date(year, month, d).weekday() == weekday]
    return date(year, month, days[which if which < 0 else which - 1])


def calendar_rows(first: int, last: int) -> list[tuple[str, date, int, str]]:
    """(name, start, duration, decay) of every holiday of the years."""
    if last < first:
        raise ValueError("the last year is before the first")
    rows = []
    for year in range(first, last + 1):
        rows += [(f"{name}-{year}", date(year, *day), n, kind) for name, day, n, kind in FIXED]
        rows += [(f"{name}-{year}", nth_weekday(year, month, weekday, which) + timedelta(days=after), n, kind) for name, month, weekday, which, after, n, kind in FLOATING]
        rows.append((f"easter-monday-{year}", easter(year) + timedelta(days=1), 2, "gaussian"))
    return rows


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.createDataFrame(calendar_rows(first, last), "name string, start date, duration int, decay string")
