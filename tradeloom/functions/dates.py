"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeloom.params import SalesCalendar


def calendar_parts(day: Column) -> dict[str, Column]:
    return {
        "fiscal_year": F.year(day),
        "fiscal_quarter": F.quarter(day),
        "fiscal_month": F.month(day),
        "week_of_year": F.weekofyear(day),
    }


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def year_week(day: Column) -> Column:
    """``YYYY-Www`` by ISO 8601."""
    return F.concat(iso_year(day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_start(day: Column) -> Column:
    return F.trunc(day, "week")


def week_end(day: Column) -> Column:
    return F.date_add(week_start(day), 6)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def in_block(year: Column, month: Column, cal: SalesCalendar) -> Column:
    return year.isin(cal.year_a, cal.year_b) & month.isin(*cal.block_months)


def period_month(year: Column, month: Column, cal: SalesCalendar) -> Column:
    """Absolute month number inside the two blocks, NULL elsewhere."""
    return F.when(in_block(year, month, cal), (year - cal.year_a) * 12 + month)


def block_label(year: Column, month: Column, cal: SalesCalendar) -> Column:
    inside = month.isin(*cal.block_months)
    return (
        F.when((year == cal.year_a) & inside, "A").when((year == cal.year_b) & inside, "B").otherwise("GAP")
    )


def period_week(iso_year_col: Column, iso_week: Column, cal: SalesCalendar) -> Column:
    """52 weeks per year. A year with 53 weeks collides with the next; see ``running_week``."""
    return (iso_year_col - cal.year_a) * 52 + iso_week


def running_week(day: Column, cal: SalesCalendar) -> Column:
    """Weeks since the first Monday-based week of ``year_a``; free of collisions."""
    start = F.to_date(F.lit(f"{cal.year_a}-01-04"))
    return (F.datediff(week_start(day), week_start(start)) / 7).cast("int") + 1


def month_angle(month: Column) -> Column:
    return F.lit(2 * math.pi) * month / 12


def month_sin(month: Column) -> Column:
    return F.sin(month_angle(month))


def month_cos(month: Column) -> Column:
    return F.cos(month_angle(month))


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
