"""Calendar columns (inventory B1 to B16). All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ISSUE_DAYS = (1, 8, 15, 22)

# Month in which a three-month mean becomes public; the last two
# become public in the following year.
SEASON_PUBLIC_MONTH = {
    "DJF": 3, "JFM": 4, "FMA": 5, "MAM": 6, "AMJ": 7, "MJJ": 8,
    "JJA": 9, "JAS": 10, "ASO": 11, "SON": 12, "OND": 1, "NDJ": 2,
}
SEASON_PUBLIC_NEXT_YEAR = ("OND", "NDJ")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def time_parts(df: DataFrame, col: str) -> DataFrame:
    """B1: year, month, day and day of year as columns."""
    c = F.col(col)
    return df.withColumns(
        {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "yday": F.dayofyear(c)}
    )


def water_year(date: str | Column, start_month: int = 10) -> Column:
    """B2: the year in which the period starting at ``start_month`` ends."""
    d = _c(date)
    return F.year(d) + F.when(F.month(d) >= start_month, 1).otherwise(0)


def water_day(date: str | Column, origin: int = 1) -> Column:
    """Days since 1 October of the water year, counted from ``origin``."""
    d = _c(date)
    return F.datediff(d, F.make_date(water_year(d) - 1, F.lit(10), F.lit(1))) + origin


def forecast_year(date: str | Column) -> Column:
    """The year a day informs; August onwards belongs to the next one."""
    d = _c(date)
    return F.year(d) + F.when(F.month(d) < 8, 0).otherwise(1)


def month_day(date: str | Column) -> Column:
    """``MMdd`` season key; 29 February keeps a group of its own."""
    return F.date_format(_c(date), "MMdd")


def month_end(year: str | Column, month: str | Column) -> Column:
    """Last day of a month."""
    return F.last_day(F.make_date(_c(year), _c(month), F.lit(1)))


def issue_from_obs(date: str | Column, lag_days: int = 1) -> Column:
    """First issue day on which an observation may be used."""
    return F.date_add(_c(date), lag_days)


def snap_up(date: str | Column, days: tuple[int, ...] = ISSUE_DAYS) -> Column:
    """First issue day on or after ``date``, rolling into the next month."""
    d = _c(date)
    first = F.trunc(d, "MM")
    out = F.add_months(first, 1)
    for day in sorted(days, reverse=True):
        out = F.when(F.dayofmonth(d) <= day, F.date_add(first, day - 1)).otherwise(out)
    return out


def snap_month(issue: str | Column, day_start: int) -> Column:
    """Most recent monthly release (on ``day_start``) not after the issue day."""
    d = _c(issue)
    here = F.date_add(F.trunc(d, "MM"), day_start - 1)
    return F.when(F.dayofmonth(d) >= day_start, here).otherwise(F.add_months(here, -1))


def prev_issue(issue: str | Column) -> Column:
    """The issue day before this one."""
    d = _c(issue)
    on_first = F.date_add(F.add_months(F.trunc(d, "MM"), -1), 21)
    return F.when(F.dayofmonth(d) == 1, on_first).otherwise(F.date_sub(d, 7))


def cond_date(
    issue: str | Column, season_start: str | Column, season_end: str | Column, no_flow: Column
) -> Column:
    """The day up to which snow counts as antecedent.

    In season the last day of the previous month, or 31 March for sites with no
    monthly flow; out of season the day before the issue day.
    """
    d = _c(issue)
    in_season = F.month(d).between(_c(season_start), _c(season_end))
    frozen = F.when(no_flow, F.make_date(F.year(d), F.lit(3), F.lit(31))).otherwise(
        F.date_sub(F.trunc(d, "MM"), 1)
    )
    return F.when(in_season, frozen).otherwise(F.date_sub(d, 1))


def dowy30(month: str | Column, day: str | Column) -> Column:
    """Day of water year with 30-day months, October first."""
    return F.pmod(_c(month) - 10, F.lit(12)) * 30 + _c(day)


def legal_mask(value: str | Column, date: str | Column, years: Column | None = None) -> Column:
    """Null outside 1 October to 21 July; ``years`` may narrow it further."""
    d = _c(date)
    md = F.month(d) * 100 + F.dayofmonth(d)
    legal = (md >= 1001) | (md <= 721)
    if years is not None:
        legal = legal & years
    return F.when(legal, _c(value))


def season_public(season: str | Column, year: str | Column) -> tuple[Column, Column]:
    """(year, month) in which a three-month mean is public."""
    pairs = [F.lit(x) for kv in SEASON_PUBLIC_MONTH.items() for x in kv]
    s = _c(season)
    month = F.element_at(F.create_map(*pairs), s)
    return _c(year) + F.when(s.isin(*SEASON_PUBLIC_NEXT_YEAR), 1).otherwise(0), month


def season_available(season: str | Column, year: str | Column, issue: str | Column) -> Column:
    """True when the three-month mean is public by the issue month."""
    y, m = season_public(season, year)
    d = _c(issue)
    return (y < F.year(d)) | ((y == F.year(d)) & (m <= F.month(d)))


def month_num(name: str | Column) -> Column:
    """``Jan`` .. ``Dec`` to 1 .. 12, null for other text."""
    return F.month(F.to_date(F.try_to_timestamp(F.concat(_c(name), F.lit("-01-2000")), F.lit("MMM-dd-yyyy"))))


def md_id(month: str | Column, day: str | Column, days: tuple[int, ...] = ISSUE_DAYS) -> Column:
    """Ordinal of an issue day within the season, 0 for 1 January."""
    position = F.array_position(F.array(*[F.lit(x) for x in days]), _c(day)).cast("int")
    return (_c(month) - 1) * len(days) + position - 1
