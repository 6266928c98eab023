"""Calendar scaffolds and the reductions that bound every later window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.calendar import ISSUE_DAYS, md_id


def daily_reduce(df: DataFrame, keys: Sequence[str], date: str, value: str, how: str = "sum") -> DataFrame:
    """One row per (key, day) from any number of raw rows.

    The map-side combine collapses a hot key before the shuffle, and afterwards
    a key holds at most one row per day, so windows and exact quantiles per key
    are bounded by the length of the record.
    """
    if how == "last":  # the latest reading of the day that is not null
        read = F.col(value).isNotNull()
        latest = F.max_by(value, F.when(read, F.col(date)))
        return df.groupBy(*keys, F.col(date).cast("date").alias("d")).agg(latest.alias("v"))
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[how]
    return df.groupBy(*keys, F.col(date).cast("date").alias("d")).agg(fn(value).alias("v"))


def scaffold(
    sites: DataFrame,
    first_year: int | Column,
    last_year: int | Column,
    months: Sequence[int] = tuple(range(1, 8)),
    days: Sequence[int] = ISSUE_DAYS,
    last_month: Column | None = None,
) -> DataFrame:
    """Every issue date of every site; ``last_month`` stops a site early.

    Years and issue days are generated per site row, so there is no join.
    """
    lo = F.lit(first_year) if isinstance(first_year, int) else first_year
    hi = F.lit(last_year) if isinstance(last_year, int) else last_year
    marks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("dd")) for m in months for d in days])
    out = sites.withColumn("yr", F.explode(F.sequence(lo, hi))).withColumn("_md", F.explode(marks))
    out = out.withColumns({"m": F.col("_md.m"), "dd": F.col("_md.dd")}).drop("_md")
    if last_month is not None:
        out = out.where(F.col("m") <= last_month)
    return out.withColumns(
        {"issue_date": F.make_date("yr", "m", "dd"), "md_id": md_id("m", "dd")}
    )


def expand_dates(
    df: DataFrame,
    by: Sequence[str],
    date: str,
    end: Column | None = None,
    freq: str = "day",
) -> DataFrame:
    """Every day (or month start) of each group from its first date to its
    last, or to ``end`` (a Column over ``first`` and ``last``); data left-joined.

    With ``freq="month"`` a reading stands for its month: dates become month starts."""
    if freq == "month":
        df = df.withColumn(date, F.trunc(date, "MM").cast("date"))
    step = F.expr("interval 1 month" if freq == "month" else "interval 1 day")
    bounds = df.groupBy(*by).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    stop = F.col("last") if end is None else end
    lo = F.trunc("first", "MM") if freq == "month" else F.col("first")
    calendar = (
        bounds.withColumn("_stop", stop)
        .where(F.col("_stop") >= lo)
        .select(*by, F.explode(F.sequence(lo, F.col("_stop"), step)).alias(date))
    )
    return calendar.join(df, [*by, date], "left")


def expand_span(df: DataFrame, by: Sequence[str], date: str, first: Column, last: Column) -> DataFrame:
    """D2 with both ends given as columns of the group's first and last date."""
    bounds = df.groupBy(*by).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    calendar = bounds.select(*by, F.explode(F.sequence(first, last)).alias(date))
    return calendar.join(df, [*by, date], "left")


def month_to_issue_days(df: DataFrame, by: Sequence[str], month_start: str, value: str) -> DataFrame:
    """F16: a monthly value on each issue day of its month; the first issue day
    takes the month before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(month_start)
    before = df.withColumn("_prev", F.lag(value).over(w))
    days = F.array(*[F.lit(x) for x in ISSUE_DAYS])
    rows = before.withColumn("_day", F.explode(days))
    return rows.select(
        *by,
        F.date_add(month_start, F.col("_day") - 1).alias("issue_date"),
        F.when(F.col("_day") == 1, F.col("_prev")).otherwise(F.col(value)).alias(value),
    )
