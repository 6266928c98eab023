"""As-of operators: nothing dated on or after the issue day is visible.

Non-equi joins are written as a union of observations and issue rows followed
by one ordered window per (key, water year): linear in the rows, one shuffle,
and bounded by the days of a water year when observations hold one row per key
and day (``frames.daily_reduce``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.calendar import snap_up, water_year
from freshet.operators.quantiles import spread_quantiles


def asof_latest(
    obs: DataFrame,
    issues: DataFrame,
    by: Sequence[str],
    date: str,
    values: Sequence[str],
    issue: str,
    strict: bool = True,
    lag_days: int = 0,
    start_month: int | None = 10,
    out: Sequence[str] | None = None,
    out_date: str | None = None,
) -> DataFrame:
    """Last non-null observation before each issue date.

    ``strict`` hides the issue day itself; ``lag_days`` delays every
    observation; ``start_month`` resets at the water year (None: never), which
    is that of the observation's own date, however late it becomes usable.
    """
    names = list(out or values)
    seen = F.struct(F.col(date).alias("d"), *[F.col(v).alias(n) for v, n in zip(values, names)])
    present = F.col(values[0]).isNotNull()
    for v in values[1:]:
        present = present & F.col(v).isNotNull()
    row_type = issues.schema.simpleString()
    o = obs.where(present).select(
        *by,
        F.date_add(date, lag_days).alias("_t"),
        (F.lit(0) if start_month is None else water_year(F.col(date), start_month)).alias("_wy"),
        F.lit(1 if strict else 0).alias("_k"),
        seen.alias("_seen"),
        F.lit(None).cast(row_type).alias("_row"),
    )
    seen_type = dict(o.dtypes)["_seen"]
    q = issues.select(
        *by,
        F.col(issue).alias("_t"),
        (F.lit(0) if start_month is None else water_year(F.col(issue), start_month)).alias("_wy"),
        F.lit(0 if strict else 1).alias("_k"),
        F.lit(None).cast(seen_type).alias("_seen"),
        F.struct(*issues.columns).alias("_row"),
    )
    w = Window.partitionBy(*by, "_wy").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    hit = o.unionByName(q).withColumn("_hit", F.last("_seen", ignorenulls=True).over(w))
    cols = [F.col(f"_hit.{n}").alias(n) for n in names]
    if out_date:
        cols.append(F.col("_hit.d").alias(out_date))
    return hit.where(F.col("_row").isNotNull()).select("_row.*", *cols)


def asof_conditional(
    obs: DataFrame, issues: DataFrame, by: Sequence[str], date: str, value: str, issue: str, cut: str
) -> DataFrame:
    """Latest value, value at the conditional date, and their difference."""
    latest = asof_latest(obs, issues, by, date, [value], issue, out=["latest"])
    both = asof_latest(obs, latest, by, date, [value], cut, strict=False, out=["conditional"])
    return both.withColumn("since", F.col("latest") - F.col("conditional"))


def bucket_latest(
    obs: DataFrame, issues: DataFrame, by: Sequence[str], date: str, value: str, issue: str, lag_days: int = 1
) -> DataFrame:
    """Last value of the bucket that ends at each issue day, by equality.

    A bucket without an observation gives null (unlike :func:`asof_latest`).
    """
    latest = (
        obs.where(F.col(value).isNotNull())
        .groupBy(*by, snap_up(F.date_add(date, lag_days)).alias(issue))
        .agg(F.max_by(value, date).alias("bucket_value"))
    )
    return issues.join(latest, [*by, issue], "left")


def _since_order(month: Column) -> Column:
    return F.pmod(month - 10, F.lit(12))


def agg_since(
    obs: DataFrame,
    issues: DataFrame,
    by: Sequence[str],
    date: str,
    value: str,
    issue: str,
    since: int | Column,
    prefix: str = "v",
    keep: Column | None = None,
    aggs: Sequence[str] = ("sum", "count", "mean", "min", "max"),
) -> DataFrame:
    """aggregates from a month of the water year up to the day before each
    issue date, whatever the issue dates are.

    ``aggs`` may also name ``std`` and quantiles as ``p10``, ``p50`` and so on.
    Observations are combined to days first; a union with the issue dates and one
    ordered window per (key, water year) then reads each day once.
    """
    start = _since_order(F.lit(since) if isinstance(since, int) else since)
    rows = obs.where(_since_order(F.month(date)) >= start)
    if keep is not None:
        rows = rows.where(keep)
    quantiles = [float(a[1:]) / 100 for a in aggs if a[0] == "p"]
    v = F.col(value)
    days = rows.groupBy(*by, water_year(F.col(date)).alias("_wy"), F.col(date).cast("date").alias("_t")).agg(
        F.sum(v).alias("_s"),
        F.sum(v * v).alias("_ss"),
        F.count(v).alias("_n"),
        F.min(v).alias("_lo"),
        F.max(v).alias("_hi"),
    )
    marks = issues.select(*by, water_year(F.col(issue)).alias("_wy"), F.col(issue).alias("_t")).distinct()
    # On its own day an issue date comes first: that day is not yet known.
    events = days.withColumn("_k", F.lit(1)).unionByName(marks.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_wy").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    grown = {
        "_cs": F.sum("_s").over(w),
        "_css": F.sum("_ss").over(w),
        "_cn": F.coalesce(F.sum("_n").over(w), F.lit(0)),
        "_clo": F.min("_lo").over(w),
        "_chi": F.max("_hi").over(w),
    }
    spread_ = (F.col("_css") - F.try_divide(F.col("_cs") * F.col("_cs"), "_cn")) / F.nullif(F.col("_cn") - 1, F.lit(0))
    made = {
        "sum": F.col("_cs"),
        "count": F.col("_cn"),
        "mean": F.try_divide("_cs", "_cn"),
        "min": F.col("_clo"),
        "max": F.col("_chi"),
        "std": F.when(F.col("_cn") > 1, F.sqrt(F.greatest(spread_, F.lit(0.0)))),
    }
    plain = [a for a in aggs if a in made]
    totals = events.withColumns(grown).where(F.col("_k") == 0)
    totals = totals.select(*by, F.col("_t").alias(issue), *[made[a].alias(f"{prefix}_{a}") for a in plain])
    out = issues.join(totals, [*by, issue], "left")
    if quantiles:
        named = [f"{prefix}_{a}" for a in aggs if a not in made]
        out = out.join(_running_quantiles(rows, marks, by, date, v, quantiles, named).withColumnRenamed("_t", issue), [*by, issue], "left")
    return out.select(*issues.columns, *[f"{prefix}_{a}" for a in aggs])


def _running_quantiles(
    rows: DataFrame, marks: DataFrame, by: Sequence[str], date: str, v: Column, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact quantiles of all values of a water year before each of its marks.

    Between two marks equal values are counted once. A count enters the quantiles of
    every later mark of its year, which are at most one a day, and the counts are
    narrowed by ``spread_quantiles``; no list of values is ever made.
    """
    days = rows.where(v.isNotNull()).groupBy(*by, water_year(F.col(date)).alias("_wy"), F.col(date).cast("date").alias("_t"), v.alias("_value"))
    days = days.agg(F.count(F.lit(1)).alias("_n"))
    # The marks of a year as one ordered list, bounded by the calendar.
    listed = marks.groupBy(*by, "_wy").agg(F.sort_array(F.collect_set("_t")).alias("_marks"))
    seen = days.join(listed, [*by, "_wy"])
    next_mark = F.array_min(F.filter("_marks", lambda m: m > F.col("_t")))
    steps = seen.groupBy(*by, "_wy", "_marks", "_value", next_mark.alias("_next")).agg(F.sum("_n").alias("_n"))
    later = F.filter("_marks", lambda m: m >= F.col("_next"))
    spread = steps.where(F.col("_next").isNotNull()).select(*by, "_value", "_n", F.explode(later).alias("_t"))
    return spread_quantiles(spread, [*by, "_t"], "_value", probs, names, weight="_n")


def agg_since_month(
    monthly: DataFrame, issues: DataFrame, by: Sequence[str], month_start: str, value: str, issue: str, since: int
) -> DataFrame:
    """F8: as F7 on monthly values, which count from the month after their own."""
    dated = monthly.withColumn("_d", F.last_day(month_start))
    return agg_since(dated, issues, by, "_d", value, issue, since)


def season_to_date(
    monthly: DataFrame,
    issues: DataFrame,
    by: Sequence[str],
    month_start: str,
    value: str,
    issue: str,
    zero_is_null: bool = False,
) -> DataFrame:
    """in-season volume known before the issue month; 0 when none."""
    dated = monthly.withColumn("_d", F.last_day(month_start))
    in_season = F.month(month_start).between(F.col("season_start"), F.col("season_end"))
    out = agg_since(dated, issues, by, "_d", value, issue, 10, "_sd", keep=in_season)
    total = F.coalesce(F.col("_sd_sum"), F.lit(0.0))
    if zero_is_null:
        total = F.when(total != 0, total)
    return out.withColumn("to_date", total).drop("_sd_sum", "_sd_count", "_sd_mean", "_sd_min", "_sd_max")


def trailing_mean(
    obs: DataFrame, issues: DataFrame, by: Sequence[str], date: str, value: str, issue: str, windows: Sequence[int]
) -> DataFrame:
    """Mean of the last n observation rows before each issue date in the
    water year; n = 0 is the mean of the whole season so far."""
    w = Window.partitionBy(*by, water_year(F.col(date))).orderBy(date)
    rolled = obs.where(F.col(value).isNotNull()).withColumns(
        {
            f"{value}_{n}": F.avg(value).over(
                w.rowsBetween(Window.unboundedPreceding if n == 0 else -(n - 1), 0)
            )
            for n in windows
        }
    )
    return asof_latest(rolled, issues, by, date, [f"{value}_{n}" for n in windows], issue)


def truncate_asof(obs: DataFrame, cuts: DataFrame, by: Sequence[str], day: str, cut: str) -> DataFrame:
    """Entries of a source strictly before that source's own cut day."""
    return obs.join(cuts, list(by)).where(F.col(day) < F.col(cut))
