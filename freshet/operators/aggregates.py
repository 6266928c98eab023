"""Aggregations and reshaping (inventory F1 to F18 not placed elsewhere)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.asof import asof_latest
from freshet.operators.quantiles import spread_quantiles
from freshet.session import cut_lineage

AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
}
QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def climatology(df: DataFrame, by: Sequence[str], value: str, hold_out: Column | None = None) -> DataFrame:
    """mean and sample sd per key over years, without the held-out rows."""
    src = df if hold_out is None else df.where(~hold_out)
    return src.groupBy(*by).agg(F.avg(value).alias("clim_mean"), F.stddev_samp(value).alias("clim_std"))


def agg_features(df: DataFrame, by: Sequence[str], cols: Sequence[str], aggs: Sequence[str]) -> DataFrame:
    """each column by each function, named ``col_func``.

    Sums and extremes are one map-side combined aggregate; quantiles are exact
    for groups of any size.
    """
    plain = [AGGREGATES[a](c).alias(f"{c}_{a}") for c in cols for a in aggs if a in AGGREGATES]
    out = df.groupBy(*by).agg(*plain) if plain else df.select(*by).distinct()
    wanted = [a for a in aggs if a in QUANTILES]
    for c in cols if wanted else ():
        names = [f"{c}_{a}" for a in wanted]
        out = out.join(spread_quantiles(df, by, c, [QUANTILES[a] for a in wanted], names), list(by), "left")
    return out


def basin_mean(obs: DataFrame, pairs: DataFrame, on: str, by: Sequence[str], value: str) -> DataFrame:
    """mean of the stations paired with a site, per day."""
    return obs.join(pairs, on).groupBy(*by).agg(F.avg(value).alias(value), F.count(value).alias("n_stations"))


def season_max(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """largest accumulated value per station and forecast year."""
    return df.groupBy(*by).agg(F.max(value).alias("season_max"))


def concat_by(df: DataFrame, by: Sequence[str], order: str, text: str, sep: str = ",") -> DataFrame:
    """joined text in a given order; for short lists such as member names."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias(f"{text}_list"))


def extreme_years(df: DataFrame, by: Sequence[str], year: str, value: str, normal: tuple[int, int]) -> DataFrame:
    """year and value of the extremes, with normal-period median and mean."""
    normal_value = F.when(F.col(year).between(*normal), F.col(value))
    lo = F.min(F.struct(F.col(value).alias("v"), F.col(year).alias("y")))
    hi = F.max(F.struct(F.col(value).alias("v"), (-F.col(year)).alias("y")))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(
            lo.alias("_lo"),
            hi.alias("_hi"),
            F.median(normal_value).alias("normal_median"),
            F.avg(normal_value).alias("normal_mean"),
        )
        .select(
            *by,
            F.col("_lo.y").alias("min_year"),
            F.col("_lo.v").alias("min_value"),
            (-F.col("_hi.y")).alias("max_year"),
            F.col("_hi.v").alias("max_value"),
            "normal_median",
            "normal_mean",
        )
    )


def pivot(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence) -> DataFrame:
    """long to wide over a known list of columns (no discovery pass)."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """wide to long, null cells kept."""
    return df.unpivot(list(ids), list(cols), name, value)


def member_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, sd, p10, median and p90 over ensemble members."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("_q"))
    return out.select(
        *by, "mean", "sd", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))]
    )


def deaccumulate(df: DataFrame, by: Sequence[str], order: str, total: str) -> DataFrame:
    """step values of a running total."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("step", F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0.0)))


def monthly_median(df: DataFrame, by: Sequence[str], date: str, value: str, running_total: bool = False) -> DataFrame:
    """median over the members on each lead date, made stepwise when it is a
    running total, then the median of each calendar month of a forecast.

    ``df`` holds one row per member and lead date; ``by`` names one forecast. The
    first date of a running total has no step.
    """
    mid = df.groupBy(*by, date).agg(F.median(value).alias("_m"))
    if running_total:
        w = Window.partitionBy(*by).orderBy(date)
        mid = mid.withColumn("_m", F.col("_m") - F.lag("_m").over(w))
    first = F.min(F.trunc(date, "MM")).over(Window.partitionBy(*by))
    lead = F.months_between(F.trunc(date, "MM"), first).cast("int").alias("lead")
    dated = mid.select(*by, F.trunc(date, "MM").alias("month"), lead, "_m")
    return dated.groupBy(*by, "month", "lead").agg(F.median("_m").alias("median"))


def forecast_mean(
    df: DataFrame,
    issues: DataFrame,
    by: Sequence[str],
    made: str,
    lead_date: str,
    value: str,
    issue: str,
    release_day: int,
    last_md: int,
) -> DataFrame:
    """mean of a forecast's lead values up to a month-day, on each issue date
    from the forecast of the latest month released by then.

    ``made`` is the first day of a forecast's month; it is known from
    ``release_day`` of that month on and used within its calendar year.
    """
    usable = F.month(lead_date) * 100 + F.dayofmonth(lead_date) <= last_md
    means = df.groupBy(*by, F.col(made).alias("_made")).agg(F.avg(F.when(usable, F.col(value))).alias("_mean"))
    known = means.where(F.col("_mean").isNotNull()).withColumn("_known", F.date_add("_made", release_day - 1))
    return asof_latest(known, issues, by, "_known", ["_mean"], issue, strict=False, start_month=1, out=["forecast_mean"])


def freq(df: DataFrame, *cols: str) -> DataFrame:
    """row counts by value."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def factorize(df: DataFrame, col: str) -> DataFrame:
    """Dense index of the distinct values in sorted order.

    The values are range-sorted and numbered by partition offsets, so they are
    never gathered in one task.
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = values.repartitionByRange(n, col).sortWithinPartitions(col)
    # The upper bits of the id are the partition, the lower ones the place in it.
    placed = cut_lineage(placed.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    code = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), "_part").select(col, code.alias("code"))


def tercile(
    df: DataFrame, value: str, by: Sequence[str] = (), labels: Sequence[str] = ("low", "mid", "high")
) -> DataFrame:
    """Class by the 33.3 and 66.6 percentiles; ties fall low. Exact for
    groups of any size."""
    cuts = spread_quantiles(df, by, value, [0.333, 0.666], ["_t1", "_t2"])
    joined = df.join(cuts, list(by)) if by else df.join(F.broadcast(cuts.limit(1)))
    label = (
        F.when(F.col(value) <= F.col("_t1"), labels[0])
        .when(F.col(value) <= F.col("_t2"), labels[1])
        .when(F.col(value).isNotNull(), labels[2])
    )
    return joined.withColumn("tercile", label).drop("_t1", "_t2")
