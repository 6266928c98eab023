"""Station and target features (inventory J12, J13, J17, J19, J21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.calendar import forecast_year, month_day, water_year
from freshet.operators.asof import agg_since
from freshet.operators.windows import known_before, roll_mean
from freshet.plans.folds import loo_stats
from freshet.session import cut_lineage


def deviation(
    obs: DataFrame, chosen: DataFrame, windows: Sequence[int], first: int, last: int, value: str = "v"
) -> DataFrame:
    """Standardised station feature for every fold.

    (x - mean) / sd by (station, month-day) from the other years, averaged over
    the fold's chosen stations per day, then trailing row means inside the
    forecast year. ``obs``: station, d, v, one row per station and day;
    ``chosen``: fold, site, station.
    """
    # The choice is a small table used twice; written once, as a job would do.
    chosen = cut_lineage(chosen.select("fold", "site", "station"))
    rows = obs.withColumns({"fy": forecast_year("d"), "season": month_day("d")})
    used = rows.join(chosen.select("station").distinct(), "station", "left_semi")
    stats = loo_stats(used, ["station", "season"], "fy", value, first, last)
    # Standardised once per (fold, station, day), then handed to each site that chose it.
    z = (
        rows.join(chosen.select("fold", "station").distinct(), "station")
        .join(stats, ["station", "season", "fold"])
        .select("fold", "station", "fy", "d", F.try_divide(F.col(value) - F.col("loo_mean"), F.col("loo_std")).alias("_z"))
    )
    daily = z.join(chosen, ["fold", "station"]).groupBy("fold", "site", "fy", "d").agg(F.avg("_z").alias("dev"))
    return roll_mean(daily, ["fold", "site", "fy"], "d", "dev", windows)


def site_deviation(
    series: DataFrame, windows: Sequence[int], first: int, last: int, value: str = "v"
) -> DataFrame:
    """The same on one series per site, held-out rows included, always with
    the statistics of the other years."""
    rows = series.withColumns({"fy": forecast_year("d"), "season": month_day("d")})
    stats = loo_stats(rows, ["site", "season"], "fy", value, first, last)
    z = rows.join(stats, ["site", "season"]).select(
        "fold", "site", "fy", "d", F.try_divide(F.col(value) - F.col("loo_mean"), F.col("loo_std")).alias("dev")
    )
    return roll_mean(z, ["fold", "site", "fy"], "d", "dev", windows)


def target_diff(
    issues: DataFrame,
    monthly: DataFrame,
    daily: DataFrame | None = None,
    diff_gap: int = 1,
    no_monthly: DataFrame | None = None,
) -> DataFrame:
    """Season volume already known at each issue date, and the rest.

    Months count from the issue month on, or only after issue day ``diff_gap``;
    daily flow of the running month is added when given, within the season's months.
    Sites listed in ``no_monthly`` (site) take the season's daily flow up to the day
    before instead. ``issues`` carries season_start, season_end and the label
    ``vol``; ``monthly`` site, yr, m, vol.
    """
    season = issues.select("site", "season_start", "season_end").distinct()
    known = (
        monthly.join(season, "site")
        .withColumn("month_tf", F.col("m") + 1)
        .where(F.col("m").between(F.col("season_start"), F.col("season_end") - 1))
    )
    w = Window.partitionBy("site", "yr").orderBy("month_tf").rowsBetween(Window.unboundedPreceding, 0)
    diffs = known.select("site", "yr", "month_tf", F.sum("vol").over(w).alias("_diff"))
    tagged = issues.withColumn("month_tf", F.when(F.col("dd") <= diff_gap, F.col("m") - 1).otherwise(F.col("m")))
    out = tagged.join(diffs, ["site", "yr", "month_tf"], "left").withColumn("diff", F.coalesce("_diff", F.lit(0.0)))
    if daily is not None:
        season_days = daily.join(season, "site").where(F.month("d").between(F.col("season_start"), F.col("season_end")))
        month_known = known_before(
            season_days.withColumns({"yr": F.year("d"), "_m": F.month("d")}), ["site", "yr"], ["site", "yr", "_m"], "d", "vol"
        ).select("site", F.col("d").alias("issue_date"), F.col("month_cum_lag1").alias("_extra"))
        out = out.join(month_known, ["site", "issue_date"], "left").withColumn(
            "diff", F.col("diff") + F.coalesce("_extra", F.lit(0.0))
        ).drop("_extra")
    if no_monthly is not None and daily is not None:
        season_flow = agg_since(
            daily.join(season, "site"), issues.select("site", "issue_date").distinct(), ["site"], "d", "vol", "issue_date", 10, "_f",
            keep=F.month("d").between(F.col("season_start"), F.col("season_end")), aggs=("sum",),
        )
        alone = no_monthly.select("site").distinct().withColumn("_alone", F.lit(True))
        out = out.join(season_flow, ["site", "issue_date"], "left").join(alone, "site", "left")
        taken = F.when(F.col("_alone"), F.coalesce("_f_sum", F.lit(0.0))).otherwise(F.col("diff"))
        out = out.withColumn("diff", taken).drop("_f_sum", "_alone")
    return out.withColumns(
        {"remaining": F.col("vol") - F.col("diff"), "is_use_diff": (F.col("diff") > 0).cast("int")}
    ).drop("_diff", "month_tf")


def availability_features(obs: DataFrame, issues: DataFrame, source: str, kind: str = "volume") -> DataFrame:
    """What is known of a source before each issue date, zeros when nothing is.

    ``present``; ``ratio``, (last known day + 1) / (season end + 1) in days of the
    water year, and ``season_ratio``, the same from the season's start on. A
    ``volume`` adds ``total`` and ``season_total``; ``snow`` adds ``acc_max``,
    ``current`` and ``max``. ``obs``: site, d, v (snow also ``acc``), one row per
    site and day; ``issues``: site, issue_date, season_start, season_end.
    """
    season = issues.select("site", "season_start", "season_end").distinct()
    zero = F.make_date(F.col("_wy") - 1, F.lit(10), F.lit(1))
    in_season = (F.month("d") >= F.col("_from")) & (F.month("d") < 10)
    extra = ["acc"] if kind == "snow" else []
    days = obs.where(F.col("v").isNotNull()).join(season.select("site", F.col("season_start").alias("_from")), "site").select(
        "site",
        water_year("d").alias("_wy"),
        F.col("d").alias("_t"),
        F.lit(1).alias("_k"),
        "v",
        *extra,
        F.when(in_season, F.col("v")).alias("_sv"),
        F.when(in_season, F.col("d")).alias("_st"),
    )
    marks = issues.select("site", water_year("issue_date").alias("_wy"), F.col("issue_date").alias("_t")).distinct()
    w = Window.partitionBy("site", "_wy").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    grown = {
        "_last": F.max(F.when(F.col("_k") == 1, F.col("_t"))).over(w),
        "_slast": F.max("_st").over(w),
        "_sum": F.sum("v").over(w),
        "_ssum": F.sum("_sv").over(w),
        "_max": F.max("v").over(w),
        "_now": F.last("v", ignorenulls=True).over(w),
    }
    if kind == "snow":
        grown["_acc"] = F.max("acc").over(w)
    events = days.unionByName(marks.withColumn("_k", F.lit(0)), allowMissingColumns=True).withColumns(grown)
    known = events.where(F.col("_k") == 0).select("site", F.col("_t").alias("issue_date"), "_wy", *grown)
    out = issues.join(known, ["site", "issue_date"], "left")

    def at(day: Column) -> Column:
        return F.datediff(day, zero)

    start = at(F.make_date("_wy", "season_start", F.lit(1)))
    end = at(F.last_day(F.make_date("_wy", "season_end", F.lit(1))))
    made = {
        "present": F.col("_last").isNotNull().cast("int"),
        "ratio": (at(F.col("_last")) + 1) / (end + 1),
        "season_ratio": (at(F.col("_slast")) + 1 - start) / (end - start + 1),
    }
    if kind == "snow":
        made |= {"acc_max": F.col("_acc"), "current": F.col("_now"), "max": F.col("_max")}
    else:
        made |= {"total": F.col("_sum"), "season_total": F.col("_ssum")}
    return out.withColumns({f"{source}_{n}": F.coalesce(c, F.lit(0)) for n, c in made.items()}).drop("_wy", *grown)


def align_latest(obs: DataFrame, by: str = "site", station: str = "station") -> DataFrame:
    """Mean over stations of each station's latest value, on every day any
    station of the site reports, once all its stations have reported.

    Written as a running sum of per-station changes, so a site with very many
    stations is combined per day before its window, and no station columns are
    made.
    """
    w = Window.partitionBy(by, station).orderBy("d")
    steps = obs.where(F.col("v").isNotNull()).select(
        by,
        "d",
        (F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0.0))).alias("_dv"),
        F.when(F.lag("v").over(w).isNull(), 1).otherwise(0).alias("_new"),
    )
    per_day = steps.groupBy(by, "d").agg(F.sum("_dv").alias("_dv"), F.sum("_new").alias("_new"))
    total = obs.where(F.col("v").isNotNull()).groupBy(by).agg(F.count_distinct(station).alias("n_stations"))
    run = Window.partitionBy(by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    grown = per_day.withColumns({"_s": F.sum("_dv").over(run), "_k": F.sum("_new").over(run)})
    full = grown.join(total, by).where(F.col("_k") == F.col("n_stations"))
    return full.select(by, "d", "n_stations", (F.col("_s") / F.col("n_stations")).alias("v"))
