"""Queries for row windows, ranks and limits."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions.calendar import water_year
from freshet.operators import asof, windows as w

_FY = "(SELECT *, CASE WHEN month(d) < 8 THEN year(d) ELSE year(d) + 1 END AS fy FROM station_day)"


@query(
    "g1_roll_mean",
    "station int, d iso, v_2 num, v_10 num, v_30 num",
    f"""SELECT station, d, avg(v) OVER (p ROWS 1 PRECEDING) AS v_2, avg(v) OVER (p ROWS 9 PRECEDING) AS v_10,
    avg(v) OVER (p ROWS 29 PRECEDING) AS v_30 FROM {_FY} WINDOW p AS (PARTITION BY station, fy ORDER BY d)""",
)
def _(d):
    from freshet.functions.calendar import forecast_year

    rows = d.station_day.withColumn("fy", forecast_year("d"))
    return w.roll_mean(rows, ["station", "fy"], "d", "v", [2, 10, 30])


@query(
    "g2_roll_sum",
    "site int, t iso, vol_sum5 num",
    """SELECT site, t, coalesce(sum(x) OVER (PARTITION BY site, wy ORDER BY t ROWS 4 PRECEDING), 0) AS vol_sum5
    FROM (SELECT *, CASE WHEN m NOT IN (10, 11) THEN vol END AS x FROM flow_month)""",
)
def _(d):
    rows = d.flow_month.withColumn("vol", F.when(~F.col("m").isin(10, 11), F.col("vol")))
    return w.roll_sum(rows, ["site", "wy"], "t", "vol", 5)


@query(
    "g3_roll_median",
    "site int, d iso, v_med7 num",
    """SELECT site, d, CASE WHEN count(v) OVER p >= 7 THEN median(v) OVER p END AS v_med7 FROM site_day
    WINDOW p AS (PARTITION BY site ORDER BY d ROWS 6 PRECEDING)""",
)
def _(d):
    return w.roll_median(d.site_day, ["site"], "d", "v", 7)


@query(
    "g4_ewm",
    "station int, t iso, v_ewm6 num",
    """WITH RECURSIVE s AS (SELECT station, t, v, row_number() OVER (PARTITION BY station ORDER BY t) AS p FROM station_month),
    e AS (SELECT station, t, p, v AS y FROM s WHERE p = 1 UNION ALL
      SELECT s.station, s.t, s.p, (2.0::DOUBLE / 7) * s.v + (1 - 2.0::DOUBLE / 7) * e.y FROM e
      JOIN s ON s.station = e.station AND s.p = e.p + 1)
    SELECT station, t, CASE WHEN p >= 6 THEN y END AS v_ewm6 FROM e""",
)
def _(d):
    return w.ewm(d.station_month, ["station"], "t", "v", 6)


@query(
    "g5_lags",
    "site int, d iso, v_lag1 num, v_lag7 num, v_lag30 num",
    """SELECT site, d, lag(v, 1) OVER p AS v_lag1, lag(v, 7) OVER p AS v_lag7, lag(v, 30) OVER p AS v_lag30
    FROM site_day WINDOW p AS (PARTITION BY site ORDER BY d)""",
)
def _(d):
    return w.lags(d.site_day, ["site"], "d", ["v"], [1, 7, 30])


@query(
    "g5_diffs",
    "site int, d iso, v_diff1 num, v_diff5 num",
    """SELECT site, d, CASE WHEN b IS NOT NULL THEN a END AS v_diff1, CASE WHEN a IS NOT NULL THEN b END AS v_diff5 FROM (
      SELECT site, d, v - lag(v, 1) OVER p AS a, v - lag(v, 5) OVER p AS b FROM site_day
      WINDOW p AS (PARTITION BY site ORDER BY d))""",
)
def _(d):
    return w.diffs(d.site_day, ["site"], "d", ["v"], [1, 5])


@query(
    "g6_lag_features",
    "site int, d iso, v_lag1 num, v_lag8 num, v_lag15 num",
    """SELECT * FROM (SELECT site, d, lag(v, 1) OVER p AS v_lag1, lag(v, 8) OVER p AS v_lag8, lag(v, 15) OVER p AS v_lag15
    FROM gap_day WINDOW p AS (PARTITION BY site ORDER BY d)) WHERE day(d) IN (1, 8, 15, 22)""",
)
def _(d):
    from freshet.operators.frames import expand_dates

    dense = expand_dates(d.site_day, ["site"], "d")
    return w.lag_features(dense, ["site"], "d", ["v"], 1, 3, 7, [1, 8, 15, 22])


@query(
    "g7_cumsum",
    "site int, d iso, season_cum num, season_cum_lag1 num, month_cum_lag1 num",
    """SELECT site, d, season_cum, lag(season_cum) OVER p AS season_cum_lag1,
      CASE WHEN day(d) <> 1 THEN lag(month_cum) OVER p END AS month_cum_lag1 FROM (
      SELECT site, d, wy, sum(vol) OVER (PARTITION BY site, wy ORDER BY d) AS season_cum,
        sum(vol) OVER (PARTITION BY site, wy, month(d) ORDER BY d) AS month_cum
      FROM (SELECT *, year(d) + (month(d) >= 10)::INTEGER AS wy FROM flow_day))
    WINDOW p AS (PARTITION BY site, wy ORDER BY d)""",
)
def _(d):
    rows = d.flow_day.withColumns({"wy": water_year("d"), "m": F.month("d")})
    return w.known_before(rows, ["site", "wy"], ["site", "wy", "m"], "d", "vol")


@query(
    "g8_swe_extra",
    "site int, d iso, swe_max num, swe_diff num, swe_melt_ratio num, swe_prec_ratio num",
    """SELECT site, d, mx AS swe_max, mx - v AS swe_diff, CASE WHEN mx <> 0 THEN (mx - v) / mx END AS swe_melt_ratio,
    CASE WHEN n <> 0 THEN v / n END AS swe_prec_ratio FROM (SELECT site, d, v, max(v) OVER p AS mx, sum(v) OVER p AS n
      FROM (SELECT *, year(d) + (month(d) >= 10)::INTEGER AS wy FROM site_day) WINDOW p AS (PARTITION BY site, wy ORDER BY d))""",
)
def _(d):
    rows = d.site_day.withColumn("wy", water_year("d"))
    rows = w.cumsum(rows, ["site", "wy"], "d", "v", "prec")
    return w.swe_extra(rows, ["site", "wy"], "d", "v", "prec")


@query(
    "g9_rank_first",
    "site int, issue_date iso, member str, rnk int",
    """SELECT site, issue_date, member, row_number() OVER (PARTITION BY site, issue_date ORDER BY q50, member) AS rnk
    FROM members""",
)
def _(d):
    return w.rank_first(d.members, ["site", "issue_date"], ["q50", "member"])


@query(
    "g10_percentile_in_season",
    "site int, d iso, pct num",
    """SELECT site, d, CASE WHEN n = 1 THEN 0 ELSE 100 * (lo + (same - 1) / 2.0::DOUBLE) / (n - 1) END AS pct FROM (
      SELECT site, d, rank() OVER (PARTITION BY site, strftime(d, '%m%d') ORDER BY v) - 1 AS lo,
        count(*) OVER (PARTITION BY site, strftime(d, '%m%d'), v) AS same,
        count(*) OVER (PARTITION BY site, strftime(d, '%m%d')) AS n FROM site_day)""",
)
def _(d):
    rows = d.site_day.withColumn("season", F.date_format("d", "MMdd"))
    return w.pct_by_doy(rows, ["site", "season"], "v")


@query(
    "g11_share",
    "station int, site int, d iso, total num, share num",
    """SELECT station, site, d, sum(v) OVER p AS total, 100 * v / sum(v) OVER p AS share FROM station_day
    WINDOW p AS (PARTITION BY site, d)""",
)
def _(d):
    return w.share(d.station_day, ["site", "d"], "v")


@query(
    "g12_group_stat",
    "station int, site int, d iso, med num, shown num",
    """SELECT station, site, d, med, CASE WHEN v / med > 2.5 THEN NULL ELSE v END AS shown FROM (
      SELECT *, median(v) OVER (PARTITION BY station, month(d), year(d)) AS med FROM station_day)""",
)
def _(d):
    rows = d.station_day.withColumns({"yr": F.year("d"), "m": F.month("d")})
    out = w.group_stat(rows, ["station", "yr", "m"], "v", F.median, "med")
    return out.withColumn("shown", F.when(~(F.col("v") / F.col("med") > 2.5), F.col("v")))


@query(
    "g13_trailing_mean",
    "site int, issue_date iso, v_5 num, v_0 num",
    """SELECT g.site, g.issue_date, CASE WHEN s.d >= make_date(yr - 1, 10, 1) THEN a END AS v_5,
      CASE WHEN s.d >= make_date(yr - 1, 10, 1) THEN b END AS v_0
    FROM issue_grid g ASOF LEFT JOIN (SELECT site, d, avg(v) OVER (p ROWS 4 PRECEDING) AS a, avg(v) OVER p AS b
      FROM (SELECT *, year(d) + (month(d) >= 10)::INTEGER AS wy FROM site_day)
      WINDOW p AS (PARTITION BY site, wy ORDER BY d)) s ON g.site = s.site AND s.d < g.issue_date""",
)
def _(d):
    return asof.trailing_mean(d.site_day, d.issue_grid, ["site"], "d", "v", "issue_date", [5, 0])


@query(
    "g14_around_issue",
    "site int, d iso, anchor iso, off int, v num",
    """SELECT site, d, anchor, date_diff('day', anchor, d) AS off, v FROM site_day, (
      SELECT make_date(y, 4, 1) AS anchor FROM range(1994, 2003) t(y)) WHERE abs(date_diff('day', anchor, d)) <= 10""",
)
def _(d):
    return w.around_issue(d.site_day, "d", 4, 1, 10).withColumnRenamed("offset", "off")


@query(
    "g15_index_three_month",
    "yr int, m int, val_3 num",
    """SELECT yr, m, CASE WHEN count(val) OVER p >= 3 THEN avg(val) OVER p END AS val_3 FROM index_month
    WINDOW p AS (ORDER BY yr, m ROWS 2 PRECEDING)""",
)
def _(d):
    # One index of one row per month, so its whole series is one small group.
    rows = d.index_month.withColumns({"index": F.lit("a"), "pos": F.col("yr") * 12 + F.col("m")})
    return w.roll_mean(rows, ["index"], "pos", "val", [3], min_periods=3)


@query(
    "g16_roll_slope",
    "site int, d iso, v_slope10 num",
    """SELECT site, d, CASE WHEN count(v) OVER q >= 2 THEN regr_slope(v, p) OVER q END * 1.9834591996927::DOUBLE AS v_slope10 FROM (
      SELECT *, row_number() OVER (PARTITION BY site ORDER BY d)::DOUBLE AS p FROM gap_day)
    WINDOW q AS (PARTITION BY site ORDER BY d ROWS 9 PRECEDING)""",
)
def _(d):
    from freshet.operators.frames import expand_dates

    slope = w.roll_slope(expand_dates(d.site_day, ["site"], "d"), ["site"], "d", "v", 10)
    return slope.withColumn("v_slope10", F.col("v_slope10") * 1.9834591996927)


@query(
    "g17_gauss_smooth",
    "site int, doy int, smooth num",
    """WITH c AS (SELECT site, dayofyear(d) AS doy, avg(v) AS v FROM site_day GROUP BY 1, 2)
    SELECT a.site, a.doy, sum(b.v * exp(-k * k / 18.0::DOUBLE)) / sum(exp(-k * k / 18.0::DOUBLE)) AS smooth
    FROM c a, range(-12, 13) t(k), c b WHERE b.site = a.site AND b.doy = (a.doy - 1 + k + 366) % 366 + 1 GROUP BY 1, 2""",
)
def _(d):
    clim = d.site_day.groupBy("site", F.dayofyear("d").alias("doy")).agg(F.avg("v").alias("v"))
    return w.gauss_smooth(clim, ["site"], "doy", "v", 3.0)


@query(
    "g18_increment",
    "station int, d iso, increment num",
    """SELECT station, d, CASE WHEN v - lag(v) OVER p < 0 THEN 0 ELSE v - lag(v) OVER p END AS increment FROM station_day
    WINDOW p AS (PARTITION BY station ORDER BY d)""",
)
def _(d):
    return w.increment(d.station_day, ["station"], "d", "v")


@query(
    "h1_sort",
    "station int, d iso, v num",
    "SELECT station, d, v FROM station_day ORDER BY v DESC, station, d",
)
def _(d):
    return w.sort(d.station_day, F.col("v").desc(), "station", "d")


@query(
    "h2_top_k",
    "site int, station int, v num, rnk int",
    """SELECT site, station, v, rnk FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v DESC, station, d) AS rnk
    FROM station_day) WHERE rnk <= 4""",
)
def _(d):
    return w.top_k(d.station_day, ["site"], F.col("v").desc(), ["station", "d"], 4)


@query(
    "h3_last_n",
    "site int, yr int, d iso, v num",
    """SELECT site, yr, d, v FROM (SELECT *, row_number() OVER (PARTITION BY site, yr ORDER BY d DESC) AS b
    FROM (SELECT *, year(d) AS yr FROM site_day)) WHERE b <= 3""",
)
def _(d):
    return w.last_n(d.site_day.withColumn("yr", F.year("d")), ["site", "yr"], ["d"], 3)


@query(
    "h4_top_n",
    "feature str, site int, size num",
    """SELECT feature, site, size FROM (SELECT feature, site, avg(abs(shap)) AS size FROM contrib_long GROUP BY 1, 2)
    ORDER BY size DESC, feature, site LIMIT 10""",
)
def _(d):
    from freshet.catalog.explain_queries import contrib_long

    sized = contrib_long(d).groupBy("feature", "site").agg(F.avg(F.abs("shap")).alias("size"))
    return w.top_n(sized, 10, F.col("size").desc(), "feature", "site")
