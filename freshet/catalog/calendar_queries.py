"""Queries for calendar columns."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions import calendar as cal


@query(
    "b1_time_parts",
    "station int, d iso, year int, month int, day int, yday int",
    "SELECT station, d, year(d) AS year, month(d) AS month, day(d) AS day, dayofyear(d) AS yday FROM station_day",
)
def _(d):
    return cal.time_parts(d.station_day, "d")


@query(
    "b2_water_year",
    "site int, d iso, wy int, wy_july int",
    """SELECT site, d, year(d) + (month(d) >= 10)::INTEGER AS wy, year(d) + (month(d) >= 7)::INTEGER AS wy_july
    FROM site_day""",
)
def _(d):
    return d.site_day.withColumns({"wy": cal.water_year("d"), "wy_july": cal.water_year("d", 7)})


@query(
    "b3_water_day",
    "site int, d iso, from_one int, from_zero int",
    """SELECT site, d, date_diff('day', make_date(year(d) + (month(d) >= 10)::INTEGER - 1, 10, 1), d) + 1 AS from_one,
    date_diff('day', make_date(year(d) + (month(d) >= 10)::INTEGER - 1, 10, 1), d) AS from_zero FROM site_day""",
)
def _(d):
    return d.site_day.withColumns({"from_one": cal.water_day("d", 1), "from_zero": cal.water_day("d", 0)})


@query(
    "b4_forecast_year",
    "site int, d iso, fy int",
    "SELECT site, d, CASE WHEN month(d) < 8 THEN year(d) ELSE year(d) + 1 END AS fy FROM site_day",
)
def _(d):
    return d.site_day.withColumn("fy", cal.forecast_year("d"))


@query(
    "b5_month_day",
    "season str, n big, total num",
    "SELECT strftime(d, '%m%d') AS season, count(*) AS n, sum(v) AS total FROM station_day GROUP BY 1",
)
def _(d):
    keyed = d.station_day.withColumn("season", cal.month_day("d"))
    return keyed.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(
    "b6_month_end",
    "site int, yr int, m int, last iso",
    "SELECT site, yr, m, last_day(t) AS last FROM flow_month",
)
def _(d):
    return d.flow_month.withColumn("last", cal.month_end("yr", "m"))


@query(
    "b7_availability_shift",
    "station int, d iso, next_day iso, pentad iso",
    "SELECT station, d, d + 1 AS next_day, d + 5 AS pentad FROM station_day",
)
def _(d):
    return d.station_day.withColumns(
        {"next_day": cal.issue_from_obs("d"), "pentad": cal.issue_from_obs("d", 5)}
    )


@query(
    "b8_snap_up",
    "station int, d iso, issue_date iso",
    """SELECT station, d, CASE WHEN day(d) <= 1 THEN date_trunc('month', d)::DATE
      WHEN day(d) <= 8 THEN make_date(year(d), month(d), 8) WHEN day(d) <= 15 THEN make_date(year(d), month(d), 15)
      WHEN day(d) <= 22 THEN make_date(year(d), month(d), 22)
      ELSE (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE END AS issue_date FROM station_day""",
)
def _(d):
    return d.station_day.withColumn("issue_date", cal.snap_up("d"))


@query(
    "b9_snap_month",
    "site int, issue_date iso, release iso",
    """SELECT site, issue_date, CASE WHEN dd >= 6 THEN make_date(yr, m, 6)
      ELSE (make_date(yr, m, 6) - INTERVAL 1 MONTH)::DATE END AS release FROM issue_grid""",
)
def _(d):
    return d.issue_grid.withColumn("release", cal.snap_month("issue_date", 6))


@query(
    "b10_prev_issue",
    "site int, issue_date iso, prev iso",
    """SELECT site, issue_date, CASE WHEN dd = 1 THEN (issue_date - INTERVAL 1 MONTH)::DATE + 21
      ELSE issue_date - 7 END AS prev FROM issue_grid""",
)
def _(d):
    return d.issue_grid.withColumn("prev", cal.prev_issue("issue_date"))


@query(
    "b11_cond_date",
    "site int, issue_date iso, cut iso",
    """SELECT site, issue_date, CASE WHEN m NOT BETWEEN season_start AND season_end THEN issue_date - 1
      WHEN site % 9 = 0 THEN make_date(yr, 3, 31) ELSE make_date(yr, m, 1) - 1 END AS cut FROM issue_grid""",
)
def _(d):
    return d.issue_grid.withColumn(
        "cut", cal.cond_date("issue_date", "season_start", "season_end", F.col("site") % 9 == 0)
    )


@query(
    "b12_dowy30",
    "m int, day int, dowy int, n big",
    """SELECT month(d) AS m, day(d) AS day, ((month(d) + 2) % 12) * 30 + day(d) AS dowy, count(*) AS n
    FROM station_day GROUP BY 1, 2, 3""",
)
def _(d):
    parts = d.station_day.select(F.month("d").alias("m"), F.dayofmonth("d").alias("day"))
    return parts.groupBy("m", "day", cal.dowy30("m", "day").alias("dowy")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b13_legal_mask",
    "station int, d iso, v num",
    """SELECT station, d, CASE WHEN month(d) * 100 + day(d) >= 1001 OR month(d) * 100 + day(d) <= 721 THEN v END AS v
    FROM station_day""",
)
def _(d):
    return d.station_day.withColumn("v", cal.legal_mask("v", "d"))


_SEASON_OF_MONTH = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")


@query(
    "b14_season_available",
    "season str, yr int, issue_date iso, mean3 num",
    """SELECT i.season, i.yr, g.issue_date, i.mean3 FROM (
      SELECT (['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'])[m] AS season, yr, m,
        val AS mean3 FROM index_month) i
    JOIN (SELECT DISTINCT issue_date FROM issue_grid) g
      ON make_date(i.yr, i.m, 1) + INTERVAL 2 MONTH <= date_trunc('month', g.issue_date)""",
)
def _(d):
    # The index month stands for the middle month of its season.
    seasons = F.array(*[F.lit(s) for s in _SEASON_OF_MONTH])
    rows = d.index_month.select(F.element_at(seasons, F.col("m")).alias("season"), "yr", F.col("val").alias("mean3"))
    issues = d.issue_grid.select("issue_date").distinct().withColumn("_y", F.year("issue_date"))
    # A season stays public: it meets the issue dates of its own and every later year.
    last = F.lit(issues.agg(F.max("_y")).first()[0])
    near = rows.where(F.col("yr") <= last).withColumn("_y", F.explode(F.sequence(F.col("yr"), last)))
    return near.join(issues, "_y").where(cal.season_available("season", "yr", "issue_date"))


@query(
    "b15_month_num",
    "name str, m int, n big",
    "SELECT strftime(d, '%b') AS name, month(d) AS m, count(*) AS n FROM station_day GROUP BY 1, 2",
)
def _(d):
    named = d.station_day.select(F.date_format("d", "MMM").alias("name"))
    return named.groupBy("name", cal.month_num("name").alias("m")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b16_md_id",
    "site int, issue_date iso, md_id int",
    "SELECT site, issue_date, md_id FROM issue_grid",
)
def _(d):
    return d.issue_grid.withColumn("md_id", cal.md_id("m", "dd"))
