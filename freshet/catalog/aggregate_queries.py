"""Queries for aggregations, reshaping and set operations."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.operators import aggregates as agg
from freshet.operators import asof, frames, joins, quantiles, sets, spatial


@query(
    "f1_climatology",
    "station int, season str, clim_mean num, clim_std num",
    """SELECT station, strftime(d, '%m%d') AS season, avg(v) AS clim_mean, stddev_samp(v) AS clim_std
    FROM station_day WHERE year(d) <> 1998 GROUP BY 1, 2""",
)
def _(d):
    rows = d.station_day.withColumn("season", F.date_format("d", "MMdd"))
    return agg.climatology(rows, ["station", "season"], "v", hold_out=F.year("d") == 1998)


@query(
    "f2_agg_features",
    "site int, m int, v_mean num, v_std num, v_min num, v_max num, v_sum num, v_count big, v_median num, v_p10 num, v_p90 num",
    """SELECT site, month(d) AS m, avg(v) AS v_mean, stddev_samp(v) AS v_std, min(v) AS v_min, max(v) AS v_max,
    sum(v) AS v_sum, count(v) AS v_count, median(v) AS v_median, quantile_cont(v, 0.1) AS v_p10,
    quantile_cont(v, 0.9) AS v_p90 FROM station_day GROUP BY 1, 2""",
)
def _(d):
    rows = d.station_day.withColumn("m", F.month("d"))
    return agg.agg_features(
        rows, ["site", "m"], ["v"], ["mean", "std", "min", "max", "sum", "count", "median", "p10", "p90"]
    )


@query(
    "f3_group_quantiles",
    "site int, m int, q10 num, q50 num, q90 num",
    """SELECT site, m, quantile_cont(vol, 0.1) AS q10, quantile_cont(vol, 0.5) AS q50, quantile_cont(vol, 0.9) AS q90
    FROM flow_month GROUP BY 1, 2""",
)
def _(d):
    return quantiles.group_quantiles(d.flow_month, ["site", "m"], "vol", (0.1, 0.5, 0.9), ("q10", "q50", "q90"))


@query(
    "f3_spread_quantiles",
    "l_returnflag str, q10 num, q50 num, q90 num, q99 num",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS q50,
    quantile_cont(l_extendedprice, 0.9) AS q90, quantile_cont(l_extendedprice, 0.99) AS q99
    FROM lineitem GROUP BY 1""",
)
def _(d):
    return quantiles.spread_quantiles(
        d.table("lineitem"), ["l_returnflag"], "l_extendedprice", (0.1, 0.5, 0.9, 0.99), ("q10", "q50", "q90", "q99")
    )


@query(
    "f4_basin_mean",
    "site int, d iso, v num, n_stations big",
    """SELECT p.site, s.d, avg(s.v) AS v, count(s.v) AS n_stations FROM station_day s
    JOIN area_pairs p ON s.station = p.station GROUP BY 1, 2""",
)
def _(d):
    return agg.basin_mean(d.station_day.drop("site"), d.area_pairs, "station", ["site", "d"], "v")


@query(
    "f5_zonal",
    "site int, t iso, mean num, median num, min num, max num, n_cells big",
    """SELECT c.site, g.t, avg(g.v) AS mean, median(g.v) AS median, min(g.v) AS min, max(g.v) AS max, count(g.v) AS n_cells FROM grid g JOIN (
      SELECT p.lat, p.lon, e.site FROM (SELECT DISTINCT lat, lon FROM grid) p, basin_edges e GROUP BY 1, 2, 3
      HAVING sum(((y1 > p.lat) <> (y2 > p.lat) AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1)::INTEGER) % 2 = 1) c
    ON g.lat = c.lat AND g.lon = c.lon GROUP BY 1, 2""",
)
def _(d):
    return spatial.zonal(d.grid, d.polygons, "site", "t", "v")


@query(
    "f6_season_max",
    "station int, wy int, season_max num",
    """SELECT station, wy, max(acc) AS season_max FROM (SELECT station, d, wy,
      sum(v) OVER (PARTITION BY station, wy ORDER BY d) AS acc
      FROM (SELECT *, year(d) + (month(d) >= 10)::INTEGER AS wy FROM station_day)) GROUP BY 1, 2""",
)
def _(d):
    from freshet.functions.calendar import water_year
    from freshet.operators.windows import cumsum

    rows = d.station_day.withColumn("wy", water_year("d"))
    acc = cumsum(rows, ["station", "wy"], "d", "v", "acc")
    return agg.season_max(acc, ["station", "wy"], "acc")


@query(
    "f7_agg_any_issue_date",
    "site int, issue_date iso, v_sum num, v_count big, v_std num, v_p50 num",
    """SELECT g.site, g.issue_date, sum(s.v) AS v_sum, count(s.v) AS v_count, stddev_samp(s.v) AS v_std,
      quantile_cont(s.v, 0.5) AS v_p50 FROM (SELECT site, issue_date + (site % 7 + 1)::INTEGER AS issue_date FROM issue_grid) g
    LEFT JOIN site_day s ON g.site = s.site AND s.d < g.issue_date
      AND s.d >= make_date(year(g.issue_date) - (month(g.issue_date) < 10)::INTEGER, 10, 1) GROUP BY 1, 2""",
)
def _(d):
    live = d.issue_grid.select("site", F.date_add("issue_date", (F.col("site") % 7 + 1).cast("int")).alias("issue_date"))
    return asof.agg_since(d.site_day, live, ["site"], "d", "v", "issue_date", 10, aggs=("sum", "count", "std", "p50"))


_SINCE = """SELECT g.site, g.issue_date, sum(s.{v}) AS v_sum, count(s.{v}) AS v_count, avg(s.{v}) AS v_mean,
  min(s.{v}) AS v_min, max(s.{v}) AS v_max FROM issue_grid g LEFT JOIN (SELECT *, {order} AS pos FROM {src}) s
  ON g.site = s.site AND s.d >= make_date(g.yr - 1, 10, 1) AND s.d < g.issue_date AND s.pos >= {start}
GROUP BY 1, 2"""
_SCALED = "(SELECT site, d, v * 1.9834591996927::DOUBLE AS v FROM site_day)"


@query(
    "f7_agg_since_october",
    "site int, issue_date iso, v_sum num, v_count big, v_mean num, v_min num, v_max num",
    _SINCE.format(v="v", order="0", src=_SCALED, start=0),
)
def _(d):
    scaled = d.site_day.withColumn("v", F.col("v") * 1.9834591996927)
    return asof.agg_since(scaled, d.issue_grid, ["site"], "d", "v", "issue_date", 10)


@query(
    "f7_agg_since_march",
    "site int, issue_date iso, v_sum num, v_count big, v_mean num, v_min num, v_max num",
    _SINCE.format(v="v", order="(month(d) + 2) % 12", src=_SCALED, start=5),
)
def _(d):
    scaled = d.site_day.withColumn("v", F.col("v") * 1.9834591996927)
    return asof.agg_since(scaled, d.issue_grid, ["site"], "d", "v", "issue_date", 3)


@query(
    "f8_agg_since_month",
    "site int, issue_date iso, v_sum num, v_count big, v_mean num, v_min num, v_max num",
    _SINCE.format(
        v="vol", order="(m + 2) % 12", src="(SELECT site, m, vol, last_day(t) AS d FROM flow_month)", start=1
    ),
)
def _(d):
    return asof.agg_since_month(d.flow_month, d.issue_grid, ["site"], "t", "vol", "issue_date", 11)


@query(
    "f9_season_to_date",
    "site int, issue_date iso, to_date num, or_null num",
    """SELECT g.site, g.issue_date, coalesce(sum(f.vol), 0) AS to_date, sum(f.vol) AS or_null FROM issue_grid g
    LEFT JOIN flow_month f ON g.site = f.site AND g.yr = f.yr AND f.m BETWEEN season_start AND season_end AND f.m < g.m
    GROUP BY 1, 2""",
)
def _(d):
    a = asof.season_to_date(
        joins.with_metadata(d.flow_month, d.site_meta, "site"), d.issue_grid, ["site"], "t", "vol", "issue_date"
    )
    b = asof.season_to_date(
        joins.with_metadata(d.flow_month, d.site_meta, "site"), d.issue_grid, ["site"], "t", "vol", "issue_date", True
    ).select("site", "issue_date", F.col("to_date").alias("or_null"))
    return a.join(b, ["site", "issue_date"])


@query(
    "f10_string_aggregation",
    "site int, issue_date iso, members str",
    """SELECT site, issue_date, string_agg(member, ',' ORDER BY q10, member) AS members FROM members GROUP BY 1, 2""",
)
def _(d):
    return agg.concat_by(d.members, ["site", "issue_date"], "q10", "member").withColumnRenamed("member_list", "members")


@query(
    "f11_extreme_years",
    "site int, min_year int, min_value num, max_year int, max_value num, normal_median num, normal_mean num",
    """SELECT site, arg_min(yr, vol) AS min_year, min(vol) AS min_value, arg_max(yr, vol) AS max_year, max(vol) AS max_value,
    median(vol) FILTER (yr BETWEEN 1996 AND 2000) AS normal_median, avg(vol) FILTER (yr BETWEEN 1996 AND 2000) AS normal_mean
    FROM site_year GROUP BY site""",
)
def _(d):
    return agg.extreme_years(d.site_year, ["site"], "yr", "vol", (1996, 2000))


@query(
    "f12_pivot",
    "site int, wy int, " + ", ".join(f"m{i} num" for i in range(1, 13)),
    "SELECT site, wy, " + ", ".join(f"max(vol) FILTER (m = {i}) AS m{i}" for i in range(1, 13)) + " FROM flow_month GROUP BY 1, 2",
)
def _(d):
    months = list(range(1, 13))
    wide = agg.pivot(d.flow_month, ["site", "wy"], "m", "vol", months)
    return wide.withColumnsRenamed({str(m): f"m{m}" for m in months})


@query(
    "f13_unpivot",
    "site int, yr int, md int, member int, quantile str, feature str, value num",
    """SELECT w.site, w.yr, w.md, w.member, w.quantile, u.feature, u.value FROM contrib_wide w, LATERAL (VALUES
      ('shap__snow', shap__snow), ('shap__rain', shap__rain), ('shap__flow_deviation_10', shap__flow_deviation_10),
      ('shap__elevation', shap__elevation)) u(feature, value)""",
)
def _(d):
    columns = [c for c in d.contrib_wide.columns if c.startswith("shap__")]
    return agg.melt(d.contrib_wide, ["site", "yr", "md", "member", "quantile"], columns, "feature", "value")


@query(
    "f14_member_stats",
    "site int, issue_date iso, mean num, sd num, p10 num, p50 num, p90 num",
    """SELECT site, issue_date, avg(q50) AS mean, stddev_samp(q50) AS sd, quantile_cont(q50, 0.1) AS p10,
    quantile_cont(q50, 0.5) AS p50, quantile_cont(q50, 0.9) AS p90 FROM members GROUP BY 1, 2""",
)
def _(d):
    return agg.member_stats(d.members, ["site", "issue_date"], "q50")


@query(
    "f14_deaccumulate",
    "station int, d iso, step num",
    "SELECT station, d, v AS step FROM station_day",
)
def _(d):
    from freshet.operators.windows import cumsum

    running = cumsum(d.station_day, ["station"], "d", "v", "acc")
    return agg.deaccumulate(running, ["station"], "d", "acc")


@query(
    "f14_monthly_median_by_lead",
    "quantile str, site int, fy int, month iso, lead int, median num",
    # Members are line numbers, forecasts are flags and sites in a water year, totals run over its days.
    """WITH r AS (SELECT l_returnflag AS quantile, s_nationkey AS site, l_shipdate::DATE AS d, l_linenumber AS member, sum(l_quantity) AS v
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4),
    a AS (SELECT *, year(d) + (month(d) >= 10)::INTEGER AS fy FROM r),
    t AS (SELECT quantile, site, fy, d, sum(v) OVER (PARTITION BY quantile, site, fy, member ORDER BY d) AS acc FROM a),
    m AS (SELECT quantile, site, fy, d, median(acc) AS mid FROM t GROUP BY 1, 2, 3, 4),
    s AS (SELECT quantile, site, fy, date_trunc('month', d)::DATE AS month,
      mid - lag(mid) OVER (PARTITION BY quantile, site, fy ORDER BY d) AS step FROM m),
    f AS (SELECT *, min(month) OVER (PARTITION BY quantile, site, fy) AS first FROM s)
    SELECT quantile, site, fy, month, date_diff('month', first, month) AS lead, median(step) AS median FROM f GROUP BY ALL""",
)
def _(d):
    from freshet.functions.calendar import water_year
    from freshet.operators.windows import cumsum

    rows = (
        d.table("lineitem")
        .groupBy(
            F.col("l_returnflag").alias("quantile"), F.col("l_suppkey").cast("int").alias("station"),
            F.col("l_shipdate").cast("date").alias("d"), F.col("l_linenumber").alias("member"),
        )
        .agg(F.sum("l_quantity").alias("v"))
        .join(d.station_meta.select("station", "site"), "station")
        .groupBy("quantile", "site", "d", "member")
        .agg(F.sum("v").alias("v"))
        .withColumn("fy", water_year("d"))
    )
    running = cumsum(rows, ["quantile", "site", "fy", "member"], "d", "v", "acc")
    return agg.monthly_median(running, ["quantile", "site", "fy"], "d", "acc", running_total=True)


@query(
    "f15_forecast_by_issue",
    "site int, issue_date iso, forecast_mean num",
    """WITH f AS (SELECT site, yr, substr(member, 1, 1)::INTEGER AS im, avg(q50) FILTER (m * 100 + 1 <= 620) AS mean
      FROM members GROUP BY 1, 2, 3),
    r AS (SELECT g.site, g.issue_date, f.mean, row_number() OVER (PARTITION BY g.site, g.issue_date ORDER BY f.im DESC) AS n
      FROM issue_grid g LEFT JOIN f ON f.site = g.site AND f.yr = g.yr AND f.mean IS NOT NULL
        AND make_date(f.yr, f.im, 6) <= g.issue_date)
    SELECT site, issue_date, mean AS forecast_mean FROM r WHERE n = 1""",
)
def _(d):
    rows = d.members.select("site", F.col("issue_date").alias("lead"), "q50", F.make_date("yr", F.substring("member", 1, 1).cast("int"), F.lit(1)).alias("made"))
    return agg.forecast_mean(rows, d.issue_grid, ["site"], "made", "lead", "q50", "issue_date", 6, 620)


@query(
    "f16_month_to_issue_days",
    "site int, issue_date iso, vol num",
    """SELECT site, t + (dd - 1) AS issue_date, CASE WHEN dd = 1 THEN prev ELSE vol END AS vol FROM (
      SELECT site, t, vol, lag(vol) OVER (PARTITION BY site ORDER BY t) AS prev FROM flow_month),
      unnest([1, 8, 15, 22]) u(dd)""",
)
def _(d):
    return frames.month_to_issue_days(d.flow_month, ["site"], "t", "vol")


@query(
    "f17_elevation_stats",
    "site int, elev_mean num, elev_sd num, south_rate num, east_rate num",
    """WITH g AS (SELECT s.site, c.lat, c.lon, c.elev FROM (SELECT lat, lon, floor(sum(v) / 7) AS elev FROM
        (SELECT lat, lon, floor(v) AS v FROM grid) GROUP BY 1, 2) c
      JOIN boxes s ON c.lat BETWEEN lat_min AND lat_max AND c.lon BETWEEN lon_min AND lon_max),
    s AS (SELECT *, lag(elev) OVER (PARTITION BY site, lon ORDER BY lat DESC) - elev AS ds,
      elev - lag(elev) OVER (PARTITION BY site, lat ORDER BY lon) AS de FROM g)
    SELECT site, avg(elev) FILTER (elev <> 0) AS elev_mean, stddev_pop(elev) FILTER (elev <> 0) AS elev_sd,
      avg((ds > 0)::INTEGER) FILTER (ds <> 0) AS south_rate, avg((de > 0)::INTEGER) FILTER (de <> 0) AS east_rate
    FROM s GROUP BY site""",
)
def _(d):
    cells = d.grid.groupBy("lat", "lon").agg(F.floor(F.sum(F.floor("v")) / 7).cast("double").alias("elev"))
    return spatial.elevation_stats(spatial.bbox_join(cells, d.boxes), "site")


@query(
    "f18_frequency",
    "l_returnflag str, l_linestatus str, n big",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def _(d):
    return agg.freq(d.table("lineitem"), "l_returnflag", "l_linestatus")


@query(
    "i1_union_by_name",
    "source str, site int, d iso, v num, vol num",
    """SELECT 'snow' AS source, site, d, v, NULL AS vol FROM site_day UNION ALL
    SELECT 'flow', site, d, NULL, vol FROM flow_day""",
)
def _(d):
    return sets.union_all([("snow", d.site_day), ("flow", d.flow_day)])


@query(
    "i2_union_distinct",
    "site int, d iso",
    "SELECT site, d FROM site_day UNION SELECT site, d FROM flow_day",
)
def _(d):
    return sets.union_distinct(d.site_day.select("site", "d"), d.flow_day.select("site", "d"))


@query(
    "i3_common_keys",
    "site int, d iso",
    "SELECT site, d FROM site_day INTERSECT SELECT site, d FROM flow_day",
)
def _(d):
    return sets.common_keys(d.site_day, d.flow_day, ["site", "d"])


@query(
    "i4_missing_keys",
    "site int, d iso",
    "SELECT site, issue_date AS d FROM issue_grid EXCEPT SELECT site, d FROM flow_day",
)
def _(d):
    expected = d.issue_grid.select("site", F.col("issue_date").alias("d"))
    return sets.missing_keys(expected, d.flow_day, ["site", "d"])
