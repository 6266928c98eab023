"""Queries for joins and as-of operators."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions.calendar import cond_date
from freshet.operators import asof, joins, spatial


@query(
    "e1_inner_join",
    "station int, d iso, anomaly num",
    """SELECT s.station, s.d, s.v - c.m AS anomaly FROM station_day s
    JOIN (SELECT station, month(d) AS mm, avg(v) AS m FROM station_day GROUP BY 1, 2) c
      ON s.station = c.station AND month(s.d) = c.mm""",
)
def _(d):
    rows = d.station_day.withColumn("mm", F.month("d"))
    clim = rows.groupBy("station", "mm").agg(F.avg("v").alias("m"))
    return joins.merge(rows, clim, ["station", "mm"]).withColumn("anomaly", F.col("v") - F.col("m"))


@query(
    "e2_integrate",
    "site int, issue_date iso, v num, vol num",
    """SELECT g.site, g.issue_date, s.v, f.vol FROM issue_grid g
    LEFT JOIN site_day s ON g.site = s.site AND g.issue_date = s.d
    LEFT JOIN flow_day f ON g.site = f.site AND g.issue_date = f.d""",
)
def _(d):
    stale = d.issue_grid.withColumns({"v": F.lit(0.0), "vol": F.lit(0.0)})
    daily = d.site_day.withColumnRenamed("d", "issue_date")
    flow = d.flow_day.withColumnRenamed("d", "issue_date")
    out = joins.integrate(stale, daily, ["v"], ["site", "issue_date"])
    return joins.integrate(out, flow, ["vol"], ["site", "issue_date"])


@query(
    "e3_full_outer",
    "site int, d iso, md_id int, v num",
    """SELECT coalesce(g.site, s.site) AS site, coalesce(g.issue_date, s.d) AS d, md_id, v
    FROM issue_grid g FULL JOIN site_day s ON g.site = s.site AND g.issue_date = s.d""",
)
def _(d):
    issues = d.issue_grid.select("site", F.col("issue_date").alias("d"), "md_id")
    return joins.merge(issues, d.site_day, ["site", "d"], "outer")


@query(
    "e4_cross_pairs",
    "site int, station int, gap num",
    """SELECT si.site, st.station, abs(si.elev - st.elev) AS gap FROM site_meta si, station_meta st""",
)
def _(d):
    sites = d.site_meta.select("site", F.col("elev").alias("site_elev"))
    pairs = joins.all_pairs(sites, d.station_meta.select("station", "elev"))
    return pairs.withColumn("gap", F.abs(F.col("site_elev") - F.col("elev")))


@query(
    "e5_metadata_lookup",
    "site int, d iso, v num, elev num, season_start int, n_months int",
    """SELECT s.site, d, v, elev, season_start, season_end - season_start + 1 AS n_months
    FROM site_day s JOIN site_meta m ON s.site = m.site""",
)
def _(d):
    return joins.with_metadata(d.site_day, d.site_meta.drop("lat", "lon"), "site")


@query(
    "e6_semi_join",
    "station int, d iso, v num",
    "SELECT station, d, v FROM station_day WHERE site IN (SELECT site FROM site_meta WHERE area = 2)",
)
def _(d):
    return joins.keep_in(d.station_day, d.site_meta.where("area = 2"), ["site"])


@query(
    "e6_anti_join",
    "site int, d iso, v num",
    "SELECT site, d, v FROM site_day s WHERE NOT EXISTS (SELECT 1 FROM flow_day f WHERE f.site = s.site AND f.d = s.d)",
)
def _(d):
    return joins.keep_not_in(d.site_day, d.flow_day, ["site", "d"])


_ASOF = """SELECT g.site, g.issue_date, CASE WHEN s.d >= make_date(year(g.{cut}) - (month(g.{cut}) < 10)::INTEGER, 10, 1)
  THEN s.v END AS v FROM {grid} g ASOF LEFT JOIN {obs} s ON g.site = s.site AND s.d {op} g.{cut}"""


@query(
    "e7_asof_latest",
    "site int, issue_date iso, v num",
    _ASOF.format(grid="issue_grid", obs="site_day", op="<", cut="issue_date"),
)
def _(d):
    return asof.asof_latest(d.site_day, d.issue_grid, ["site"], "d", ["v"], "issue_date")


@query(
    "e7_asof_inclusive_lagged",
    "site int, issue_date iso, v num, v_date iso",
    """SELECT g.site, g.issue_date, s.vol AS v, s.d AS v_date FROM issue_grid g
    ASOF LEFT JOIN (SELECT site, d, vol, d + 5 AS usable FROM flow_day) s ON g.site = s.site AND s.usable <= g.issue_date""",
)
def _(d):
    out = asof.asof_latest(
        d.flow_day, d.issue_grid, ["site"], "d", ["vol"], "issue_date",
        strict=False, lag_days=5, start_month=None, out=["v"], out_date="v_date",
    )
    return out


@query(
    "e7_asof_lagged_water_year",
    "site int, issue_date iso, v num, v_date iso",
    """WITH g AS (SELECT site, make_date(yr, 10, dd) AS issue_date FROM issue_grid WHERE m = 1)
    SELECT g.site, g.issue_date, CASE WHEN s.d >= make_date(year(g.issue_date), 10, 1) THEN s.v END AS v,
      CASE WHEN s.d >= make_date(year(g.issue_date), 10, 1) THEN s.d END AS v_date
    FROM g ASOF LEFT JOIN (SELECT *, d + 5 AS usable FROM site_day) s ON g.site = s.site AND s.usable < g.issue_date""",
)
def _(d):
    first = d.issue_grid.where("m = 1").select("site", F.make_date("yr", F.lit(10), "dd").alias("issue_date"))
    return asof.asof_latest(d.site_day, first, ["site"], "d", ["v"], "issue_date", lag_days=5, out_date="v_date")


@query(
    "e8_asof_conditional",
    "site int, issue_date iso, latest num, conditional num, since num",
    """WITH g AS (SELECT *, CASE WHEN m NOT BETWEEN season_start AND season_end THEN issue_date - 1
        WHEN site % 9 = 0 THEN make_date(yr, 3, 31) ELSE make_date(yr, m, 1) - 1 END AS cut FROM issue_grid),
    a AS (SELECT g.site, g.issue_date, CASE WHEN s.d >= make_date(yr - 1, 10, 1) THEN s.v END AS latest
      FROM g ASOF LEFT JOIN site_day s ON g.site = s.site AND s.d < g.issue_date),
    b AS (SELECT g.site, g.issue_date, CASE WHEN s.d >= make_date(yr - 1, 10, 1) THEN s.v END AS conditional
      FROM g ASOF LEFT JOIN site_day s ON g.site = s.site AND s.d <= g.cut)
    SELECT a.site, a.issue_date, latest, conditional, latest - conditional AS since
    FROM a JOIN b ON a.site = b.site AND a.issue_date = b.issue_date""",
)
def _(d):
    cut = cond_date("issue_date", "season_start", "season_end", F.col("site") % 9 == 0)
    issues = d.issue_grid.withColumn("cut", cut)
    return asof.asof_conditional(d.site_day, issues, ["site"], "d", "v", "issue_date", "cut")


@query(
    "e9_prev_month_value",
    "site int, issue_date iso, on_first num, on_fifth num",
    """SELECT g.site, g.issue_date, a.vol AS on_first, b.vol AS on_fifth FROM issue_grid g
    LEFT JOIN flow_month a ON g.site = a.site AND a.t = date_trunc('month', g.issue_date) - INTERVAL 1 MONTH
    LEFT JOIN flow_month b ON g.site = b.site
      AND b.t = date_trunc('month', g.issue_date) - to_months(1 + (g.dd < 5)::INTEGER)""",
)
def _(d):
    first = joins.prev_month_value(d.issue_grid, d.flow_month, "site", "issue_date", "t", "vol")
    first = first.withColumnRenamed("prev_value", "on_first")
    return joins.prev_month_value(first, d.flow_month, "site", "issue_date", "t", "vol", 5).withColumnRenamed(
        "prev_value", "on_fifth"
    )


@query(
    "e10_bucket_latest",
    "site int, issue_date iso, bucket_value num",
    """SELECT g.site, g.issue_date, b.v AS bucket_value FROM issue_grid g LEFT JOIN (
      SELECT site, snap, arg_max(v, d) AS v FROM (SELECT site, d, v, CASE WHEN day(d + 1) <= 1 THEN d + 1
        WHEN day(d + 1) <= 8 THEN make_date(year(d + 1), month(d + 1), 8)
        WHEN day(d + 1) <= 15 THEN make_date(year(d + 1), month(d + 1), 15)
        WHEN day(d + 1) <= 22 THEN make_date(year(d + 1), month(d + 1), 22)
        ELSE (date_trunc('month', d + 1) + INTERVAL 1 MONTH)::DATE END AS snap FROM site_day)
      GROUP BY site, snap) b ON g.site = b.site AND g.issue_date = b.snap""",
)
def _(d):
    return asof.bucket_latest(d.site_day, d.issue_grid, ["site"], "d", "v", "issue_date")


@query(
    "e11_bbox_join",
    "site int, t iso, lat num, lon num, v num",
    """SELECT site, t, lat, lon, v FROM grid JOIN boxes
    ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max""",
)
def _(d):
    return spatial.bbox_join(d.grid, d.boxes)


_CROSSINGS = """SELECT p.station, e.site, sum(((y1 > p.lat) <> (y2 > p.lat)
    AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1)::INTEGER) % 2 = 1 AS in_basin,
  min(sqrt(
    power((x1 - p.lon) * kx + greatest(0, least(1, tt)) * (x2 - x1) * kx, 2)
    + power((y1 - p.lat) * 111.195::DOUBLE + greatest(0, least(1, tt)) * (y2 - y1) * 111.195::DOUBLE, 2))) AS km
FROM (SELECT *, -((x1 - p.lon) * kx * (x2 - x1) * kx + (y1 - p.lat) * (y2 - y1) * 111.195::DOUBLE ** 2)
    / (((x2 - x1) * kx) ** 2 + ((y2 - y1) * 111.195::DOUBLE) ** 2) AS tt
  FROM (SELECT station, lat, lon, cos(radians(lat)) * 111.195::DOUBLE AS kx FROM station_meta) p, basin_edges) pe,
LATERAL (SELECT pe.station, pe.lat, pe.lon) p(station, lat, lon), LATERAL (SELECT pe.site) e(site)
GROUP BY p.station, e.site"""


@query(
    "e12_point_in_polygon",
    "station int, site int",
    f"SELECT station, site FROM ({_CROSSINGS}) WHERE in_basin",
)
def _(d):
    return spatial.within_join(d.station_meta.select("station", "lat", "lon"), d.polygons)


@query(
    "e12_point_near_polygon",
    "station int, site int, in_basin bit",
    f"SELECT station, site, in_basin FROM ({_CROSSINGS}) WHERE in_basin OR km <= 25",
)
def _(d):
    return spatial.within_join(d.station_meta.select("station", "lat", "lon"), d.polygons, buffer_km=25.0)


@query(
    "e12_first_polygon",
    "station int, site int",
    f"SELECT station, min(site) AS site FROM ({_CROSSINGS}) WHERE in_basin GROUP BY station",
)
def _(d):
    points = d.station_meta.select("station", "lat", "lon")
    return spatial.within_join(points, d.polygons, first_by=(["station"], "site"))


_DIST = """SELECT si.site, st.station, 2 * 6371.0::DOUBLE * asin(sqrt(sin(radians(st.lat - si.lat) / 2) ** 2
  + cos(radians(st.lat)) * cos(radians(si.lat)) * sin(radians(st.lon - si.lon) / 2) ** 2)) AS dist
FROM site_meta si, station_meta st"""


@query(
    "e13_nearest",
    "site int, station int, dist num, rnk int",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY dist, station) AS rnk FROM ({_DIST}))
    WHERE rnk <= 10 OR dist <= 300""",
)
def _(d):
    return spatial.nearest(d.site_meta, d.station_meta, "site", "station", k=10, radius_km=300.0)


@query(
    "e13_nearest_cut",
    "site int, station int, dist num, rnk int",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY dist, station) AS rnk FROM ({_DIST}))
    WHERE rnk <= 10 AND dist < 200""",
)
def _(d):
    near = spatial.nearest(d.site_meta, d.station_meta, "site", "station", k=10)
    return near.where((F.col("rnk") <= 10) & (F.col("dist") < 200))


@query(
    "e14_huc_join",
    "site int, huc4 str, n_stations big, elev num",
    """SELECT a.site, a.huc AS huc4, count(*) AS n_stations, avg(b.elev) AS elev
    FROM site_meta a JOIN station_meta b ON substr(a.huc, 1, 4) = substr(b.huc, 1, 4) GROUP BY 1, 2""",
)
def _(d):
    pairs = joins.huc_join(d.site_meta.select("site", "huc"), d.station_meta.select("station", "huc", "elev"), 4)
    return pairs.groupBy("site", "huc4").agg(F.count(F.lit(1)).alias("n_stations"), F.avg("elev").alias("elev"))


@query(
    "e15_site_station_pairs",
    "site int, station int, method str, dist num, rnk int",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY dist, station) AS rnk FROM ({_DIST})),
    tagged AS (
      SELECT site, station, 'around' AS method, dist, rnk FROM ranked WHERE rnk <= 5 UNION ALL
      SELECT a.site, b.station, 'huc', NULL, NULL FROM site_meta a JOIN station_meta b ON a.huc = substr(b.huc, 1, 4) UNION ALL
      SELECT site, station, 'near', NULL, NULL FROM ({_CROSSINGS}) WHERE in_basin OR km <= 25 UNION ALL
      SELECT site, station, 'within', NULL, NULL FROM ({_CROSSINGS}) WHERE in_basin)
    SELECT site, station, string_agg(method, ',' ORDER BY method) AS method, min(dist) AS dist, min(rnk) AS rnk
    FROM tagged WHERE station IN (SELECT station FROM station_day GROUP BY station
      HAVING min(d) < (SELECT min(d) + INTERVAL 1 MONTH FROM station_day) AND max(d) > (SELECT max(d) - INTERVAL 6 MONTH FROM station_day))
      GROUP BY site, station""",
)
def _(d):
    points = d.station_meta.select("station", "lat", "lon")
    tagged = [
        ("huc", joins.huc_join(d.site_meta.select("site", "huc"), d.station_meta.select("station", "huc"), 4)),
        ("around", spatial.nearest(d.site_meta, d.station_meta, "site", "station", k=5)),
        ("within", spatial.within_join(points, d.polygons)),
        ("near", spatial.within_join(points, d.polygons, buffer_km=25.0)),
    ]
    # Active from the first month of all records to the last half year.
    spans = d.station_day.groupBy("station").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    first, last = spans.agg(F.add_months(F.min("a"), 1), F.add_months(F.max("b"), -6)).first()
    active = spans.where((F.col("a") < F.lit(first)) & (F.col("b") > F.lit(last)))
    return joins.site_station_pairs(tagged, active, max_rank=5)


@query(
    "e16_target_months",
    "site int, issue_date iso, pred_month int, month_vol num",
    """SELECT g.site, g.issue_date, f.m AS pred_month, f.vol AS month_vol FROM issue_grid g
    JOIN flow_month f ON g.site = f.site AND g.yr = f.yr AND f.m BETWEEN season_start AND season_end AND g.m <= f.m""",
)
def _(d):
    return joins.expand_target_months(d.issue_grid, d.flow_month)


@query(
    "e17_merge_all",
    "site int, yr int, vol num, y num, q50 num",
    """SELECT a.site, a.yr, a.vol, b.y, c.q50 FROM site_year a
    LEFT JOIN (SELECT site, yr, avg(y) AS y FROM truth GROUP BY 1, 2) b ON a.site = b.site AND a.yr = b.yr
    LEFT JOIN (SELECT site, yr, max(q50) AS q50 FROM members GROUP BY 1, 2) c ON a.site = c.site AND a.yr = c.yr""",
)
def _(d):
    y = d.truth.groupBy("site", "yr").agg(F.avg("y").alias("y"))
    top = d.members.groupBy("site", "yr").agg(F.max("q50").alias("q50"))
    return joins.merge_all([d.site_year, y, top], ["site", "yr"])


@query(
    "e18_nearest_cell",
    "station int, cell_lat num, cell_lon num",
    """SELECT station, (SELECT arg_min(g.lat, struct_pack(a := abs(g.lat - s.lat), b := g.lat)) FROM (SELECT DISTINCT lat FROM grid) g) AS cell_lat,
      (SELECT arg_min(g.lon, struct_pack(a := abs(g.lon - s.lon), b := g.lon)) FROM (SELECT DISTINCT lon FROM grid) g) AS cell_lon
    FROM station_meta s""",
)
def _(d):
    return spatial.nearest_cell(d.station_meta, d.grid)
