"""Queries for folds, selection, scaling and features (J1 to J24 except models)."""

from pyspark.sql import Window, functions as F

from freshet.catalog.registry import query
from freshet.functions.calendar import md_id, snap_up, water_year
from freshet.operators import asof
from freshet.plans import features, folds, selection
from freshet.session import spread

YEARS = "(SELECT yr FROM years)"


@query(
    "j1_loocv",
    "fold int, site int, n_train big, mean_vol num",
    f"""SELECT fold, site, count(*) AS n_train, avg(vol) AS mean_vol FROM site_year, {YEARS} f(fold)
    WHERE yr <> fold GROUP BY 1, 2""",
)
def _(d):
    rows = folds.loocv(d.site_year, "yr", *d.years)
    return rows.groupBy("fold", "site").agg(F.count(F.lit(1)).alias("n_train"), F.avg("vol").alias("mean_vol"))


@query(
    "j1_loo_statistics",
    "station int, m int, fold int, n big, loo_mean num, loo_std num",
    f"""SELECT station, month(d) AS m, fold, count(v) AS n, avg(v) AS loo_mean, stddev_samp(v) AS loo_std
    FROM station_day, {YEARS} f(fold) WHERE year(d) <> fold GROUP BY 1, 2, 3""",
)
def _(d):
    rows = d.station_day.withColumns({"yr": F.year("d"), "m": F.month("d")})
    return folds.loo_stats(rows, ["station", "m"], "yr", "v", *d.years)


def _draw(n: int, text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {n})"


@query(
    "j2_kfold",
    "repeat int, fold int, n_years big, n_rows big",
    f"""WITH k AS (SELECT yr, r AS repeat, ntile(3) OVER (PARTITION BY r ORDER BY {_draw(1 << 32, "yr || '|' || r || '|11'")}, yr) - 1 AS fold
      FROM (SELECT DISTINCT yr FROM site_year), range(4) t(r))
    SELECT repeat, fold, count(DISTINCT yr) AS n_years, count(*) AS n_rows FROM site_year JOIN k USING (yr) GROUP BY 1, 2""",
)
def _(d):
    rows = folds.kfold(d.site_year, "yr", k=3, repeats=4, seed=11)
    return rows.groupBy("repeat", "fold").agg(
        F.count_distinct("yr").alias("n_years"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "j3_year_cat",
    "site int, yr int, cat str",
    """SELECT site, yr, CASE WHEN yr = 2001 THEN 'test' WHEN yr IN (1999, 2000) THEN 'valid' ELSE 'train' END AS cat
    FROM site_year""",
)
def _(d):
    return d.site_year.withColumn("cat", folds.year_cat("yr", [1999, 2000], [2001]))


_J4 = f"""WITH x AS (SELECT station, year(d) AS yr, avg(v) AS x FROM station_day
    WHERE month(d) IN (1, 2, 3) AND year(d) >= 1995 GROUP BY 1, 2),
  s AS (SELECT fold, p.site, x.station, round(corr(x.x, l.vol), 9) AS r, count(*) AS n FROM x
    JOIN area_pairs p ON x.station = p.station JOIN site_year l ON l.site = p.site AND l.yr = x.yr, {YEARS} f(fold)
    WHERE x.yr <> fold GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT fold, site, station, r, rnk FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, site ORDER BY r DESC, station) AS rnk FROM s WHERE r IS NOT NULL AND NOT isnan(r))
WHERE rnk <= 5"""


def chosen(d):
    yearly = selection.yearly_station_mean(d.station_day, "station", "d", "v", F.year("d"), (1, 2, 3), 1995)
    return selection.corr_select(yearly, d.area_pairs, d.site_year, 5, 5, *d.years)


@query("j4_corr_select", "fold int, site int, station int, r num9, rnk int", _J4)
def _(d):
    return chosen(d)


@query(
    "j5_r2_select",
    "site int, station int, r2 num, n_days big, rnk int",
    """WITH x AS (SELECT p.site, s.station, month(s.t) AS season, s.v AS x, l.vol FROM station_month s
      JOIN area_pairs p ON s.station = p.station JOIN site_year l ON l.site = p.site AND l.yr = year(s.t)),
    c AS (SELECT site, station, season, corr(x, vol) AS r FROM x GROUP BY 1, 2, 3),
    t AS (SELECT site, station, avg(r * r) AS r2, count(*) AS n_days FROM c WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(r2, 9) DESC, station) AS rnk FROM t)
    WHERE rnk <= 3""",
)
def _(d):
    rows = (
        d.station_month.drop("site")
        .join(d.area_pairs, "station")
        .withColumn("yr", F.year("t"))
        .join(d.site_year, ["site", "yr"])
        .select("site", "station", F.month("t").alias("season"), F.col("v").alias("x"), "vol")
    )
    return selection.r2_select(rows, 3)


def issue_rows(d):
    """Last station value before each issue date of the season, January to July, next to its volume."""
    # Dealt by station once; values, candidate sites and the correlations after them stay in that
    # task. The volumes come along as a map with one entry per year of a site.
    latest = (
        spread(d.station_day, ["station"], d.parts).groupBy("station", snap_up(F.date_add("d", 1)).alias("issue"))
        .agg(F.max_by("v", "d").alias("x"))
        .where(F.month("issue") <= 7)
        .withColumn("yr", F.year("issue"))
    )
    volumes = d.site_year.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("yr", "vol"))).alias("_vol"))
    return (
        latest.join(spread(d.area_pairs.join(volumes, "site"), ["station"], d.parts), "station")
        .where(F.map_contains_key("_vol", F.col("yr")))
        .select("site", "station", "yr", md_id(F.month("issue"), F.dayofmonth("issue")).alias("md"), "x", F.try_element_at("_vol", F.col("yr")).alias("vol"))
    )


_ISSUE_ROWS = """snaps AS (SELECT station, CASE WHEN day(d + 1) <= 1 THEN d + 1
    WHEN day(d + 1) <= 8 THEN make_date(year(d + 1), month(d + 1), 8)
    WHEN day(d + 1) <= 15 THEN make_date(year(d + 1), month(d + 1), 15)
    WHEN day(d + 1) <= 22 THEN make_date(year(d + 1), month(d + 1), 22)
    ELSE (date_trunc('month', d + 1) + INTERVAL 1 MONTH)::DATE END AS issue, d, v FROM station_day),
  last AS (SELECT station, issue, arg_max(v, d) AS x FROM snaps WHERE month(issue) <= 7 GROUP BY 1, 2),
  irows AS (SELECT p.site, l.station, year(issue) AS yr, (month(issue) - 1) * 4 + (day(issue) - 1) // 7 AS md, x, y.vol
    FROM last l JOIN area_pairs p ON l.station = p.station JOIN site_year y ON y.site = p.site AND y.yr = year(issue)),
  icorr AS (SELECT * FROM (SELECT site, station, md, corr(x, vol) AS r, count(x) AS n_obs FROM irows GROUP BY 1, 2, 3)
    WHERE r IS NOT NULL AND NOT isnan(r))"""


@query(
    "j6_issue_corr_select",
    "site int, station int, obs big, median_r num, season str",
    f"""WITH {_ISSUE_ROWS},
    mid AS (SELECT site, station, min(n_obs) AS obs, median(r) AS median_r, 'middle' AS season FROM icorr
      WHERE n_obs > 5 AND md <= 23 GROUP BY 1, 2),
    early AS (SELECT site, station, min(n_obs) AS obs, median(r) AS median_r, 'start' AS season FROM icorr
      WHERE md <= 5 GROUP BY 1, 2),
    u AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY obs DESC, round(median_r, 9) DESC, station) AS k, 4 AS lim FROM mid
      UNION ALL SELECT *, row_number() OVER (PARTITION BY site ORDER BY obs DESC, round(median_r, 9) DESC, station), 2 FROM early)
    SELECT site, station, obs, median_r, season FROM (
      SELECT *, row_number() OVER (PARTITION BY site, station ORDER BY season) AS pick FROM u WHERE k <= lim AND median_r > 0.1)
    WHERE pick = 1""",
)
def _(d):
    return selection.issue_corr_select(issue_rows(d), min_obs=5, min_median=0.1)


@query(
    "j6_merge_choices",
    "site int, station int, variable str, median_r num9, rnk int",
    f"""WITH {_ISSUE_ROWS},
    top AS (SELECT *, row_number() OVER (PARTITION BY site, variable ORDER BY obs DESC, round(median_r, 9) DESC, station) AS k FROM (
      SELECT site, station, 'mid' AS variable, min(n_obs) AS obs, median(r) AS median_r FROM icorr
        WHERE n_obs > 5 AND md BETWEEN 6 AND 23 GROUP BY 1, 2 UNION ALL
      SELECT site, station, 'early', min(n_obs), median(r) FROM icorr WHERE md <= 5 AND n_obs > 5 GROUP BY 1, 2)),
    best AS (SELECT site, station, max(struct_pack(r := round(median_r, 9), variable := variable)) AS b FROM top
      WHERE k <= 4 AND median_r > 0.05 GROUP BY 1, 2)
    SELECT * FROM (SELECT site, station, b.variable AS variable, b.r AS median_r,
      row_number() OVER (PARTITION BY site ORDER BY b.r DESC, station) AS rnk FROM best) WHERE rnk <= 4""",
)
def _(d):
    rows = issue_rows(d)
    mid = selection.issue_corr_select(rows.where("md >= 6"), min_obs=5, min_median=0.05, early_md=-1)
    early = selection.issue_corr_select(rows.where("md <= 5"), min_obs=5, min_median=0.05, early_md=-1)
    return selection.merge_choices([("mid", mid), ("early", early)])


@query(
    "j7_donors",
    "site int, station int, score num",
    f"""WITH sel AS (SELECT DISTINCT site, station FROM ({_J4}) WHERE r > 0.6),
    poor AS (SELECT m.site, m.huc FROM site_meta m LEFT JOIN (SELECT site, count(*) AS n FROM sel GROUP BY site) c
      ON m.site = c.site WHERE coalesce(n, 0) < 3)
    SELECT site, station, score FROM (SELECT p.site, s.station, s.elev AS score,
      row_number() OVER (PARTITION BY p.site ORDER BY s.elev DESC, s.station) AS k FROM poor p
      JOIN station_meta s ON substr(s.huc, 1, 4) = p.huc
      WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.site = p.site AND sel.station = s.station)) WHERE k = 1""",
)
def _(d):
    sel = chosen(d).where(F.col("r") > 0.6).select("site", "station").distinct()
    cand = d.station_meta.select(F.substring("huc", 1, 4).alias("huc"), "station", F.col("elev").alias("score"))
    return selection.donors(sel, d.site_meta.select("site", "huc"), cand)


@query(
    "j8_max_corr_issue",
    "site int, md int, best_station int, best_md int, best_r num9, is_later bit",
    f"""WITH {_ISSUE_ROWS}, rr AS (SELECT site, station, md, round(r, 9) AS r FROM icorr),
    best AS (SELECT site, station AS best_station, md AS best_md, r AS best_r FROM (
      SELECT *, row_number() OVER (PARTITION BY site ORDER BY r DESC, md, station) AS k FROM rr) WHERE k = 1)
    SELECT site, md, best_station, best_md, best_r, md > best_md AS is_later
    FROM (SELECT DISTINCT site, md FROM rr) JOIN best USING (site)""",
)
def _(d):
    return selection.max_corr_issue(issue_rows(d))


_MONTH_CORR = """SELECT f.site, f.m, round(corr(f.vol, l.vol), 9) AS r FROM flow_month f
JOIN site_year l ON f.site = l.site AND f.yr = l.yr GROUP BY 1, 2"""


@query(
    "j9_mask_weak",
    "site int, yr int, m int, vol num",
    f"""SELECT f.site, f.yr, f.m, CASE WHEN c.r > 0.12 AND NOT isnan(c.r) THEN f.vol END AS vol FROM flow_month f
    LEFT JOIN ({_MONTH_CORR}) c ON f.site = c.site AND f.m = c.m""",
)
def _(d):
    return selection.mask_weak(d.flow_month, d.site_year)


@query(
    "j10_best_month",
    "site int, best_month int, r num9",
    f"""SELECT site, m AS best_month, r FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY r DESC, m) AS k
    FROM ({_MONTH_CORR}) WHERE r > 0.2 AND NOT isnan(r)) WHERE k = 1""",
)
def _(d):
    return selection.best_month(d.flow_month, d.site_year)


@query(
    "j10_best_gauge",
    "site int, station int, median_r num9",
    """WITH r AS (SELECT p.site, s.station, month(s.t) AS m, corr(s.v, f.vol) AS r, count(*) AS n FROM station_month s
      JOIN area_pairs p ON s.station = p.station JOIN flow_month f ON f.site = p.site AND f.t = s.t GROUP BY 1, 2, 3),
    t AS (SELECT site, station, round(median(r), 9) AS median_r FROM r WHERE n >= 6 AND NOT isnan(r) GROUP BY 1, 2)
    SELECT site, station, median_r FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY median_r DESC, station) AS k
      FROM t WHERE median_r > 0) WHERE k = 1""",
)
def _(d):
    rows = (
        d.station_month.drop("site").join(d.area_pairs, "station")
        .join(d.flow_month, ["site", "t"])
        .select("site", "station", "m", F.col("v").alias("x"), "vol")
    )
    return selection.best_gauge(rows, min_pairs=6)


@query(
    "j11_index_screen",
    "site int, index_name str, m int, r num9",
    """SELECT site, index_name, m, r FROM (SELECT *, row_number() OVER (PARTITION BY site, index_name ORDER BY r, m) AS k FROM (
      SELECT l.site, i.name AS index_name, i.m, round(corr(i.val, l.vol), 9) AS r FROM site_year l JOIN (
        SELECT 'a' AS name, yr, m, val FROM index_month UNION ALL SELECT 'b', yr, m, val * val FROM index_month) i
      ON l.yr = i.yr GROUP BY 1, 2, 3) WHERE r IS NOT NULL AND NOT isnan(r)) WHERE k = 1 AND abs(r) > 0.1""",
)
def _(d):
    a = d.index_month.withColumn("index", F.lit("a"))
    b = d.index_month.withColumns({"index": F.lit("b"), "val": F.col("val") * F.col("val")})
    return selection.index_screen(a.unionByName(b), d.site_year).withColumnRenamed("index", "index_name")


@query(
    "j12_deviation",
    "fold int, site int, d iso, dev num, dev_5 num, dev_30 num",
    f"""WITH sel AS (SELECT fold, site, station FROM ({_J4}) ),
    o AS (SELECT station, d, v, strftime(d, '%m%d') AS season, CASE WHEN month(d) < 8 THEN year(d) ELSE year(d) + 1 END AS fy
      FROM station_day),
    st AS (SELECT o.station, season, fold, avg(v) AS m, CASE WHEN max(v) > min(v) THEN stddev_samp(v) END AS s
      FROM o, {YEARS} f(fold) WHERE fy <> fold GROUP BY 1, 2, 3),
    z AS (SELECT sel.fold, sel.site, o.fy, o.d, avg((o.v - st.m) / st.s) AS dev FROM o
      JOIN sel ON o.station = sel.station
      JOIN st ON st.station = o.station AND st.season = o.season AND st.fold = sel.fold GROUP BY 1, 2, 3, 4)
    SELECT fold, site, d, dev, avg(dev) OVER (p ROWS 4 PRECEDING) AS dev_5, avg(dev) OVER (p ROWS 29 PRECEDING) AS dev_30
    FROM z WINDOW p AS (PARTITION BY fold, site, fy ORDER BY d)""",
)
def _(d):
    return features.deviation(d.station_day.drop("site"), chosen(d), [5, 30], *d.years)


@query(
    "j13_site_deviation",
    "fold int, site int, d iso, dev num, dev_10 num",
    f"""WITH o AS (SELECT site, d, v, strftime(d, '%m%d') AS season, CASE WHEN month(d) < 8 THEN year(d) ELSE year(d) + 1 END AS fy
      FROM site_day),
    st AS (SELECT site, season, fold, avg(v) AS m, CASE WHEN max(v) > min(v) THEN stddev_samp(v) END AS s
      FROM o, {YEARS} f(fold) WHERE fy <> fold GROUP BY 1, 2, 3),
    z AS (SELECT st.fold, o.site, o.fy, o.d, (o.v - st.m) / st.s AS dev FROM o
      JOIN st ON st.site = o.site AND st.season = o.season)
    SELECT fold, site, d, dev, avg(dev) OVER (PARTITION BY fold, site, fy ORDER BY d ROWS 9 PRECEDING) AS dev_10 FROM z""",
)
def _(d):
    return features.site_deviation(d.site_day, [10], *d.years)


@query(
    "j14_scale_standard",
    "fold int, site int, yr int, scaled num",
    f"""SELECT f.fold, y.site, y.yr, (y.vol - s.m) / s.sd AS scaled FROM site_year y, {YEARS} f(fold)
    LEFT JOIN (SELECT site, fold, avg(vol) AS m, stddev_samp(vol) AS sd FROM site_year, {YEARS} g(fold)
      WHERE yr <> fold GROUP BY 1, 2) s ON s.site = y.site AND s.fold = f.fold""",
)
def _(d):
    return folds.scale(d.site_year, ["site"], "yr", "vol", *d.years)


@query(
    "j14_scale_max",
    "fold int, station int, yr int, scaled num",
    f"""WITH y AS (SELECT station, year(t) AS yr, max(v) AS v FROM station_month GROUP BY 1, 2)
    SELECT f.fold, y.station, y.yr, y.v / s.mx AS scaled FROM y, {YEARS} f(fold)
    LEFT JOIN (SELECT station, fold, max(v) AS mx FROM y, {YEARS} g(fold) WHERE yr <> fold GROUP BY 1, 2) s
      ON s.station = y.station AND s.fold = f.fold""",
)
def _(d):
    yearly = d.station_month.groupBy("station", F.year("t").alias("yr")).agg(F.max("v").alias("v"))
    return folds.scale(yearly, ["station"], "yr", "v", *d.years, "max")


@query(
    "j15_scale_p99",
    "site int, d iso, scaled num, restored num",
    """SELECT s.site, d, v / p AS scaled, v AS restored FROM site_day s
    JOIN (SELECT site, quantile_cont(v, 0.99) AS p FROM site_day GROUP BY site) q ON s.site = q.site""",
)
def _(d):
    return folds.unscale_p99(folds.scale_p99(d.site_day, ["site"], "v"))


@query(
    "j16_scale_target",
    "fold int, site int, yr int, target num, loo_max num",
    f"""SELECT f.fold, y.site, y.yr, y.vol / s.mx AS target, s.mx AS loo_max FROM site_year y, {YEARS} f(fold)
    JOIN (SELECT site, fold, max(vol) AS mx FROM site_year, {YEARS} g(fold) WHERE yr <> fold GROUP BY 1, 2) s
      ON s.site = y.site AND s.fold = f.fold""",
)
def _(d):
    return folds.scale_target(d.site_year, ["site"], "yr", "vol", *d.years)


_J17 = """WITH k AS (SELECT f.site, f.yr, f.m + 1 AS mt, sum(f.vol) OVER (PARTITION BY f.site, f.yr ORDER BY f.m) AS diff
    FROM flow_month f JOIN site_meta s ON f.site = s.site WHERE f.m BETWEEN season_start AND season_end - 1),
  i AS (SELECT g.*, y.vol, CASE WHEN dd <= {gap} THEN m - 1 ELSE m END AS mt FROM issue_grid g
    JOIN site_year y ON g.site = y.site AND g.yr = y.yr)
SELECT i.site, i.yr, i.issue_date, i.vol, coalesce(k.diff, 0) AS diff FROM i
LEFT JOIN k ON i.site = k.site AND i.yr = k.yr AND i.mt = k.mt"""


@query(
    "j17_target_diff",
    "site int, issue_date iso, diff num, remaining num, is_use_diff int",
    f"""SELECT site, issue_date, diff, vol - diff AS remaining, (diff > 0)::INTEGER AS is_use_diff
    FROM ({_J17.format(gap=1)})""",
)
def _(d):
    issues = d.issue_grid.join(d.site_year, ["site", "yr"])
    return features.target_diff(issues, d.flow_month)


@query(
    "j17_target_diff_daily",
    "site int, issue_date iso, diff num, remaining num, is_use_diff int",
    f"""WITH c AS (SELECT f.site, f.d, year(f.d) AS yr, sum(f.vol) OVER (PARTITION BY f.site, year(f.d), month(f.d) ORDER BY f.d) AS mc
      FROM flow_day f JOIN site_meta s ON f.site = s.site AND month(f.d) BETWEEN season_start AND season_end),
    e AS (SELECT site, d, CASE WHEN day(d) <> 1 THEN lag(mc) OVER (PARTITION BY site, yr ORDER BY d) END AS extra FROM c),
    t AS ({_J17.format(gap=0)})
    SELECT t.site, issue_date, diff + coalesce(extra, 0) AS diff, vol - diff - coalesce(extra, 0) AS remaining,
      (diff + coalesce(extra, 0) > 0)::INTEGER AS is_use_diff
    FROM t LEFT JOIN e ON t.site = e.site AND t.issue_date = e.d""",
)
def _(d):
    issues = d.issue_grid.join(d.site_year, ["site", "yr"])
    return features.target_diff(issues, d.flow_month, d.flow_day, diff_gap=0)


@query(
    "j18_synthesize",
    "copy int, yr int, n big, factor num, vol num",
    f"""WITH s AS (SELECT *, 0.5::DOUBLE + {_draw(1_000_003, "yr || '|' || copy || '|3'")} / 1000003.0::DOUBLE AS factor
      FROM site_year, range(4) c(copy))
    SELECT copy, yr, count(*) AS n, max(factor) AS factor, avg(vol * factor) AS vol FROM s GROUP BY 1, 2""",
)
def _(d):
    rows = folds.synthesize(d.site_year, "yr", ["vol"], n=4, seed=3)
    return rows.groupBy("copy", "yr").agg(
        F.count(F.lit(1)).alias("n"), F.max("factor").alias("factor"), F.avg("vol").alias("vol")
    )


_J19 = """WITH s AS (SELECT o.*, m.season_start, year(d) + (month(d) >= 10)::INTEGER AS wy FROM {src} o JOIN site_meta m ON o.site = m.site),
g AS (SELECT *, make_date(yr - 1, 10, 1) AS zero, make_date(yr, season_start, 1) - make_date(yr - 1, 10, 1) AS start_,
  last_day(make_date(yr, season_end, 1)) - make_date(yr - 1, 10, 1) AS end_ FROM issue_grid),
j AS (SELECT g.site, g.issue_date, g.zero, g.start_, g.end_, s.* EXCLUDE (site), month(s.d) >= s.season_start AND month(s.d) < 10 AS in_season
  FROM g LEFT JOIN s ON g.site = s.site AND g.yr = s.wy AND s.d < g.issue_date)
SELECT site, issue_date, (count(v) > 0)::INTEGER AS {p}_present, coalesce((max(d) - max(zero) + 1) / (max(end_) + 1)::DOUBLE, 0) AS {p}_ratio,
  coalesce((max(d) FILTER (in_season) - max(zero) + 1 - max(start_)) / (max(end_) - max(start_) + 1)::DOUBLE, 0) AS {p}_season_ratio, {cols}
FROM j GROUP BY 1, 2"""


@query(
    "j19_availability_volume",
    "site int, issue_date iso, flow_present int, flow_ratio num, flow_season_ratio num, flow_total num, flow_season_total num",
    _J19.format(
        p="flow", src="(SELECT site, d, vol AS v FROM flow_day)",
        cols="coalesce(sum(v), 0) AS flow_total, coalesce(sum(v) FILTER (in_season), 0) AS flow_season_total",
    ),
)
def _(d):
    return features.availability_features(d.flow_day.withColumnRenamed("vol", "v"), d.issue_grid, "flow")


@query(
    "j19_availability_snow",
    "site int, issue_date iso, snow_present int, snow_ratio num, snow_season_ratio num, snow_acc_max num, snow_current num, snow_max num",
    _J19.format(
        p="snow",
        src="(SELECT site, d, v, sum(v) OVER (PARTITION BY site, year(d) + (month(d) >= 10)::INTEGER ORDER BY d) AS acc FROM site_day)",
        cols="coalesce(max(acc), 0) AS snow_acc_max, coalesce(arg_max(v, d), 0) AS snow_current, coalesce(max(v), 0) AS snow_max",
    ),
)
def _(d):
    acc = F.sum("v").over(Window.partitionBy("site", water_year("d")).orderBy("d"))
    return features.availability_features(d.site_day.withColumn("acc", acc), d.issue_grid, "snow", kind="snow")


@query(
    "j17_target_diff_no_monthly",
    "site int, issue_date iso, diff num, remaining num, is_use_diff int",
    """WITH g AS (SELECT g.*, y.vol FROM issue_grid g JOIN site_year y ON g.site = y.site AND g.yr = y.yr),
    t AS (SELECT g.site, g.issue_date, g.vol, coalesce(sum(f.vol), 0) AS diff FROM g LEFT JOIN flow_day f ON g.site = f.site
      AND year(f.d) = g.yr AND month(f.d) BETWEEN g.season_start AND g.season_end AND f.d < g.issue_date GROUP BY 1, 2, 3)
    SELECT site, issue_date, diff, vol - diff AS remaining, (diff > 0)::INTEGER AS is_use_diff FROM t""",
)
def _(d):
    issues = d.issue_grid.join(d.site_year, ["site", "yr"])
    return features.target_diff(issues, d.flow_month, d.flow_day, diff_gap=0, no_monthly=d.site_meta.select("site"))


@query(
    "j20_truncate_asof",
    "source str, yr int, n big, last iso",
    """WITH o AS (SELECT 'snow' AS source, d FROM site_day UNION ALL SELECT 'flow', d FROM flow_day)
    SELECT source, year(d) AS yr, count(*) AS n, max(d) AS last FROM o
    WHERE dayofyear(d) < CASE source WHEN 'snow' THEN 120 ELSE 91 END GROUP BY 1, 2""",
)
def _(d):
    rows = (
        d.site_day.select(F.lit("snow").alias("source"), "d")
        .unionByName(d.flow_day.select(F.lit("flow").alias("source"), "d"))
        .withColumn("doy", F.dayofyear("d"))
    )
    # Cut days by source; both sources are present in the data.
    cuts = rows.groupBy("source").agg(F.max(F.when(F.col("source") == "snow", 120).otherwise(91)).alias("cut"))
    kept = asof.truncate_asof(rows, cuts, ["source"], "doy", "cut")
    return kept.groupBy("source", F.year("d").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))


@query(
    "j21_align_latest",
    "site int, d iso, v num, n_stations big",
    """SELECT days.site, days.d, avg(v) AS v, count(v) AS n_stations FROM (SELECT DISTINCT m.site, m.station, s.d
      FROM station_meta m JOIN (SELECT DISTINCT site, d FROM station_day) s ON m.site = s.site) days
    ASOF LEFT JOIN station_day o ON days.station = o.station AND days.site = o.site AND o.d <= days.d
    GROUP BY days.site, days.d HAVING count(v) = count(*)""",
)
def _(d):
    return features.align_latest(d.station_day)


@query(
    "j23_regression_fill",
    "s_suppkey big, s_acctbal num",
    """SELECT s_suppkey, coalesce(y, a + b * x) AS s_acctbal FROM (
      SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS y, s_nationkey::DOUBLE AS x FROM supplier),
    (SELECT regr_slope(s_acctbal, s_nationkey) AS b, regr_intercept(s_acctbal, s_nationkey) AS a FROM supplier
      WHERE s_acctbal >= 0)""",
)
def _(d):
    rows = d.table("supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"),
        F.col("s_nationkey").cast("double").alias("x"),
    )
    return selection.regr_fill(rows, "s_acctbal", "x")
