"""Queries for explanation tables."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.plans import explain, models

GROUPS = {"snow": "weather", "rain": "weather", "flow_deviation_10": "flow", "elevation": "elevation"}


def contrib_long(d):
    return explain.shap_long(d.contrib_wide, GROUPS)


CKEYS = "member int, quantile str, site int, yr int, md int"


@query(
    "m1_shap_long",
    f"{CKEYS}, feature str, feature_group str, shap num, shap_total num",
    "SELECT member, quantile, site, yr, md, feature, feature_group, shap, shap_total FROM contrib_long",
)
def _(d):
    return contrib_long(d)


@query(
    "m1_shap_by_group",
    f"{CKEYS}, feature_group str, shap num, shap_abs num",
    """SELECT member, quantile, site, yr, md, feature_group, sum(shap) AS shap, abs(sum(shap)) AS shap_abs
    FROM contrib_long GROUP BY ALL""",
)
def _(d):
    return explain.shap_agg(contrib_long(d))


@query(
    "m2_contrib_pct",
    "quantile str, site int, yr int, md int, feature_group str, contrib num",
    """SELECT quantile, site, yr, md, feature_group, avg(coalesce(share, 0)) * sign(sum(shap)) AS contrib FROM (
      SELECT *, CASE WHEN sum(abs(shap)) OVER p <> 0 THEN 100 * abs(shap) / sum(abs(shap)) OVER p END AS share FROM (
        SELECT member, quantile, site, yr, md, feature_group, round(sum(shap), 6) AS shap FROM contrib_long GROUP BY ALL)
      WINDOW p AS (PARTITION BY member, quantile, site, yr, md)) GROUP BY 1, 2, 3, 4, 5""",
)
def _(d):
    grouped = explain.shap_agg(contrib_long(d)).withColumn("shap", F.round("shap", 6))
    return explain.contrib_pct(grouped)


@query(
    "m3_global_importance",
    "yr int, md int, feature_group str, feature str, a num, n num, r num",
    """WITH s1 AS (SELECT *, CASE WHEN sum(abs(shap)) OVER p <> 0 THEN 100 * abs(shap) / sum(abs(shap)) OVER p ELSE 0 END AS share
        FROM contrib_long WINDOW p AS (PARTITION BY member, quantile, site, yr, md)),
      s2 AS (SELECT quantile, site, yr, md, feature_group, feature, sum(share) AS c FROM s1 GROUP BY ALL),
      s3 AS (SELECT quantile, site, yr, md, feature_group, feature,
        100 * c / sum(c) OVER (PARTITION BY quantile, site, yr, md) AS c FROM s2),
      s4 AS (SELECT quantile, yr, md, feature_group, feature, avg(c) AS c FROM s3 GROUP BY ALL),
      s5 AS (SELECT *, 100 * c / sum(c) OVER (PARTITION BY quantile, yr, md) AS v FROM s4),
      w AS (SELECT yr, md, feature_group, feature, max(v) FILTER (quantile = 'A') AS a, max(v) FILTER (quantile = 'N') AS n,
        max(v) FILTER (quantile = 'R') AS r FROM s5 GROUP BY 1, 2, 3, 4)
    SELECT * FROM w WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL UNION ALL
    SELECT yr, md, feature_group, 'total', sum(a), sum(n), sum(r) FROM w
    WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(d):
    out = explain.global_importance(contrib_long(d), ["A", "N", "R"])
    return out.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query(
    "m4_importance_by_group",
    "site int, grp str, importance num, share num",
    """SELECT site, grp, importance, 100 * importance / sum(importance) OVER (PARTITION BY site) AS share FROM (
      SELECT site, CASE WHEN feature LIKE 'flow%' THEN 'antecedent' WHEN feature IN ('snow', 'rain') THEN 'weather' ELSE 'other' END AS grp,
        sum(imp) AS importance FROM (SELECT site, feature, avg(abs(shap)) AS imp FROM contrib_long GROUP BY 1, 2) GROUP BY 1, 2)""",
)
def _(d):
    imp = contrib_long(d).groupBy("site", "feature").agg(F.avg(F.abs("shap")).alias("importance"))
    return explain.importance_by_group(imp, {"antecedent": "^flow", "weather": "^(snow|rain)$"})


@query(
    "m5_ensemble_contrib",
    "site int, yr int, md int, item str, contribution num",
    """SELECT l.site, l.yr, l.md, CASE WHEN feature = 'elevation' THEN 'static_site_features'
      ELSE split_part(feature, '_deviation', 1) END AS item, sum(shap * w.weight) AS contribution
    FROM contrib_long l JOIN (SELECT member, quantile, count(*)::DOUBLE / (SELECT count(*) FROM contrib_wide) AS weight
      FROM contrib_wide GROUP BY 1, 2) w ON l.member = w.member AND l.quantile = w.quantile GROUP BY 1, 2, 3, 4""",
)
def _(d):
    # Weight of a model: its share of all explained rows.
    counts = d.contrib_wide.groupBy("member", "quantile").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    weights = counts.join(F.broadcast(total)).select("member", "quantile", (F.col("n") / F.col("_t")).alias("weight"))
    return explain.ensemble_contrib(contrib_long(d), weights, ["site", "yr", "md"], ["elevation"])


_BAND = """WITH r AS (SELECT site, strftime(d, '%m%d') AS md, year(d) + (month(d) >= 10)::INTEGER AS y, v FROM site_day
  WHERE strftime(d, '%m%d') <> '0229')
SELECT p.site, p.md, p.mn AS lo, p25, p50, p75, p.mx AS hi, previous, cur FROM (
  SELECT site, md, min(v) AS mn, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
    max(v) AS mx, max(v) FILTER (y = 2000) AS previous FROM r WHERE y < 2001 GROUP BY 1, 2) p
LEFT JOIN (SELECT site, md, max(v) AS cur FROM r WHERE y = 2001 GROUP BY 1, 2) c ON p.site = c.site AND p.md = c.md"""


def season_band(d):
    from freshet.functions.calendar import water_year

    return explain.season_band(d.site_day, "site", "d", "v", 2001, water_year("d"))


@query(
    "m6_season_band",
    "site int, md str, lo num, p25 num, p50 num, p75 num, hi num, previous num, cur num",
    _BAND,
)
def _(d):
    return season_band(d).withColumnsRenamed({"min": "lo", "max": "hi", "current": "cur"})


@query(
    "m7_percent_of_normal",
    "site int, md str, cur num, normal num, pct_of_normal num",
    f"""SELECT site, arg_max(md, md) AS md, arg_max(cur, md) AS cur, arg_max(p50, md) AS normal,
    100 * arg_max(cur, md) / arg_max(p50, md) AS pct_of_normal FROM ({_BAND}) WHERE cur IS NOT NULL GROUP BY site""",
)
def _(d):
    return explain.normals(season_band(d), "site").withColumnRenamed("current", "cur")


_CONTEXT = """WITH f AS (SELECT site, yr, m AS md, 'swe' AS feature, avg(v) AS value FROM (SELECT *, year(d) AS yr, month(d) AS m FROM station_day) GROUP BY 1, 2, 3
    UNION ALL SELECT site, yr, m, 'vol', vol FROM flow_month),
  s AS (SELECT site, md, feature, min(value) AS value_min, median(value) AS value_median, avg(value) AS value_mean,
    max(value) AS value_max FROM f WHERE yr < (SELECT max(yr) FROM flow_month) AND site IN (SELECT site FROM flow_month)
    AND (site, yr, md) IN (SELECT site, yr, md FROM f WHERE feature = 'swe')
    AND (site, yr, md) IN (SELECT site, yr, md FROM f WHERE feature = 'vol') GROUP BY 1, 2, 3),
  c AS (SELECT f.*, value_min, value_median, value_mean, value_max,
    CASE WHEN value_median > 0 AND value_median <> value_mean THEN 100 * value / value_median END AS pmedian,
    CASE WHEN value_median > 0 AND value_median <> value_mean THEN 100 * value / value_mean END AS pmean,
    value - value_mean AS anomaly FROM f JOIN s ON f.site = s.site AND f.md = s.md AND f.feature = s.feature WHERE f.yr = (SELECT max(yr) FROM flow_month)
    AND (f.site, f.yr, f.md) IN (SELECT site, yr, md FROM f WHERE feature = 'swe')
    AND (f.site, f.yr, f.md) IN (SELECT site, yr, md FROM f WHERE feature = 'vol'))
SELECT site, md, feature, value, value_min, value_median, value_mean, value_max, pmedian, pmean, anomaly,
  CASE WHEN feature = 'swe' THEN coalesce(pmedian, value) ELSE coalesce(pmean, anomaly) END AS shown,
  pmedian IS NOT NULL AS use_percent FROM c"""


def context(d):
    swe = d.station_day.groupBy("site", F.year("d").alias("yr"), F.month("d").alias("md")).agg(F.avg("v").alias("swe"))
    vol = d.flow_month.select("site", "yr", F.col("m").alias("md"), "vol")
    wide = swe.join(vol, ["site", "yr", "md"])
    # The latest year against all years before it.
    last = vol.agg(F.max("yr")).first()[0]
    return explain.feature_context(
        wide.where(F.col("yr") == last), wide.where(F.col("yr") < last), ["site", "md"], ["swe", "vol"], ["swe"], ["temp"], ["cover"]
    )


@query(
    "m8_feature_context",
    "site int, md int, feature str, value num, value_min num, value_median num, value_mean num, value_max num, "
    "pmedian num, pmean num, anomaly num, shown num, use_percent bit",
    _CONTEXT,
)
def _(d):
    return context(d).withColumnRenamed("value_shown", "shown")


@query(
    "m8_guarded_display",
    "site int, md int, feature str, shown num",
    f"""SELECT c.site, c.md, c.feature, CASE WHEN use_percent AND mid > 100 AND shown / mid > 1.5 THEN NULL ELSE shown END AS shown
    FROM ({_CONTEXT}) c JOIN (SELECT site, feature, median(shown) AS mid FROM ({_CONTEXT}) GROUP BY 1, 2) g
      ON c.site = g.site AND c.feature = g.feature""",
)
def _(d):
    return explain.guard_outliers(context(d), ["site", "feature"], ratio=1.5).withColumnRenamed("value_shown", "shown")


@query(
    "m9_forecast_track",
    "site int, issue_date iso, q50 num, hist_q10 num, hist_q50 num, hist_q90 num, pct_of_mean num, pct_of_median num",
    """SELECT p.site, p.issue_date, p.q50, hist_q10, hist_q50, hist_q90, 100 * p.q50 / hm AS pct_of_mean,
      100 * p.q50 / hist_q50 AS pct_of_median FROM pred p JOIN (
      SELECT site, quantile_cont(y, 0.1) AS hist_q10, quantile_cont(y, 0.5) AS hist_q50, quantile_cont(y, 0.9) AS hist_q90,
        avg(y) AS hm FROM truth GROUP BY site) h ON p.site = h.site WHERE p.issue_date <= DATE '2001-05-01'""",
)
def _(d):
    return explain.forecast_track(d.pred, d.truth, "site", "y", F.lit("2001-05-01").cast("date"))


@query(
    "m12_explain_change",
    "quantile str, site int, issue_date iso, item str, now num, before num, change num",
    """WITH r AS (SELECT l_returnflag AS quantile, s_nationkey AS site, l_shipdate::DATE AS d, l_quantity AS a, l_tax AS b
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    w AS (SELECT quantile, site, make_date(year(d), month(d), CASE WHEN day(d) >= 22 THEN 22 WHEN day(d) >= 15 THEN 15
        WHEN day(d) >= 8 THEN 8 ELSE 1 END) AS issue_date, sum(a) - 25.5 * count(*) AS snow, round(sum(b), 2) * 100 - 4.0 * count(*) AS rain
      FROM r GROUP BY 1, 2, 3),
    c AS (SELECT quantile, site, issue_date, u.item, u.v FROM w, LATERAL (VALUES ('snow', snow), ('rain', rain)) u(item, v)),
    p AS (SELECT *, CASE WHEN day(issue_date) = 1 THEN (issue_date - INTERVAL 1 MONTH)::DATE + 21 ELSE issue_date - 7 END AS prev FROM c)
    SELECT a.quantile, a.site, a.issue_date, a.item, a.v AS now, b.v AS before, a.v - b.v AS change FROM p a
    JOIN c b ON a.quantile = b.quantile AND a.site = b.site AND a.prev = b.issue_date AND a.item = b.item""",
)
def _(d):
    lines = d.table("lineitem").select(
        F.col("l_returnflag").alias("quantile"), F.col("l_suppkey").cast("int").alias("station"),
        F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_tax",
    )
    day = F.dayofmonth("d")
    dd = F.when(day >= 22, 22).when(day >= 15, 15).when(day >= 8, 8).otherwise(1)
    weekly = (
        lines.join(d.station_meta.select("station", "site"), "station")
        .groupBy("quantile", "site", F.make_date(F.year("d"), F.month("d"), dd).alias("issue_date"))
        .agg(
            (F.sum("l_quantity") - 25.5 * F.count(F.lit(1))).alias("snow"),
            (F.round(F.sum("l_tax"), 2) * 100 - 4.0 * F.count(F.lit(1))).alias("rain"),
        )
    )
    rows = weekly.unpivot(["quantile", "site", "issue_date"], ["snow", "rain"], "item", "v")
    return explain.explain_change(rows, ["quantile", "site"], "issue_date", "item", "v")


def _site_features(d):
    """One row per site, month and year: snow, flow and index."""
    swe = d.station_day.groupBy("site", F.year("d").alias("yr"), F.month("d").alias("m")).agg(F.avg("v").alias("swe"))
    flow = d.flow_month.select("site", "yr", "m", "vol")
    return swe.join(flow, ["site", "yr", "m"]).join(d.index_month, ["yr", "m"])


def _score(df):
    """A fixed scoring rule with an interaction, standing for any fitted model."""
    return df.withColumn("prediction", F.col("vol") * 0.5 + F.col("swe") * F.col("val") * 2.0 + F.col("swe") * 3.0)


_FEATURES = """WITH f AS (SELECT s.site, s.yr, s.m, s.swe, v.vol, i.val FROM (
    SELECT site, year(d) AS yr, month(d) AS m, avg(v) AS swe FROM station_day GROUP BY 1, 2, 3) s
  JOIN flow_month v ON s.site = v.site AND s.yr = v.yr AND s.m = v.m
  JOIN index_month i ON i.yr = s.yr AND i.m = s.m)"""


@query(
    "m10_what_if",
    "site int, yr int, m int, feature str, data_type str, n big, low num, high num, mean num",
    f"""{_FEATURES},
    b AS (SELECT site, m, min(swe) AS slo, max(swe) AS shi, min(vol) AS vlo, max(vol) AS vhi FROM f GROUP BY 1, 2),
    t AS (SELECT f.site, f.yr, f.m, 'swe' AS feature, 'grid' AS data_type, slo + (shi - slo) * i / 29 AS swe, vol, val
        FROM f JOIN b ON f.site = b.site AND f.m = b.m, range(30) r(i) UNION ALL
      SELECT f.site, f.yr, f.m, 'vol', 'grid', swe, vlo + (vhi - vlo) * i / 29, val
        FROM f JOIN b ON f.site = b.site AND f.m = b.m, range(30) r(i) UNION ALL
      SELECT site, yr, m, u.feature, 'current', swe, vol, val FROM f, (VALUES ('swe'), ('vol')) u(feature) UNION ALL
      SELECT f.site, f.yr, f.m, 'swe', 'reference', g.swe, f.vol, f.val FROM f
        JOIN (SELECT DISTINCT site, m, swe FROM f) g ON f.site = g.site AND f.m = g.m UNION ALL
      SELECT f.site, f.yr, f.m, 'vol', 'reference', f.swe, g.vol, f.val FROM f
        JOIN (SELECT DISTINCT site, m, vol FROM f) g ON f.site = g.site AND f.m = g.m)
    SELECT site, yr, m, feature, data_type, count(*) AS n, min(p) AS low, max(p) AS high, avg(p) AS mean FROM (
      SELECT *, vol * 0.5 + swe * val * 2.0 + swe * 3.0 AS p FROM t) GROUP BY 1, 2, 3, 4, 5""",
)
def _(d):
    rows = _site_features(d)
    tried = models.what_if(rows, rows, ["site", "m"], ["swe", "vol"], _score)
    p = "prediction"
    return tried.groupBy("site", "yr", "m", "feature", "data_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean")
    )


_SHAPLEY = f"""{_FEATURES},
  v AS (SELECT e.site, e.yr, e.m, s, avg((CASE WHEN s & 2 > 0 THEN e.vol ELSE b.vol END) * 0.5
      + (CASE WHEN s & 1 > 0 THEN e.swe ELSE b.swe END) * (CASE WHEN s & 4 > 0 THEN e.val ELSE b.val END) * 2.0
      + (CASE WHEN s & 1 > 0 THEN e.swe ELSE b.swe END) * 3.0) AS v
    FROM f e JOIN f b ON e.site = b.site AND e.m = b.m, range(8) r(s) GROUP BY 1, 2, 3, 4),
  p AS (SELECT site, yr, m, max(CASE WHEN s = 0 THEN v END) AS expected,
    list(v ORDER BY s) AS l FROM v GROUP BY 1, 2, 3)
SELECT site, yr, m, label, expected, CASE label
  WHEN 'snow' THEN (l[2]-l[1])/3 + (l[4]-l[3])/6 + (l[6]-l[5])/6 + (l[8]-l[7])/3
  WHEN 'flow' THEN (l[3]-l[1])/3 + (l[4]-l[2])/6 + (l[7]-l[5])/6 + (l[8]-l[6])/3
  ELSE (l[5]-l[1])/3 + (l[6]-l[2])/6 + (l[7]-l[3])/6 + (l[8]-l[4])/3 END AS shap
FROM p, (VALUES ('snow'), ('flow'), ('climate')) u(label)"""


@query("m11_group_shapley", "site int, yr int, m int, label str, expected num, shap num", _SHAPLEY)
def _(d):
    rows = _site_features(d)
    groups = {"snow": ["swe"], "flow": ["vol"], "climate": ["val"]}
    return models.group_shapley(rows, rows, ["site", "yr", "m"], ["site", "m"], groups, _score)


@query(
    "m11_waterfall",
    "site int, yr int, m int, label str, shap num",
    f"""WITH s AS ({_SHAPLEY}), o AS (SELECT s.site, s.yr, s.m, max(expected) AS expected, max(v.vol) AS vol FROM s
      JOIN flow_month v ON s.site = v.site AND s.yr = v.yr AND s.m = v.m GROUP BY 1, 2, 3),
    k AS (SELECT *, median(vol) OVER (PARTITION BY site, m) AS mid FROM o)
    SELECT * FROM (SELECT site, yr, m, label, round(shap, 2) AS shap FROM s UNION ALL
      SELECT site, yr, m, 'Expected', round(expected + mid, 2) FROM k UNION ALL
      SELECT site, yr, m, 'Known volume', round(vol - mid, 2) FROM k) WHERE shap <> 0""",
)
def _(d):
    rows = _site_features(d)
    groups = {"snow": ["swe"], "flow": ["vol"], "climate": ["val"]}
    key = ["site", "yr", "m"]
    shap = models.group_shapley(rows, rows, key, ["site", "m"], groups, _score)
    offsets = rows.select(*key, F.col("vol").alias("offset"))
    return models.waterfall(shap, offsets, key, ["site", "m"])
