"""Queries for scores."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.plans import metrics


def pin(p: str, q: float, y: str = "y") -> str:
    return f"2 * avg(CASE WHEN {y} >= {p} THEN {q}::DOUBLE * ({y} - {p}) ELSE ({q}::DOUBLE - 1) * ({y} - {p}) END)"


MQL = f"({pin('q10', 0.1)} + {pin('q50', 0.5)} + {pin('q90', 0.9)}) / 3"
BUNDLE = f"""count(*) AS n, {MQL} AS mql, {pin('q10', 0.1)} AS loss_q10, {pin('q50', 0.5)} AS loss_q50,
  {pin('q90', 0.9)} AS loss_q90, avg((y BETWEEN q10 AND q90)::INTEGER) AS coverage,
  avg((y > q10 AND y < q90)::INTEGER) AS coverage_strict, sqrt(avg((y - q50) * (y - q50))) AS rmse,
  avg(abs(y - q50)) AS mae, avg(y - q50) AS bias, avg(y) AS mean_y, avg(q50) AS mean_q50"""
MEASURES = (
    "n num, mql num, loss_q10 num, loss_q50 num, loss_q90 num, coverage num, coverage_strict num, "
    "rmse num, mae num, bias num, mean_y num, mean_q50 num"
)


@query(
    "l1_pinball",
    "site int, loss_q10 num, loss_q50 num, loss_q90 num",
    f"""SELECT site, {pin('q10', 0.1)} AS loss_q10, {pin('q50', 0.5)} AS loss_q50, {pin('q90', 0.9)} AS loss_q90
    FROM pred GROUP BY site""",
)
def _(d):
    return d.pred.groupBy("site").agg(
        *[metrics.pinball("y", c, q).alias(f"loss_{c}") for c, q in metrics.QUANTILES.items()]
    )


@query("l2_mean_quantile_loss", "yr int, mql num", f"SELECT yr, {MQL} AS mql FROM pred GROUP BY yr")
def _(d):
    return d.pred.groupBy("yr").agg(metrics.mql("y").alias("mql"))


@query(
    "l3_coverage",
    "m int, closed num, strict num",
    """SELECT m, avg((y BETWEEN q10 AND q90)::INTEGER) AS closed, avg((y > q10 AND y < q90)::INTEGER) AS strict
    FROM pred GROUP BY m""",
)
def _(d):
    return d.pred.groupBy("m").agg(
        metrics.coverage("y").alias("closed"), metrics.coverage("y", strict=True).alias("strict")
    )


@query(
    "l4_point_errors",
    "site int, rmse num, mae num, mape num, bias num, r2 num, nse_pred_mean num",
    """SELECT p.site, sqrt(avg((y - q50) ** 2)) AS rmse, avg(abs(y - q50)) AS mae, avg(abs(y - q50) / y) AS mape,
    avg(y - q50) AS bias, 1 - sum((y - q50) ** 2) / sum((y - my) ** 2) AS r2,
    1 - sum((y - q50) ** 2) / sum((y - mp) ** 2) AS nse_pred_mean
    FROM pred p JOIN (SELECT site, avg(y) AS my, avg(q50) AS mp FROM pred GROUP BY site) c ON p.site = c.site GROUP BY p.site""",
)
def _(d):
    return metrics.point_errors(d.pred, ["site"], "y", "q50")


@query(
    "l5_correlations",
    "site int, n big, pearson num, spearman num",
    """SELECT site, count(*) AS n, corr(y, q50) AS pearson, corr(ry, rp) AS spearman FROM (
      SELECT site, y, q50, rank() OVER (PARTITION BY site ORDER BY y) + (count(*) OVER (PARTITION BY site, y) - 1) / 2 AS ry,
        rank() OVER (PARTITION BY site ORDER BY q50) + (count(*) OVER (PARTITION BY site, q50) - 1) / 2 AS rp FROM pred)
    GROUP BY site""",
)
def _(d):
    return metrics.correlations(d.pred, ["site"], "y", "q50")


@query("l6_metric_bundle", f"site int, yr int, {MEASURES}", f"SELECT site, yr, {BUNDLE} FROM pred GROUP BY site, yr")
def _(d):
    return metrics.eval_agg(d.pred, ["site", "yr"], "y")


_NAMES = [c.split()[0] for c in MEASURES.split(",")]


def _summary(fn: str) -> str:
    return ", ".join(f"{fn}({c}) AS {c}" for c in _NAMES)


@query(
    "l7_several_groupings",
    f"grouping_name str, stat str, site int, yr int, m int, {MEASURES}",
    f"""WITH g AS (
      SELECT 'site' AS grouping_name, site, NULL AS yr, NULL AS m, {BUNDLE} FROM pred GROUP BY site UNION ALL
      SELECT 'yr', NULL, yr, NULL, {BUNDLE} FROM pred GROUP BY yr UNION ALL
      SELECT 'site+m', site, NULL, m, {BUNDLE} FROM pred GROUP BY site, m)
    SELECT grouping_name, 'group' AS stat, site, yr, m, {', '.join(_NAMES)} FROM g UNION ALL
    SELECT grouping_name, 'mean', NULL, NULL, NULL, {_summary('avg')} FROM g GROUP BY 1 UNION ALL
    SELECT grouping_name, 'std', NULL, NULL, NULL, {_summary('stddev_samp')} FROM g GROUP BY 1""",
)
def _(d):
    out = metrics.eval_all(d.pred, [["site"], ["yr"], ["site", "m"]], "y")
    return out.withColumnRenamed("grouping", "grouping_name")


@query(
    "l8_skill",
    "site int, mql num, mql_ref num, skill num",
    f"""SELECT a.site, a.mql, b.mql AS mql_ref, 1 - a.mql / b.mql AS skill FROM (SELECT site, {MQL} AS mql FROM pred GROUP BY site) a
    JOIN (SELECT site, {MQL} AS mql FROM (SELECT site, q10 * 0.8::DOUBLE AS q10, q50 * 0.9::DOUBLE AS q50, q90, y FROM pred)
      GROUP BY site) b ON a.site = b.site""",
)
def _(d):
    ref = d.pred.withColumns({"q10": F.col("q10") * 0.8, "q50": F.col("q50") * 0.9})
    return metrics.skill(d.pred, ref, ["site"], "y")


@query(
    "l9_score_table",
    "m int, mql num, coverage num, mean_volume num, total_volume num, relative_loss num",
    f"""SELECT a.m, mql, coverage, mean_volume, total_volume, mql / mean_volume AS relative_loss FROM (
      SELECT m, {MQL} AS mql, avg((y BETWEEN q10 AND q90)::INTEGER) AS coverage, avg(y) AS mean_volume
      FROM pred WHERE yr <> 2001 GROUP BY m) a
    JOIN (SELECT m, sum(v) AS total_volume FROM (SELECT m, site, yr, max(y) AS v FROM pred WHERE yr <> 2001 GROUP BY 1, 2, 3)
      GROUP BY m) b ON a.m = b.m""",
)
def _(d):
    return metrics.score_table(d.pred, ["m"], "y", without=F.col("yr") == 2001)


@query(
    "l9_scores_by_year",
    "yr int, mql num, mean_volume num, precipitation num",
    f"""WITH a AS (SELECT year(d) + (month(d) >= 10)::INTEGER AS yr, site, sum(v) OVER (PARTITION BY site,
        year(d) + (month(d) >= 10)::INTEGER ORDER BY d) AS acc FROM site_day),
    p AS (SELECT yr, sum(m) AS precipitation FROM (SELECT yr, site, max(acc) AS m FROM a GROUP BY 1, 2) GROUP BY 1)
    SELECT s.yr, mql, mean_volume, precipitation FROM (SELECT yr, {MQL} AS mql, avg(y) AS mean_volume FROM pred GROUP BY yr) s
    LEFT JOIN p ON s.yr = p.yr""",
)
def _(d):
    from freshet.functions.calendar import water_year
    from freshet.operators.windows import cumsum

    running = cumsum(d.site_day.withColumn("yr", water_year("d")), ["site", "yr"], "d", "v", "acc")
    rain = running.select("site", "yr", F.col("acc").alias("v"))
    return metrics.score_table(d.pred, ["yr"], "y", precipitation=rain)
