"""Queries for model jobs."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.plans import folds, models, selection


def site_month_features(d):
    """One row per site, month and year: snow, index and volume."""
    swe = d.station_day.groupBy("site", F.year("d").alias("yr"), F.month("d").alias("m")).agg(F.avg("v").alias("swe"))
    rows = swe.join(d.flow_month.select("site", "yr", "m", "vol"), ["site", "yr", "m"])
    return rows.join(d.index_month, ["yr", "m"])


@query("j22_pca", "vec_id big, pc1 num4, pc2 num4, pc3 num4")
def _(d):
    return models.pca(d.table("embeddings"), "vec_id", "embedding", 3)


@query("j24_greedy_stations", "fold int, site int, n_stations int, rmse num4")
def _(d):
    yearly = d.station_month.drop("site").groupBy("station", F.year("t").alias("yr")).agg(F.max("v").alias("x"))
    rows = yearly.join(d.area_pairs, "station").join(d.site_year, ["site", "yr"])
    best = selection.greedy_stations(folds.loocv(rows, "yr", *d.years), min_years=5, parts=d.parts)
    return best.withColumn("n_stations", F.size("stations"))


#: The fit of K16: bags, the share of rows and of columns in a bag, and the penalty on slopes.
BAGS, ROW_SHARE, COL_SHARE, ALPHA = 100, 0.9, 0.8, 0.01


def fitted_quantiles(d, by, features):
    rows = site_month_features(d)
    return models.fit_quantile(
        rows, by, features, "vol", bags=BAGS, row_share=ROW_SHARE, col_share=COL_SHARE, alpha=ALPHA, row_key=["site", "yr", "m"]
    )


@query("k16_quantile_regression", "site int, yr int, m int, q10 num4, q50 num4, q90 num4")
def _(d):
    feats = ["swe", "val"]
    coefs = fitted_quantiles(d, ["site"], feats)
    return models.predict_quantile(site_month_features(d).select("site", "yr", "m", *feats), coefs, ["site"], feats)


def season_features(d):
    """Snow, index, and the volume of the month a year before (0 in the first year)."""
    rows = site_month_features(d)
    before = rows.select("site", (F.col("yr") + 1).alias("yr"), "m", F.col("vol").alias("vol_before"))
    return rows.join(before, ["site", "yr", "m"], "left").withColumn("vol_before", F.coalesce("vol_before", F.lit(0.0)))


def fitted_score(coefs, features):
    """Scores by the fitted median of a site."""

    def score(df):
        return models.predict_quantile(df, coefs, ["site"], features, probs=(0.5,)).withColumnRenamed("q50", "prediction")

    return score


def _median_fit(d):
    rows, feats = season_features(d), ["swe", "val", "vol_before"]
    coefs = models.fit_quantile(
        rows, ["site"], feats, "vol", probs=(0.5,), bags=BAGS, row_share=ROW_SHARE, col_share=COL_SHARE, alpha=ALPHA,
        row_key=["site", "yr", "m"],
    )
    return rows, fitted_score(coefs, feats)


@query("m10_what_if_fitted", "site int, yr int, m int, feature str, data_type str, n big, low num4, high num4, mean num4")
def _(d):
    rows, score = _median_fit(d)
    tried = models.what_if(rows, rows, ["site", "m"], ["swe", "val", "vol_before"], score)
    p = "prediction"
    return tried.groupBy("site", "yr", "m", "feature", "data_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean")
    )


@query("m11_group_shapley_fitted", "site int, yr int, m int, label str, expected num4, shap num4")
def _(d):
    rows, score = _median_fit(d)
    groups = {"snow": ["swe"], "climate": ["val"], "flow": ["vol_before"]}
    return models.group_shapley(rows, rows, ["site", "yr", "m"], ["site", "m"], groups, score)


@query("k17_partial_least_squares", "site int, m int, fold int, q10 num4, q50 num4, q90 num4, ncomp int, n_train int")
def _(d):
    rows = site_month_features(d).withColumn("cross", F.col("swe") * F.col("val"))
    return models.fit_pls(rows, ["site", "m"], "yr", ["swe", "val", "cross"], "vol", max_comp=3)


@query("k18_boosted_trees", "site int, yr int, m int, q10 num4, q50 num4, q90 num4")
def _(d):
    rows = site_month_features(d)
    years = range(d.years[0], d.years[1] + 1)
    return models.fit_gbt(rows, ["site", "m", "swe", "val"], "vol", "yr", list(years), ["m"])
