"""Tables behind forecast explanations (inventory M1 to M9, M12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.calendar import prev_issue
from freshet.operators.aggregates import melt, pivot
from freshet.operators.windows import share

MEMBER_KEYS = ("member", "quantile", "site", "yr", "md")


def shap_long(
    wide: DataFrame, groups: Mapping[str, str], keys: Sequence[str] = MEMBER_KEYS, prefix: str = "shap__"
) -> DataFrame:
    """M1: contribution columns to rows, without nulls, with the feature's group
    and the sums of contributions and of their sizes over features."""
    cols = [c for c in wide.columns if c.startswith(prefix) and "total" not in c]

    def over_columns(fn) -> Column:
        parts = [F.coalesce(fn(F.col(c)), F.lit(0.0)) for c in cols]
        return sum(parts[1:], parts[0])

    # Sums over features are taken while they are still one row: no shuffle.
    summed = wide.withColumns({"shap_total": over_columns(lambda c: c), "abs_total": over_columns(F.abs)})
    ids = [*keys, "pred", "shap_total", "abs_total"]
    rows = melt(summed.select(*ids, *cols), ids, cols, "feature", "shap")
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return (
        rows.where(F.col("shap").isNotNull())
        .withColumn("feature", F.regexp_replace("feature", f"^{prefix}", ""))
        .withColumn("feature_group", F.coalesce(F.element_at(table, F.col("feature")), F.col("feature")))
    )


def shap_agg(long: DataFrame, keys: Sequence[str] = MEMBER_KEYS) -> DataFrame:
    """M1: contributions summed per feature group."""
    return long.groupBy(*keys, "feature_group").agg(F.sum("shap").alias("shap")).withColumn("shap_abs", F.abs("shap"))


def contrib_pct(long: DataFrame, keys: Sequence[str] = MEMBER_KEYS, item: str = "feature_group") -> DataFrame:
    """M2: 100 x |c| / sum |c| per member, averaged over members, with the sign
    of the summed contribution."""
    across = [k for k in keys if k != "member"]
    sized = share(long.withColumn("_abs", F.abs("shap")), keys, "_abs", few=True)
    return sized.groupBy(*across, item).agg(
        (F.avg(F.coalesce("share", F.lit(0.0))) * F.signum(F.sum("shap"))).alias("contrib")
    )


def global_importance(
    long: DataFrame,
    quantiles: Sequence[str],
    date: Sequence[str] = ("yr", "md"),
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """M3: share per site, averaged and renormalised per date, one column per
    quantile, with a ``total`` row per feature group.

    A site's share is the mean over all its members, one without the feature
    counting 0, each times its weight; the number of members cancels when the
    shares are brought to 100, so the sum is taken.
    """
    per_member = long.withColumn("share", F.try_divide(100 * F.abs("shap"), F.col("abs_total")))
    if weights is not None:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        per_member = per_member.withColumn("share", F.col("share") * F.coalesce(table[F.col("member")], F.lit(0.0)))
    site_keys = ["quantile", "site", *date]
    item = ["feature_group", "feature"]
    per_site = per_member.groupBy(*site_keys, *item).agg(F.sum(F.coalesce("share", F.lit(0.0))).alias("c"))
    per_site = share(per_site, site_keys, "c", few=True).drop("c", "total").withColumnRenamed("share", "c")
    per_date = per_site.groupBy("quantile", *date, *item).agg(F.avg("c").alias("c"))
    per_date = share(per_date, ["quantile", *date], "c", few=True).drop("c", "total").withColumnRenamed("share", "c")
    wide = pivot(per_date, [*date, *item], "quantile", "c", list(quantiles)).dropna(subset=list(quantiles))
    totals = wide.groupBy(*date, "feature_group").agg(*[F.sum(q).alias(q) for q in quantiles])
    return wide.unionByName(totals.withColumn("feature", F.lit("total")))


def importance_by_group(importance: DataFrame, patterns: Mapping[str, str], value: str = "importance") -> DataFrame:
    """M4: importance per group of feature-name patterns, as a share of all."""
    group = F.lit("other")
    for name, pattern in reversed(list(patterns.items())):
        group = F.when(F.col("feature").rlike(pattern), F.lit(name)).otherwise(group)
    sums = importance.groupBy("site", group.alias("grp")).agg(F.sum(value).alias("importance"))
    return share(sums, ["site"], "importance", few=True)


def ensemble_contrib(
    long: DataFrame,
    weights: DataFrame,
    keys: Sequence[str],
    static: Sequence[str],
    on: Sequence[str] = ("member", "quantile"),
) -> DataFrame:
    """M5: weight x contribution per model, static features summed to one item,
    dynamic ones summed per name stem."""
    item = F.when(F.col("feature").isin(*static), "static_site_features").otherwise(
        F.split("feature", "_deviation")[0]
    )
    weighted = long.join(weights, list(on)).withColumn("_c", F.col("shap") * F.col("weight"))
    return weighted.groupBy(*keys, item.alias("item")).agg(F.sum("_c").alias("contribution"))


def season_band(series: DataFrame, site: str, date: str, value: str, current_year: int, year: Column) -> DataFrame:
    """M6: min, quartiles and max per month-day of earlier years, with the
    current and previous year's values; 29 February is left out."""
    rows = series.withColumns({"md": F.date_format(date, "MMdd"), "_y": year}).where(F.col("md") != "0229")
    past = rows.where(F.col("_y") < current_year)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    band = past.groupBy(site, "md").agg(
        F.min(value).alias("min"),
        q.alias("_q"),
        F.max(value).alias("max"),
        F.max(F.when(F.col("_y") == current_year - 1, F.col(value))).alias("previous"),
    )
    now = rows.where(F.col("_y") == current_year).groupBy(site, "md").agg(F.max(value).alias("current"))
    return band.join(now, [site, "md"], "left").select(
        site, "md", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"),
        "max", "previous", "current",
    )


def normals(band: DataFrame, site: str) -> DataFrame:
    """M7: latest current value over the median of that month-day, in percent."""
    latest = band.where(F.col("current").isNotNull()).groupBy(site).agg(
        F.max_by(F.struct("md", "current", "p50"), "md").alias("_l")
    )
    return latest.select(
        site, F.col("_l.md").alias("md"), F.col("_l.current").alias("current"), F.col("_l.p50").alias("normal"),
        F.try_divide(100 * F.col("_l.current"), F.col("_l.p50")).alias("pct_of_normal"),
    )


def feature_context(
    features: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    as_median: Sequence[str],
    as_anomaly: Sequence[str],
    as_value: Sequence[str],
) -> DataFrame:
    """M8: each feature next to its history per site and issue day, as percent
    of median and mean, as anomaly, and as the form shown for that feature."""
    past = melt(history.select(*keys, *cols), list(keys), list(cols), "feature", "value")
    stats = past.groupBy(*keys, "feature").agg(
        F.min("value").alias("value_min"),
        F.median("value").alias("value_median"),
        F.avg("value").alias("value_mean"),
        F.max("value").alias("value_max"),
    )
    ids = [c for c in features.columns if c not in cols]
    now = melt(features, ids, list(cols), "feature", "value").join(stats, [*keys, "feature"])
    usable = (F.col("value_median") > 0) & (F.col("value_median") != F.col("value_mean"))
    out = now.withColumns(
        {
            "pmedian": F.when(usable, F.try_divide(100 * F.col("value"), F.col("value_median"))),
            "pmean": F.when(usable, F.try_divide(100 * F.col("value"), F.col("value_mean"))),
            "anomaly": F.col("value") - F.col("value_mean"),
        }
    )
    name = F.col("feature")
    shown = (
        F.when(name.isin(*as_median), F.coalesce("pmedian", "value"))
        .when(name.isin(*as_anomaly), F.col("anomaly"))
        .when(name.isin(*as_value), F.col("value"))
        .otherwise(F.coalesce("pmean", "anomaly"))
    )
    return out.withColumns(
        {
            "value_shown": shown,
            "use_percent": F.col("pmedian").isNotNull() & ~name.isin(*as_anomaly, *as_value),
        }
    )


def guard_outliers(context: DataFrame, by: Sequence[str], ratio: float = 2.5) -> DataFrame:
    """M8: blank a shown percentage above ``ratio`` x its group's median, when
    that median is above 100."""
    med = context.groupBy(*by).agg(F.median("value_shown").alias("_m"))
    out = context.join(med, list(by))
    far = F.col("use_percent") & (F.col("_m") > 100) & (F.col("value_shown") / F.col("_m") > ratio)
    return out.withColumn("value_shown", F.when(F.coalesce(~far, F.lit(True)), F.col("value_shown"))).drop("_m")


def forecast_track(pred: DataFrame, history: DataFrame, site: str, value: str, upto: Column) -> DataFrame:
    """M9: predictions up to an issue date next to the site's historical
    quantiles, with their ratio to mean and median."""
    stats = history.groupBy(site).agg(
        F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_h"), F.avg(value).alias("hist_mean")
    )
    flat = stats.select(
        site, "hist_mean", *[F.col("_h")[i].alias(f"hist_{n}") for i, n in enumerate(("q10", "q50", "q90"))]
    )
    return pred.where(F.col("issue_date") <= upto).join(flat, site).withColumns(
        {
            "pct_of_mean": F.try_divide(100 * F.col("q50"), F.col("hist_mean")),
            "pct_of_median": F.try_divide(100 * F.col("q50"), F.col("hist_q50")),
        }
    )


def explain_change(contrib: DataFrame, keys: Sequence[str], issue: str, item: str, value: str) -> DataFrame:
    """Contributions of each issue date beside those of the issue date
    before it, and their difference, for the items present on both."""
    now = contrib.select(*keys, issue, prev_issue(issue).alias("_before"), item, F.col(value).alias("now"))
    before = contrib.select(*keys, F.col(issue).alias("_before"), item, F.col(value).alias("before"))
    both = now.join(before, [*keys, "_before", item]).drop("_before")
    return both.withColumn("change", F.col("now") - F.col("before"))
