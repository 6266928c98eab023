"""Choice of stations, months and indices (inventory J4 to J11, J23, J24).

Station frames are reduced to one row per (station, year) or (station, issue,
year) before they meet the labels, so candidate pairs are joined on yearly rows
and never on daily ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from freshet.functions.scalars import line, pearson
from freshet.operators.windows import top_k
from freshet.plans.folds import loocv
from freshet.session import cut_lineage, spread


def yearly_station_mean(
    obs: DataFrame, station: str, date: str, value: str, year: Column, months: Sequence[int], min_year: int
) -> DataFrame:
    """Mean per (station, year) in the given months."""
    return (
        obs.withColumn("yr", year)
        .where(F.month(date).isin(*months) & (F.col("yr") >= min_year))
        .groupBy(station, "yr")
        .agg(F.avg(value).alias("x"))
    )


def corr_select(
    yearly: DataFrame,
    pairs: DataFrame,
    labels: DataFrame,
    k: int,
    thresh: int,
    first: int,
    last: int,
    ascending: bool = False,
) -> DataFrame:
    """Per fold and site the k stations whose yearly mean correlates best
    with the site's volume over the other years."""
    rows = yearly.join(pairs, "station").join(labels, ["site", "yr"])
    scored = (
        loocv(rows, "yr", first, last)
        .groupBy("fold", "site", "station")
        .agg(pearson("x", "vol").alias("r"), F.count("x").alias("n"))
        .where((F.col("n") >= thresh) & F.col("r").isNotNull())
    )
    # Rounded so that equal scores tie on every run and fall back to the id.
    score = F.round("r", 9)
    return top_k(scored, ["fold", "site"], score.asc() if ascending else score.desc(), ["station"], k)


def r2_select(rows: DataFrame, k: int) -> DataFrame:
    """Squared correlation per (site, station, day key), averaged; top k.

    ``rows`` holds site, station, season, x, vol.
    """
    per_day = rows.groupBy("site", "station", "season").agg(pearson("x", "vol").alias("r"), F.count("x").alias("n"))
    scored = per_day.where(F.col("r").isNotNull()).groupBy("site", "station").agg(
        F.avg(F.col("r") * F.col("r")).alias("r2"), F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_obs")
    )
    return top_k(scored, ["site"], F.round("r2", 9).desc(), ["station"], k)


def issue_corr(rows: DataFrame) -> DataFrame:
    """Correlation per (site, station, issue ordinal) from rows with md, x, vol."""
    return (
        rows.groupBy("site", "station", "md")
        .agg(pearson("x", "vol").alias("r"), F.count("x").alias("n_obs"))
        .where(F.col("r").isNotNull())
    )


def issue_corr_select(
    rows: DataFrame,
    min_obs: int = 20,
    mid_k: int = 4,
    early_k: int = 2,
    min_median: float = 0.3,
    last_md: int = 23,
    early_md: int = 5,
) -> DataFrame:
    """J6 for one variable: a mid-season branch and an early branch.

    Stations are ordered by observation count, then by median correlation, cut
    to the branch's k, and must pass the median; the mid-season row wins when a
    station passes in both.
    """
    scored = issue_corr(rows)

    def branch(src: DataFrame, k: int, season: str, rank: int) -> DataFrame:
        per_station = src.groupBy("site", "station").agg(
            F.min("n_obs").alias("obs"), F.median("r").alias("median_r"), F.max("r").alias("max_r")
        )
        top = top_k(
            per_station, ["site"], F.struct(-F.col("obs"), -F.round("median_r", 9)).asc(), ["station"], k
        )
        return (
            top.where(F.col("median_r") > min_median)
            .drop("rnk")
            .withColumns({"season": F.lit(season), "_rank": F.lit(rank)})
        )

    mid = branch(scored.where((F.col("n_obs") > min_obs) & (F.col("md") <= last_md)), mid_k, "middle", 0)
    early = branch(scored.where(F.col("md") <= early_md), early_k, "start", 1)
    both = mid.unionByName(early)
    pick = F.min(F.struct("_rank", "obs", "median_r", "max_r", "season")).alias("_p")
    return both.groupBy("site", "station").agg(pick).select(
        "site", "station", "_p.obs", "_p.median_r", "_p.max_r", "_p.season"
    )


def merge_choices(tagged: Sequence[tuple[str, DataFrame]], k: int = 4) -> DataFrame:
    """Choices of several variables, best row per station, best k per site."""
    frames = [df.withColumn("variable", F.lit(name)) for name, df in tagged]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    best = rows.groupBy("site", "station").agg(
        F.max(F.struct(F.round("median_r", 9).alias("median_r"), "variable")).alias("_b")
    )
    flat = best.select("site", "station", "_b.median_r", "_b.variable")
    return top_k(flat, ["site"], F.col("median_r").desc(), ["station"], k)


def donors(chosen: DataFrame, sites: DataFrame, candidates: DataFrame, minimum: int = 3) -> DataFrame:
    """Sites with fewer than ``minimum`` stations take the best scored
    station of their drainage code that they do not have yet.

    ``candidates``: huc, station, score; best first, ties by station.
    """
    counts = sites.join(chosen.groupBy("site").agg(F.count(F.lit(1)).alias("_n")), "site", "left")
    poor = counts.where(F.coalesce("_n", F.lit(0)) < minimum).select("site", "huc")
    free = poor.join(candidates, "huc").join(chosen.select("site", "station"), ["site", "station"], "left_anti")
    return top_k(free, ["site"], F.round("score", 9).desc(), ["station"], 1).select("site", "station", "score")


def max_corr_issue(rows: DataFrame) -> DataFrame:
    """Per site the station and issue ordinal with the highest correlation,
    and for each issue ordinal whether it is later."""
    best = F.min(F.struct((-F.round("r", 9)).alias("s"), "md", "station")).alias("_b")
    # One row per issue ordinal of a site, then the best of those.
    marks = issue_corr(rows).groupBy("site", "md").agg(best)
    top = marks.withColumn("_b", F.min("_b").over(Window.partitionBy("site")))
    return top.select(
        "site", "md", F.col("_b.station").alias("best_station"), F.col("_b.md").alias("best_md"), (-F.col("_b.s")).alias("best_r")
    ).withColumn("is_later", F.col("md") > F.col("best_md"))


def mask_weak(monthly: DataFrame, labels: DataFrame, limit: float = 0.12) -> DataFrame:
    """Monthly flow nulled where its correlation with the volume over the
    years is at or below ``limit``."""
    r = (
        monthly.join(labels.withColumnRenamed("vol", "season_vol"), ["site", "yr"])
        .groupBy("site", "m")
        .agg(pearson("vol", "season_vol").alias("r"))
    )
    return monthly.join(r, ["site", "m"], "left").withColumn("vol", F.when(F.col("r") > limit, F.col("vol")))


def best_month(monthly: DataFrame, labels: DataFrame, limit: float = 0.2) -> DataFrame:
    """Month with the top correlation, if above ``limit``."""
    r = (
        monthly.join(labels.withColumnRenamed("vol", "season_vol"), ["site", "yr"])
        .groupBy("site", "m")
        .agg(F.round(pearson("vol", "season_vol"), 9).alias("r"))
        .where(F.col("r") > limit)
    )
    pick = F.min(F.struct((-F.col("r")).alias("s"), "m")).alias("_b")
    return r.groupBy("site").agg(pick).select("site", F.col("_b.m").alias("best_month"), (-F.col("_b.s")).alias("r"))


def best_gauge(rows: DataFrame, min_pairs: int = 10) -> DataFrame:
    """Neighbour gauge with the top median correlation over months.

    ``rows``: site, station, m, x, vol.
    """
    per_month = (
        rows.groupBy("site", "station", "m")
        .agg(pearson("x", "vol").alias("r"), F.count("x").alias("n"))
        .where((F.col("n") >= min_pairs) & F.col("r").isNotNull())
    )
    med = per_month.groupBy("site", "station").agg(F.round(F.median("r"), 9).alias("median_r"))
    return top_k(med.where(F.col("median_r") > 0), ["site"], F.col("median_r").desc(), ["station"], 1).drop("rnk")


def index_screen(index: DataFrame, labels: DataFrame, limit: float = 0.1) -> DataFrame:
    """Per site and index the month with the most negative correlation,
    dropped inside +/- ``limit``. ``index``: index, yr, m, val."""
    r = (
        labels.join(index, "yr")
        .groupBy("site", "index", "m")
        .agg(F.round(pearson("val", "vol"), 9).alias("r"))
        .where(F.col("r").isNotNull())
    )
    pick = r.groupBy("site", "index").agg(F.min(F.struct("r", "m")).alias("_b"))
    return pick.select("site", "index", F.col("_b.m").alias("m"), F.col("_b.r").alias("r")).where(F.abs("r") > limit)


def regr_fill(df: DataFrame, y: str, x: str) -> DataFrame:
    """Missing y from a straight line on x over the rows that have both."""
    fit = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).agg(
        *[c.alias(n) for c, n in zip(line(y, x), ("_b", "_a"))]
    )
    joined = df.join(F.broadcast(fit))
    return joined.withColumn(y, F.coalesce(F.col(y), F.col("_a") + F.col("_b") * F.col(x))).drop("_a", "_b")


def _robust_rmse(x: np.ndarray, y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """RMSE over all seen rows of least-squares fits refitted without far residuals.

    ``x``: (sets, rows, columns); ``y`` and ``seen``: (sets, rows). All sets are
    solved together; a row that a fit leaves out has weight nothing.
    """
    design = np.concatenate([np.ones((*y.shape, 1)), np.where(seen[..., None], x, 0.0)], axis=2)
    target = np.where(seen, y, 0.0)
    tiny = np.finfo(float).eps * max(design.shape[1:])

    def fit(keep: np.ndarray, which: np.ndarray) -> np.ndarray:
        inverse = np.linalg.pinv(design[which] * keep[which][..., None], rcond=tiny)
        return (inverse @ (target * keep)[which][..., None])[..., 0]

    n = seen.sum(axis=1)
    coef = fit(seen, np.arange(len(y)))
    going = np.arange(len(y))
    for _ in range(3):
        resid = np.abs(target - (design @ coef[..., None])[..., 0])
        ordered = np.sort(np.where(seen, resid, np.inf), axis=1)
        at = np.arange(len(y))
        median = (ordered[at, (n - 1) // 2] + ordered[at, n // 2]) / 2
        keep = seen & (resid <= 3.0 * np.maximum(median, 1e-12)[:, None])
        going = going[keep[going].sum(axis=1) > design.shape[2]]
        if not len(going):
            break
        coef[going] = fit(keep, going)
    resid = np.where(seen, target - (design @ coef[..., None])[..., 0], 0.0)
    return np.sqrt((resid**2).sum(axis=1) / n)


@F.pandas_udf(T.DoubleType())
def _set_rmse(xs: pd.Series, ys: pd.Series, least: pd.Series) -> pd.Series:
    """Fit error of each candidate set; ``xs`` holds its stations' years one after another, null where unseen."""
    out = np.full(len(xs), np.nan)
    shapes = pd.DataFrame({"x": xs.map(len), "y": ys.map(len)})
    for (size, years), rows in shapes.groupby(["x", "y"]).indices.items():
        x = np.stack(xs.iloc[rows].to_list()).astype(float).reshape(len(rows), size // years, years).transpose(0, 2, 1)
        y = np.stack(ys.iloc[rows].to_list()).astype(float)
        seen = ~np.isnan(x).any(axis=2)
        enough = seen.sum(axis=1) >= max(int(least.iloc[0]), 1)
        if enough.any():
            out[rows[enough]] = _robust_rmse(x[enough], y[enough], seen[enough])
    return pd.Series(out)


def greedy_stations(rows: DataFrame, rounds: int = 5, min_years: int = 30, parts: int = 1) -> DataFrame:
    """Per (fold, site) the station set with the lowest fit error.

    ``rows``: fold, site, station, yr, x, vol (training rows). Every single
    station is scored, then in each round the best set so far is merged with
    every other scored set. Rows meet the label once: each station becomes one
    array over the years of its site, bounded by the record's length, and a
    candidate carries the arrays of its at most 2^rounds stations. A round then
    joins only the best set of each (fold, site), and no task gathers the stations
    of a site; new sets are checkpointed so that the plan does not grow. Sets are dealt
    by their stations over at least ``parts`` tasks and are made single, told from the
    known ones and fitted there.

    Defined results: null and NaN x are unseen; of repeated (station, year) rows
    the largest x counts; a set fits on the years that all of its stations have.
    """
    keys = ["fold", "site"]
    own = [*keys, "station"]
    seen = rows.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double")) & F.col("vol").isNotNull())
    axis = (
        seen.groupBy(*keys, "yr").agg(F.max("vol").cast("double").alias("vol"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("yr", "vol"))).alias("_axis"))
    )
    stations = (
        spread(seen.select(*own, "yr", F.col("x").cast("double").alias("x")), own, parts)
        .groupBy(*own, "yr").agg(F.max("x").alias("x"))
        .groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("yr", "x"))).alias("_of"))
    )
    member = F.struct("station", F.transform("_axis", lambda a: F.try_element_at("_of", a["yr"])).alias("x"))
    single = stations.join(axis, keys).select(*keys, F.array("station").alias("stations"), F.array(member).alias("_members"), F.col("_axis.vol").alias("_ys"))

    def scored(candidates: DataFrame) -> DataFrame:
        xs = F.flatten(F.transform("_members", lambda m: m["x"]))
        fits = candidates.withColumn("rmse", _set_rmse(xs, "_ys", F.lit(min_years)))
        return cut_lineage(fits.where(F.col("rmse").isNotNull() & ~F.isnan("rmse")))

    def best(sets: DataFrame) -> DataFrame:
        # Rounded so that equal fits fall to the smaller, then lower, set.
        rank = F.struct(F.round("rmse", 9), F.size("stations"), F.col("stations"))
        picked = F.min_by(F.struct("stations", "_members", "_ys", "rmse"), rank).alias("_b")
        return sets.groupBy(*keys).agg(picked).select(*keys, "_b.*")

    def dealt(sets: DataFrame) -> DataFrame:
        return spread(sets, [*keys, "stations"], parts)

    known = scored(dealt(single))
    top = cut_lineage(best(known))
    for _ in range(rounds):
        lead = top.select(*keys, F.col("stations").alias("_top"), F.col("_members").alias("_lead"))
        more = F.filter("_members", lambda m: ~F.array_contains("_top", m["station"]))
        merged = known.join(lead, keys).withColumn("_members", F.array_sort(F.concat("_lead", more)))
        wider = (F.size("_members") > F.size("_top")) & (F.size("_members") > F.size("stations"))
        merged = merged.where(wider).withColumn("stations", F.transform("_members", lambda m: m["station"]))
        once = dealt(merged.select(*keys, "stations", "_members", "_ys")).dropDuplicates([*keys, "stations"])
        # A marked left join, as Spark moves an anti join before the dealing.
        old = dealt(known.select(*keys, "stations")).withColumn("_old", F.lit(True))
        fresh = once.join(old, [*keys, "stations"], "left").where(F.col("_old").isNull())
        fresh = scored(fresh.select(*keys, "stations", "_members", "_ys"))
        known = known.unionByName(fresh)
        top = cut_lineage(best(top.unionByName(fresh.select(*top.columns))))
    return top.select(*keys, "stations", "rmse")
