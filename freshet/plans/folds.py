"""Folds and fold-aware scaling (inventory J1 to J3, J14 to J16, J18).

A learned statistic for fold f never sees rows of year f.  Where a statistic is
a sum, every fold is served from one pass: totals per key less the part of the
held-out year.  Only order statistics need the rows once per fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.scalars import draw
from freshet.operators.quantiles import quantile


def _years(first: int, last: int) -> Column:
    return F.sequence(F.lit(first), F.lit(last))


def loocv(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    """One ``fold`` per held-out year with every other year as training row.

    A generator per row rather than a join; for totals use :func:`loo_stats`.
    """
    return df.withColumn("fold", F.explode(F.filter(_years(first, last), lambda f: f != F.col(year))))


def loo_stats(
    df: DataFrame, by: Sequence[str], year: str, value: str, first: int, last: int
) -> DataFrame:
    """F1 for every fold at once: mean and sample sd without the fold's year.

    Sums are centred on the key's overall mean, which keeps the digits that a
    raw sum of squares loses; rows are combined to one per (key, year) first, and
    a fold is the total less its year's part.
    """
    x = F.col(value)
    yearly = df.where(x.isNotNull()).groupBy(*by, F.col(year).alias("_y")).agg(
        F.count(x).alias("_ny"), F.avg(x).alias("_my"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("_vy")
    )
    # One entry per year of a key.
    totals = yearly.groupBy(*by).agg(
        F.sum("_ny").alias("_n"),
        (F.sum(F.col("_ny") * F.col("_my")) / F.sum("_ny")).alias("_c"),
        F.collect_list(
            F.struct("_y", F.col("_ny").alias("n"), F.col("_my").alias("m"), F.col("_vy").alias("v"))
        ).alias("_parts"),
    )

    def off(p: Column) -> Column:
        return p["m"] - F.col("_c")

    squares = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["v"] + off(p) * off(p)))
    own = F.element_at(
        F.map_from_entries(F.transform("_parts", lambda p: F.struct(p["_y"].cast("int"), p))), F.col("fold")
    )
    folds = (
        totals.withColumn("_q", squares)
        .withColumn("fold", F.explode(_years(first, last)))
        .withColumn("_p", own)
        .select(
            *by, "fold", "_c", "_q",
            (F.col("_n") - F.coalesce(F.col("_p.n"), F.lit(0))).alias("_tn"),
            F.coalesce(-F.col("_p.n") * off(F.col("_p")), F.lit(0.0)).alias("_ts"),
            (
                F.col("_q")
                - F.coalesce(F.col("_p.n") * (F.col("_p.v") + off(F.col("_p")) * off(F.col("_p"))), F.lit(0.0))
            ).alias("_tq"),
        )
        .where(F.col("_tn") > 0)
    )
    left = F.col("_tq") - F.col("_ts") * F.col("_ts") / F.col("_tn")
    # What is left of equal values is rounding noise: exactly no spread.
    spread = F.when(left > 1e-12 * F.col("_q"), left).otherwise(0.0)
    return folds.select(
        *by,
        "fold",
        F.col("_tn").alias("n"),
        (F.col("_c") + F.col("_ts") / F.col("_tn")).alias("loo_mean"),
        F.when(F.col("_tn") > 1, F.sqrt(spread / (F.col("_tn") - 1))).alias("loo_std"),
    )


def kfold(df: DataFrame, year: str, k: int, repeats: int = 1, seed: int = 0) -> DataFrame:
    """K folds over whole years, repeated with other seeded orders.

    Ranks run over the distinct years only; rows get their fold by a join.
    """
    years = df.select(year).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy("repeat").orderBy(draw(1 << 32, year, "repeat", seed), year)
    folds = years.withColumn("fold", F.ntile(k).over(order) - 1)
    return df.join(folds, year)


def year_cat(year: str | Column, valid: Sequence[int], test: Sequence[int]) -> Column:
    """``train``, ``valid`` or ``test`` by year lists."""
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y.isin(*test), "test").when(y.isin(*valid), "valid").otherwise("train")


def scale(
    df: DataFrame, by: Sequence[str], year: str, value: str, first: int, last: int, method: str = "standard"
) -> DataFrame:
    """Every row scaled once per fold by that fold's training statistics.

    ``standard``: (x - mean) / sd; ``max``: x / training maximum.
    """
    rows = df.withColumn("fold", F.explode(_years(first, last)))
    if method == "standard":
        stats = loo_stats(df, by, year, value, first, last)
        scaled = F.try_divide(F.col(value) - F.col("loo_mean"), F.col("loo_std"))
        drop = ["n", "loo_mean", "loo_std"]
    else:
        stats = loo_max(df, by, year, value, first, last)
        scaled = F.try_divide(F.col(value), F.col("loo_max"))
        drop = ["loo_max"]
    return rows.join(stats, [*by, "fold"], "left").withColumn("scaled", scaled).drop(*drop)


def loo_max(df: DataFrame, by: Sequence[str], year: str, value: str, first: int, last: int) -> DataFrame:
    """Training maximum per fold from yearly maxima (one row per key and year)."""
    yearly = df.groupBy(*by, year).agg(F.max(value).alias("_x"))
    return loocv(yearly, year, first, last).groupBy(*by, "fold").agg(F.max("_x").alias("loo_max"))


def scale_p99(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Value over its key's 99th percentile, null values dropped; the
    divisor stays as ``p99`` for the inverse. Keys are calendar-bounded series."""
    p99 = df.groupBy(*by).agg(quantile(value, 0.99).alias("p99"))
    out = df.where(F.col(value).isNotNull()).join(p99, list(by))
    return out.withColumn("scaled", F.try_divide(F.col(value), F.col("p99")))


def unscale_p99(df: DataFrame, scaled: str = "scaled") -> DataFrame:
    """J15 inverse."""
    return df.withColumn("restored", F.col(scaled) * F.col("p99"))


def scale_target(df: DataFrame, by: Sequence[str], year: str, value: str, first: int, last: int) -> DataFrame:
    """Volume over the site's training maximum per fold, with the maximum
    kept to undo it after prediction."""
    top = loo_max(df, by, year, value, first, last)
    rows = df.withColumn("fold", F.explode(_years(first, last)))
    return rows.join(top, [*by, "fold"]).withColumn("target", F.try_divide(F.col(value), F.col("loo_max")))


def synthesize(
    df: DataFrame,
    year: str,
    cols: Sequence[str],
    n: int = 4,
    bounds: tuple[float, float] = (0.5, 1.5),
    seed: int = 0,
    inverted: Sequence[str] = (),
) -> DataFrame:
    """N scaled copies of every row; one seeded factor per (year, copy).

    Positive values take the factor f and negative ones lo + hi - f; columns in
    ``inverted`` the other way round.
    """
    lo, hi = bounds
    unit = draw(1_000_003, year, "copy", seed) / 1_000_003.0
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("factor", lo + (hi - lo) * unit)
    f, g = F.col("factor"), lo + hi - F.col("factor")
    scaled: Mapping[str, Column] = {
        c: F.col(c)
        * (
            F.when(F.col(c) > 0, g if c in inverted else f).when(F.col(c) < 0, f if c in inverted else g).otherwise(1.0)
        )
        for c in cols
    }
    return out.withColumns(scaled)
