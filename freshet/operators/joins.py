"""Key joins (inventory E1 to E6, E9, E14 to E17).

No side is hinted: Catalyst and AQE broadcast by measured size, split skewed
keys, and fall back to sort-merge beyond the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on named keys; ``how="outer"`` keeps both sides."""
    return a.join(b, list(on), how)


def integrate(main: DataFrame, feat: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Replace feature columns of ``main`` by those of ``feat``."""
    stale = [c for c in cols if c in main.columns]
    return main.drop(*stale).join(feat.select(*keys, *cols), list(keys), "left")


def all_pairs(small: DataFrame, large: DataFrame, spread: int = 64) -> DataFrame:
    """Every pair of two frames.

    One plan at every size: the large side is dealt to ``spread`` buckets and the
    small side copied to each, so this is an equi join that needs no broadcast and
    no look at the sizes before.
    """
    left = large.withColumn("_b", F.pmod(F.xxhash64(*large.columns), F.lit(spread)))
    right = small.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return left.join(right, "_b").drop("_b")


def with_metadata(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """E5: season bounds and place of a site, with the season length in months."""
    out = df.join(dim, key)
    return out.withColumn("n_months", F.col("season_end") - F.col("season_start") + 1)


def keep_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(*on), list(on), "left_semi")


def keep_not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(*on), list(on), "left_anti")


def prev_month_value(
    issues: DataFrame, monthly: DataFrame, key: str, issue: str, month_start: str, value: str, release_day: int = 1
) -> DataFrame:
    """Value of the month before the issue month; before ``release_day`` of
    the month the one before that."""
    from freshet.functions.calendar import snap_month

    wanted = F.add_months(F.trunc(snap_month(issue, release_day), "MM"), -1)
    lookup = monthly.select(key, F.col(month_start).alias("_want"), F.col(value).alias("prev_value"))
    return issues.withColumn("_want", wanted).join(lookup, [key, "_want"], "left").drop("_want")


#: A key is hot when it holds more than one part in so many of a side's rows.
HOT_PARTS = 1000


def spread_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner equi join whose output may be dominated by a few keys.

    A key with over 1/1000 of the rows of either side is dealt over a grid: the rows
    of ``a`` into parts, each joined with every part of ``b``, both of 1/1000 of a
    side at most. There are fewer than 2000 such keys, so their counts are broadcast.
    """

    def hot(df: DataFrame, name: str) -> DataFrame:
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        total = counts.agg(F.sum("_n").alias("_total"))
        found = counts.join(F.broadcast(total)).where(F.col("_n") * HOT_PARTS > F.col("_total"))  # one row
        return found.select(key, F.ceil(F.col("_n") * HOT_PARTS / F.col("_total")).cast("int").alias(name))

    grid = hot(a, "_pa").join(hot(b, "_pb"), key, "full").select(
        F.col(key).alias("_hot"), F.coalesce("_pa", F.lit(1)).alias("_pa"), F.coalesce("_pb", F.lit(1)).alias("_pb")
    )

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        marked = df.join(F.broadcast(grid), F.col(key) == F.col("_hot"), "left")
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(own, F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        placed = marked.withColumn(mine, place.cast("int"))  # once for all copies of a row
        return placed.withColumn(theirs, F.explode(copies)).drop("_hot", "_pa", "_pb")

    return dealt(a, "_pa", "_pb", "_sa", "_sb").join(dealt(b, "_pb", "_pa", "_sb", "_sa"), [key, "_sa", "_sb"]).drop("_sa", "_sb")


def huc_join(sites: DataFrame, stations: DataFrame, level: int, code: str = "huc") -> DataFrame:
    """Sites and stations that share the first ``level`` characters of a code."""
    a = sites.withColumn("_p", F.substring(code, 1, level)).drop(code)
    b = stations.withColumn("_p", F.substring(code, 1, level)).drop(code)
    return spread_join(a, b, "_p").withColumnRenamed("_p", f"huc{level}")


def site_station_pairs(
    tagged: Sequence[tuple[str, DataFrame]], active: DataFrame | None = None, max_rank: int | None = None
) -> DataFrame:
    """Union of pairing methods, one row per pair with the method names in
    order, the least distance and rank; then only active stations."""
    frames = []
    for name, df in tagged:
        cols = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("dist", "rnk")]
        frames.append(df.select("site", "station", *cols, F.lit(name).alias("method")))
    rows = reduce(DataFrame.unionByName, frames)
    if max_rank is not None:
        rows = rows.where(F.col("rnk").isNull() | (F.col("rnk") <= max_rank))
    out = rows.groupBy("site", "station").agg(
        F.array_join(F.sort_array(F.collect_set("method")), ",").alias("method"),
        F.min("dist").alias("dist"),
        F.min("rnk").alias("rnk"),
    )
    return out if active is None else out.join(active.select("station"), "station", "left_semi")


def expand_target_months(issues: DataFrame, monthly: DataFrame, site: str = "site", year: str = "yr") -> DataFrame:
    """Each issue row with each later or current in-season month of its
    site-year. ``monthly`` holds at most twelve rows per site and year."""
    target = monthly.select(site, year, F.col("m").alias("pred_month"), F.col("vol").alias("month_vol"))
    in_season = F.col("pred_month").between(F.col("season_start"), F.col("season_end"))
    return issues.join(target, [site, year]).where(in_season & (F.col("m") <= F.col("pred_month")))


def merge_all(frames: Sequence[DataFrame], key: Sequence[str], how: str = "left") -> DataFrame:
    """Left fold of joins on one key; equal keys reuse one partitioning."""
    return reduce(lambda a, b: a.join(b, list(key), how), frames)
