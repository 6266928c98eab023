"""Data-quality operators (inventory D10 to D22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.scalars import draw
from freshet.operators.quantiles import spread_quantiles
from freshet.session import spread


def null_outliers_ma(
    df: DataFrame, by: Sequence[str], order: str, value: str, n: int = 5, k: float = 2.0
) -> DataFrame:
    """Null where the value is further than ``k`` sd of the rolling mean
    (sd over the whole series) from its trailing ``n``-row mean."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    whole = Window.partitionBy(*by)
    ma = F.when(F.count(value).over(w) >= n, F.avg(value).over(w))
    out = df.withColumn("_ma", ma).withColumn("_sd", F.stddev_samp("_ma").over(whole))
    far = F.abs(F.col(value) - F.col("_ma")) > k * F.col("_sd")
    return out.withColumn(value, F.when(F.coalesce(~far, F.lit(True)), F.col(value))).drop("_ma", "_sd")


def null_outliers_iqr(df: DataFrame, by: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Null outside Q1 - k IQR .. Q3 + k IQR. Groups may be of any size."""
    q = spread_quantiles(df, by, value, [0.25, 0.75], ["_q1", "_q3"])
    joined = df.join(q, list(by), "left") if by else df.join(F.broadcast(q.limit(1)), how="left")
    lo = F.col("_q1") - k * (F.col("_q3") - F.col("_q1"))
    hi = F.col("_q3") + k * (F.col("_q3") - F.col("_q1"))
    return joined.withColumn(value, F.when(F.col(value).between(lo, hi), F.col(value))).drop("_q1", "_q3")


def zscore_outliers(df: DataFrame, by: Sequence[str], value: str, limit: float = 2.5) -> DataFrame:
    """Rows with an absolute population z-score of at least ``limit``."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    return df.join(stats, list(by)).withColumn("z", z).where(F.abs("z") >= limit).drop("_m", "_s")


def drop_sparse(df: DataFrame, series: Sequence[str], period: str, value: str, thresh: int, parts: int = 1) -> DataFrame:
    """Keep series with at least ``thresh`` periods that have a value.

    The rows are dealt by series over at least ``parts`` tasks, not cut down by their
    bytes: a few million short rows are few bytes, but much memory to sort. The join is
    an inner one (a series is there once), as Spark moves a semi join before the dealing."""
    full = (
        df.where(F.col(value).isNotNull())
        .groupBy(*series)
        .agg(F.count_distinct(period).alias("_n"))
        .where(F.col("_n") >= thresh)
    )
    keep = spread(full.select(*series), list(series), parts)
    return spread(df, list(series), parts).join(keep, list(series)).select(*df.columns)


def column_screen(
    df: DataFrame, cols: Sequence[str], max_null: float = 0.5, max_zero: float = 0.6
) -> DataFrame:
    """D13 on a wide table: one row per column with its null and zero share, a
    copy mark (equal to an earlier column in every row) and the verdict."""
    total = F.count(F.lit(1))
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.avg(F.col(c).isNull().cast("int")).alias(f"null_{i}"))
        aggs.append(F.coalesce(F.avg((F.col(c) == 0).cast("int")), F.lit(0.0)).alias(f"zero_{i}"))
        same = [F.sum(F.col(c).eqNullSafe(F.col(e)).cast("int")) == total for e in cols[:i]]
        copy = F.lit(False)
        for s in same:
            copy = copy | s
        aggs.append(copy.alias(f"copy_{i}"))
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.col(f"null_{i}").alias("null_share"),
                F.col(f"zero_{i}").alias("zero_share"),
                F.col(f"copy_{i}").alias("is_copy"),
            )
            for i, c in enumerate(cols)
        ]
    )
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    keep = (F.col("null_share") < max_null) & (F.col("zero_share") <= max_zero) & ~F.col("is_copy")
    return out.withColumn("keep", keep)


def coverage_gate(
    df: DataFrame, by: Sequence[str], value: str, expected: DataFrame, on: Sequence[str], share: float = 0.65
) -> DataFrame:
    """Group mean, null while fewer than ``share`` of the ``n_expected``
    series report."""
    got = df.groupBy(*by).agg(F.avg(value).alias("v"), F.count(value).alias("n_present"))
    ok = F.col("n_present") / F.col("n_expected") >= share
    return got.join(expected, list(on)).withColumn("v", F.when(ok, F.col("v")))


def screen_series(
    df: DataFrame, series: Sequence[str], value: str, min_rows: int, max_missing_pct: float
) -> DataFrame:
    """Keep long series with few gaps."""
    missing = 100.0 * F.avg(F.col(value).isNull().cast("int"))
    good = (
        df.groupBy(*series)
        .agg(F.count(F.lit(1)).alias("_n"), missing.alias("_pct"))
        .where((F.col("_n") >= min_rows) & (F.col("_pct") <= max_missing_pct))
    )
    return df.join(good, list(series), "left_semi")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), keep: str = "last") -> DataFrame:
    """One row per key, the first or last by ``order``.

    An aggregate rather than a window: it combines on the map side, so a key
    with very many copies never reaches one task whole.
    """
    rest = [c for c in df.columns if c not in keys]
    if not order:
        return df.dropDuplicates(list(keys))
    rank = F.struct(*[F.col(c) for c in [*order, *[r for r in rest if r not in order]]])
    row = F.struct(*[F.col(c) for c in rest])
    pick = (F.max_by if keep == "last" else F.min_by)(row, rank).alias("_row")
    out = df.groupBy(*keys).agg(pick).select(*keys, "_row.*")
    return out.select(*df.columns)


def find_gaps(df: DataFrame, by: Sequence[str], date: str, max_days: int = 1) -> DataFrame:
    """Rows that follow a gap of more than ``max_days``."""
    w = Window.partitionBy(*by).orderBy(date)
    out = df.withColumn("prev_date", F.lag(date).over(w))
    return out.withColumn("gap", F.datediff(date, "prev_date")).where(F.col("gap") > max_days)


def freshness(df: DataFrame, ids: DataFrame, key: str, date: str, value: str, issue: Column) -> DataFrame:
    """Last day with a value per expected id, its age, and a status."""
    last = (
        df.where(F.col(value).isNotNull() & (F.col(date) < issue))
        .groupBy(key)
        .agg(F.max(date).alias("last_date"))
    )
    out = ids.select(key).join(last, key, "left")
    age = F.datediff(issue, "last_date")
    status = F.when(F.col("last_date").isNull(), "missing").when(age > 1, "behind").otherwise("ok")
    return out.withColumns({"age": age, "status": status})


def qa_checks(df: DataFrame, keys: Sequence[str], value: str, expected: DataFrame, id_col: str) -> DataFrame:
    """Counts of repeated keys, negative values and expected ids not seen."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col(value) < 0).cast("int")).alias("_neg")
    )
    totals = per_key.agg(
        F.sum((F.col("_n") > 1).cast("long")).alias("duplicate_keys"),
        F.sum("_neg").alias("negative_values"),
    )
    absent = expected.select(id_col).join(df, id_col, "left_anti").agg(F.count(F.lit(1)).alias("missing_ids"))
    rows = [
        totals.select(F.lit(n).alias("check"), F.col(n).cast("long").alias("n"))
        for n in ("duplicate_keys", "negative_values")
    ]
    return rows[0].unionByName(rows[1]).unionByName(
        absent.select(F.lit("missing_ids").alias("check"), F.col("missing_ids").cast("long").alias("n"))
    )


def profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sd, min, quartiles and max; groups may be of any size."""
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = spread_quantiles(df, by, value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return base.join(q, list(by), "left")


def simulate_gap(df: DataFrame, key: str, date: str, max_gap: int, seed: int = 0) -> DataFrame:
    """Cut each id a seeded number of days (1 to ``max_gap``) before its end."""
    cut = df.groupBy(key).agg(F.max(date).alias("_last"))
    days = draw(max_gap, key, seed).cast("int") + 1
    cut = cut.select(key, F.date_sub("_last", days).alias("_cut"))
    return df.join(cut, key).where(F.col(date) <= F.col("_cut")).drop("_cut")


def cut_gap(df: DataFrame, key: str, date: str, days: int) -> DataFrame:
    """D21 with a fixed length: drop the last ``days`` days of each id."""
    last = df.groupBy(key).agg(F.max(date).alias("_last"))
    return df.join(last, key).where(F.col(date) <= F.date_sub("_last", days)).drop("_last")


def check_submission(pred: DataFrame, wanted: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Row counts, unmatched keys and rows whose position differs."""
    p = pred.select(*keys, F.col(ordinal).alias("_p"), F.lit(1).alias("_in_p"))
    w = wanted.select(*keys, F.col(ordinal).alias("_w"), F.lit(1).alias("_in_w"))
    both = p.join(w, list(keys), "full")
    has_p, has_w = F.col("_in_p").isNotNull(), F.col("_in_w").isNotNull()
    return both.agg(
        F.sum(has_p.cast("long")).alias("n_pred"),
        F.sum(has_w.cast("long")).alias("n_wanted"),
        F.sum((has_p & ~has_w).cast("long")).alias("unexpected"),
        F.sum((~has_p & has_w).cast("long")).alias("absent"),
        F.sum((has_p & has_w & (F.col("_p") != F.col("_w"))).cast("long")).alias("moved"),
    )
