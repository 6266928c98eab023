"""Row windows, ranks and limits (inventory G and H).

Windows over a series run on one row per key and day, which bounds the group
by the record's length. Ranks that keep k rows are written ``row_number <= k``,
which Spark limits before the shuffle, so a hot key sends k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _w(by: Sequence[str], order: str | Sequence[str]):
    return Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))


def roll_mean(
    df: DataFrame, by: Sequence[str], order: str, col: str, windows: Sequence[int], min_periods: int = 1
) -> DataFrame:
    """Trailing mean over n rows, null until ``min_periods`` values."""
    out = {}
    for n in windows:
        w = _w(by, order).rowsBetween(-(n - 1), 0)
        out[f"{col}_{n}"] = F.when(F.count(col).over(w) >= min_periods, F.avg(col).over(w))
    return df.withColumns(out)


def roll_sum(df: DataFrame, by: Sequence[str], order: str, col: str, n: int) -> DataFrame:
    """Trailing sum; no value gives 0."""
    w = _w(by, order).rowsBetween(-(n - 1), 0)
    return df.withColumn(f"{col}_sum{n}", F.coalesce(F.sum(col).over(w), F.lit(0.0)))


def roll_median(df: DataFrame, by: Sequence[str], order: str, col: str, n: int) -> DataFrame:
    """Trailing median, null until the window is full."""
    w = _w(by, order).rowsBetween(-(n - 1), 0)
    value = F.when(F.count(col).over(w) >= n, F.percentile(col, F.lit(0.5)).over(w))
    return df.withColumn(f"{col}_med{n}", value)


#: Decay, in powers of e, that a block of ``ewm`` covers; well inside a double's range.
BLOCK_DECAY = 100.0


def ewm(df: DataFrame, by: Sequence[str], order: str, col: str, span: int) -> DataFrame:
    """Recursive exponential mean, null until ``span`` values were seen.

    A null value repeats the mean before it and lets the weight of the past decay.
    Each row is an affine map of the mean before it, y -> a y + b, and their products
    are prefix sums: within a block by windows over the rows, from block to block by
    the blocks' own maps. A block ends when the past has decayed by e**-100, so
    nothing overflows and the two blocks before decide a block's start to the last bit.
    """
    name, alpha = f"{col}_ewm{span}", 2.0 / (span + 1)
    key = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0))
    w = Window.partitionBy("_g").orderBy(order, "_id")
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"_g": key, "_x": F.col(col).cast("double"), "_id": F.monotonically_increasing_id()})
    rows = rows.withColumn("_nr", F.row_number().over(w))
    rows = rows.withColumn("_seen", F.count("_x").over(upto))
    since = F.col("_nr") - F.last(F.when(F.col("_x").isNotNull(), F.col("_nr")), True).over(past)
    kept = F.pow(F.lit(1.0 - alpha), since)
    moves = F.col("_x").isNotNull() & since.isNotNull()
    rows = rows.withColumns(
        {
            # Rows without a value, and the first value, which has no past, have a = 1.
            "_decay": F.when(moves, F.least(F.lit(10 * BLOCK_DECAY), -F.log(kept / (kept + alpha)))).otherwise(0.0),
            "_b": F.when(moves, alpha * F.col("_x") / (kept + alpha)).otherwise(F.coalesce("_x", F.lit(0.0))),
        }
    )
    # log(0) is null in Spark: the past is forgotten at once.
    rows = rows.withColumn("_decay", F.coalesce("_decay", F.lit(10 * BLOCK_DECAY)))
    rows = rows.withColumn("_sum", F.sum("_decay").over(upto))
    rows = rows.withColumn("_block", F.floor(F.col("_sum") / BLOCK_DECAY))
    block = Window.partitionBy("_g", "_block").orderBy("_nr").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_rel": F.col("_sum") - F.first("_sum").over(block), "_a1": F.exp(-F.first("_decay").over(block))})
    rows = rows.withColumn("_own", F.exp(-F.col("_rel")) * F.sum(F.col("_b") * F.exp("_rel")).over(block))
    ends = rows.groupBy("_g", "_block").agg(
        (F.max("_a1") * F.exp(-F.max("_rel"))).alias("_a"), F.max_by("_own", "_nr").alias("_y")
    )
    blocks = Window.partitionBy("_g").orderBy("_block")
    lagged = [F.coalesce(F.lag(c, n).over(blocks), F.lit(0.0)) for n in (1, 2) for c in ("_y", "_a")]
    starts = ends.select("_g", "_block", (lagged[0] + lagged[1] * (lagged[2])).alias("_start"))
    value = F.col("_a1") * F.exp(-F.col("_rel")) * F.col("_start") + F.col("_own")
    out = rows.join(starts, ["_g", "_block"])
    return out.select(*df.columns, F.when(F.col("_seen") >= span, value).alias(name))


def lags(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Values k rows back, named ``col_lagk``."""
    w = _w(by, order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in ks})


def diffs(
    df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], ks: Sequence[int], blank_rows: bool = True
) -> DataFrame:
    """Differences to k rows back; with ``blank_rows`` a row with any null
    difference is blanked whole."""
    w = _w(by, order)
    names = {f"{c}_diff{k}": F.col(c) - F.lag(c, k).over(w) for c in cols for k in ks}
    out = df.withColumns(names)
    if not blank_rows:
        return out
    full = F.lit(True)
    for n in names:
        full = full & F.col(n).isNotNull()
    return out.withColumn("_full", full).withColumns({n: F.when(F.col("_full"), F.col(n)) for n in names}).drop("_full")


def lag_features(
    df: DataFrame, by: Sequence[str], date: str, cols: Sequence[str], start: int, n: int, step: int, days: Sequence[int]
) -> DataFrame:
    """N lags from ``start`` every ``step`` rows, kept on issue days only."""
    out = lags(df, by, date, cols, [start + i * step for i in range(n)])
    return out.where(F.dayofmonth(date).isin(*days))


def cumsum(df: DataFrame, by: Sequence[str], order: str, col: str, name: str) -> DataFrame:
    """Running sum."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(col).over(w))


def known_before(df: DataFrame, season: Sequence[str], month: Sequence[str], date: str, col: str) -> DataFrame:
    """Season-to-date and month-to-date sums of the rows before each day;
    month-to-date is null on the first of the month."""
    before = _w(season, date)
    out = df.withColumns(
        {
            "season_cum": F.sum(col).over(before.rowsBetween(Window.unboundedPreceding, 0)),
            "month_cum": F.sum(col).over(_w(month, date).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    lagged = F.lag("month_cum").over(before)
    return out.withColumns(
        {
            "season_cum_lag1": F.lag("season_cum").over(before),
            "month_cum_lag1": F.when(F.dayofmonth(date) != 1, lagged),
        }
    )


def swe_extra(df: DataFrame, by: Sequence[str], order: str, swe: str, precip: str) -> DataFrame:
    """Running snow maximum, melt since then, and the two ratios."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("swe_max", F.max(swe).over(w))
    return out.withColumns(
        {
            "swe_diff": F.col("swe_max") - F.col(swe),
            "swe_melt_ratio": F.try_divide(F.col("swe_max") - F.col(swe), F.col("swe_max")),
            "swe_prec_ratio": F.try_divide(swe, precip),
        }
    )


def rank_first(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rnk") -> DataFrame:
    """1, 2, .. within a group; ties are broken by the later order keys."""
    return df.withColumn(name, F.row_number().over(_w(by, order)))


def pct_by_doy(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Percentile (0 to 100) of a value within its day of year; equal values
    share the middle of the positions they take."""
    group = [*by, F.col(value).isNull()]
    first = F.rank().over(Window.partitionBy(*group).orderBy(value)) - 1
    same = F.count(F.lit(1)).over(Window.partitionBy(*group).orderBy(value).rangeBetween(0, 0))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    pct = F.coalesce(100 * F.try_divide(first + (same - 1) / 2, n - 1), F.lit(0.0))
    return df.withColumn("pct", F.when(F.col(value).isNotNull(), pct))



def share(df: DataFrame, by: Sequence[str], value: str, few: bool = False) -> DataFrame:
    """100 x value / group sum, with the sum as ``total``.

    The sum is an aggregate joined back, so a hot group is combined before it is
    shuffled. ``few=True`` says that a group is bounded (the features of one
    prediction) and uses one window instead of the join.
    """
    if few:
        total = F.sum(value).over(Window.partitionBy(*by))
        return df.withColumn("total", total).withColumn("share", F.try_divide(100 * F.col(value), F.col("total")))
    totals = df.groupBy(*by).agg(F.sum(value).alias("total"))
    return df.join(totals, list(by)).withColumn("share", F.try_divide(100 * F.col(value), F.col("total")))


def group_stat(df: DataFrame, by: Sequence[str], value: str, fn, name: str) -> DataFrame:
    """A group statistic on each row, by aggregate and join."""
    return df.join(df.groupBy(*by).agg(fn(value).alias(name)), list(by))


def around_issue(df: DataFrame, date: str, month: int, day: int, n: int) -> DataFrame:
    """Rows within n days of a month-day of any year, tagged with that
    year's anchor. Only the anchors of the years that n days reach are tried."""
    year, reach = F.year(date), n // 365 + 1
    anchors = [F.make_date(year + k, F.lit(month), F.lit(day)) for k in range(-reach, reach + 1)]
    out = df.withColumn("anchor", F.explode(F.array(*anchors))).withColumn("offset", F.datediff(date, "anchor"))
    return out.where(F.abs("offset") <= n)



def roll_slope(df: DataFrame, by: Sequence[str], order: str, col: str, n: int) -> DataFrame:
    """Least-squares slope per row over the last n rows, null below 2 values."""
    w = _w(by, order)
    frame = w.rowsBetween(-(n - 1), 0)
    pos = df.withColumn("_x", F.row_number().over(w).cast("double"))
    slope = F.regr_slope(F.col(col), F.col("_x")).over(frame)
    return pos.withColumn(f"{col}_slope{n}", F.when(F.count(col).over(frame) >= 2, slope)).drop("_x")


def gauss_smooth(df: DataFrame, by: Sequence[str], doy: str, value: str, sigma: float, period: int = 366) -> DataFrame:
    """Circular Gaussian mean over day of year, weights normalised by the
    present values. Each row is spread to its neighbours and combined, so the
    climatology is never joined to itself."""
    reach = int(4 * sigma + 0.5)
    weights = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.exp(F.lit(-k * k / (2.0 * sigma * sigma))).alias("w"))
            for k in range(-reach, reach + 1)
        ]
    )
    spread = df.where(F.col(value).isNotNull()).withColumn("_w", F.explode(weights))
    target = F.pmod(F.col(doy) - 1 + F.col("_w.k"), F.lit(period)) + 1
    sums = spread.groupBy(*by, target.alias(doy)).agg(
        (F.sum(F.col(value) * F.col("_w.w")) / F.sum("_w.w")).alias("smooth")
    )
    out = df.join(sums, [*by, doy], "left")
    return out.withColumn("smooth", F.when(F.col(value).isNotNull(), F.col("smooth")))


def increment(df: DataFrame, by: Sequence[str], order: str, col: str) -> DataFrame:
    """Change since the row before, falls counted as 0."""
    step = F.col(col) - F.lag(col).over(_w(by, order))
    return df.withColumn("increment", F.when(step < 0, F.lit(0.0)).otherwise(step))


def sort(df: DataFrame, *keys: str | Column) -> DataFrame:
    """H1: total order over all keys (range exchange)."""
    return df.orderBy(*keys)


def top_k(df: DataFrame, by: Sequence[str], score: Column, ties: Sequence[str], k: int) -> DataFrame:
    """H2: best k rows per group by ``score`` (an ordering), ties by id."""
    w = Window.partitionBy(*by).orderBy(score, *ties)
    return df.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """H3: the n latest rows per group."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """H4: first n rows of a total order (per-task heap, then a merge)."""
    return df.orderBy(*order).limit(n)
