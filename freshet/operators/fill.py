"""Gap filling (inventory D3 to D9). Windows run on one row per key and date."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.frames import expand_span
from freshet.session import spread


def _past(by: Sequence[str], order: str, limit: int | None = None):
    w = Window.partitionBy(*by).orderBy(order)
    return w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)


def _future(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)


def ffill(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """D3: last seen value, carried over at most ``limit`` rows."""
    w = _past(by, order, limit)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def bfill(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Next seen value."""
    w = _future(by, order)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in cols})


def fill(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], direction: str = "downup") -> DataFrame:
    """``down``, ``up`` or ``downup`` (forward, then backward)."""
    if direction == "down":
        return ffill(df, by, order, cols)
    if direction == "up":
        return bfill(df, by, order, cols)
    past, future = _past(by, order), _future(by, order)
    return df.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(future))
            for c in cols
        }
    )


def hold_forecast(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    cols: Sequence[str],
    blank: Column,
) -> DataFrame:
    """Blank the marked forecasts and repeat the one before, inside ``by``."""
    return ffill(df.withColumns({c: F.when(~blank, F.col(c)) for c in cols}), by, order, cols)


def interpolate_linear(
    df: DataFrame, by: Sequence[str], order: str, col: str, limit: int, floor: float | None = 0.0
) -> DataFrame:
    """D6, order 1: straight line over the first ``limit`` rows of each gap.

    Position is the row, as rows are the steps of a dense series; rows after the
    last value stay null.
    """
    w = Window.partitionBy(*by).orderBy(order)
    past, future = _past(by, order), _future(by, order)
    seen = F.when(F.col(col).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(col).alias("v")))
    out = (
        df.withColumn("_pos", F.row_number().over(w))
        .withColumn("_seen", seen)
        .withColumn("_a", F.last("_seen", ignorenulls=True).over(past))
        .withColumn("_b", F.first("_seen", ignorenulls=True).over(future))
    )
    a, b, pos = F.col("_a"), F.col("_b"), F.col("_pos")
    line = a["v"] + F.try_divide((b["v"] - a["v"]) * (pos - a["p"]), b["p"] - a["p"])
    value = F.when(F.col(col).isNotNull(), F.col(col)).when(pos - a["p"] <= limit, line)
    if floor is not None:
        value = F.when(value < floor, F.lit(float(floor))).otherwise(value)
    return out.withColumn(col, value).drop("_pos", "_seen", "_a", "_b")


def _tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a diagonally dominant system by cyclic reduction, log n vector steps."""
    low, mid, up, right = low.copy(), mid.copy(), up.copy(), right.copy()
    n, step = len(mid), 1
    low[0] = up[-1] = 0.0

    def shifted(v: np.ndarray, k: int, fill: float) -> np.ndarray:
        out = np.full(n, fill)
        if k > 0:
            out[k:] = v[:-k]
        else:
            out[:k] = v[-k:]
        return out

    while step < n:
        back = -low / shifted(mid, step, 1.0)
        ahead = -up / shifted(mid, -step, 1.0)
        mid = mid + back * shifted(up, step, 0.0) + ahead * shifted(low, -step, 0.0)
        right = right + back * shifted(right, step, 0.0) + ahead * shifted(right, -step, 0.0)
        low, up = back * shifted(low, step, 0.0), ahead * shifted(up, -step, 0.0)
        step *= 2
    return right / mid


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolating spline of order 2 through (x, y), knots halfway between the
    inner points, at places inside [x[0], x[-1]]; a line through two points."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    knots = np.concatenate([np.repeat(x[0], 3), (x[1:-2] + x[2:-1]) / 2, np.repeat(x[-1], 3)])

    def basis(p: np.ndarray, at_or_after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t0, t1, t2, t3 = (knots[at_or_after + k] for k in (-1, 0, 1, 2))
        b = (p - t1) / (t2 - t1)
        a = 1 - b
        return a * (t2 - p) / (t2 - t0), a * (p - t0) / (t2 - t0) + b * (t3 - p) / (t3 - t1), b * (p - t1) / (t3 - t1)

    inner = np.arange(1, n - 1)
    low, mid, up = np.zeros(n), np.ones(n), np.zeros(n)
    low[1:-1], mid[1:-1], up[1:-1] = basis(x[1:-1], inner + 1)
    c = _tridiagonal(low, mid, up, y.astype(float))
    span = np.clip(np.searchsorted(knots, at, "right") - 1, 2, n - 1)
    parts = basis(at, span)
    return sum(parts[k] * c[span - 2 + k] for k in range(3))


def _quadratic_gap(y: np.ndarray, limit: int) -> np.ndarray:
    """Fills the first ``limit`` rows of each inner gap by the order-2 spline."""
    known = np.flatnonzero(~np.isnan(y))
    out = y.copy()
    if known.size < 2:
        return out
    gaps = np.flatnonzero(np.isnan(y))
    k = np.searchsorted(known, gaps)
    inside = (k > 0) & (k < known.size)
    gaps, k = gaps[inside], k[inside]
    gaps = gaps[gaps - known[k - 1] <= limit]
    if gaps.size:
        out[gaps] = _spline(known.astype(float), y[known], gaps.astype(float))
    return out


def interpolate(
    df: DataFrame, by: Sequence[str], order: str, col: str, limit: int = 5, floor: float = 0.0, digits: int | None = None
) -> DataFrame:
    """D6, order 2: the interpolating spline, a line where only two values are
    known, rounded to ``digits``. One key is one dense calendar-bounded series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = _quadratic_gap(pdf[col].to_numpy(dtype=float), limit)
        pdf[col] = np.where(np.isnan(y), np.nan, np.maximum(y, floor))
        return pdf

    filled = spread(df, list(by)).groupBy(*by).applyInPandas(run, df.schema)
    value = F.when(~F.isnan(col), F.col(col))
    return filled.withColumn(col, value if digits is None else F.round(value, digits))


def to_daily(
    df: DataFrame, by: Sequence[str], date: str, value: str, limit: int, first: Column, last: Column
) -> DataFrame:
    """Mean within a day, then every day from ``first`` to ``last`` (Columns
    over the group's own first and last date), carried over ``limit`` days."""
    days = df.groupBy(*by, F.col(date)).agg(F.avg(value).alias(value))
    return ffill(expand_span(days, by, date, first, last), by, date, [value], limit)


def clim_impute(
    df: DataFrame, by: Sequence[str], date: str, value: str, season: str = "_md"
) -> DataFrame:
    """Missing value = month-day median plus the last seen anomaly.

    Month-days with no median are interpolated along the year, then take the
    nearest one, then 0.
    """
    src = df.withColumn(season, F.date_format(date, "MMdd"))
    clim = src.groupBy(*by, season).agg(F.median(value).alias("_c"))
    clim = fill(interpolate_linear(clim, by, season, "_c", 366, None), by, season, ["_c"])
    clim = clim.withColumn("_c", F.coalesce("_c", F.lit(0.0)))
    joined = src.join(clim, [*by, season])
    anomaly = F.last(F.col(value) - F.col("_c"), ignorenulls=True).over(_past(by, date))
    return joined.withColumn(
        value, F.coalesce(F.col(value), F.col("_c") + anomaly, F.col("_c"))
    ).drop("_c", season)


def fill_group_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Missing value = mean of its group, by a small aggregate and a join,
    so a large group is never gathered in one task."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return (
        df.join(means, list(by), "left")
        .withColumn(value, F.coalesce(value, "_mean"))
        .drop("_mean")
    )
