"""Scalar math, cleaning and row-wise helpers (inventory C1 to C17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.calendar import _c

# Fixed values.
ACRE_FEET_PER_CFS_DAY = 1.9834591996927
FEET_PER_METRE = 3.28084
EARTH_RADIUS_KM = 6371.0
KM_PER_MILE = 1.609344


def cfs_to_kaf(flow: str | Column) -> Column:
    """Mean daily cfs to thousand acre-feet for the day."""
    return _c(flow) * (ACRE_FEET_PER_CFS_DAY / 1000.0)


def af_to_kaf(volume: str | Column) -> Column:
    return _c(volume) / 1000.0


def f_to_c(t: str | Column) -> Column:
    return (_c(t) - 32.0) * 5.0 / 9.0


def k_to_c(t: str | Column) -> Column:
    return _c(t) - 273.15


def m_to_ft(x: str | Column) -> Column:
    return _c(x) * FEET_PER_METRE


def null_if(
    text: str | Column,
    missing: Sequence[str] = ("M", ""),
    zero: Sequence[str] = ("T",),
    below: float | None = None,
) -> Column:
    """Text measure to double; sentinels and NaN to null, traces to 0."""
    t = F.trim(_c(text).cast("string"))
    value = F.when(t.isin(*zero), F.lit(0.0)).otherwise(t.try_cast("double"))
    bad = t.isin(*missing) | F.isnan(value)
    if below is not None:
        bad = bad | (value < below)
    return F.when(~bad, value)


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit to a range; null stays null."""
    c = _c(x)
    out = c
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(out)
    return out


def safe_div(a: str | Column, b: str | Column) -> Column:
    """C4: ratio that is null, never infinite, on a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation as an aggregate over complete pairs, null when either side
    does not vary (the built-in one divides by zero there)."""
    xs, ys = F.when(_c(y).isNotNull(), _c(x)), F.when(_c(x).isNotNull(), _c(y))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def line(y: str | Column, x: str | Column) -> tuple[Column, Column]:
    """Least-squares (slope, intercept) as aggregates over complete pairs."""
    ys, xs = F.when(_c(x).isNotNull(), _c(y)), F.when(_c(y).isNotNull(), _c(x))
    slope = F.try_divide(F.covar_pop(ys, xs), F.var_pop(xs))
    return slope, F.avg(ys) - slope * F.avg(xs)


def row_mean(*cols: str | Column) -> Column:
    """Mean over the present columns, null when all are null."""
    present = [F.when(_c(c).isNotNull(), 1).otherwise(0) for c in cols]
    values = [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols]
    return F.try_divide(sum(values[1:], values[0]), sum(present[1:], present[0]))


def to_log(x: str | Column, plus_one: bool = False) -> Column:
    """Training scale of a volume."""
    return F.log1p(_c(x)) if plus_one else F.when(_c(x) > 0, F.log(_c(x)))


def from_log(x: str | Column, plus_one: bool = False) -> Column:
    """Inverse of :func:`to_log`."""
    return F.expm1(_c(x)) if plus_one else F.exp(_c(x))


def area_cat(site: str | Column, areas: Mapping[str, Sequence], default: str = "others") -> Column:
    """Named area of a site from a short list of lists."""
    out = F.lit(default)
    for name, members in reversed(list(areas.items())):
        out = F.when(_c(site).isin(*members), F.lit(name)).otherwise(out)
    return out


def lead_cat(month: str | Column, day: str | Column, season_start: str | Column) -> Column:
    """``long`` up to the first issue day of the season, then ``short``."""
    m, s = _c(month), _c(season_start)
    return F.when((m < s) | ((m == s) & (_c(day) == 1)), "long").otherwise("short")


def period_cat(md: str | Column, last_long: int = 10) -> Column:
    """``long`` up to an issue ordinal."""
    return F.when(_c(md) <= last_long, "long").otherwise("short")


def year_type(df: DataFrame, year: str, value: str, dry: float = 775.0, wet: float = 975.0) -> DataFrame:
    """Dry, normal or wet year by the mean over all sites."""
    mean = F.avg(value)
    label = F.when(mean > wet, "wet").when(mean < dry, "dry").otherwise("normal")
    return df.groupBy(year).agg(label.alias("year_type"))


def bucket(x: str | Column, edges: Sequence[float]) -> Column:
    """Left-closed bins; the value becomes the lower edge of its bin."""
    c = _c(x)
    out = F.lit(None).cast("double")
    for edge in sorted(edges):
        out = F.when(c >= edge, F.lit(float(edge))).otherwise(out)
    return out


def one_hot(index: str | Column, n: int) -> Column:
    """C11: array of length n with a single 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == _c(index)).cast("int"))


def haversine(lat1, lon1, lat2, lon2, miles: bool = False) -> Column:
    """Great-circle distance in km or miles."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(_c(lon2) - _c(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    km = F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_RADIUS_KM)
    return km / KM_PER_MILE if miles else km


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, -180 to 180."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlon = F.radians(_c(lon2) - _c(lon1))
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.degrees(F.atan2(y, x))


def rearrange(df: DataFrame, cols: Sequence[str], absolute: bool = False) -> DataFrame:
    """C14: sort the quantile columns within each row so they cannot cross."""
    values = [F.abs(F.col(c)) if absolute else F.col(c) for c in cols]
    ordered = df.withColumn("_sorted", F.array_sort(F.array(*values)))
    return ordered.withColumns({c: F.col("_sorted")[i] for i, c in enumerate(cols)}).drop("_sorted")


def scale_pred(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """Multiply each quantile column by its factor."""
    return df.withColumns({c: F.col(c) * f for c, f in factors.items()})


def round_pred(df: DataFrame, cols: Sequence[str], digits: int = 1) -> DataFrame:
    """Round the quantile columns."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def norm_id(s: str | Column) -> Column:
    """``id:state:network`` to a name safe in files and columns."""
    return F.regexp_replace(_c(s), ":", "_")


def id_head(s: str | Column) -> Column:
    """The token before the first ``_``."""
    return F.split(_c(s), "_")[0]


def huc(s: str | Column, level: int) -> Column:
    """Drainage code cut to a level."""
    return F.substring(_c(s), 1, level)


def fmt(value: str | Column, kind: str) -> Column:
    """C17: report text; ``thousands``, ``percent`` or ``plain``."""
    v = _c(value)
    if kind == "thousands":
        text = F.format_number(v, 0)
    elif kind == "percent":
        text = F.when(v < 10, F.format_string("%.1f%%", v)).otherwise(F.format_string("%.0f%%", v))
    else:
        text = F.format_string("%.2f", v)
    return F.when(v.isNotNull(), text)


def fmt_range(lo: Column, hi: Column, sep: str = "-") -> Column:
    """C17: ``lo-hi``, or one value when both agree."""
    return F.when(lo == hi, lo).otherwise(F.concat_ws(sep, lo, hi))


def draw(n: int | Column, *parts: str | int | Column) -> Column:
    """A reproducible number 0 .. n-1 for the values of ``parts``: the first 32
    bits of the md5 of their texts, joined by ``|``, modulo n."""
    texts = [(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts]
    word = F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 8)
    return F.conv(word, 16, 10).cast("long") % n
