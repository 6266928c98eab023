"""Baselines, blends, ensembles and calibration (inventory K1 to K15).

Frames keep quantile columns named q10, q50, q90.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.quantiles import group_quantiles, quantile, spread_quantiles

Q = ("q10", "q50", "q90")

# Share of the monthly model by quantile and issue month 1 .. 7.
MONTH_SHARE = {
    "q10": (0.4, 0.4, 0.4, 0.6, 0.7, 0.8, 1.0),
    "q50": (0.4, 0.4, 0.4, 0.4, 0.4, 0.7, 1.0),
    "q90": (0.4, 0.5, 0.6, 0.6, 0.6, 0.8, 1.0),
}
# Share of the first model family by quantile.
FAMILY_SHARE = {"q10": 0.4, "q50": 0.4, "q90": 0.7}
# Weights of the outermost member and the next one on either side.
EDGE_WEIGHTS = (0.2, 0.8)


def baseline_quantiles(
    history: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, years: tuple[int, int], year: str = "yr"
) -> DataFrame:
    """K1: p10, p50, p90 of past volumes per key, joined to target rows."""
    past = history.where(F.col(year).between(*years))
    return targets.join(group_quantiles(past, keys, value, (0.1, 0.5, 0.9), Q), list(keys), "left")


def blend_month_year(monthly: DataFrame, yearly: DataFrame, keys: Sequence[str], month: str) -> DataFrame:
    """K2: weighted mean of monthly and yearly model; yearly alone when the
    monthly value is null."""
    m = monthly.select(*keys, *[F.col(q).alias(f"{q}_mth") for q in Q])
    both = yearly.join(m, list(keys), "left")
    blended = {}
    for q in Q:
        share = F.element_at(F.array(*[F.lit(x) for x in MONTH_SHARE[q]]), F.col(month))
        mix = (1 - share) * F.col(q) + share * F.col(f"{q}_mth")
        blended[q] = F.coalesce(mix, F.col(q))
    return both.withColumns(blended).drop(*[f"{q}_mth" for q in Q])


def season_from_months(pred: DataFrame, keys: Sequence[str], month: str, pred_month: str, observed: str) -> DataFrame:
    """K3: months before the issue month take the observed volume when there is
    one; the months are then summed per site and issue date."""
    known = (F.col(pred_month) < F.col(month)) & F.col(observed).isNotNull()
    return pred.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(known, F.col(observed)).otherwise(F.col(q))), F.lit(0.0)).alias(q) for q in Q]
    )


def last_month_residual(monthly: DataFrame, labels: DataFrame) -> DataFrame:
    """K4: the season's last month = season volume less the earlier in-season
    months; a negative rest becomes that site-month's 10 % quantile.

    ``monthly``: site, yr, m, vol, season_start, season_end.
    """
    p10 = monthly.groupBy("site", "m").agg(quantile("vol", 0.1).alias("_p10"))
    early = F.when(F.col("m").between(F.col("season_start"), F.col("season_end") - 1), F.col("vol"))
    known = monthly.groupBy("site", "yr").agg(F.coalesce(F.sum(early), F.lit(0.0)).alias("_known"))
    out = (
        monthly.join(known, ["site", "yr"])
        .join(labels.select("site", "yr", F.col("vol").alias("_season")), ["site", "yr"], "left")
        .join(p10, ["site", "m"], "left")
    )
    value = F.when(F.col("m") == F.col("season_end"), F.col("_season") - F.col("_known")).otherwise(F.col("vol"))
    return out.withColumn("vol", F.when(value < 0, F.col("_p10")).otherwise(value)).drop("_p10", "_known", "_season")


def weighted_blend(
    a: DataFrame, b: DataFrame, keys: Sequence[str], shares: Mapping[str, float] = FAMILY_SHARE
) -> DataFrame:
    """K5: per-quantile mix of two model families, ``shares`` being that of ``a``."""
    right = b.select(*keys, *[F.col(q).alias(f"_{q}") for q in Q])
    mixed = {q: (1 - shares[q]) * F.col(f"_{q}") + shares[q] * F.col(q) for q in Q}
    return a.join(right, list(keys)).withColumns(mixed).drop(*[f"_{q}" for q in Q])


def ensemble_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K6: mean of the members and their count."""
    return df.groupBy(*keys).agg(*[F.avg(q).alias(q) for q in Q], F.count(F.lit(1)).alias("n_members"))


def ensemble_quantile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K6: 10 % of the lower, mean of the middle, 90 % of the upper members."""
    return df.groupBy(*keys).agg(
        quantile("q10", 0.1).alias("q10"), F.avg("q50").alias("q50"), quantile("q90", 0.9).alias("q90")
    )


def ensemble_median(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K6: median of the members, not below 0."""
    return df.groupBy(*keys).agg(*[F.greatest(F.lit(0.0), F.median(q)).alias(q) for q in Q])


def ensemble_by_site(df: DataFrame, keys: Sequence[str], routes: DataFrame, on: Sequence[str]) -> DataFrame:
    """K7: mean over the members that a route table lists for each site."""
    return ensemble_mean(df.join(routes, list(on), "left_semi"), keys)


def rerank_members(df: DataFrame, keys: Sequence[str], member: str, edge: Sequence[float] = EDGE_WEIGHTS) -> DataFrame:
    """K8: order each member's three outputs, rank the members per quantile, and
    weight the extremes; the middle is the plain mean.

    ``edge``: weights from the outermost member inwards, lowest for the lower and
    highest for the upper quantile; with fewer members they are brought to a sum
    of 1.  Groups hold one row per member, so the ranks are over a handful of rows.
    """
    ordered = df.withColumn("_s", F.array_sort(F.array(*Q)))
    ordered = ordered.withColumns({q: F.col("_s")[i] for i, q in enumerate(Q)}).drop("_s")
    table = F.array(*[F.lit(float(w)) for w in edge])

    def weight(*order: Column | str) -> Column:
        return F.get(table, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)

    weighted = ordered.withColumns({"_lo": weight("q10", member), "_hi": weight(F.desc("q90"), F.desc(member))})

    def mean(q: str, w: str) -> Column:
        return F.try_divide(F.sum(F.col(q) * F.col(w)), F.sum(F.when(F.col(q).isNotNull(), F.col(w))))

    return weighted.groupBy(*keys).agg(mean("q10", "_lo").alias("q10"), F.avg("q50").alias("q50"), mean("q90", "_hi").alias("q90"))


def conformal(
    oof: DataFrame, pred: DataFrame, keys: Sequence[str], y: str, q: float = 0.9, any_size: bool = False
) -> DataFrame:
    """K9: widen the interval per key by the q-quantile of the out-of-fold
    misses on each side (negative misses narrow it).

    A key of site and issue day holds one miss per year; ``any_size=True`` is
    for keys that pool sites.
    """
    miss = oof.withColumns({"_below": F.col("q10") - F.col(y), "_above": F.col(y) - F.col("q90")})
    if any_size:
        lo = spread_quantiles(miss, keys, "_below", [q], ["_lo"])
        widths = lo.join(spread_quantiles(miss, keys, "_above", [q], ["_hi"]), list(keys))
    else:
        widths = miss.groupBy(*keys).agg(quantile("_below", q).alias("_lo"), quantile("_above", q).alias("_hi"))
    out = pred.join(widths, list(keys), "left")
    return out.withColumns(
        {
            "q10": F.col("q10") - F.coalesce("_lo", F.lit(0.0)),
            "q90": F.col("q90") + F.coalesce("_hi", F.lit(0.0)),
        }
    ).drop("_lo", "_hi")


def calibrate(df: DataFrame, md: str = "md_id", step: float = 0.005, start: float = 1.0, last: int = 27) -> DataFrame:
    """Factors linear in the issue ordinal, neutral at the last one."""
    end = min(start, 2 - start)  # a start above 1 is mirrored
    back = last - F.col(md)
    return df.withColumns(
        {"q10": F.col("q10") * (start - back * step), "q90": F.col("q90") * (end + back * step)}
    )


def clip_history(df: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Middle inside the historical range, lower not below its minimum,
    upper not above its maximum, then both on their side of the middle.
    ``bounds``: keys, lo, hi; a row without bounds only gets the second step."""
    out = df.join(bounds, list(keys), "left")
    mid = F.least(F.greatest(F.col("q50"), F.col("lo")), F.col("hi"))
    return out.withColumns(
        {
            "q10": F.least(F.greatest(F.col("q10"), F.col("lo")), mid),
            "q50": mid,
            "q90": F.greatest(F.least(F.col("q90"), F.col("hi")), mid),
        }
    )


def floor_history(df: DataFrame, bounds: DataFrame, keys: Sequence[str], rmse: str) -> DataFrame:
    """K11, second form: negative lower and low middle take the minimum; an
    upper below the middle is rebuilt from the error. A row without bounds has
    no minimum to take and keeps its values."""
    out = df.join(bounds, list(keys), "left")
    mid = F.when(F.col("q50") < F.col("lo"), F.col("lo")).otherwise(F.col("q50"))
    return out.withColumns(
        {
            "q10": F.when(F.col("q10") < 0, F.coalesce("lo", "q10")).otherwise(F.col("q10")),
            "q50": mid,
            "q90": F.when(F.col("q90") < mid, mid + 1.2816 * F.col(rmse)).otherwise(F.col("q90")),
        }
    )


def natflow_floor(
    df: DataFrame, observed: str, month: str, factors: Mapping[int, Mapping[str, tuple[float, float]]]
) -> DataFrame:
    """A prediction below threshold x observed season flow becomes
    multiplier x max(flow, prediction). ``factors[month][q] = (multiplier,
    threshold)``; other months stay."""
    out = {}
    for q in Q:
        value = F.col(q)
        for m, per_q in factors.items():
            mult, thres = per_q[q]
            low = (F.col(month) == m) & (F.col(q) < F.col(observed) * thres)
            value = F.when(low, mult * F.greatest(F.col(observed), F.col(q))).otherwise(value)
        out[q] = value
    return df.withColumns(out)


# --- distributions in closed form, fitted by moments -----------------------

EULER_GAMMA = 0.5772156649015329
FAMILIES = ("logistic", "gumbel", "uniform", "loglogistic", "lognormal")


def fit_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Moments and range from which every family's parameters follow."""
    positive = F.when(F.col(value) > 0, F.log(value))
    return df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"),
        F.stddev_samp(value).alias("_sd"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.avg(positive).alias("_lmean"),
        F.stddev_samp(positive).alias("_lsd"),
    )


def _params(family: str) -> tuple[Column, Column]:
    """Location and scale columns of a family from the moment columns."""
    logistic = math.sqrt(3.0) / math.pi
    if family == "logistic":
        return F.col("_mean"), F.col("_sd") * logistic
    if family == "gumbel":
        scale = F.col("_sd") * (math.sqrt(6.0) / math.pi)
        return F.col("_mean") - EULER_GAMMA * scale, scale
    if family == "uniform":
        return F.col("_min"), F.col("_max") - F.col("_min")
    if family == "loglogistic":
        return F.col("_lmean"), F.col("_lsd") * logistic
    if family == "lognormal":
        return F.col("_lmean"), F.col("_lsd")
    raise ValueError(family)


#: Fixed values of the rational approximation of the error function (Abramowitz
#: and Stegun 7.1.26; error below 1.5e-7): p, then a1 to a5.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    p, *a = ERF
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + p * x)
    tail = F.lit(0.0)
    for c in reversed(a):
        tail = (tail + c) * t
    upper = 1 - tail * F.exp(-x * x) / 2
    return F.when(z < 0, 1 - upper).otherwise(upper)


#: Fixed values of Acklam's rational approximation of the inverse normal
#: distribution (relative error below 1.2e-9): middle part, its divisor, tail part,
#: its divisor, and where the lower tail ends.
INVERSE_MIDDLE = (
    -3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
    1.383577518672690e2, -3.066479806614716e1, 2.506628277459239,
)
INVERSE_MIDDLE_BY = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
INVERSE_TAIL = (
    -7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838,
    -2.549732539343734, 4.374664141464968, 2.938163982698783,
)
INVERSE_TAIL_BY = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
INVERSE_EDGE = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_inverse(p: Column) -> Column:
    """Standard normal quantile of a probability inside (0, 1)."""

    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.log(q))
        return _polynomial(INVERSE_TAIL, r) / _polynomial(INVERSE_TAIL_BY, r)

    q = p - 0.5
    middle = q * _polynomial(INVERSE_MIDDLE, q * q) / _polynomial(INVERSE_MIDDLE_BY, q * q)
    return F.when(p < INVERSE_EDGE, tail(p)).when(p > 1 - INVERSE_EDGE, -tail(1 - p)).when(p.isNotNull(), middle)


def cdf(family: str, x: Column) -> Column:
    loc, scale = _params(family)
    point = F.log(x) if family in ("loglogistic", "lognormal") else x
    z = F.try_divide(point - loc, scale)
    if family == "lognormal":
        return F.when(x > 0, normal_cdf(z)).otherwise(0.0)
    if family == "gumbel":
        return F.exp(-F.exp(-z))
    if family == "uniform":
        return F.when(z.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), z)))
    p = 1 / (1 + F.exp(-z))
    return p if family == "logistic" else F.when(x > 0, p).otherwise(0.0)


def inverse_cdf(family: str, p: Column) -> Column:
    loc, scale = _params(family)
    if family == "logistic":
        return loc + scale * F.log(F.try_divide(p, 1 - p))
    if family == "gumbel":
        return loc - scale * F.log(-F.log(p))
    if family == "uniform":
        return loc + scale * p
    if family == "lognormal":
        return F.exp(loc + scale * normal_inverse(p))
    return F.exp(loc + scale * F.log(F.try_divide(p, 1 - p)))


def neg_log_density(family: str, x: Column) -> Column:
    loc, scale = _params(family)
    if family == "uniform":
        return F.log(scale)
    if family == "gumbel":
        z = F.try_divide(x - loc, scale)
        return F.log(scale) + z + F.exp(-z)
    point = x if family == "logistic" else F.log(x)
    z = F.try_divide(point - loc, scale)
    if family == "lognormal":
        return F.log(scale) + z * z / 2 + math.log(2 * math.pi) / 2 + F.log(x)
    base = z + F.log(scale) + 2 * F.log1p(F.exp(-z))
    return base if family == "logistic" else base + F.log(x)


def _by_family(fn, arg: Column, family: Column) -> Column:
    out = F.lit(None).cast("double")
    for name in FAMILIES:
        out = F.when(family == name, fn(name, arg)).otherwise(out)
    return out


def best_dist(
    df: DataFrame, keys: Sequence[str], value: str, families: Sequence[str] = FAMILIES
) -> DataFrame:
    """Family with the least negative log-likelihood per key, with the
    moments its parameters come from."""
    moments = fit_moments(df, keys, value)
    sums = (
        df.where(F.col(value).isNotNull())
        .join(moments, list(keys))
        .groupBy(*keys)
        .agg(*[F.sum(neg_log_density(f, F.col(value))).alias(f) for f in families])
    )
    ranked = F.array_min(
        F.filter(
            F.array(
                *[
                    F.struct(F.col(f).alias("nll"), F.lit(i).alias("i"), F.lit(f).alias("family"))
                    for i, f in enumerate(families)
                ]
            ),
            lambda s: s["nll"].isNotNull() & ~F.isnan(s["nll"]),
        )
    )
    picked = sums.withColumn("_b", ranked).select(*keys, F.col("_b.family").alias("family"), F.col("_b.nll").alias("nll"))
    return picked.join(moments, list(keys))


def dist_quantiles(
    pred: DataFrame, fitted: DataFrame, keys: Sequence[str], reach: float = 0.8, weight: Column | float = 1.0
) -> DataFrame:
    """Interval from the site's distribution around the middle prediction.

    The upper end lies ``reach`` of the way from the middle's probability to
    that of the historical maximum, the lower end likewise to the minimum;
    ``weight`` is the share of this interval in the blend with the model's own.
    A key without a fitted family keeps the model's interval.
    """
    family = F.col("family")
    joined = pred.join(fitted, list(keys), "left")
    top = _by_family(cdf, F.col("_max"), family)
    bottom = _by_family(cdf, F.col("_min"), family)
    joined = joined.withColumns({"_ptop": top, "_pbottom": bottom}).withColumn(
        "_p",
        F.greatest(F.col("_pbottom"), F.least(F.col("_ptop"), _by_family(cdf, F.col("q50"), family))),
    )
    hi = _by_family(inverse_cdf, F.col("_p") + reach * (F.col("_ptop") - F.col("_p")), family)
    lo = _by_family(inverse_cdf, F.col("_p") - reach * (F.col("_p") - F.col("_pbottom")), family)
    # Rounding of the distribution functions must not lead out of the record.
    hi = F.when(hi > F.col("_max"), F.col("_max")).otherwise(hi)
    lo = F.when(lo < F.col("_min"), F.col("_min")).otherwise(lo)
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    moments = [c for c in fitted.columns if c.startswith("_")]
    return joined.withColumns(
        {
            "q10": F.coalesce(w * lo + (1 - w) * F.col("q10"), "q10"),
            "q90": F.coalesce(w * hi + (1 - w) * F.col("q90"), "q90"),
        }
    ).drop("_p", "_ptop", "_pbottom", *moments)


def nearest_model(
    wanted: DataFrame, models: DataFrame, keys: Sequence[str], md: str, offsets: Sequence[int] = (0, -1, -2, -3)
) -> DataFrame:
    """Model of the issue ordinal, or of the first offset that has one.

    Offsets are a short list, so each wanted row tries them by equality.
    """
    tries = F.explode(
        F.array(*[F.struct(F.lit(i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(offsets)])
    )
    have = models.select(*keys, F.col(md).alias("_md")).distinct()
    found = (
        wanted.select(*keys, md)
        .distinct()
        .withColumn("_t", tries)
        .withColumn("_md", F.col(md) + F.col("_t.k"))
        .join(have, [*keys, "_md"])
        .groupBy(*keys, md)
        .agg(F.min_by("_md", "_t.o").alias("model_md"))
    )
    return wanted.join(found, [*keys, md], "left")
