"""Likelihood fits of the closed-form distribution families, all keys and families at once.

Logistic, Gumbel and log-logistic densities are log-concave in z = a * x - b, so
Newton steps on (a, b) lead to the one best fit.  A step is one aggregate per key
over all rows; a step that does not lower the negative log-likelihood is cut to a
quarter and tried again, so a fit is never worse than the moments it starts from.
Uniform and lognormal fits have closed forms.

Defined results: null values take no part; a key whose values are all equal, or
that has one value only, has no fits and gives no row; the log families need values
above 0 only.  Keys may be null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.plans.postprocess import EULER_GAMMA, FAMILIES
from freshet.session import cut_lineage

#: (a, b) of the standardised values by moments, where the Newton steps begin.
STARTS = {
    "logistic": (math.pi / math.sqrt(3.0), 0.0),
    "gumbel": (math.pi / math.sqrt(6.0), -EULER_GAMMA),
    "loglogistic": (math.pi / math.sqrt(3.0), 0.0),
}


def _shape(family: str, z: Column) -> tuple[Column, Column, Column]:
    """Negative log density of the standard family, its slope and its curvature."""
    if family == "gumbel":
        e = F.exp(-z)
        return z + e, 1 - e, e
    size, e = F.abs(z), F.exp(-F.abs(z))
    return size + 2 * F.log1p(e), F.signum(z) * (1 - e) / (1 + e), 2 * e / ((1 + e) * (1 + e))


def _sums(family: str) -> Column:
    """What a Newton step needs of all values of a key."""
    p = F.col(f"_{family}")
    u = (F.log("_x") - F.col("_lmean")) / F.col("_lsd") if family == "loglogistic" else (F.col("_x") - F.col("_mean")) / F.col("_sd")
    h, d, c = _shape(family, p["a"] * u - p["b"])
    parts = {"h": h, "du": d * u, "d": d, "cuu": c * u * u, "cu": c * u, "c": c}
    return F.struct(*[F.sum(v).alias(k) for k, v in parts.items()]).alias(f"_s_{family}")


def _stepped(family: str) -> Column:
    """Keep the better of the place reached and the best so far, and go on from there."""
    p, s, n = F.col(f"_{family}"), F.col(f"_s_{family}"), F.col("_n")
    a = p["a"]
    nll = s["h"] - n * F.log(a)
    better = p["best"].isNull() | (nll < p["best"])
    slope_a, slope_b = s["du"] - n / a, -s["d"]
    aa, ab, bb = s["cuu"] + n / (a * a), -s["cu"], s["c"]
    det = aa * bb - ab * ab
    newton_a = F.try_divide(ab * slope_b - bb * slope_a, det)
    newton_b = F.try_divide(ab * slope_a - aa * slope_b, det)
    at_a, at_b = F.when(better, a).otherwise(p["at_a"]), F.when(better, p["b"]).otherwise(p["at_b"])
    step_a, step_b = F.when(better, newton_a).otherwise(p["step_a"] / 4), F.when(better, newton_b).otherwise(p["step_b"] / 4)
    # a stays positive: a step may take nine tenths of it at the most.
    share = F.least(F.lit(1.0), F.try_divide(0.9 * at_a, F.greatest(-step_a, F.lit(0.0))))
    share = F.coalesce(share, F.lit(1.0))
    step_a, step_b = share * F.coalesce(step_a, F.lit(0.0)), share * F.coalesce(step_b, F.lit(0.0))
    return F.struct(
        (at_a + step_a).alias("a"), (at_b + step_b).alias("b"),
        at_a.alias("at_a"), at_b.alias("at_b"), F.when(better, nll).otherwise(p["best"]).alias("best"),
        step_a.alias("step_a"), step_b.alias("step_b"),
    )


def _fits(df: DataFrame, keys: Sequence[str], value: str, steps: int, near: float) -> DataFrame:
    """keys and ``fits``: an array of (nll, rank, family, loc, scale), the best first."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_x")))
    logs = F.when(F.col("_x") > 0, F.log("_x"))
    facts = rows.groupBy(*names).agg(
        F.count("*").cast("double").alias("_n"), F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.avg(logs).alias("_lmean"), F.stddev_samp(logs).alias("_lsd"), F.stddev_pop(logs).alias("_lpop"), F.sum(logs).alias("_lsum"),
    )
    none = F.lit(None).cast("double")
    for family, (a, b) in STARTS.items():
        start = [F.lit(a).alias("a"), F.lit(b).alias("b"), *[none.alias(c) for c in ("at_a", "at_b", "best", "step_a", "step_b")]]
        facts = facts.withColumn(f"_{family}", F.struct(*start))
    state = cut_lineage(facts.where("_max > _min"))
    fixed = [*names, "_n", "_mean", "_sd", "_min", "_max", "_lmean", "_lsd", "_lpop", "_lsum"]
    for _ in range(steps):
        own = state.select(*[F.col(c).alias(f"_o{c}") if c in names else F.col(c) for c in state.columns])
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_o{c}"))
        sums = rows.join(own, same).groupBy(*names).agg(*[_sums(f) for f in STARTS])
        sums = sums.select(*[F.col(c).alias(f"_o{c}") for c in names], *[f"_s_{f}" for f in STARTS])
        state = cut_lineage(state.join(sums, same).select(*fixed, *[_stepped(f).alias(f"_{f}") for f in STARTS]))
        # Fits that the log families have no values for stay null and do not count.
        moved = [F.abs(F.col(f"_{f}.{c}")) for f in STARTS for c in ("step_a", "step_b")]
        far = state.agg(F.max(F.greatest(*[F.when(F.isnan(m), 0.0).otherwise(m) for m in moved]))).first()[0]
        if far is None or far < near:
            break

    n, above = F.col("_n"), F.col("_min") > 0
    normal = n * (F.log("_lpop") + 0.5 + math.log(2 * math.pi) / 2) + F.col("_lsum")
    found = {"uniform": (F.col("_min"), F.col("_max") - F.col("_min"), n * F.log(F.col("_max") - F.col("_min")))}
    found["lognormal"] = (F.col("_lmean"), F.col("_lpop"), F.when(above, normal))
    for family in STARTS:
        mean, sd = ("_lmean", "_lsd") if family == "loglogistic" else ("_mean", "_sd")
        p = F.col(f"_{family}")
        nll = p["best"] + n * F.log(sd)
        found[family] = (F.col(mean) + F.col(sd) * p["at_b"] / p["at_a"], F.col(sd) / p["at_a"], F.when(above, nll + F.col("_lsum")) if family == "loglogistic" else nll)
    fits = [
        F.struct(found[f][2].alias("nll"), F.lit(i).alias("rank"), F.lit(f).alias("family"), found[f][0].alias("loc"), found[f][1].alias("scale"))
        for i, f in enumerate(FAMILIES)
    ]
    sound = F.filter(F.array(*fits), lambda f: f["nll"].isNotNull() & ~F.isnan(f["nll"]))
    return state.select(*[F.col(c).alias(k) for c, k in zip(names, keys)], F.array_sort(sound).alias("fits"))


def fit_likelihood(df: DataFrame, keys: Sequence[str], value: str, steps: int = 40, near: float = 1e-8) -> DataFrame:
    """keys, family, loc, scale and nll of every family; loc and scale of the log families are those of the logarithms."""
    fits = _fits(df, keys, value, steps, near).select(*keys, F.explode("fits").alias("_f"))
    return fits.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in ("family", "loc", "scale", "nll")])


def best_likelihood(df: DataFrame, keys: Sequence[str], value: str, steps: int = 40, near: float = 1e-8) -> DataFrame:
    """The family with the least negative log-likelihood per key, as in ``fit_likelihood``; ties go to the first of ``FAMILIES``."""
    fits = _fits(df, keys, value, steps, near).where(F.size("fits") > 0).withColumn("_f", F.col("fits")[0])
    return fits.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in ("family", "loc", "scale", "nll")])
