"""Scores (inventory L1 to L9), all as aggregates of one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.scalars import pearson
from freshet.operators.quantiles import spread_ranks

QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


def pinball(y: str, p: str, q: float) -> Column:
    """L1: twice the mean quantile loss, as an aggregate."""
    miss = F.col(y) - F.col(p)
    return 2 * F.avg(F.when(miss >= 0, q * miss).otherwise((q - 1) * miss))


def mql(y: str) -> Column:
    """L2: mean of L1 at 10, 50 and 90 %."""
    parts = [pinball(y, c, q) for c, q in QUANTILES.items()]
    return (parts[0] + parts[1] + parts[2]) / 3


def coverage(y: str, lo: str = "q10", hi: str = "q90", strict: bool = False) -> Column:
    """L3: share of truths inside the interval."""
    v = F.col(y)
    inside = (F.col(lo) < v) & (v < F.col(hi)) if strict else (F.col(lo) <= v) & (v <= F.col(hi))
    return F.avg(inside.cast("int"))


def rmse(y: str, p: str) -> Column:
    d = F.col(y) - F.col(p)
    return F.sqrt(F.avg(d * d))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def mape(y: str, p: str) -> Column:
    return F.avg(F.try_divide(F.abs(F.col(y) - F.col(p)), F.abs(F.col(y))))


def bias(y: str, p: str) -> Column:
    return F.avg(F.col(y) - F.col(p))


def r2(y: str, p: str) -> Column:
    """Coefficient of determination, centred on the mean of the truth."""
    return nse(y, p)


def nse(y: str, p: str, centre: str | None = None) -> Column:
    """L4: efficiency, centred on the truth's mean; ``centre=p`` gives the other
    form, centred on the mean of the prediction."""
    d = F.col(y) - F.col(p)
    both = d.isNotNull()
    yv = F.when(both, F.col(y))
    spread = F.var_pop(yv)
    if centre is not None and centre != y:
        off = F.avg(yv) - F.avg(F.when(both, F.col(centre)))
        spread = spread + off * off
    return 1 - F.try_divide(F.avg(d * d), spread)


def point_errors(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """L4: rmse, mae, mape, bias, r2 and both forms of the efficiency."""
    return df.groupBy(*by).agg(
        rmse(y, p).alias("rmse"),
        mae(y, p).alias("mae"),
        mape(y, p).alias("mape"),
        bias(y, p).alias("bias"),
        r2(y, p).alias("r2"),
        nse(y, p, centre=p).alias("nse_pred_mean"),
    )


def correlations(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Pearson, and Spearman as Pearson on average ranks.

    Ranks are taken over equal-value counts and by buckets, so groups may be of
    any size.
    """
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn(
        "_g", F.struct(*(by or [F.lit(0).alias("_all")]))
    )

    def ranked(src: DataFrame, col: str, name: str) -> DataFrame:
        ranks = spread_ranks(both, by, col, name)
        return src.withColumn("_v", F.col(col).cast("double")).join(ranks, ["_g", "_v"]).drop("_v")

    out = ranked(ranked(both, y, "_ry"), p, "_rp")
    return out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson(y, p).alias("pearson"), pearson("_ry", "_rp").alias("spearman")
    )


def bundle(y: str) -> list[Column]:
    """The aggregates of the metric bundle."""
    return [
        F.count(F.lit(1)).alias("n"),
        mql(y).alias("mql"),
        *[pinball(y, c, q).alias(f"loss_{c}") for c, q in QUANTILES.items()],
        coverage(y).alias("coverage"),
        coverage(y, strict=True).alias("coverage_strict"),
        rmse(y, "q50").alias("rmse"),
        mae(y, "q50").alias("mae"),
        bias(y, "q50").alias("bias"),
        F.avg(y).alias("mean_y"),
        F.avg("q50").alias("mean_q50"),
    ]


def eval_agg(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """N, losses, coverage, errors and means in one row per group."""
    return df.groupBy(*by).agg(*bundle(y))


def eval_all(df: DataFrame, groupings: Sequence[Sequence[str]], y: str) -> DataFrame:
    """The bundle for several lists of keys in one grouping-sets aggregate,
    with a mean and a sd row over the groups of each list.

    ``grouping`` names the list; ``stat`` is ``group``, ``mean`` or ``std``.
    """
    keys = list(dict.fromkeys(k for g in groupings for k in g))
    sets = [[F.col(k) for k in g] for g in groupings]
    grouped = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        *bundle(y), F.grouping_id().alias("_gid")
    )
    label = F.lit(None).cast("string")
    for g in groupings:
        gid = sum(0 if k in g else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
        label = F.when(F.col("_gid") == gid, F.lit("+".join(g))).otherwise(label)
    grouped = grouped.withColumn("grouping", label).drop("_gid")
    measures = [c for c in grouped.columns if c not in (*keys, "grouping")]
    typed = grouped.withColumns({m: F.col(m).cast("double") for m in measures}).withColumn("stat", F.lit("group"))
    extra = []
    for stat, fn in (("mean", F.avg), ("std", F.stddev_samp)):
        row = typed.groupBy("grouping").agg(*[fn(m).alias(m) for m in measures])
        extra.append(row.withColumn("stat", F.lit(stat)))
    return typed.unionByName(extra[0], allowMissingColumns=True).unionByName(extra[1], allowMissingColumns=True)


def skill(pred: DataFrame, ref: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """1 - loss / reference loss per group."""
    a = pred.groupBy(*by).agg(mql(y).alias("mql"))
    b = ref.groupBy(*by).agg(mql(y).alias("mql_ref"))
    return a.join(b, list(by)).withColumn("skill", 1 - F.try_divide("mql", "mql_ref"))


def score_table(
    pred: DataFrame, by: Sequence[str], y: str, without: Column | None = None, precipitation: DataFrame | None = None
) -> DataFrame:
    """Loss and coverage per slice, without one year, next to the slice's
    total volume (the largest per site and year, summed) and the loss relative
    to its mean volume.

    ``precipitation`` (site, yr, v: a total that runs over the year) adds, to
    slices by ``yr``, the sum over sites of each year's largest value."""
    rows = pred if without is None else pred.where(~without)
    score = rows.groupBy(*by).agg(
        mql(y).alias("mql"), coverage(y).alias("coverage"), F.avg(y).alias("mean_volume")
    )
    inner = list(dict.fromkeys([*by, "site", "yr"]))
    total = rows.groupBy(*inner).agg(F.max(y).alias("_v")).groupBy(*by).agg(F.sum("_v").alias("total_volume"))
    out = score.join(total, list(by)).withColumn("relative_loss", F.try_divide("mql", "mean_volume"))
    if precipitation is not None:
        most = precipitation.groupBy("site", "yr").agg(F.max("v").alias("_v"))
        out = out.join(most.groupBy("yr").agg(F.sum("_v").alias("precipitation")), "yr", "left")
    return out
