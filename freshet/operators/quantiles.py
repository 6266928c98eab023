"""Exact quantiles.

``group_quantiles`` uses the built-in ``percentile``; it holds the distinct
values of one group in one buffer, so it is for groups bounded by the calendar
(one value per year, per day of a record).  ``spread_quantiles`` gives the same
numbers for groups of any size: values become 64-bit integers in the same order and
are narrowed 16 bits at a time, so no task ever orders more than 65,536 buckets or
distinct values, however they lie.

NaN counts as null; infinities are the least and the greatest values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bits that each step of the narrowing leaves undecided; a part has at most 2**16 members.
STEPS = (48, 32, 16, 0)


def quantile(col: str | Column, prob: float) -> Column:
    """Linear-interpolated quantile as an aggregate; nulls are ignored."""
    return F.percentile(col, F.lit(float(prob)))


def group_quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """exact quantiles of calendar-bounded groups in one aggregate."""
    values = F.percentile(col, F.array(*[F.lit(float(p)) for p in probs]))
    out = df.groupBy(*by).agg(values.alias("_q"))
    return out.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def _number(col: str | Column) -> Column:
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(v), v)


def _ordered(v: Column) -> Column:
    """A long for each double, in the same order: exponent above, mantissa below."""
    size = F.abs(v)
    about = F.floor(F.log(2.0, F.when(size < float("inf"), size)))
    power = F.pow(F.lit(2.0), about)
    # The logarithm may round over a power of two.
    exponent = about + F.when(power > size, -1).when(size >= power * 2, 1).otherwise(0)
    exponent = F.when(size < 2.0**-1021, -1022).otherwise(exponent)
    # Scaled in two steps, as 2**1074 is no double; what lies below 2**-1022 goes on evenly.
    scaled = size * F.pow(F.lit(2.0), F.lit(26) - F.floor(exponent / 2)) * F.pow(F.lit(2.0), F.lit(26) - F.ceil(exponent / 2))
    key = (exponent + 1022) * (1 << 52) + scaled.cast("long")
    key = F.when(size == float("inf"), F.lit((1 << 63) - 1)).otherwise(key)
    return F.coalesce(F.when(v != 0, F.signum(v).cast("long") * key), F.lit(0).cast("long"))


def _wanted(probs: Sequence[float]) -> Column:
    """The two ranks around each probability, from the group's row count."""
    ranks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, edge in ((0, F.floor), (1, F.ceil)):
            ranks.append(
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(side).alias("side"),
                    edge(at).cast("long").alias("rank"),
                    at.alias("pos"),
                )
            )
    return F.array(*ranks)


def _narrow(hist: DataFrame, part: list[str], bucket: str, keep: Sequence[str] = ()) -> DataFrame:
    """Buckets that hold a wanted rank, with the ranks made local to them."""
    order = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_upto", F.sum("_n").over(order))
    before = F.col("_upto") - F.col("_n")
    hit = F.filter("_want", lambda w: (w["rank"] >= before) & (w["rank"] < F.col("_upto")))
    local = F.transform(
        hit,
        lambda w: F.struct(
            w["i"].alias("i"), w["side"].alias("side"), (w["rank"] - before).alias("rank"), w["pos"].alias("pos")
        ),
    )
    return cum.select(*part, bucket, *keep, local.alias("_want")).where(F.size("_want") > 0)


def _counted(df: DataFrame, by: Sequence[str], col: str, weight: str | None) -> DataFrame:
    """Rows of each distinct value, (_g, _v, _n) and the value's place ``_k``.

    The group is one never-null struct: joins on it match null keys.
    """
    v = _number(col)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(v.isNotNull()).groupBy(F.struct(*(by or [F.lit(0).alias("_all")])).alias("_g"), v.alias("_v"))
    return counts.agg(n.alias("_n")).withColumn("_k", _ordered(F.col("_v")))


def _bucket(bits: int) -> Column:
    return F.shiftright("_k", bits)


def spread_quantiles(
    df: DataFrame,
    by: Sequence[str],
    col: str,
    probs: Sequence[float],
    names: Sequence[str],
    weight: str | None = None,
) -> DataFrame:
    """F3 for groups of any size: exact, with no group held in one task.

    Equal values are counted first (map-side combined, spread over the value), then
    the buckets that hold a wanted rank are narrowed by 16 bits at a time, down to
    the value itself. The wanted ranks travel with the buckets that hold them.
    ``weight`` counts a row so many times.
    """
    near = _counted(df, by, col, weight)
    part: list[str] = ["_g"]
    for i, bits in enumerate(STEPS):
        own = f"_b{i}"
        near = near.withColumn(own, _bucket(bits))
        hist = near.groupBy(*part, own).agg(F.sum("_n").alias("_n"), *([F.any_value("_want").alias("_want")] if i else []))
        if not i:
            hist = hist.withColumn("_total", F.sum("_n").over(Window.partitionBy("_g"))).withColumn("_want", _wanted(probs))
        hit = _narrow(hist, part, own)
        part = [*part, own]
        if bits:
            near = near.drop("_want").join(hit, part)
            continue
        found = near.drop("_want").join(hit, part).select("_g", "_v", F.explode("_want").alias("_w"))
    at = [
        F.max(F.when((F.col("_w.i") == i) & (F.col("_w.side") == side), F.col("_v")))
        for i in range(len(probs))
        for side in (0, 1)
    ]
    pos = [F.max(F.when(F.col("_w.i") == i, F.col("_w.pos"))) for i in range(len(probs))]
    values = []
    for i, name in enumerate(names):
        lo, hi, frac = at[2 * i], at[2 * i + 1], pos[i] - F.floor(pos[i])
        values.append(F.when((lo == hi) | (frac == 0), lo).otherwise(lo + (hi - lo) * frac).alias(name))
    return found.groupBy("_g").agg(*values).select(*[F.col(f"_g.{c}").alias(c) for c in by], *names)


def spread_ranks(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """Average rank of each distinct value within its group, for groups of any
    size: (group, value, rank).

    A rank is the rows in lower buckets at each of the four steps of the narrowing,
    so no window covers more than 65,536 rows. The group is one struct column, ``_g``.
    """
    counts = _counted(df, by, col, None)
    keys = ["_g", *[f"_b{i}" for i in range(len(STEPS))]]
    rows = counts.withColumns({f"_b{i}": _bucket(bits) for i, bits in enumerate(STEPS)})

    def before(part: list[str], order: str) -> Column:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    # From the finest buckets up, then the offsets down again.
    levels = [rows.select(*keys, "_n")]
    for i in range(len(STEPS) - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*keys[: i + 1]).agg(F.sum("_n").alias("_n")))
    offsets = levels[0].select(*keys[:2], "_n", before(keys[:1], keys[1]).alias("_o"))
    for i in range(1, len(STEPS)):
        own = levels[i].select(*keys[: i + 2], "_n", before(keys[: i + 1], keys[i + 1]).alias("_p"))
        offsets = own.join(offsets.drop("_n"), keys[: i + 1])
        offsets = offsets.select(*keys[: i + 2], "_n", (F.col("_o") + F.col("_p")).alias("_o"))
    return rows.select(*keys, "_v").join(offsets, keys).select("_g", "_v", (F.col("_o") + (F.col("_n") + 1) / 2).alias(name))
