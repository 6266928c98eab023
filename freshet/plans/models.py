"""Model jobs (inventory J22, K16 to K18, M10, M11).

Fits over any number of rows are sums or pyspark.ml jobs; only the partial
least squares fit runs in Python, on the few yearly rows of one site and issue
day.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from freshet.plans.postprocess import conformal
from freshet.session import cut_lineage, spread


def pca(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Scores on the first k components of complete rows, centred first.

    ``k`` is cut to the number of columns. Signs are arbitrary.
    """
    rows = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    width = rows.select(F.size(vector)).head()[0]
    features = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_x"))
    stages = Pipeline(
        stages=[
            StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False),
            PCA(k=min(k, width), inputCol="_c", outputCol="_p"),
        ]
    )
    scores = stages.fit(features).transform(features).select(key, vector_to_array("_p").alias("_a"))
    return scores.select(key, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(min(k, width))])


#: Rows in one block of a fit; a block is one row of arrays.
FIT_BLOCK = 4096
#: Groups solved together.
GROUPS = 64


def fit_quantile(
    df: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    y: str,
    probs: Sequence[float] = (0.1, 0.5, 0.9),
    bags: int = 1,
    row_share: float = 1.0,
    col_share: float = 1.0,
    alpha: float = 0.0,
    row_key: Sequence[str] = (),
    steps: int = 12,
    seed: int = 0,
) -> DataFrame:
    """Linear quantile regression per group, quantile and bag.

    Minimises the mean quantile loss plus ``alpha`` times the sum of absolute slopes,
    features and target scaled to unit sd. Proximal Newton steps on a smoothed loss,
    from the least-squares fit, with the smoothing width shrinking by 0.65 a step
    (about 0.3 % of the target's sd at the end); a step's penalised quadratic problem
    is solved by coordinate steps on the aggregated matrices.

    The rows of a group are dealt into blocks once, each one row of arrays, and the
    coefficients of a group are one row for all quantiles and bags, so a step is one
    pass: a block gives one vector with the sums of all its fits, and vectors are
    summed on the map side. Coefficients are checkpointed after each step. Rows join
    a bag by a hash of ``row_key``; columns of a bag are drawn once with the seed.
    """
    p = len(features) + 1
    rng = np.random.default_rng(seed)
    use = np.zeros((bags, p), bool)
    for b in range(bags):
        use[b, 0] = True
        use[b, 1:] = rng.random(p - 1) < col_share if col_share < 1.0 else True
        if p > 1 and not use[b, 1:].any():
            use[b, rng.integers(1, p)] = True
    fits = [(q, b) for q in probs for b in range(bags)]
    complete = F.col(y).isNotNull()
    for f in features:
        complete = complete & F.col(f).isNotNull()
    stats = df.where(complete).groupBy(*by).agg(
        *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"_s{i}") for i, f in enumerate(features)],
        F.avg(y).alias("_my"),
        F.stddev_pop(y).alias("_sy"),
        F.count(F.lit(1)).alias("_rows"),
    )

    def unit(s: str) -> Column:
        return F.when(F.col(s) > 0, F.col(s)).otherwise(1.0)

    scaled = [(F.col(f) - F.col(f"_m{i}")) / unit(f"_s{i}") for i, f in enumerate(features)]
    row = F.array(*scaled, (F.col(y) - F.col("_my")) / unit("_sy"))
    hashed = F.xxhash64(*(row_key or [*features, y]))
    parts = F.ceil(F.col("_rows") / FIT_BLOCK)
    dealt = df.where(complete).join(stats, list(by)).select(*by, row.alias("_x"), hashed.alias("_h"), parts.alias("_parts"))
    dealt = cut_lineage(dealt.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))))
    blocks = dealt.groupBy(*by, "_part").agg(F.collect_list(F.struct("_x", "_h")).alias("_r"))
    blocks = cut_lineage(blocks.select(*by, F.flatten("_r._x").alias("_x"), F.col("_r._h").alias("_h")))
    coefs = blocks.select(*by).distinct().withColumn("beta", F.lit(None).cast("array<double>"))
    key_fields = [f for f in blocks.schema.fields if f.name in by]
    schema = T.StructType([*key_fields, T.StructField("beta", T.ArrayType(T.DoubleType()))])
    for step in range(steps + 1):
        width = None if step == 0 else 0.5 * 0.65 ** (step - 1)
        sums = _block_sums(blocks.join(coefs, list(by)), by, key_fields, fits, p, row_share, seed, width)
        total = sums.groupBy(*by).agg(Summarizer.sum(array_to_vector("_sums")).alias("_v"), F.any_value("beta").alias("beta"))
        total = total.select(*by, vector_to_array("_v").alias("_v"), "beta")
        coefs = cut_lineage(_proximal_step(total, by, schema, fits, use, alpha, 0.0 if step == 0 else 1e-3))
    # One row per fit again, on the scale of the inputs.
    named = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(b).alias("bag")) for q, b in fits])
    each = coefs.select(*by, "beta", F.posexplode(named).alias("_i", "_fit"))
    each = each.select(*by, "_fit.q", "_fit.bag", F.slice("beta", F.col("_i") * p + 1, p).alias("beta"))
    out = each.join(stats, list(by))
    slopes = [F.col("beta")[i + 1] * unit("_sy") / unit(f"_s{i}") for i in range(p - 1)]
    shift = sum((s * F.col(f"_m{i}") for i, s in enumerate(slopes)), F.lit(0.0))
    level = F.col("_my") + F.col("beta")[0] * unit("_sy") - shift
    return out.select(*by, "q", "bag", F.array(level, *slopes).alias("beta"))


def _in_bag(h: np.ndarray, bag: int, row_share: float, seed: int) -> np.ndarray:
    """Whether the rows of these hashes are in a bag."""
    x = h.astype(np.uint64) + np.uint64((bag * 2_654_435_761 + seed * 40_503 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 < row_share


def _block_sums(
    blocks: DataFrame, by: Sequence[str], key_fields: list, fits: list, p: int, row_share: float, seed: int, width: float | None
) -> DataFrame:
    """Per block one vector: for each fit the row count, the curvature and the gradient."""
    schema = T.StructType(
        [*key_fields, T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("beta", T.ArrayType(T.DoubleType()))]
    )
    upper = np.triu_indices(p)
    prob, bag_of = np.array([q for q, _ in fits]), np.array([b for _, b in fits])
    n_bags = int(bag_of.max()) + 1

    def run(batches):
        for pdf in batches:
            out = []
            for flat, h, beta in zip(pdf["_x"], pdf["_h"], pdf["beta"]):
                rows = np.asarray(flat, float).reshape(-1, p)
                x = np.hstack([np.ones((len(rows), 1)), rows[:, :-1]])
                target, h = rows[:, -1], np.asarray(h, np.int64)
                old = np.zeros((len(fits), p)) if beta is None else np.asarray(beta, float).reshape(-1, p)
                mine = np.ones((len(h), n_bags))
                if row_share < 1:
                    mine = np.column_stack([_in_bag(h, b, row_share, seed) for b in range(n_bags)]).astype(float)
                mine = mine[:, bag_of]
                if width is None:
                    curve, pull = mine, mine * target[:, None]
                else:
                    below = 1 / (1 + np.exp(np.clip((target[:, None] - x @ old.T) / width, -50, 50)))
                    curve, pull = mine * below * (1 - below) / width, mine * (prob - below)
                products = x[:, upper[0]] * x[:, upper[1]]
                sums = np.hstack([mine.sum(axis=0)[:, None], curve.T @ products, pull.T @ x])
                out.append(sums.ravel())
            yield pdf[[*by]].assign(_sums=out, beta=pdf["beta"])

    return blocks.mapInPandas(run, schema)


def _proximal(a: np.ndarray, b: np.ndarray, beta: np.ndarray, use: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Minimises, for each fit, the quadratic with curvature a and gradient -b at beta plus the penalty on slopes.

    Columns that a fit doesn't use stay 0. All fits take their coordinate steps together.
    """
    fits, p = beta.shape
    a = a * use[:, :, None] * use[:, None, :]
    a[:, np.arange(p), np.arange(p)] += ~use
    b = np.where(use, b, 0.0)
    if not penalty.any():
        return beta + np.linalg.solve(a, b[..., None])[..., 0]
    pull = np.einsum("kij,kj->ki", a, beta) + b  # the quadratics' linear parts
    z = beta.copy()
    for _ in range(500):
        moved = 0.0
        for j in range(p):
            rest = pull[:, j] - np.einsum("ki,ki->k", a[:, j], z) + a[:, j, j] * z[:, j]
            new = (rest if j == 0 else np.sign(rest) * np.maximum(np.abs(rest) - penalty, 0.0)) / a[:, j, j]
            moved = max(moved, np.abs(new - z[:, j]).max())
            z[:, j] = new
        if moved < 1e-10:
            break
    return z


def _proximal_step(
    total: DataFrame, by: Sequence[str], schema: T.StructType, fits: list, use: np.ndarray, alpha: float, ridge: float
) -> DataFrame:
    """New coefficients of all fits of a group; ``ridge`` is relative to the row count."""
    p = use.shape[1]
    upper = np.triu_indices(p)
    size = 1 + len(upper[0]) + p
    used = use[[b for _, b in fits]]

    def solved(flats, betas) -> list[np.ndarray]:
        sums = np.stack([np.asarray(v, float) for v in flats]).reshape(-1, size)
        old = np.stack([np.zeros(len(fits) * p) if v is None else np.asarray(v, float) for v in betas]).reshape(-1, p)
        n = np.maximum(sums[:, 0], 1.0)  # a bag without rows keeps zeros
        a = np.zeros((len(sums), p, p))
        a[:, upper[0], upper[1]] = sums[:, 1 : 1 + len(upper[0])]
        a = a + np.triu(a, 1).transpose(0, 2, 1) + ((ridge + 1e-9) * n)[:, None, None] * np.eye(p)
        new = _proximal(a, sums[:, 1 + len(upper[0]) :], old, np.tile(used, (len(flats), 1)), alpha * n)
        return list(new.reshape(len(flats), -1))

    def run(batches):
        for pdf in batches:
            out = []
            for first in range(0, len(pdf), GROUPS):
                part = slice(first, first + GROUPS)
                out += solved(pdf["_v"].iloc[part], pdf["beta"].iloc[part])
            yield pdf[[*by]].assign(beta=out)

    return total.mapInPandas(run, schema)


def predict_quantile(
    df: DataFrame, coefs: DataFrame, by: Sequence[str], features: Sequence[str], probs: Sequence[float] = (0.1, 0.5, 0.9)
) -> DataFrame:
    """Mean over bags of the linear predictions, one column per quantile.

    The coefficients of a group become one row, so every row of ``df`` stays as it
    is, repeated rows included; a group without coefficients gets nulls.
    """
    mean = [F.avg(F.col("beta")[i]).alias(f"_b{i}") for i in range(len(features) + 1)]
    each = coefs.groupBy(*by, "q").agg(*mean).withColumn("_beta", F.array(*[f"_b{i}" for i in range(len(features) + 1)]))
    names = {p: f"_q{i}" for i, p in enumerate(probs)}
    wide = each.groupBy(*by).agg(*[F.max(F.when(F.round("q", 6) == round(p, 6), F.col("_beta"))).alias(n) for p, n in names.items()])

    def value(beta: str) -> Column:
        return sum((F.col(f) * F.col(beta)[i + 1] for i, f in enumerate(features)), F.col(beta)[0])

    joined = df.join(wide, list(by), "left")
    return joined.select(*[F.col(c) for c in df.columns], *[value(n).alias(f"q{round(p * 100)}") for p, n in names.items()])


def _pls_fit(x: np.ndarray, y: np.ndarray, ncomp: int):
    """One-response partial least squares; returns coefficient vectors for
    1 .. ncomp components on centred data."""
    e, f = x.copy(), y.copy()
    ws, ps, qs, coefs = [], [], [], []
    for _ in range(ncomp):
        w = e.T @ f
        norm = np.linalg.norm(w)
        if norm < 1e-12:
            break
        w = w / norm
        t = e @ w
        tt = t @ t
        load, q = e.T @ t / tt, (f @ t) / tt
        e, f = e - np.outer(t, load), f - q * t
        ws.append(w)
        ps.append(load)
        qs.append(q)
        wm, pm = np.column_stack(ws), np.column_stack(ps)
        coefs.append(wm @ np.linalg.solve(pm.T @ wm, np.array(qs)))
    return coefs


def _pls_predict(x: np.ndarray, y: np.ndarray, new: np.ndarray, ncomp: int) -> list[float]:
    mx, sx, my = x.mean(0), x.std(0, ddof=1), y.mean()
    sx = np.where(sx > 0, sx, 1.0)
    coefs = _pls_fit((x - mx) / sx, y - my, ncomp)
    if not coefs:
        return [my] * ncomp
    values = [float(my + ((new - mx) / sx) @ c) for c in coefs]
    return values + [values[-1]] * (ncomp - len(values))


def _held_out(x_all: np.ndarray, y_all: np.ndarray, other: np.ndarray, test: np.ndarray, max_comp: int):
    """q10, q50, q90, rmse, components and training rows for one held-out row, or None."""
    rows = other & ~np.isnan(y_all)
    if not rows.any():
        return None
    cols = [j for j in range(x_all.shape[1]) if not np.isnan(test[j]) and np.isnan(x_all[rows, j]).mean() < 0.5]
    rows = rows & ~np.isnan(x_all[:, cols]).any(axis=1)
    x, t = x_all[rows], y_all[rows]
    distinct: list[int] = []
    for j in cols:
        usable = len(t) and (x[:, j] == 0).mean() <= 0.6 and np.ptp(x[:, j]) > 0
        if usable and not any(np.array_equal(x[:, j], x[:, k]) for k in distinct):
            distinct.append(j)
    n = len(t)
    if not distinct or n < 4:
        return None
    x, new = x[:, distinct], test[distinct]
    comps = min(max_comp, len(distinct), n - 2)
    errors = np.zeros(comps)
    for i in range(n):
        keep = np.arange(n) != i
        errors += (np.array(_pls_predict(x[keep], t[keep], x[i], comps)) - t[i]) ** 2
    best = int(np.argmin(errors))
    rmse = math.sqrt(errors[best] / n)
    centre = _pls_predict(x, t, new, comps)[best]
    return centre - 1.2816 * rmse, centre, centre + 1.2816 * rmse, rmse, best + 1, n


def fit_pls(
    df: DataFrame, by: Sequence[str], year: str, features: Sequence[str], y: str, max_comp: int = 4
) -> DataFrame:
    """Per group and held-out year a PLS fit on the other years.

    Components by leave-one-out error, interval = centre -/+ 1.2816 x that
    error. A group is one site and issue day: a row or a few per year, and every
    row of a held-out year is predicted (``row`` numbers them).
    """
    fields = [f for f in df.schema.fields if f.name in by]
    schema = T.StructType(
        [
            *fields,
            T.StructField("fold", T.IntegerType()),
            T.StructField("row", T.IntegerType()),
            *[T.StructField(c, T.DoubleType()) for c in ("q10", "q50", "q90", "rmse")],
            T.StructField("ncomp", T.IntegerType()),
            T.StructField("n_train", T.IntegerType()),
        ]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x_all = pdf[list(features)].to_numpy(dtype=float)
        y_all = pdf[y].to_numpy(dtype=float)
        years = pdf[year].to_numpy()
        key = [pdf[b].iloc[0] for b in by]
        out = []
        order = np.lexsort((*x_all.T, years))
        x_all, y_all, years = x_all[order], y_all[order], years[order]
        for fold in np.unique(years):
            for number, test in enumerate(x_all[years == fold]):
                found = _held_out(x_all, y_all, years != fold, test, max_comp)
                if found is not None:
                    out.append([*key, int(fold), number, *found])
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return spread(df, list(by)).groupBy(*by).applyInPandas(run, schema)


def fit_gbt(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    fold: str,
    folds: Sequence[int],
    keys: Sequence[str],
    max_iter: int = 20,
    max_depth: int = 4,
    seed: int = 0,
) -> DataFrame:
    """Boosted trees over all sites, trained once per fold by pyspark.ml;
    out-of-fold middle, with intervals from the misses of the other folds."""
    rows = cut_lineage(df.dropna(subset=[*features, y]))
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_x"),
            GBTRegressor(
                featuresCol="_x", labelCol=y, predictionCol="q50", maxIter=max_iter, maxDepth=max_depth, seed=seed
            ),
        ]
    )
    parts = []
    held = {r[0] for r in rows.select(fold).distinct().collect()}  # one value per fold
    for f in [f for f in folds if f in held]:
        model = pipeline.fit(rows.where(F.col(fold) != f))
        parts.append(model.transform(rows.where(F.col(fold) == f)).drop("_x"))
    oof = parts[0]
    for part in parts[1:]:
        oof = oof.unionByName(part)
    oof = cut_lineage(oof.withColumns({"q10": F.col("q50"), "q90": F.col("q50")}))
    # Misses of fold g widen the intervals of every other fold.
    other = oof.withColumn(
        "_for", F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda g: g != F.col(fold)))
    )
    misses = other.select(*keys, F.col("_for").alias("_f"), "q10", "q90", y)
    return conformal(misses, oof.withColumn("_f", F.col(fold)), [*keys, "_f"], y, any_size=True).drop("_f")


Score = Callable[[DataFrame], DataFrame]


def _tried_points(f: str, n: int) -> list[Column]:
    """Arrays of the grid, current and reference values of one feature."""
    lo, hi = F.col(f"_lo_{f}"), F.col(f"_hi_{f}")

    def point(v: Column, kind: str) -> Column:
        return F.struct(F.lit(f).alias("feature"), v.cast("double").alias("v"), F.lit(kind).alias("data_type"))

    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(lo + (hi - lo) * i / (n - 1), "grid"))
    return [
        grid,
        F.array(point(F.col(f), "current")),
        F.transform(f"_ref_{f}", lambda v: point(v, "reference")),
    ]


def what_if(
    rows: DataFrame, reference: DataFrame, by: Sequence[str], features: Sequence[str], score: Score, n: int = 30
) -> DataFrame:
    """N points between a feature's reference minimum and maximum, the
    current value and each reference value, other features as they are.

    ``reference`` holds one row per ``by`` key and year, so the tried values of
    a key are few. ``score`` adds a ``prediction`` column.
    """
    ids = list(rows.columns)
    spans = reference.groupBy(*by).agg(
        *[F.min(f).alias(f"_lo_{f}") for f in features],
        *[F.max(f).alias(f"_hi_{f}") for f in features],
        *[F.collect_set(f).alias(f"_ref_{f}") for f in features],
    )
    tries = [t for f in features for t in _tried_points(f, n)]
    exploded = rows.join(spans, list(by)).withColumn("_t", F.explode(F.concat(*tries)))
    changed = exploded.select(
        *[
            F.when(F.col("_t.feature") == c, F.col("_t.v")).otherwise(F.col(c)).alias(c) if c in features else F.col(c)
            for c in ids
        ],
        F.col("_t.feature").alias("feature"),
        F.col("_t.v").alias("feature_value"),
        F.col("_t.data_type").alias("data_type"),
    )
    keep = [c for c in ids if c not in features]
    return score(changed).select(*keep, "feature", "feature_value", "data_type", "prediction")


#: Coalitions up to which all are tried.
ALL_COALITIONS = 1 << 10


def coalitions(g: int, tried: int = ALL_COALITIONS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions of g groups (their bits) and, for each group, every coalition's part in its value.

    Up to ``tried`` coalitions all are taken and the parts are the exact Shapley
    weights. Beyond, the empty and the full one and pairs of a drawn coalition and its
    complement are taken, sizes drawn by their Shapley kernel weight; the parts are
    then those of the weighted least squares that fits an additive model through the
    empty and the full coalition. Models of single groups and pairs of groups come out
    exactly, others with an error that falls with the root of ``tried``.
    """
    if 1 << g <= tried:
        bits = np.arange(1 << g)
        weight = [math.factorial(s) * math.factorial(g - s - 1) / math.factorial(g) for s in range(g)]
        parts = np.zeros((g, len(bits)))
        for c in bits.tolist():
            size = c.bit_count()
            for i in range(g):
                parts[i, c] = weight[size - 1] if c >> i & 1 else -weight[size]
        return bits, parts
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, g)
    kernel = 1.0 / (sizes * (g - sizes))
    drawn: dict[int, int] = {}
    full = (1 << g) - 1
    for size in rng.choice(sizes, (tried - 2) // 2, p=kernel / kernel.sum()):
        c = sum(1 << int(i) for i in rng.choice(g, size, replace=False))
        for side in (c, full ^ c):
            drawn[side] = drawn.get(side, 0) + 1
    bits = np.array([0, full, *drawn])
    z = (bits[2:, None] >> np.arange(g) & 1).astype(float)
    w = np.array(list(drawn.values()), float)
    # Least squares under the condition that the parts sum to v(full) - v(empty).
    a = np.linalg.pinv(z.T @ (w[:, None] * z))
    ones = np.ones(g)
    free = a - np.outer(a @ ones, ones @ a) / (ones @ a @ ones)
    parts = np.zeros((g, len(bits)))
    parts[:, 2:] = free @ (z * w[:, None]).T
    parts[:, 0] = -parts[:, 2:].sum(axis=1) - a @ ones / (ones @ a @ ones)
    parts[:, 1] = a @ ones / (ones @ a @ ones)
    return bits, parts


def group_shapley(
    rows: DataFrame,
    background: DataFrame,
    key: Sequence[str],
    by: Sequence[str],
    groups: Mapping[str, Sequence[str]],
    score: Score,
    tried: int = ALL_COALITIONS,
) -> DataFrame:
    """Contribution per feature group under independence, with the expected value.

    A coalition takes its groups from the explained row and the rest from each
    background row of the same ``by`` key; ``background`` holds one row per key
    and year, so the rows compared are few. Up to ``tried`` coalitions are scored for
    a row, all of them or a draw as :func:`coalitions` says, and a group's value is
    one weighted sum over them.
    """
    names = list(groups)
    bits, parts = coalitions(len(names), tried)
    owner = {c: i for i, name in enumerate(names) for c in groups[name]}
    base = background.select(*by, *[F.col(c).alias(f"_bg_{c}") for c in owner])
    listed = rows.sparkSession.createDataFrame([(i, int(c), parts[:, i].tolist()) for i, c in enumerate(bits)], "_i int, _s long, _w array<double>")
    mixed = rows.join(base, list(by)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(bits) - 1))))
    mixed = mixed.join(F.broadcast(listed), "_i")  # at most ``tried`` rows
    taken = mixed.withColumns(
        {
            c: F.when(F.col("_s").bitwiseAND(1 << i) != 0, F.col(c)).otherwise(F.col(f"_bg_{c}"))
            for c, i in owner.items()
        }
    )
    value = score(taken).groupBy(*key, "_i").agg(
        F.avg("prediction").alias("_v"), F.first("_w").alias("_w"), F.first("_s").alias("_s")
    )
    terms = [F.sum(F.col("_w")[i] * F.col("_v")).alias(name) for i, name in enumerate(names)]
    wide = value.groupBy(*key).agg(F.max(F.when(F.col("_s") == 0, F.col("_v"))).alias("expected"), *terms)
    return wide.unpivot([*key, "expected"], names, "label", "shap")


def waterfall(shapley: DataFrame, offsets: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Expected value and known-volume offset as rows before the groups.

    ``offsets``: key, by, offset. The expected offset is the median per ``by``.
    """
    medians = offsets.groupBy(*by).agg(F.median("offset").alias("_mid"))
    known = offsets.join(medians, list(by)).select(*key, "offset", "_mid")
    first = shapley.select(*key, "expected").distinct().join(known, list(key))
    rows = shapley.select(*key, "label", F.round("shap", 2).alias("shap"))
    expected = first.select(*key, F.lit("Expected").alias("label"), F.round(F.col("expected") + F.col("_mid"), 2).alias("shap"))
    offset = first.select(*key, F.lit("Known volume").alias("label"), F.round(F.col("offset") - F.col("_mid"), 2).alias("shap"))
    return expected.unionByName(offset).unionByName(rows).where(F.col("shap") != 0)
