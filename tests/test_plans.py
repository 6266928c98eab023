import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators.windows import roll_mean
from freshet.plans import explain, folds, likelihood, metrics, models, postprocess as pp, selection

D = dt.date


def labels(spark, seed=0, sites=3, first=1990, last=2001):
    rng = np.random.default_rng(seed)
    rows = [(s, y, float(rng.gamma(4, 100))) for s in range(sites) for y in range(first, last + 1)]
    return spark.createDataFrame(rows, "site int, yr int, vol double"), rows


def test_fold_statistics_equal_numpy(spark):
    df, rows = labels(spark)
    for r in folds.loo_stats(df, ["site"], "yr", "vol", 1990, 2003).collect():
        kept = [v for s, y, v in rows if s == r.site and y != r.fold]
        assert r.loo_mean == pytest.approx(np.mean(kept))
        assert r.loo_std == pytest.approx(np.std(kept, ddof=1))
        assert r.n == len(kept)


def test_fold_statistics_ignore_the_held_out_year(spark):
    df, _ = labels(spark)
    changed = df.withColumn("vol", F.when(F.col("yr") == 1995, F.lit(1e6)).otherwise(F.col("vol")))

    def stats(frame):
        out = folds.loo_stats(frame, ["site"], "yr", "vol", 1995, 1995)
        return {r.site: (r.loo_mean, r.loo_std) for r in out.collect()}

    a, b = stats(df), stats(changed)
    for site in a:
        assert a[site] == pytest.approx(b[site], rel=1e-6)


def test_equal_values_leave_no_spread(spark):
    rows = [(1, y, 0.1 if y != 2000 else 7.3) for y in range(1995, 2005)]
    df = spark.createDataFrame(rows, "site int, yr int, vol double")
    row = folds.loo_stats(df, ["site"], "yr", "vol", 2000, 2000).head()
    assert row.loo_std == 0.0


def test_loocv_trains_on_every_other_year(spark):
    df, _ = labels(spark, sites=1)
    out = folds.loocv(df, "yr", 1990, 2001)
    assert out.where("yr = fold").count() == 0
    assert out.count() == 12 * 11


def test_kfold_keeps_years_whole(spark):
    df, _ = labels(spark)
    out = folds.kfold(df, "yr", 3, repeats=2, seed=5)
    assert out.groupBy("repeat", "yr").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.select("repeat", "fold").distinct().count() == 6


def test_synthetic_factors_mirror_negatives(spark):
    df = spark.createDataFrame([(2000, 2.0, -2.0, 0.0)], "yr int, a double, b double, c double")
    for r in folds.synthesize(df, "yr", ["a", "b", "c"], n=3, inverted=["b"]).collect():
        assert 0.5 <= r.factor <= 1.5
        assert (r.a, r.b, r.c) == pytest.approx((2 * r.factor, -2 * r.factor, 0.0))


def test_corr_select_orders_by_correlation(spark):
    lab, rows = labels(spark, sites=1)
    vols = {y: v for _, y, v in rows}
    rng = np.random.default_rng(3)
    yearly = [(10, y, v) for y, v in vols.items()] + [(11, y, -v) for y, v in vols.items()]
    yearly += [(12, y, float(rng.normal())) for y in vols]
    yearly = spark.createDataFrame(yearly, "station int, yr int, x double")
    pairs = spark.createDataFrame([(0, 10), (0, 11), (0, 12)], "site int, station int")
    best = selection.corr_select(yearly, pairs, lab, 1, 5, 1995, 1996)
    worst = selection.corr_select(yearly, pairs, lab, 1, 5, 1995, 1996, ascending=True)
    assert {r.station for r in best.collect()} == {10}
    assert {r.station for r in worst.collect()} == {11}


def test_greedy_set_beats_single_stations(spark):
    rng = np.random.default_rng(7)
    rows = []
    for y in range(1960, 2000):
        a, b, c = rng.normal(size=3)
        vol = 100 + 5 * a + 3 * b + 0.01 * rng.normal()
        rows += [(2000, 1, s, y, float(x), float(vol)) for s, x in ((1, a), (2, b), (3, c))]
    df = spark.createDataFrame(rows, "fold int, site int, station int, yr int, x double, vol double")
    row = selection.greedy_stations(df, rounds=2).head()
    assert {1, 2} <= set(row.stations)
    assert row.rmse < 0.1


def one_set_rmse(x, y):
    """Trimmed refits of one candidate set, on its own."""
    design = np.column_stack([np.ones(len(x)), x])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(3):
        far = np.abs(y - design @ coef)
        keep = far <= 3 * max(np.median(far), 1e-12)
        if keep.sum() <= design.shape[1]:
            break
        coef = np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]
    return np.sqrt(np.mean((y - design @ coef) ** 2))


def test_fits_of_many_sets_equal_the_fit_of_each():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 12, 3)), rng.normal(size=(40, 12))
    x[5, :, 2] = x[5, :, 1]  # stations that say the same
    y[7] = 2.0 * x[7, :, 0] + 1.0
    y[:, 0] += 50.0  # a far year
    seen = rng.random((40, 12)) < 0.8
    seen[:, :5] = True
    got = selection._robust_rmse(np.where(seen[..., None], x, np.nan), y, seen)
    want = [one_set_rmse(a[s], b[s]) for a, b, s in zip(x, y, seen)]
    assert got == pytest.approx(want, abs=1e-9)


def test_greedy_sets_equal_a_plain_search(spark):
    rng = np.random.default_rng(11)
    rows, by = [], {}
    for site in (1, 2):
        vol = {y: float(rng.normal(100, 20)) for y in range(1980, 1995)}
        for station in range(6):
            for y in vol:
                if rng.random() < 0.9:
                    x = float(vol[y] * (station + 1) + rng.normal(0, 40))
                    rows.append((1990, site, station, y, x, vol[y]))
                    by.setdefault(site, {}).setdefault(station, {})[y] = x
        rows += [(1990, site, 0, 1979, None, 5.0), (1990, site, 1, 1979, float("nan"), 5.0), (1990, site, 9, 1980, 1.0, vol[1980])]
        by[site]["vol"] = vol
    got = selection.greedy_stations(spark.createDataFrame(rows, "fold int, site int, station int, yr int, x double, vol double"), rounds=2, min_years=8)
    assert got.columns == ["fold", "site", "stations", "rmse"]
    for r in got.collect():
        vol = by[r.site]["vol"]

        def fit(members):
            years = [y for y in vol if all(y in by[r.site][m] for m in members)]
            if len(years) >= 8:
                return one_set_rmse(np.array([[by[r.site][m][y] for m in members] for y in years]), np.array([vol[y] for y in years]))

        known = {(m,): fit((m,)) for m in range(6)}

        def best():
            return min((round(v, 9), len(k), k) for k, v in known.items() if v is not None)[2]

        for _ in range(2):
            top = best()
            known |= {k: fit(k) for k in {tuple(sorted({*top, *k})) for k in known if known[k] is not None} if k not in known}
        assert tuple(r.stations) == best() and r.rmse == pytest.approx(known[best()])


def test_conformal_reaches_its_share(spark):
    rng = np.random.default_rng(0)
    rows = [(1, 50.0, 50.0, 50.0, float(y)) for y in rng.normal(50, 10, 2000)]
    df = spark.createDataFrame(rows, "md int, q10 double, q50 double, q90 double, y double")
    out = pp.conformal(df, df, ["md"], "y")
    share = out.agg(metrics.coverage("y").alias("c")).head().c
    assert share == pytest.approx(0.8, abs=0.02)


@pytest.mark.parametrize("family", pp.FAMILIES)
def test_inverse_of_each_distribution(spark, family):
    rows = [(1, float(v)) for v in np.random.default_rng(1).gamma(5, 20, 200)]
    fitted = pp.fit_moments(spark.createDataFrame(rows, "site int, y double"), ["site"], "y")
    probs = fitted.withColumn("p", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.3, 0.5, 0.9)])))
    back = probs.select("p", pp.cdf(family, pp.inverse_cdf(family, F.col("p"))).alias("q"))
    for r in back.collect():
        assert r.q == pytest.approx(r.p)


def test_distribution_quantiles_stay_in_the_record(spark):
    rows = [(1, float(v)) for v in np.random.default_rng(2).gamma(5, 20, 100)]
    hist = spark.createDataFrame(rows, "site int, y double")
    fitted = pp.best_dist(hist, ["site"], "y").drop("nll")
    pred = spark.createDataFrame([(1, None, x, None) for x in (1.0, 90.0, 1e6)], "site int, q10 double, q50 double, q90 double")
    lo, hi = min(r[1] for r in rows), max(r[1] for r in rows)
    out = pp.dist_quantiles(pred.fillna(0.0), fitted, ["site"]).collect()
    for r in out:
        assert lo - 1e-6 <= r.q10 <= r.q90 <= hi + 1e-6


def test_nearest_model_prefers_the_earlier(spark):
    wanted = spark.createDataFrame([(1, 5), (1, 2), (1, 20)], "site int, md int")
    have = spark.createDataFrame([(1, 3), (1, 4)], "site int, md int")
    got = {r.md: r.model_md for r in pp.nearest_model(wanted, have, ["site"], "md").collect()}
    assert got == {5: 4, 2: None, 20: None}


def test_spearman_with_ties(spark):
    ys, ps = [1.0, 2.0, 2.0, 3.0, 9.0], [2.0, 1.0, 1.0, 1.0, 7.0]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(ys, ps)], "g int, y double, p double")
    row = metrics.correlations(df, ["g"], "y", "p").head()
    ry, rp = [1, 2.5, 2.5, 4, 5], [4, 2, 2, 2, 5]
    assert row.spearman == pytest.approx(np.corrcoef(ry, rp)[0, 1])


def test_pinball_equals_its_formula(spark):
    df = spark.createDataFrame([(10.0, 7.0), (5.0, 9.0)], "y double, p double")
    got = df.agg(metrics.pinball("y", "p", 0.1).alias("x")).head().x
    assert got == pytest.approx(2 * np.mean([0.1 * 3, 0.9 * 4]))


def test_quantile_regression_leaves_the_right_share_below(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 3000)
    y = 2 + 3 * x + rng.exponential(4, 3000)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, i int, x double, y double")
    coefs = models.fit_quantile(df, ["g"], ["x"], "y")
    out = models.predict_quantile(df, coefs, ["g"], ["x"])
    shares = out.agg(*[F.avg((F.col("y") < F.col(q)).cast("int")).alias(q) for q in ("q10", "q50", "q90")]).head()
    assert list(shares) == pytest.approx([0.1, 0.5, 0.9], abs=0.02)


def quantile_loss(x, y, q, alpha, level, slope):
    rest = y - level - slope * x
    return np.mean(np.maximum(q * rest, (q - 1) * rest)) + alpha * abs(slope)


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.15, 5.0])
def test_penalised_quantile_regression_equals_the_linear_programme(spark, alpha):
    """The optimum of one feature lies where two points, or one point and slope 0, are met."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=40)
    y = 0.5 * x + rng.normal(size=40)
    sx, sy = x.std(), y.std()
    u, v = (x - x.mean()) / sx, (y - y.mean()) / sy
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")
    got = {r.q: r.beta for r in models.fit_quantile(df, ["g"], ["x"], "y", alpha=alpha, steps=20).collect()}
    for q, (level, slope) in got.items():
        lines = [(v[i] - s * u[i], s) for i in range(40) for s in [0.0, *((v[i] - v[j]) / (u[i] - u[j]) for j in range(i))]]
        best = min(quantile_loss(u, v, q, alpha, *line) for line in lines)
        scaled = ((level + slope * x.mean() - y.mean()) / sy, slope * sx / sy)
        assert quantile_loss(u, v, q, alpha, *scaled) <= best * 1.005 + 1e-6
        if alpha == 5.0:
            assert slope == 0


def test_bags_draw_rows_and_columns(spark):
    rng = np.random.default_rng(22)
    rows = [(i % 2, i, *map(float, rng.normal(size=4))) for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double, c double, y double")
    coefs = models.fit_quantile(df, ["g"], ["a", "b", "c"], "y", bags=6, row_share=0.5, col_share=0.5, row_key=["i"], steps=4)
    found = coefs.collect()
    assert len(found) == 2 * 3 * 6
    used = {(r.g, r.bag): tuple(x != 0 for x in r.beta[1:]) for r in found}
    assert len(set(used.values())) > 1 and all(any(u) for u in used.values())
    assert all(used[0, b] == used[1, b] for b in range(6))
    share = np.mean([models._in_bag(np.arange(20_000), b, 0.3, 1) for b in range(5)])
    assert share == pytest.approx(0.3, abs=0.01)


def test_sampled_coalitions():
    for g, tried in ((3, 1024), (10, 1024), (12, 600), (20, 800)):
        bits, parts = models.coalitions(g, tried)
        assert len(bits) <= tried and len(set(bits.tolist())) == len(bits)
        rng = np.random.default_rng(g)
        single, pair = rng.normal(size=g), np.triu(rng.normal(size=(g, g)), 1)
        z = bits[:, None] >> np.arange(g) & 1
        v = 4 + z @ single + np.einsum("si,ij,sj->s", z, pair, z)
        want = single + (pair.sum(0) + pair.sum(1)) / 2
        assert parts @ v == pytest.approx(want, abs=1e-8)
    # Beyond pairs the sampled values still add up, and the error falls with the root of the draws.
    bits, parts = models.coalitions(14, 4000)
    z = bits[:, None] >> np.arange(14) & 1
    v = np.tanh(z @ np.linspace(-1, 1, 14)) + z[:, 0] * z[:, 1] * z[:, 2]
    got = parts @ v
    assert got.sum() == pytest.approx(v[list(bits).index(2**14 - 1)] - v[list(bits).index(0)])
    all_bits, exact = models.coalitions(14, 2**14)
    z = all_bits[:, None] >> np.arange(14) & 1
    exact = exact @ (np.tanh(z @ np.linspace(-1, 1, 14)) + z[:, 0] * z[:, 1] * z[:, 2])
    assert np.abs(got - exact).max() < 4 / np.sqrt(4000)


def test_shapley_of_many_groups(spark):
    rng = np.random.default_rng(23)
    names = [f"f{i}" for i in range(20)]
    rows = [(1, y, *map(float, rng.normal(size=20))) for y in range(4)]
    df = spark.createDataFrame(rows, "site int, yr int, " + ", ".join(f"{n} double" for n in names))

    def score(frame):
        return frame.withColumn("prediction", sum((F.col(n) * (i + 1) for i, n in enumerate(names)), F.col("f0") * F.col("f1")))

    got = models.group_shapley(df, df, ["site", "yr"], ["site"], {n: [n] for n in names}, score, tried=300).collect()
    x = np.array([r[2:] for r in rows])
    mean, both = x.mean(0), (x[:, 0] * x[:, 1]).mean()
    for r in got:
        i, own = names.index(r.label), x[r.yr]
        want = (i + 1) * (own[i] - mean[i])
        if i < 2:
            j = 1 - i
            want += ((own[i] * mean[j] - both) + (own[0] * own[1] - own[j] * mean[i])) / 2
        assert r.shap == pytest.approx(want, abs=1e-6)


def test_pls_with_all_components_is_least_squares():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=30)
    new = np.array([0.3, 0.1, -1.0])
    design = np.column_stack([np.ones(30), x])
    want = np.r_[1.0, new] @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert models._pls_predict(x, y, new, 3)[2] == pytest.approx(want)


def test_pca_scores_keep_the_variance(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1] + 10
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id int, v array<double>")
    got = models.pca(df, "id", "v", 2).toPandas()
    want = np.linalg.eigvalsh(np.cov(m.T))[::-1][:2]
    assert list(got[["pc1", "pc2"]].var()) == pytest.approx(list(want))
    assert abs(got["pc1"].mean()) < 1e-9


def test_shapley_values_add_up(spark):
    rng = np.random.default_rng(9)
    rows = [(1, y, *map(float, rng.normal(size=3))) for y in range(12)]
    df = spark.createDataFrame(rows, "site int, yr int, a double, b double, c double")

    def score(frame):
        return frame.withColumn("prediction", F.col("a") * F.col("b") + F.col("c"))

    out = models.group_shapley(df, df, ["site", "yr"], ["site"], {"ab": ["a", "b"], "c": ["c"]}, score)
    total = out.groupBy("yr").agg((F.sum("shap") + F.max("expected")).alias("t"))
    truth = {r.yr: r.prediction for r in score(df).collect()}
    assert {r.yr: pytest.approx(r.t) for r in total.collect()} == truth


def test_explain_change_goes_by_issue_date(spark):
    rows = [(1, D(1999, 12, 22), "a", 1.0), (1, D(2000, 1, 1), "a", 3.0), (1, D(2000, 1, 1), "b", 2.0), (1, D(2000, 1, 8), "b", 5.0)]
    df = spark.createDataFrame(rows, "site int, issue date, item string, v double")
    out = explain.explain_change(df, ["site"], "issue", "item", "v")
    assert {(r.issue, r.item): r.change for r in out.collect()} == {(D(2000, 1, 1), "a"): 2.0, (D(2000, 1, 8), "b"): 3.0}


def test_predictions_keep_repeated_rows(spark):
    coefs = spark.createDataFrame([(1, q, 0, [1.0, 2.0 * q]) for q in (0.2, 0.5)], "g int, q double, bag int, beta array<double>")
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 3.0)], "g int, x double")
    out = models.predict_quantile(df, coefs, ["g"], ["x"], probs=(0.2, 0.5)).collect()
    assert sorted((r.g, r.q20, r.q50) for r in out if r.q20 is not None) == [(1, pytest.approx(2.2), 4.0)] * 2
    assert len(out) == 3


def test_pls_predicts_every_row_of_a_held_out_year(spark):
    rng = np.random.default_rng(3)
    rows = [(1, 2000 + i // 2, float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, yr int, a double, b double, y double")
    assert models.fit_pls(df, ["g"], "yr", ["a", "b"], "y").count() == 20


def test_pls_on_one_feature_is_a_straight_line(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=12)
    y = 3 * x + rng.normal(size=12)
    df = spark.createDataFrame([(1, 2000 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, yr int, a double, y double")
    got = {r.fold: r.q50 for r in models.fit_pls(df, ["g"], "yr", ["a"], "y").collect()}
    for i in range(12):
        keep = np.arange(12) != i
        assert got[2000 + i] == pytest.approx(np.polyval(np.polyfit(x[keep], y[keep], 1), x[i]))


def test_rows_without_history_stay(spark):
    pred = spark.createDataFrame([(1, 5.0, 7.0, 9.0), (2, 5.0, 7.0, 9.0)], "site int, q10 double, q50 double, q90 double")
    bounds = spark.createDataFrame([(1, 6.0, 8.0)], "site int, lo double, hi double")
    for fn in (pp.clip_history, lambda *a: pp.floor_history(*a, "q50")):
        assert {r.site for r in fn(pred, bounds, ["site"]).collect()} == {1, 2}
    past = spark.createDataFrame([(1, float(v)) for v in (4, 5, 7, 9, 12)], "site int, y double")
    fitted = pp.best_dist(past, ["site"], "y").drop("nll")
    out = {r.site: r for r in pp.dist_quantiles(pred, fitted, ["site"]).collect()}
    assert out[2].q10 == 5.0 and out[2].q90 == 9.0 and out[1].q10 < out[1].q50 < out[1].q90


def test_rerank_takes_any_number_of_members(spark):
    for n in (1, 2, 7):
        df = spark.createDataFrame([(1, m, float(m), float(m), float(m)) for m in range(n)], "k int, member int, q10 double, q50 double, q90 double")
        r = pp.rerank_members(df, ["k"], "member").head()
        near = min(1, n - 1)
        want = 0.0 if n == 1 else 0.8 * near
        assert r.q10 == pytest.approx(want) and r.q90 == pytest.approx(n - 1 - want)


def test_normal_functions_undo_each_other(spark):
    df = spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.99999)], "p double")
    out = df.select("p", pp.normal_cdf(pp.normal_inverse(F.col("p"))).alias("q")).collect()
    assert all(r.q == pytest.approx(r.p, abs=3e-7) for r in out)


def test_roll_mean_restarts_per_year(spark):
    df = spark.createDataFrame([(1, 2000, 1, 2.0), (1, 2000, 2, 4.0), (1, 2001, 3, 8.0)], "s int, fy int, d int, v double")
    got = [r.v_2 for r in roll_mean(df, ["s", "fy"], "d", "v", [2]).orderBy("d").collect()]
    assert got == [2.0, 3.0, 8.0]


def test_correlation_of_a_constant_is_null(spark):
    from freshet.functions.scalars import line, pearson

    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 5.0), (1, None, 9.0)], "g int, x double, y double")
    slope, _ = line("y", "x")
    row = df.groupBy("g").agg(pearson("x", "y").alias("r"), slope.alias("b")).head()
    assert (row.r, row.b) == (None, None)
    skipped = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "x double, y double")
    assert skipped.agg(pearson("x", "y").alias("r")).head().r == pytest.approx(1.0)


def test_trees_beat_the_climatology(spark):
    rng = np.random.default_rng(8)
    rows = [(1, y, 4, float(x), float(5 * x + rng.normal(0, 0.3))) for y in (2000, 2001, 2002) for x in rng.uniform(0, 10, 40)]
    df = spark.createDataFrame(rows, "site int, yr int, m int, x double, y double")
    out = models.fit_gbt(df, ["x"], "y", "yr", [2000, 2001, 2002, 2003], ["m"], max_iter=5)
    r = out.agg(F.avg(F.abs(F.col("y") - F.col("q50"))).alias("err"), F.count("*").alias("n"),
                F.avg(F.col("y").between(F.col("q10"), F.col("q90")).cast("int")).alias("inside")).head()
    ys = np.array([row[4] for row in rows])
    assert r.n == 120 and r.err < 0.3 * np.abs(ys - np.median(ys)).mean() and 0.7 <= r.inside <= 0.95


def nll_of(family, x, loc, scale):
    logs = np.log(x) if family in ("loglogistic", "lognormal") else x
    z = (logs - loc) / scale
    plain = {"gumbel": z + np.exp(-z), "lognormal": z * z / 2 + np.log(2 * np.pi) / 2, "uniform": 0 * z}.get(family, z + 2 * np.log1p(np.exp(-z)))
    return float((plain + np.log(scale) + (np.log(x) if logs is not x else 0)).sum())


def test_likelihood_fits_are_the_best_of_their_family(spark):
    rng = np.random.default_rng(5)
    data = {1: rng.gamma(4, 100, 40), 2: rng.lognormal(3, 1.5, 25), 3: rng.normal(0, 1, 30), 4: np.r_[rng.gumbel(50, 5, 60), 900.0], 5: np.array([3.0, 8.0])}
    rows = [(k, float(v)) for k, xs in data.items() for v in xs] + [(6, 7.0), (7, 1.0), (7, 1.0), (1, None), (None, 1.0), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "site int, y double")
    fits = likelihood.fit_likelihood(df, ["site"], "y").collect()
    assert {r.site for r in fits} == {1, 2, 3, 4, 5, None}
    assert {r.family for r in fits if r.site == 3} == {"logistic", "gumbel", "uniform"}
    for r in fits:
        x = data.get(r.site, np.array([1.0, 2.0, 4.0]))
        assert r.nll == pytest.approx(nll_of(r.family, x, r["loc"], r.scale), rel=1e-9, abs=1e-9)
        if r.family == "uniform":
            continue
        for by in (1e-3, 1e-2, 0.1, 1.0):  # one valley: no point around is lower
            for turn in np.linspace(0, 2 * np.pi, 8, endpoint=False):
                other = nll_of(r.family, x, r["loc"] + by * r.scale * np.cos(turn), r.scale * np.exp(by * np.sin(turn)))
                assert r.nll <= other + 1e-9
    best = {r.site: r for r in likelihood.best_likelihood(df, ["site"], "y").collect()}
    for site, r in best.items():
        least = min((f for f in fits if f.site == site), key=lambda f: f.nll)
        assert r.family == least.family and r.nll == pytest.approx(least.nll, rel=1e-12)
    moments = {r.site: r.nll for r in pp.best_dist(df.where("site IN (1, 2, 4)"), ["site"], "y").collect()}
    assert all(best[s].nll <= nll + 1e-9 for s, nll in moments.items())
    assert likelihood.fit_likelihood(df.limit(0), ["site"], "y").count() == 0
