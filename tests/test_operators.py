import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import aggregates, asof, fill, frames, joins, quality, quantiles, spatial, windows

D = dt.date


def obs_frame(spark, rows):
    return spark.createDataFrame(rows, "site int, d date, v double")


def issues_frame(spark, days):
    return spark.createDataFrame([(1, x) for x in days], "site int, issue_date date")


def latest(spark, obs, days, **kw):
    out = asof.asof_latest(obs_frame(spark, obs), issues_frame(spark, days), ["site"], "d", ["v"], "issue_date", **kw)
    return {r.issue_date: r.v for r in out.collect()}


def test_asof_hides_the_issue_day(spark):
    obs = [(1, D(2000, 1, 7), 1.0), (1, D(2000, 1, 8), 2.0)]
    assert latest(spark, obs, [D(2000, 1, 8)]) == {D(2000, 1, 8): 1.0}
    assert latest(spark, obs, [D(2000, 1, 8)], strict=False) == {D(2000, 1, 8): 2.0}


def test_asof_resets_on_first_october(spark):
    obs = [(1, D(1999, 9, 30), 1.0)]
    assert latest(spark, obs, [D(1999, 10, 8)]) == {D(1999, 10, 8): None}
    assert latest(spark, obs, [D(1999, 10, 8)], start_month=None) == {D(1999, 10, 8): 1.0}


def test_asof_skips_null_and_applies_lag(spark):
    obs = [(1, D(2000, 1, 1), 1.0), (1, D(2000, 1, 4), None), (1, D(2000, 1, 5), 3.0)]
    got = latest(spark, obs, [D(2000, 1, 8)], lag_days=5, strict=False)
    assert got == {D(2000, 1, 8): 1.0}


def test_no_feature_sees_its_issue_day_or_later(spark):
    rng = random.Random(4)
    obs = [(1, D(2000, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(200) if rng.random() < 0.6]
    days = [D(2000, m, k) for m in range(1, 8) for k in (1, 8, 15, 22)]
    out = asof.asof_latest(
        obs_frame(spark, obs), issues_frame(spark, days), ["site"], "d", ["v"], "issue_date", out_date="seen"
    ).collect()
    assert all(r.seen is None or r.seen < r.issue_date for r in out)
    assert len(out) == len(days)


def test_bucket_latest_leaves_an_empty_bucket_null(spark):
    obs = obs_frame(spark, [(1, D(2000, 1, 2), 5.0)])
    out = asof.bucket_latest(obs, issues_frame(spark, [D(2000, 1, 8), D(2000, 1, 15)]), ["site"], "d", "v", "issue_date")
    assert {r.issue_date: r.bucket_value for r in out.collect()} == {D(2000, 1, 8): 5.0, D(2000, 1, 15): None}


def test_agg_since_keeps_september_out_of_the_next_water_year(spark):
    obs = obs_frame(spark, [(1, D(1999, 9, 28), 100.0), (1, D(1999, 10, 2), 1.0), (1, D(2000, 1, 3), 2.0)])
    out = asof.agg_since(obs, issues_frame(spark, [D(2000, 1, 1), D(2000, 1, 8)]), ["site"], "d", "v", "issue_date", 10)
    assert {r.issue_date: r.v_sum for r in out.collect()} == {D(2000, 1, 1): 1.0, D(2000, 1, 8): 3.0}


def test_trailing_mean_zero_is_the_season(spark):
    obs = obs_frame(spark, [(1, D(2000, 1, k), float(k)) for k in range(1, 8)])
    row = asof.trailing_mean(obs, issues_frame(spark, [D(2000, 1, 8)]), ["site"], "d", "v", "issue_date", [2, 0]).head()
    assert (row.v_2, row.v_0) == (6.5, 4.0)


def test_ffill_limit_counts_rows(spark):
    obs = obs_frame(spark, [(1, D(2000, 1, k), 1.0 if k == 1 else None) for k in range(1, 6)])
    got = [r.v for r in fill.ffill(obs, ["site"], "d", ["v"], limit=2).orderBy("d").collect()]
    assert got == [1.0, 1.0, 1.0, None, None]


def test_interpolation_limit_and_floor(spark):
    values = [0.0, None, None, None, 8.0, None]
    obs = obs_frame(spark, [(1, D(2000, 1, k + 1), v) for k, v in enumerate(values)])
    got = [r.v for r in fill.interpolate_linear(obs, ["site"], "d", "v", limit=2).orderBy("d").collect()]
    assert got == [0.0, 2.0, 4.0, None, 8.0, None]


def test_quadratic_interpolation_follows_a_parabola(spark):
    values = [float((k - 1) ** 2) if k not in (2, 4) else None for k in range(7)]
    obs = obs_frame(spark, [(1, D(2000, 1, k + 1), v) for k, v in enumerate(values)])
    got = [r.v for r in fill.interpolate(obs, ["site"], "d", "v").orderBy("d").collect()]
    assert got == pytest.approx([float((k - 1) ** 2) for k in range(7)])


def test_clim_impute_keeps_the_anomaly(spark):
    rows = [(1, D(y, 6, k), float(10 * k)) for y in (1999, 2000, 2001) for k in (1, 2, 3)]
    rows += [(1, D(2002, 6, 1), 13.0), (1, D(2002, 6, 2), None), (1, D(2002, 6, 3), None)]
    got = fill.clim_impute(obs_frame(spark, rows), ["site"], "d", "v").where("d >= '2002-01-01'").orderBy("d").collect()
    assert [r.v for r in got] == [13.0, 23.0, 33.0]


def test_expand_dates_to_a_given_end(spark):
    obs = obs_frame(spark, [(1, D(2000, 2, 27), 1.0)])
    out = frames.expand_dates(obs, ["site"], "d", end=F.make_date(F.year("last"), F.lit(3), F.lit(1)))
    assert [(r.d, r.v) for r in out.orderBy("d").collect()] == [
        (D(2000, 2, 27), 1.0), (D(2000, 2, 28), None), (D(2000, 2, 29), None), (D(2000, 3, 1), None)
    ]


def test_spread_quantiles_on_a_hot_group_with_ties_and_signs(spark):
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.normal(0, 1e-6, 3000), rng.lognormal(3, 3, 3000), -rng.lognormal(1, 2, 2000), np.zeros(500)])
    small = rng.integers(0, 5, 101).astype(float)
    rows = [("hot", float(x)) for x in hot] + [("small", float(x)) for x in small] + [("hot", None), (None, 4.0)]
    probs = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: list(r)[1:] for r in quantiles.spread_quantiles(df, ["g"], "v", probs, list("abcdef")).collect()}
    for key, values in (("hot", hot), ("small", small)):
        assert got[key] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-18)
    assert got[None] == [4.0] * 6
    whole = quantiles.spread_quantiles(df, [], "v", [0.5], ["m"]).head().m
    assert whole == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]))


def test_dedup_keeps_the_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, x string")
    assert {(r.k, r.x) for r in quality.dedup(df, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}
    assert {(r.k, r.x) for r in quality.dedup(df, ["k"], ["t"], "first").collect()} == {(1, "a"), (2, "c")}


def test_column_screen_finds_copies(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, None), (2.0, 2.0, 0.0, 1.0)], "a double, b double, z double, n double")
    got = {r.name: (r.is_copy, r.keep) for r in quality.column_screen(df, ["a", "b", "z", "n"], max_null=0.6).collect()}
    assert got == {"a": (False, True), "b": (True, False), "z": (False, False), "n": (False, True)}


def test_all_pairs_give_the_same_rows_however_spread(spark):
    a, b = spark.range(7).toDF("x"), spark.range(11).toDF("y")
    small = joins.all_pairs(a, b).select("x", "y")
    large = joins.all_pairs(a, b, spread=4).select("x", "y")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert large.count() == 77


def test_nearest_equals_brute_force_over_the_globe(spark):
    rng = np.random.default_rng(2)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-89, 89, 40), rng.uniform(-180, 180, 40)))]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300)))]
    b += [(1000 + i, 45.0 + i * 1e-3, 7.0) for i in range(150)]  # a hot cell
    fa = spark.createDataFrame(a, "site int, lat double, lon double")
    fb = spark.createDataFrame(b, "station int, lat double, lon double")
    got = {(r.site, r.station): r.rnk for r in spatial.nearest(fa, fb, "site", "station", 6, 1500.0).collect()}

    def km(p, q):
        la, lb = np.radians(p[1]), np.radians(q[1])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(h)))

    want = {}
    for p in a:
        ranked = sorted((km(p, q), q[0]) for q in b)
        for k, (dist, sid) in enumerate(ranked, 1):
            if k <= 6 or dist <= 1500.0:
                want[(p[0], sid)] = k
    assert got == want


def test_nearest_at_poles_date_line_and_hot_places(spark):
    rng = np.random.default_rng(7)
    spots = [(89.9, 10.0), (-89.99, -170.0), (90.0, 0.0), (0.0, 180.0), (0.0, -179.999), (12.0, 179.9), (45.0, 7.0), (45.0, 7.0)]
    a = [(i, *p) for i, p in enumerate(spots)]
    b = [(i, float(89 + rng.uniform(0, 1)), float(rng.uniform(-180, 180))) for i in range(60)]
    b += [(100 + i, float(-89 - rng.uniform(0, 1)), float(rng.uniform(-180, 180))) for i in range(60)]
    b += [(200 + i, float(rng.uniform(-5, 15)), float((179 + rng.uniform(0, 2) + 180) % 360 - 180)) for i in range(80)]
    b += [(300 + i, 45.0, 7.0) for i in range(400)] + [(900, None, 1.0)]
    fa = spark.createDataFrame(a, "site int, lat double, lon double")
    fb = spark.createDataFrame(b, "station int, lat double, lon double")

    def km(p, q):
        la, lb = np.radians(p[1]), np.radians(q[1])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(h)))

    ranked = {p[0]: sorted((round(km(p, q), 6), q[0]) for q in b if q[1] is not None) for p in a}
    for finest in (3, 14):
        got = {}
        for r in spatial.nearest(fa, fb, "site", "station", 7, finest=finest).collect():
            got.setdefault(r.site, {})[r.rnk] = r.station
        assert got == {s: {n: q for n, (_, q) in enumerate(rows[:7], 1)} for s, rows in ranked.items()}
    few = spatial.nearest(fa, fb.where("station < 3"), "site", "station", 5).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in few} == {p[0]: 3 for p in a}


def test_nearest_value_on_an_axis(spark):
    rng = np.random.default_rng(8)
    axis = sorted({float(x) for x in rng.uniform(0, 100, 500).round(1)} | {50.0, 51.0})
    xs = [*(float(x) for x in rng.uniform(-20, 120, 800).round(2)), 50.5, 50.0, None] + [7.25] * 50
    points = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, v double")
    grid = spark.createDataFrame([(a,) for a in axis] * 2, "v double")
    got = {r.i: r.at for r in spatial.nearest_value(points, grid, "v", "at").collect()}
    assert got == {i: None if x is None else min(axis, key=lambda a: (abs(a - x), a)) for i, x in enumerate(xs)}
    assert spatial.nearest_value(points, grid.limit(0), "v", "at").where("at is not null").count() == 0


def test_spread_join_splits_a_hot_code(spark):
    sites = spark.range(900).selectExpr("id AS site", "if(id % 3 = 0, '1701', concat(1000 + id, '')) AS huc")
    stations = spark.range(700).selectExpr("id AS station", "if(id % 3 = 0, '1701', concat(1000 + id % 50, '')) AS huc")
    got = joins.huc_join(sites, stations, 4)
    a, b = sites.toPandas(), stations.toPandas()
    want = a.merge(b, on="huc")
    assert sorted((r.site, r.station, r.huc4) for r in got.collect()) == sorted(want[["site", "station", "huc"]].itertuples(index=False, name=None))
    both = joins.spread_join(sites.withColumnRenamed("huc", "k"), stations.withColumnRenamed("huc", "k"), "k")
    assert both.count() == len(want) and both.columns == ["k", "site", "station"]


def test_quantile_parts_stay_small_beside_an_outlier(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([1e9 + rng.uniform(0, 1, 200_000), [1.004e9]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = quantiles.spread_quantiles(df, [], "v", [0.1, 0.5, 0.999], ["a", "b", "c"]).head()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.999])), rel=1e-15)
    key = quantiles._ordered(F.col("v"))
    parts = df.distinct().groupBy(F.shiftright(key, 16).alias("part")).count()
    assert parts.agg(F.max("count")).head()[0] < 10_000
    ranks = quantiles.spread_ranks(df, [], "v", "r").toPandas().sort_values("_v")
    assert (ranks["r"].to_numpy() == pd.Series(values).rank().groupby(values).first().to_numpy()).all()


def test_ordered_numbers_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(10)
    edges = [0.0, 5e-324, 2.0**-1022, 2.0**-1021, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 2.0**52, 1.7976931348623157e308, np.inf]
    powers = [f(2.0**e, d) for e in range(-1070, 1023, 97) for f in (np.nextafter,) for d in (0, np.inf)]
    values = sorted({float(s * x) for x in [*edges, *powers, *rng.lognormal(0, 200, 500)] for s in (-1, 1)})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, v double")
    keys = [r.k for r in df.select("i", quantiles._ordered(F.col("v")).alias("k")).orderBy("i").collect()]
    assert all(a < b for a, b in zip(keys, keys[1:]))


def test_running_quantiles_of_raw_rows_of_a_hot_key(spark):
    rng = np.random.default_rng(11)
    days = rng.integers(0, 60, 30_000)
    values = rng.normal(0, 1, 30_000).round(3)
    frame = pd.DataFrame({"site": 1, "d": [dt.date(2000, 1, 1) + dt.timedelta(int(x)) for x in days], "v": values})
    issues = issues_frame(spark, [D(2000, 1, 1), D(2000, 1, 15), D(2000, 2, 20), D(2000, 5, 1)])
    out = asof.agg_since(spark.createDataFrame(frame), issues, ["site"], "d", "v", "issue_date", 10, aggs=("p10", "count", "p50", "p99"))
    for r in out.where("site = 1").collect():
        seen = frame.v[frame.d < r.issue_date]
        assert r.v_count == len(seen)
        want = [None] * 3 if not len(seen) else list(np.quantile(seen, [0.1, 0.5, 0.99]))
        assert [r.v_p10, r.v_p50, r.v_p99] == (want if want[0] is None else pytest.approx(want))


def test_long_exponential_means(spark):
    rng = np.random.default_rng(12)
    x = pd.Series(rng.normal(5, 2, 6000)).where(rng.uniform(size=6000) > 0.3)
    x[:3], x[2000:3900] = np.nan, np.nan
    df = spark.createDataFrame([(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    for span in (1, 2, 6, 400):
        got = [r[-1] for r in windows.ewm(df, ["k"], "i", "v", span).orderBy("i").collect()]
        want = x.ewm(span=span, adjust=False, min_periods=span).mean()
        assert [g is None for g in got] == list(want.isna())
        assert np.allclose([g for g in got if g is not None], want.dropna(), rtol=1e-12)


def test_point_in_polygon_with_hole_and_buffer(spark):
    def ring(*pts):
        return [{"x": float(x), "y": float(y)} for x, y in pts]

    outer, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))
    poly = spark.createDataFrame([(1, [outer, hole])], "site int, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame(
        [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.5, -0.05), (4, 9.0, 9.0)], "p int, lat double, lon double"
    )
    assert {r.p for r in spatial.within_join(pts, poly).collect()} == {1}
    near = {r.p: r.in_basin for r in spatial.within_join(pts, poly, buffer_km=10.0).collect()}
    assert near == {1: True, 3: False}


def test_ewm_recursion(spark):
    xs = [1.0, 2.0, 4.0, 8.0]
    obs = obs_frame(spark, [(1, D(2000, 1, k + 1), x) for k, x in enumerate(xs)])
    got = [r.v_ewm3 for r in windows.ewm(obs, ["site"], "d", "v", 3).orderBy("d").collect()]
    assert got == [None, None, pytest.approx(2.75), pytest.approx(5.375)]


def test_diffs_blank_the_whole_row(spark):
    obs = obs_frame(spark, [(1, D(2000, 1, k), float(k)) for k in range(1, 5)])
    got = [(r.v_diff1, r.v_diff2) for r in windows.diffs(obs, ["site"], "d", ["v"], [1, 2]).orderBy("d").collect()]
    assert got == [(None, None), (None, None), (1.0, 2.0), (1.0, 2.0)]


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("g"), "id")
    out = windows.top_k(df, ["g"], F.col("id").desc(), [], 2)
    assert out.count() == 6
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_gauss_smooth_wraps_and_ignores_gaps(spark):
    rows = [(1, k, 1.0) for k in range(1, 367) if k not in (3, 4)]
    out = windows.gauss_smooth(spark.createDataFrame(rows, "site int, doy int, v double"), ["site"], "doy", "v", 3.0)
    assert all(r.smooth == pytest.approx(1.0) for r in out.collect())


def test_factorize_is_sorted_and_dense(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "s string")
    assert {r.s: r.code for r in aggregates.factorize(df, "s").collect()} == {"a": 0, "b": 1, "c": 2}


def test_daily_reduce_bounds_a_hot_key(spark):
    raw = spark.range(50_000).select(
        F.lit(1).alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("t"), F.lit(1.0).alias("x")
    )
    out = frames.daily_reduce(raw, ["k"], "t", "x")
    assert {r.v for r in out.collect()} == {5000.0}
    assert out.count() == 10


def test_spread_ranks_of_ties_and_signs(spark):
    values = [-3.0, -3.0, 0.0, 1e-9, 5.0, 5.0, 5.0, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r._v: r.rk for r in quantiles.spread_ranks(df, [], "v", "rk").collect()}
    assert got == {-3.0: 1.5, 0.0: 3.0, 1e-9: 4.0, 5.0: 6.0, 1e12: 8.0}


def test_aggregates_at_any_issue_date(spark):
    obs = [(1, D(2000, 1, k), v) for k, v in ((1, 1.0), (2, 10.0), (3, 100.0))]
    issues = issues_frame(spark, [D(2000, 1, 4), D(2000, 1, 2)])
    out = asof.agg_since(obs_frame(spark, obs), issues, ["site"], "d", "v", "issue_date", 10, aggs=("sum", "count", "p50", "std"))
    got = {r.issue_date: r for r in out.collect()}
    assert (got[D(2000, 1, 4)].v_sum, got[D(2000, 1, 4)].v_p50) == (111.0, 10.0)
    assert got[D(2000, 1, 4)].v_std == pytest.approx(statistics.stdev([1, 10, 100]))
    assert (got[D(2000, 1, 2)].v_sum, got[D(2000, 1, 2)].v_count) == (1.0, 1)


def test_lagged_readings_stay_in_their_water_year(spark):
    assert latest(spark, [(1, D(2000, 9, 28), 4.0)], [D(2000, 10, 8)], lag_days=5)[D(2000, 10, 8)] is None


def test_last_reading_of_a_day(spark):
    rows = [(1, dt.datetime(2000, 1, 1, 1), 9.0), (1, dt.datetime(2000, 1, 1, 5), 3.0), (1, dt.datetime(2000, 1, 1, 7), None)]
    df = spark.createDataFrame(rows, "k int, t timestamp, x double")
    assert frames.daily_reduce(df, ["k"], "t", "x", "last").head().v == 3.0


def test_months_keep_readings_inside_them(spark):
    df = spark.createDataFrame([(1, D(2000, 1, 15), 5.0), (1, D(2000, 3, 1), 6.0)], "k int, d date, v double")
    got = {r.d: r.v for r in frames.expand_dates(df, ["k"], "d", freq="month").collect()}
    assert got == {D(2000, 1, 1): 5.0, D(2000, 2, 1): None, D(2000, 3, 1): 6.0}


def test_quantiles_of_close_values_and_of_odd_ones(spark):
    df = spark.range(200_000).select((F.lit(1e9) + F.col("id") / 2000.0).alias("v"))
    got = quantiles.spread_quantiles(df, [], "v", [0.25, 0.5], ["a", "b"]).head()
    assert (got.a, got.b) == (pytest.approx(1e9 + 199_999 * 0.25 / 2000), pytest.approx(1e9 + 199_999 * 0.5 / 2000))
    near = df.select(quantiles._range_bucket(F.col("v"), F.lit(1e9), F.lit(1e9 + 100)).alias("b")).groupBy("b").count()
    assert near.agg(F.max("count")).head()[0] <= 8
    odd = spark.createDataFrame([(float(v),) for v in ("nan", "inf", "-inf", 1, 2, 2)] + [(None,)], "v double")
    got = quantiles.spread_quantiles(odd, [], "v", [0.0, 0.5, 1.0], ["a", "b", "c"]).head()
    assert (got.a, got.b, got.c) == (float("-inf"), 2.0, float("inf"))
    ranks = {r._v: r.r for r in quantiles.spread_ranks(odd, [], "v", "r").collect()}
    assert ranks == {float("-inf"): 1.0, 1.0: 2.0, 2.0: 3.5, float("inf"): 5.0}


def test_exponential_mean_with_nulls(spark):
    values = [1.0, None, 3.0, None, None, 2.0, 8.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    got = [r.v_ewm2 for r in windows.ewm(df, ["k"], "i", "v", 2).orderBy("i").collect()]
    want = pd.Series(values, dtype=float).ewm(span=2, adjust=False, min_periods=2).mean()
    assert [x is None for x in got] == list(want.isna())
    assert [x for x in got if x is not None] == pytest.approx(want.dropna().tolist())


def test_spline_returns_a_parabola_and_meets_its_points():
    x = np.array([0.0, 1.0, 4.0, 5.0, 9.0, 10.0, 11.0])
    at = np.linspace(0, 11, 45)
    assert fill._spline(x, x**2 - 3 * x, at) == pytest.approx(at**2 - 3 * at)
    y = np.array([1.0, 5.0, 2.0, 2.0, 8.0, 0.0, 3.0])
    assert fill._spline(x, y, x) == pytest.approx(y)
    big = np.arange(5000.0)
    assert fill._spline(big, np.sin(big / 50), big + 0.0) == pytest.approx(np.sin(big / 50))
