"""Queries for baselines, blends and calibration."""

from pyspark.sql import functions as F

from freshet.catalog.domain import KAF
from freshet.catalog.registry import query
from freshet.plans import folds, likelihood, postprocess as pp

KEYS = ["site", "issue_date"]
Q3 = "q10 num, q50 num, q90 num"


@query(
    "k1_baseline_quantiles",
    f"site int, yr int, m int, {Q3}",
    """SELECT f.site, f.yr, f.m, q10, q50, q90 FROM flow_month f LEFT JOIN (
      SELECT site, m, quantile_cont(vol, 0.1) AS q10, quantile_cont(vol, 0.5) AS q50, quantile_cont(vol, 0.9) AS q90
      FROM flow_month WHERE yr BETWEEN 1995 AND 1999 GROUP BY 1, 2) b ON f.site = b.site AND f.m = b.m WHERE f.yr >= 2000""",
)
def _(d):
    targets = d.flow_month.where("yr >= 2000").select("site", "yr", "m")
    return pp.baseline_quantiles(d.flow_month, targets, ["site", "m"], "vol", (1995, 1999))


def month_model(d):
    """Mean of the members of the issue month, absent below four members."""
    means = d.members.groupBy("site", "yr", "m").agg(
        *[F.avg(q).alias(q) for q in pp.Q], F.count(F.lit(1)).alias("_n")
    )
    return means.where(F.col("_n") >= 4).drop("_n")


_MONTH_MODEL = """SELECT site, yr, m, avg(q10) AS q10, avg(q50) AS q50, avg(q90) AS q90 FROM members
GROUP BY 1, 2, 3 HAVING count(*) >= 4"""


def _mix(q: str) -> str:
    share = "[" + ", ".join(f"{x}::DOUBLE" for x in pp.MONTH_SHARE[q]) + "]"
    return f"coalesce((1 - ({share})[p.m]) * p.{q} + ({share})[p.m] * mm.{q}, p.{q}) AS {q}"


@query(
    "k2_blend_month_year",
    f"site int, issue_date iso, {Q3}",
    f"""SELECT p.site, p.issue_date, {_mix('q10')}, {_mix('q50')}, {_mix('q90')} FROM pred p
    LEFT JOIN ({_MONTH_MODEL}) mm ON p.site = mm.site AND p.yr = mm.yr AND p.m = mm.m""",
)
def _(d):
    return pp.blend_month_year(month_model(d), d.pred, ["site", "yr", "m"], "m")


_K3 = ", ".join(
    f"coalesce(sum(CASE WHEN f.m < g.m AND o.vol IS NOT NULL THEN o.vol ELSE f.{q} END), 0) AS {q}" for q in pp.Q
)


@query(
    "k3_season_from_months",
    f"site int, issue_date iso, {Q3}",
    f"""SELECT g.site, g.issue_date, {_K3} FROM issue_grid g
    JOIN ({_MONTH_MODEL}) f ON g.site = f.site AND g.yr = f.yr
    LEFT JOIN (SELECT * FROM flow_month WHERE yr < 2001) o ON o.site = f.site AND o.yr = f.yr AND o.m = f.m
    WHERE f.m BETWEEN season_start AND season_end GROUP BY 1, 2""",
)
def _(d):
    observed = d.flow_month.where("yr < 2001").select(
        "site", "yr", F.col("m").alias("pm"), F.col("vol").alias("obs")
    )
    rows = (
        d.issue_grid.join(month_model(d).withColumnRenamed("m", "pm"), ["site", "yr"])
        .where(F.col("pm").between(F.col("season_start"), F.col("season_end")))
        .join(observed, ["site", "yr", "pm"], "left")
    )
    return pp.season_from_months(rows, KEYS, "m", "pm", "obs")


@query(
    "k4_last_month_residual",
    "site int, yr int, m int, vol num",
    """WITH f AS (SELECT f.*, season_start, season_end FROM flow_month f JOIN site_meta s ON f.site = s.site),
    p AS (SELECT site, m, quantile_cont(vol, 0.1) AS p10 FROM f GROUP BY 1, 2),
    k AS (SELECT site, yr, coalesce(sum(CASE WHEN m BETWEEN season_start AND season_end - 1 THEN vol END), 0) AS known FROM f GROUP BY 1, 2),
    v AS (SELECT f.site, f.yr, f.m, p10, CASE WHEN f.m = season_end THEN y.vol * 0.75::DOUBLE - known ELSE f.vol END AS vol
      FROM f JOIN k ON f.site = k.site AND f.yr = k.yr JOIN p ON f.site = p.site AND f.m = p.m
      LEFT JOIN site_year y ON f.site = y.site AND f.yr = y.yr)
    SELECT site, yr, m, CASE WHEN vol < 0 THEN p10 ELSE vol END AS vol FROM v""",
)
def _(d):
    monthly = d.flow_month.join(d.site_meta.select("site", "season_start", "season_end"), "site")
    labels = d.site_year.withColumn("vol", F.col("vol") * 0.75)
    return pp.last_month_residual(monthly, labels)


@query(
    "k5_family_blend",
    f"site int, yr int, m int, dd int, {Q3}",
    """SELECT p.site, p.yr, p.m, p.dd, 0.6::DOUBLE * b.q10 + 0.4::DOUBLE * p.q10 AS q10, 0.6::DOUBLE * b.q50 + 0.4::DOUBLE * p.q50 AS q50,
    (1 - 0.7::DOUBLE) * b.q90 + 0.7::DOUBLE * p.q90 AS q90 FROM pred p
    JOIN (SELECT site, issue_date, q10 * 0.9::DOUBLE AS q10, q50, q90 * 1.1::DOUBLE AS q90 FROM pred) b
      ON p.site = b.site AND p.issue_date = b.issue_date""",
)
def _(d):
    other = d.pred.withColumns({"q10": F.col("q10") * 0.9, "q90": F.col("q90") * 1.1})
    return pp.weighted_blend(d.pred, other, KEYS)


@query(
    "k6_ensemble_mean",
    f"site int, issue_date iso, {Q3}, n_members big",
    """SELECT site, issue_date, avg(q10) AS q10, avg(q50) AS q50, avg(q90) AS q90, count(*) AS n_members
    FROM members GROUP BY 1, 2""",
)
def _(d):
    return pp.ensemble_mean(d.members, KEYS)


@query(
    "k6_ensemble_quantile",
    f"site int, issue_date iso, {Q3}",
    """SELECT site, issue_date, quantile_cont(q10, 0.1) AS q10, avg(q50) AS q50, quantile_cont(q90, 0.9) AS q90
    FROM members GROUP BY 1, 2""",
)
def _(d):
    return pp.ensemble_quantile(d.members, KEYS)


@query(
    "k6_ensemble_median",
    f"site int, issue_date iso, {Q3}",
    """SELECT site, issue_date, greatest(0, median(q10 - 300)) AS q10, greatest(0, median(q50)) AS q50,
    greatest(0, median(q90)) AS q90 FROM members GROUP BY 1, 2""",
)
def _(d):
    return pp.ensemble_median(d.members.withColumn("q10", F.col("q10") - 300), KEYS)


@query(
    "k7_ensemble_by_site",
    f"site int, issue_date iso, {Q3}, n_members big",
    """SELECT site, issue_date, avg(q10) AS q10, avg(q50) AS q50, avg(q90) AS q90, count(*) AS n_members FROM members
    WHERE site NOT IN (1, 4, 9) OR substr(member, 1, 1) <= '2' GROUP BY 1, 2""",
)
def _(d):
    # Two members for three sites, all for the rest.
    some = F.col("site").isin(1, 4, 9)
    listed = d.members.select("site", "member").distinct()
    routes = listed.where(~some | (F.substring("member", 1, 1) <= "2"))
    return pp.ensemble_by_site(d.members, KEYS, routes, ["site", "member"])


_MEMBER_LINES = """SELECT s_nationkey AS site, year(l_shipdate) AS yr, l_linenumber AS member,
  list_sort([min(l_extendedprice), round(sum(l_extendedprice), 2) / count(*) * 4.0, max(l_extendedprice)]) AS l
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3"""


@query(
    "k8_rerank_members",
    f"site int, yr int, {Q3}",
    f"""SELECT site, yr, sum(q10 * w10) / sum(w10) AS q10, avg(q50) AS q50, sum(q90 * w90) / sum(w90) AS q90 FROM (
      SELECT *, CASE r10 WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 0.8::DOUBLE END AS w10,
        CASE r90 WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 0.8::DOUBLE END AS w90 FROM (
      SELECT site, yr, l[1] * {KAF}::DOUBLE AS q10, l[2] * {KAF}::DOUBLE AS q50, l[3] * {KAF}::DOUBLE AS q90,
        row_number() OVER (PARTITION BY site, yr ORDER BY l[1], member) AS r10,
        row_number() OVER (PARTITION BY site, yr ORDER BY l[3] DESC, member DESC) AS r90 FROM ({_MEMBER_LINES}))) GROUP BY 1, 2""",
)
def _(d):
    # Seven members (line numbers), fewer in some site-years.
    price = F.col("l_extendedprice")
    rows = (
        d.table("lineitem")
        .groupBy(
            F.col("l_suppkey").cast("int").alias("station"),
            F.year("l_shipdate").alias("yr"),
            F.col("l_linenumber").alias("member"),
        )
        .agg(F.min(price).alias("lo"), F.round(F.sum(price), 2).alias("s"), F.count(price).alias("n"), F.max(price).alias("hi"))
        .join(d.station_meta.select("station", "site"), "station")
        .groupBy("site", "yr", "member")
        .agg(
            (F.min("lo") * KAF).alias("q10"),
            (F.round(F.sum("s"), 2) / F.sum("n") * 4.0 * KAF).alias("q50"),
            (F.max("hi") * KAF).alias("q90"),
        )
    )
    return pp.rerank_members(rows, ["site", "yr"], "member")


@query(
    "k9_conformal",
    "site int, issue_date iso, q10 num, q90 num",
    """SELECT p.site, p.issue_date, p.q10 - coalesce(lo, 0) AS q10, p.q90 + coalesce(hi, 0) AS q90 FROM pred p LEFT JOIN (
      SELECT site, md_id, quantile_cont(q10 - y, 0.9) AS lo, quantile_cont(y - q90, 0.9) AS hi FROM pred WHERE yr < 2000
      GROUP BY 1, 2) c ON p.site = c.site AND p.md_id = c.md_id WHERE p.yr >= 2000""",
)
def _(d):
    return pp.conformal(d.pred.where("yr < 2000"), d.pred.where("yr >= 2000"), ["site", "md_id"], "y")


@query(
    "k10_calibrate",
    f"site int, issue_date iso, {Q3}",
    """SELECT site, issue_date, q10 * (1 - (27 - md_id) * 0.005::DOUBLE) AS q10, q50,
    q90 * (1 + (27 - md_id) * 0.005::DOUBLE) AS q90 FROM pred""",
)
def _(d):
    return pp.calibrate(d.pred)


_BOUNDS = "(SELECT site, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM pred GROUP BY site)"


def bounds(d):
    return d.pred.groupBy("site").agg(
        F.percentile("y", F.lit(0.05)).alias("lo"), F.percentile("y", F.lit(0.95)).alias("hi")
    )


@query(
    "k11_clip_history",
    f"site int, issue_date iso, {Q3}",
    f"""SELECT site, issue_date, least(greatest(q10, lo), mid) AS q10, mid AS q50, greatest(least(q90, hi), mid) AS q90
    FROM (SELECT p.*, lo, hi, least(greatest(q50, lo), hi) AS mid FROM pred p JOIN {_BOUNDS} b ON p.site = b.site)""",
)
def _(d):
    return pp.clip_history(d.pred, bounds(d), ["site"])


@query(
    "k11_site_without_history",
    f"site int, issue_date iso, {Q3}",
    f"""SELECT site, issue_date, coalesce(least(greatest(q10, lo), mid), q10) AS q10, mid AS q50,
      coalesce(greatest(least(q90, hi), mid), q90) AS q90 FROM (SELECT p.*, lo, hi, least(greatest(q50, lo), hi) AS mid
      FROM pred p LEFT JOIN (SELECT * FROM {_BOUNDS} WHERE hi > 2 * lo) b ON p.site = b.site)""",
)
def _(d):
    return pp.clip_history(d.pred, bounds(d).where("hi > 2 * lo"), ["site"])


@query(
    "k11_floor_history",
    f"site int, issue_date iso, {Q3}",
    f"""SELECT site, issue_date, CASE WHEN q10 - 300 < 0 THEN lo ELSE q10 - 300 END AS q10, mid AS q50,
      CASE WHEN q90 - 200 < mid THEN mid + 1.2816::DOUBLE * e ELSE q90 - 200 END AS q90
    FROM (SELECT p.*, lo, e, CASE WHEN q50 < lo THEN lo ELSE q50 END AS mid FROM pred p JOIN {_BOUNDS} b ON p.site = b.site
      JOIN (SELECT site, sqrt(avg((y - q50) ** 2)) AS e FROM pred GROUP BY site) r ON p.site = r.site)""",
)
def _(d):
    err = d.pred.groupBy("site").agg(F.sqrt(F.avg((F.col("y") - F.col("q50")) ** 2)).alias("e"))
    rows = d.pred.withColumns({"q10": F.col("q10") - 300, "q90": F.col("q90") - 200}).join(err, "site")
    return pp.floor_history(rows, bounds(d), ["site"], "e")


FLOOR = {
    5: {"q10": (1.05, 1.0), "q50": (1.1, 1.05), "q90": (1.15, 1.1)},
    6: {"q10": (1.1, 1.05), "q50": (1.15, 1.1), "q90": (1.2, 1.15)},
    7: {"q10": (1.15, 1.1), "q50": (1.2, 1.15), "q90": (1.3, 1.2)},
}


def _floor_case(q: str) -> str:
    cases = " ".join(
        f"WHEN m = {m} AND {q} < y * {f[q][1]}::DOUBLE THEN {f[q][0]}::DOUBLE * greatest(y, {q})" for m, f in FLOOR.items()
    )
    return f"CASE {cases} ELSE {q} END AS {q}"


@query(
    "k12_natflow_floor",
    f"site int, issue_date iso, {Q3}",
    f"SELECT site, issue_date, {_floor_case('q10')}, {_floor_case('q50')}, {_floor_case('q90')} FROM pred",
)
def _(d):
    return pp.natflow_floor(d.pred, "y", "m", FLOOR)


_HISTORY = "(SELECT p.*, h.fold FROM pred p, (SELECT DISTINCT yr AS fold FROM pred) h WHERE p.yr <> h.fold)"
_MOMENTS = f"""SELECT site, fold, avg(y) AS mean, stddev_samp(y) AS sd, min(y) AS mn, max(y) AS mx, avg(ln(y)) AS lmean,
  stddev_samp(ln(y)) AS lsd FROM {_HISTORY} GROUP BY site, fold"""
_FIT = f"""SELECT *, sd * sqrt(3.0::DOUBLE) / pi() AS ls, sd * sqrt(6.0::DOUBLE) / pi() AS gs, lsd * sqrt(3.0::DOUBLE) / pi() AS lls,
  mean - 0.5772156649015329::DOUBLE * sd * sqrt(6.0::DOUBLE) / pi() AS gl FROM ({_MOMENTS})"""
_NLL = f"""SELECT p.site, p.fold, sum((y - mean) / ls + ln(ls) + 2 * ln(1 + exp(-(y - mean) / ls))) AS logistic,
  sum(ln(gs) + (y - gl) / gs + exp(-(y - gl) / gs)) AS gumbel, sum(ln(mx - mn)) AS uniform,
  sum((ln(y) - lmean) / lls + ln(lls) + 2 * ln(1 + exp(-(ln(y) - lmean) / lls)) + ln(y)) AS loglogistic,
  sum(ln(lsd) + ((ln(y) - lmean) / lsd) ** 2 / 2 + ln(2 * pi()) / 2 + ln(y)) AS lognormal
FROM {_HISTORY} p JOIN ({_FIT}) f ON p.site = f.site AND p.fold = f.fold GROUP BY p.site, p.fold"""
_BEST = f"""SELECT site, fold, least(logistic, gumbel, uniform, loglogistic, lognormal) AS nll,
  CASE least(logistic, gumbel, uniform, loglogistic, lognormal) WHEN logistic THEN 'logistic' WHEN gumbel THEN 'gumbel'
    WHEN uniform THEN 'uniform' WHEN loglogistic THEN 'loglogistic' ELSE 'lognormal' END AS family FROM ({_NLL})"""


def history(d):
    """Every row of a site in each fold that holds out another year."""
    held_out = d.pred.select(F.col("yr").alias("fold")).distinct()
    return folds.loocv(d.pred, "yr", *d.years).join(held_out, "fold", "left_semi")


@query("k14_best_dist", "site int, fold int, family str, nll num", _BEST)
def _(d):
    return pp.best_dist(history(d), ["site", "fold"], "y")


# Newton steps on a and b of z = a * u - b, u the standardised values (or logarithms) of a fold.
_LIKELY = f"""SELECT site, fold, family, loc, scale, nll FROM (
  WITH RECURSIVE h AS MATERIALIZED (SELECT site, fold, y FROM {_HISTORY} WHERE y IS NOT NULL),
  v AS MATERIALIZED (SELECT site, fold, kind, CASE kind WHEN 'loglogistic' THEN ln(y) ELSE y END AS x
    FROM h, (VALUES ('logistic'), ('gumbel'), ('loglogistic')) k(kind)),
  f AS MATERIALIZED (SELECT site, fold, kind, count(*)::DOUBLE AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM v GROUP BY ALL HAVING min(x) < max(x)),
  u AS MATERIALIZED (SELECT v.site, v.fold, v.kind, (x - mean) / sd AS u, n FROM v JOIN f USING (site, fold, kind)),
  r(site, fold, kind, step, a, b) AS (
    SELECT site, fold, kind, 0, CASE kind WHEN 'gumbel' THEN pi() / sqrt(6.0::DOUBLE) ELSE pi() / sqrt(3.0::DOUBLE) END,
      CASE kind WHEN 'gumbel' THEN -0.5772156649015329::DOUBLE ELSE 0.0::DOUBLE END FROM f
    UNION ALL
    SELECT site, fold, kind, step + 1, a + (ab * gb - bb * ga) / (aa * bb - ab * ab), b + (ab * ga - aa * gb) / (aa * bb - ab * ab) FROM (
      SELECT site, fold, kind, step, a, b, sum(d * u) - max(n) / a AS ga, -sum(d) AS gb, sum(c * u * u) + max(n) / (a * a) AS aa,
        -sum(c * u) AS ab, sum(c) AS bb FROM (
        SELECT r.*, u.u, u.n, CASE r.kind WHEN 'gumbel' THEN 1 - exp(-(a * u - b)) ELSE 2 / (1 + exp(-(a * u - b))) - 1 END AS d,
          CASE r.kind WHEN 'gumbel' THEN exp(-(a * u - b)) ELSE 2 * exp(-(a * u - b)) / (1 + exp(-(a * u - b))) ** 2 END AS c
        FROM r JOIN u ON r.site = u.site AND r.fold = u.fold AND r.kind = u.kind WHERE step < 20)
      GROUP BY site, fold, kind, step, a, b)),
  e AS (SELECT r.site, r.fold, r.kind, mean + sd * b / a AS loc, sd / a AS scale FROM r JOIN f USING (site, fold, kind) WHERE step = 20)
  SELECT e.site, e.fold, e.kind AS family, e.loc, e.scale,
    sum(CASE e.kind WHEN 'gumbel' THEN (x - loc) / scale + exp(-(x - loc) / scale) ELSE (x - loc) / scale + 2 * ln(1 + exp(-(x - loc) / scale)) END
      + ln(scale) + CASE e.kind WHEN 'loglogistic' THEN x ELSE 0 END) AS nll
  FROM e JOIN v USING (site, fold, kind) GROUP BY ALL
  UNION ALL SELECT site, fold, 'uniform', min(y), max(y) - min(y), count(*) * ln(max(y) - min(y)) FROM h GROUP BY site, fold
  UNION ALL SELECT site, fold, 'lognormal', avg(ln(y)), stddev_pop(ln(y)),
    count(*) * (ln(stddev_pop(ln(y))) + 0.5 + ln(2 * pi()) / 2) + sum(ln(y)) FROM h GROUP BY site, fold)"""


@query("k14_likelihood_fits", "site int, fold int, family str, loc num3, scale num3, nll num3", _LIKELY)
def _(d):
    return likelihood.fit_likelihood(history(d), ["site", "fold"], "y")


@query(
    "k14_best_likelihood",
    "site int, fold int, family str, loc num3, scale num3, nll num3",
    f"SELECT * FROM ({_LIKELY}) QUALIFY row_number() OVER (PARTITION BY site, fold ORDER BY nll) = 1",
)
def _(d):
    return likelihood.best_likelihood(history(d), ["site", "fold"], "y")


def _polynomial(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"(({out}) * ({x}) + {c!r}::DOUBLE)"
    return out


def _normal_cdf(z: str) -> str:
    p, *a = pp.ERF
    t = f"(1 / (1 + {p!r}::DOUBLE * abs({z}) / sqrt(2.0::DOUBLE)))"
    tail = f"({_polynomial([*reversed(a), 0.0], t)}) * exp(-(({z}) ** 2) / 2) / 2"
    return f"(CASE WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END)"


def _normal_inverse(p: str) -> str:
    def tail(q: str) -> str:
        r = f"sqrt(-2 * ln({q}))"
        return f"{_polynomial(pp.INVERSE_TAIL, r)} / {_polynomial(pp.INVERSE_TAIL_BY, r)}"

    q = f"(({p}) - 0.5::DOUBLE)"
    middle = f"{q} * {_polynomial(pp.INVERSE_MIDDLE, f'{q} * {q}')} / {_polynomial(pp.INVERSE_MIDDLE_BY, f'{q} * {q}')}"
    edge = f"{pp.INVERSE_EDGE}::DOUBLE"
    return f"(CASE WHEN ({p}) < {edge} THEN {tail(p)} WHEN ({p}) > 1 - {edge} THEN -({tail(f'1 - ({p})')}) ELSE {middle} END)"


def _cdf(family: str, x: str) -> str:
    return {
        "lognormal": _normal_cdf(f"((ln({x}) - lmean) / lsd)"),
        "logistic": f"1 / (1 + exp(-({x} - mean) / ls))",
        "gumbel": f"exp(-exp(-({x} - gl) / gs))",
        "uniform": f"least(1, greatest(0, ({x} - mn) / (mx - mn)))",
        "loglogistic": f"1 / (1 + exp(-(ln({x}) - lmean) / lls))",
    }[family]


def _inv(family: str, p: str) -> str:
    return {
        "lognormal": f"exp(lmean + lsd * {_normal_inverse(p)})",
        "logistic": f"mean + ls * ln(({p}) / (1 - ({p})))",
        "gumbel": f"gl - gs * ln(-ln({p}))",
        "uniform": f"mn + (mx - mn) * ({p})",
        "loglogistic": f"exp(lmean + lls * ln(({p}) / (1 - ({p}))))",
    }[family]


def _case(fn, arg: str) -> str:
    """The family's own formula, by the chosen family."""
    return "CASE family " + " ".join(f"WHEN '{f}' THEN {fn(f, arg)}" for f in pp.FAMILIES) + " END"


def _k13(cdf, inv, fit: str, cols: str = "") -> str:
    low, high = inv("p - 0.8::DOUBLE * (p - pb)"), inv("p + 0.8::DOUBLE * (pt - p)")
    return f"""SELECT site, issue_date, {cols} 0.7::DOUBLE * (CASE WHEN lo < mn THEN mn ELSE lo END) + (1 - 0.7::DOUBLE) * q10 AS q10, q50,
      0.7::DOUBLE * (CASE WHEN hi > mx THEN mx ELSE hi END) + (1 - 0.7::DOUBLE) * q90 AS q90 FROM (
      SELECT *, {low} AS lo, {high} AS hi FROM (
      SELECT *, greatest(pb, least(pt, {cdf('q50')})) AS p FROM (
        SELECT p.*, f.* EXCLUDE (site, fold), {cdf('mx')} AS pt, {cdf('mn')} AS pb
        FROM pred p JOIN ({fit}) f ON p.site = f.site AND p.yr = f.fold)))"""


def _register_k13(family: str):
    @query(f"k13_dist_quantiles_{family}", f"site int, issue_date iso, {Q3}", _k13(lambda x: _cdf(family, x), lambda p: _inv(family, p), _FIT))
    def _(d):
        fitted = pp.fit_moments(history(d), ["site", "fold"], "y").withColumn("family", F.lit(family))
        return pp.dist_quantiles(d.pred.withColumn("fold", F.col("yr")), fitted, ["site", "fold"], weight=0.7)


for _family in ("logistic", "gumbel", "uniform", "lognormal"):
    _register_k13(_family)


@query(
    "k13_dist_quantiles_best",
    f"site int, issue_date iso, family str, {Q3}",
    _k13(
        lambda x: _case(_cdf, x),
        lambda p: _case(_inv, p),
        f"SELECT m.*, b.family FROM ({_FIT}) m JOIN ({_BEST}) b ON m.site = b.site AND m.fold = b.fold",
        "family,",
    ),
)
def _(d):
    fitted = pp.best_dist(history(d), ["site", "fold"], "y").drop("nll")
    return pp.dist_quantiles(d.pred.withColumn("fold", F.col("yr")), fitted, ["site", "fold"], weight=0.7)


@query(
    "k15_nearest_model",
    "site int, issue_date iso, model_md int",
    """SELECT g.site, g.issue_date, max(a.md_id) AS model_md FROM issue_grid g
    LEFT JOIN (SELECT DISTINCT site, md_id FROM pred) a
      ON g.site = a.site AND a.md_id BETWEEN g.md_id - 3 AND g.md_id GROUP BY 1, 2""",
)
def _(d):
    return pp.nearest_model(d.issue_grid, d.pred, ["site"], "md_id")
