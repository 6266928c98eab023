"""Queries for scaffolds, gap filling and data quality."""

from pyspark.sql import Window, functions as F

from freshet.catalog.registry import query
from freshet.operators import fill, frames, quality


def gap_day(d):
    """Every day of each site, null on days without a reading."""
    return frames.expand_dates(d.site_day, ["site"], "d")


@query(
    "d1_scaffold",
    "site int, yr int, m int, dd int, issue_date iso, md_id int",
    "SELECT site, yr, m, dd, issue_date, md_id FROM issue_grid WHERE m <= season_end",
)
def _(d):
    return frames.scaffold(
        d.site_meta.select("site", "season_end"), *d.years, last_month=F.col("season_end")
    )


@query("d2_expand_dates", "site int, d iso, v num", "SELECT site, d, v FROM gap_day")
def _(d):
    return gap_day(d)


@query(
    "d2_expand_months_to_year_end",
    "station int, t iso, v num",
    """SELECT b.station, b.t, s.v FROM (
      SELECT station, unnest(generate_series(lo, make_date(year(hi), 12, 31), INTERVAL 1 MONTH))::DATE AS t
      FROM (SELECT station, min(t) AS lo, max(t) AS hi FROM station_month GROUP BY station)) b
    LEFT JOIN station_month s ON b.station = s.station AND b.t = s.t""",
)
def _(d):
    end = F.make_date(F.year("last"), F.lit(12), F.lit(31))
    return frames.expand_dates(d.station_month, ["station"], "t", end=end, freq="month")


@query(
    "d3_ffill",
    "site int, d iso, v num, v2 num",
    """SELECT site, d, last_value(v IGNORE NULLS) OVER (PARTITION BY site ORDER BY d) AS v,
      last_value(v IGNORE NULLS) OVER (PARTITION BY site ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v2
    FROM gap_day""",
)
def _(d):
    rows = gap_day(d).withColumn("v2", F.col("v"))
    return fill.ffill(fill.ffill(rows, ["site"], "d", ["v"]), ["site"], "d", ["v2"], limit=2)


@query(
    "d4_fill_up_and_both",
    "station int, t iso, up num, down_up num",
    """SELECT station, t, first_value(x IGNORE NULLS) OVER (PARTITION BY station ORDER BY t
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up,
      coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY station ORDER BY t),
        first_value(x IGNORE NULLS) OVER (PARTITION BY station ORDER BY t
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS down_up
    FROM (SELECT station, t, CASE WHEN v >= 150 THEN v END AS x FROM station_month)""",
)
def _(d):
    x = F.when(F.col("v") >= 150, F.col("v"))
    rows = d.station_month.select("station", "t", x.alias("up"), x.alias("down_up"))
    return fill.fill(fill.fill(rows, ["station"], "t", ["up"], "up"), ["station"], "t", ["down_up"])


@query(
    "d5_hold_forecast",
    "site int, issue_date iso, q50 num",
    """SELECT site, issue_date, last_value(x IGNORE NULLS) OVER (PARTITION BY site, yr ORDER BY issue_date) AS q50
    FROM (SELECT *, CASE WHEN NOT (m IN (5, 6, 7) AND dd IN (8, 15, 22) AND site NOT IN (3, 5)) THEN q50 END AS x
      FROM pred)""",
)
def _(d):
    blank = F.col("m").isin(5, 6, 7) & F.col("dd").isin(8, 15, 22) & ~F.col("site").isin(3, 5)
    return fill.hold_forecast(d.pred, ["site", "yr"], "issue_date", ["q50"], blank)


_LINE = """SELECT {key}, d, CASE WHEN v IS NOT NULL THEN v WHEN p - pa <= {limit} THEN va + (vb - va) * (p - pa) / (pb - pa) END AS v
FROM (SELECT {key}, d, v, p,
  last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa, last_value(v IGNORE NULLS) OVER a AS va,
  first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pb, first_value(v IGNORE NULLS) OVER b AS vb
  FROM (SELECT {key}, d, v, row_number() OVER (PARTITION BY {key} ORDER BY d) AS p FROM {src})
  WINDOW a AS (PARTITION BY {key} ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY {key} ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("d6_interpolate_linear", "site int, d iso, v num", _LINE.format(key="site", limit=3, src="gap_day"))
def _(d):
    return fill.interpolate_linear(gap_day(d), ["site"], "d", "v", limit=3)


@query("d6_interpolate_quadratic", "site int, d iso, v num")
def _(d):
    return fill.interpolate(gap_day(d), ["site"], "d", "v", limit=5)


_PARABOLA = "(p::DOUBLE * p / 50.0::DOUBLE - 3.0::DOUBLE * p + 400.0::DOUBLE)"


@query(
    "d6_interpolate_parabola",
    "site int, d iso, v num",
    # A sampled parabola comes back whole, inside the known rows and the limit.
    f"""WITH s AS (SELECT site, d, row_number() OVER (PARTITION BY site ORDER BY d) AS p FROM site_day),
    k AS (SELECT *, CASE WHEN p % 5 IN (1, 2) THEN p END AS known FROM s),
    g AS (SELECT *, max(known) OVER (PARTITION BY site ORDER BY p) AS before,
      min(known) OVER (PARTITION BY site ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM k)
    SELECT site, d, CASE WHEN before IS NOT NULL AND after IS NOT NULL AND p - before <= 5 THEN greatest(0, {_PARABOLA}) END AS v FROM g""",
)
def _(d):
    p = F.row_number().over(Window.partitionBy("site").orderBy("d"))
    rows = d.site_day.select("site", "d", p.cast("double").alias("p"))
    curve = F.col("p") * F.col("p") / 50.0 - 3.0 * F.col("p") + 400.0
    sampled = rows.select("site", "d", F.when((F.col("p") % 5).isin(1.0, 2.0), curve).alias("v"))
    return fill.interpolate(sampled, ["site"], "d", "v", limit=5)


@query(
    "d7_monthly_to_daily",
    "station int, d iso, v num",
    """SELECT station, d, last_value(v IGNORE NULLS) OVER (PARTITION BY station ORDER BY d
        ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS v FROM (
      SELECT b.station, b.d, s.v FROM (
        SELECT station, unnest(generate_series(make_date(year(lo), 1, 1), last_day(hi), INTERVAL 1 DAY))::DATE AS d
        FROM (SELECT station, min(t) AS lo, max(t) AS hi FROM station_month GROUP BY station)) b
      LEFT JOIN station_month s ON b.station = s.station AND b.d = s.t)""",
)
def _(d):
    first = F.make_date(F.year("first"), F.lit(1), F.lit(1))
    return fill.to_daily(d.station_month, ["station"], "t", "v", 24, first, F.last_day("last")).withColumnRenamed("t", "d")


@query(
    "d8_climatology_impute",
    "site int, d iso, v num",
    f"""WITH src AS (SELECT site, d, v, strftime(d, '%m%d') AS md FROM gap_day),
    raw AS (SELECT site, md AS d, median(v) AS v FROM src GROUP BY 1, 2),
    line AS ({_LINE.format(key="site", limit=366, src="raw")}),
    clim AS (SELECT site, d AS md, coalesce(
      last_value(v IGNORE NULLS) OVER (PARTITION BY site ORDER BY d),
      first_value(v IGNORE NULLS) OVER (PARTITION BY site ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      0) AS c FROM line)
    SELECT s.site, s.d, coalesce(v, c + last_value(v - c IGNORE NULLS) OVER (PARTITION BY s.site ORDER BY s.d), c) AS v
    FROM src s JOIN clim USING (site, md)""",
)
def _(d):
    return fill.clim_impute(gap_day(d), ["site"], "d", "v")


@query(
    "d9_fill_group_mean",
    "site int, yr int, m int, vol num",
    """SELECT site, yr, m, coalesce(x, avg(x) OVER (PARTITION BY site, m)) AS vol
    FROM (SELECT site, yr, m, CASE WHEN vol <= 4000 THEN vol END AS x FROM flow_month)""",
)
def _(d):
    rows = d.flow_month.withColumn("vol", F.when(F.col("vol") <= 4000, F.col("vol")))
    return fill.fill_group_mean(rows, ["site", "m"], "vol")


@query(
    "d10_outliers_rolling",
    "station int, d iso, v num",
    """SELECT station, d, CASE WHEN abs(v - ma) > 2 * sd THEN NULL ELSE v END AS v FROM (
      SELECT *, stddev_samp(ma) OVER (PARTITION BY station) AS sd FROM (
        SELECT station, d, v, CASE WHEN count(v) OVER w >= 5 THEN avg(v) OVER w END AS ma FROM station_day
        WINDOW w AS (PARTITION BY station ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))""",
)
def _(d):
    return quality.null_outliers_ma(d.station_day, ["station"], "d", "v")


@query(
    "d11_outliers_iqr",
    "event_id big, event_type str, value num",
    """SELECT event_id, e.event_type, CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END AS value
    FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM events GROUP BY event_type) q ON e.event_type = q.event_type""",
)
def _(d):
    return quality.null_outliers_iqr(d.table("events"), ["event_type"], "value")


@query(
    "d12_outliers_zscore",
    "site int, yr int, vol num, z num",
    """SELECT * FROM (SELECT site, yr, vol, (vol - avg(vol) OVER w) / stddev_pop(vol) OVER w AS z FROM site_year
    WINDOW w AS (PARTITION BY site)) WHERE abs(z) >= 1.5""",
)
def _(d):
    return quality.zscore_outliers(d.site_year, ["site"], "vol", 1.5)


@query(
    "d13_drop_sparse",
    "station int, n big",
    """SELECT station, count(*) AS n FROM station_day WHERE station IN (
      SELECT station FROM station_day GROUP BY station HAVING count(DISTINCT d) >= 530)
    GROUP BY station""",
)
def _(d):
    return quality.drop_sparse(d.station_day, ["station"], "d", "v", 530, d.parts).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d13_column_screen",
    "name str, null_share num, zero_share num, is_copy bit, keep bit",
    """SELECT name, null_share, zero_share, is_copy, null_share < 0.5 AND zero_share <= 0.6 AND NOT is_copy AS keep FROM (
      SELECT 'l_discount' AS name, avg((l_discount IS NULL)::INT) AS null_share, avg((l_discount = 0)::INT) AS zero_share,
        false AS is_copy FROM lineitem UNION ALL
      SELECT 'd2', avg((l_discount IS NULL)::INT), avg((l_discount = 0)::INT), true FROM lineitem UNION ALL
      SELECT 'late', avg((l_returnflag <> 'R')::INT), avg(CASE WHEN l_returnflag = 'R' THEN (l_tax = 0)::INT END), false
      FROM lineitem)""",
)
def _(d):
    rows = d.table("lineitem").select(
        "l_discount", F.col("l_discount").alias("d2"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("late")
    )
    return quality.column_screen(rows, ["l_discount", "d2", "late"])


@query(
    "d14_coverage_gate",
    "site int, d iso, n_present big, v num",
    """SELECT s.site, d, count(v) AS n_present, CASE WHEN count(v) / n_expected >= 0.65 THEN avg(v) END AS v
    FROM station_day s JOIN (SELECT site, count(*) AS n_expected FROM station_meta GROUP BY site) e ON s.site = e.site
    GROUP BY s.site, d, n_expected""",
)
def _(d):
    expected = d.station_meta.groupBy("site").agg(F.count(F.lit(1)).alias("n_expected"))
    return quality.coverage_gate(d.station_day, ["site", "d"], "v", expected, ["site"])


@query(
    "d15_screen_series",
    "site int, n big",
    """SELECT site, count(*) AS n FROM gap_day WHERE site IN (SELECT site FROM gap_day GROUP BY site
      HAVING count(*) >= 2000 AND 100.0 * avg((v IS NULL)::INT) <= 45) GROUP BY site""",
)
def _(d):
    good = quality.screen_series(gap_day(d), ["site"], "v", 2000, 45.0)
    return good.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d16_dedup",
    "l_orderkey big, l_linenumber int, l_shipdate str, l_partkey big, l_suppkey big",
    """SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS l_shipdate, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(d):
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    last = quality.dedup(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return last.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query(
    "d17_find_gaps",
    "site int, d iso, prev_date iso, gap int",
    """SELECT * FROM (SELECT site, d, lag(d) OVER w AS prev_date, date_diff('day', lag(d) OVER w, d) AS gap
    FROM site_day WINDOW w AS (PARTITION BY site ORDER BY d)) WHERE gap > 1""",
)
def _(d):
    return quality.find_gaps(d.site_day, ["site"], "d")


@query(
    "d18_freshness",
    "p_partkey big, last_date iso, age int, status str",
    """SELECT m.p_partkey, last_date, date_diff('day', last_date, DATE '1999-03-08') AS age,
      CASE WHEN last_date IS NULL THEN 'missing' WHEN DATE '1999-03-08' - last_date > 1 THEN 'behind' ELSE 'ok' END AS status
    FROM part m LEFT JOIN (SELECT station, max(d) AS last_date FROM station_day
      WHERE d < DATE '1999-03-08' GROUP BY station) l ON m.p_partkey = l.station""",
)
def _(d):
    issue = F.lit("1999-03-08").cast("date")
    rows = d.station_day.withColumn("p_partkey", F.col("station").cast("long"))
    return quality.freshness(rows, d.table("part"), "p_partkey", "d", "v", issue)


@query(
    "d19_qa_checks",
    "item str, n big",
    """SELECT 'duplicate_keys' AS item, count(*) AS n FROM (SELECT 1 FROM lineitem
      GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1) UNION ALL
    SELECT 'negative_values', count(*) FROM lineitem WHERE l_quantity - 10 < 0 UNION ALL
    SELECT 'missing_ids', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_suppkey FROM lineitem)""",
)
def _(d):
    rows = d.table("lineitem").select(
        F.col("l_suppkey").alias("id"), "l_shipdate", (F.col("l_quantity") - 10).alias("v")
    )
    expected = d.table("part").select(F.col("p_partkey").alias("id"))
    return quality.qa_checks(rows, ["id", "l_shipdate"], "v", expected, "id").withColumnRenamed("check", "item")


@query(
    "d20_profile",
    "event_type str, n big, mean num, sd num, min num, p25 num, p50 num, p75 num, max num",
    """SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min,
      quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
      max(value) AS max FROM events GROUP BY event_type""",
)
def _(d):
    return quality.profile(d.table("events"), ["event_type"], "value")


@query(
    "d21_cut_gap",
    "station int, n big, last iso",
    """SELECT s.station, count(*) AS n, max(d) AS last FROM station_day s
    JOIN (SELECT station, max(d) AS hi FROM station_day GROUP BY station) h ON s.station = h.station
    WHERE d <= hi - 14 GROUP BY s.station""",
)
def _(d):
    cut = quality.cut_gap(d.station_day, "station", "d", 14)
    return cut.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))


@query(
    "d21_simulate_gap",
    "station int, n big, last iso",
    """WITH c AS (SELECT station, max(d) - (('0x' || substr(md5(station || '|7'), 1, 8))::BIGINT % 30 + 1)::INTEGER AS cut
      FROM station_day GROUP BY station)
    SELECT s.station, count(*) AS n, max(d) AS last FROM station_day s JOIN c ON s.station = c.station AND d <= cut GROUP BY 1""",
)
def _(d):
    cut = quality.simulate_gap(d.station_day, "station", "d", 30, seed=7)
    return cut.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))


@query(
    "d22_check_submission",
    "n_pred big, n_wanted big, unexpected big, absent big, moved big",
    """SELECT count(p.site) AS n_pred, count(g.site) AS n_wanted, sum((g.site IS NULL)::INT) AS unexpected,
      sum((p.site IS NULL)::INT) AS absent, coalesce(sum((p.ord <> g.ord)::INT), 0) AS moved
    FROM (SELECT site, issue_date, md_id + (site % 2 = 0 AND dd = 1)::INT AS ord FROM pred) p
    FULL JOIN (SELECT site, issue_date, md_id AS ord FROM issue_grid) g
      ON p.site = g.site AND p.issue_date = g.issue_date""",
)
def _(d):
    shift = ((F.col("site") % 2 == 0) & (F.col("dd") == 1)).cast("int")
    pred = d.pred.select("site", "issue_date", (F.col("md_id") + shift).alias("ord"))
    wanted = d.issue_grid.select("site", "issue_date", F.col("md_id").alias("ord"))
    return quality.check_submission(pred, wanted, ["site", "issue_date"], "ord")
