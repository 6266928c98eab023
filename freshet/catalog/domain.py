"""Forecast frames over the given tables, in Spark and in SQL.

site = nation, station = supplier, daily station series = lineitem by supplier
and ship day, flow = orders by the customer's nation.  Raw rows are combined per
(key, day) before any join, so a key with a third of all rows costs one row per
day after the map side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.calendar import forecast_year, md_id, water_year
from freshet.operators.frames import scaffold
from freshet.session import parts_of, spread

KAF = 0.0019834591996927  # one cfs day in thousand acre-feet


class Domain:
    """Lazy frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Tasks for shuffles of the shipped lines: as many as their bytes ask for."""
        return parts_of(self.spark, f"{self.dir}/lineitem.parquet")

    @cached_property
    def years(self) -> tuple[int, int]:
        """First calendar year and last forecast year of the shipped lines."""
        day = F.col("l_shipdate")
        row = self.table("lineitem").agg(F.min(F.year(day)), F.max(forecast_year(day))).first()
        return (row[0], row[1]) if row[0] is not None else (0, -1)

    @cached_property
    def site_meta(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.alias("site"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("area"),
            (35.0 + (n * 7) % 15).alias("lat"),
            (-115.0 + (n * 3) % 17).alias("lon"),
            (1000.0 + (n * 37) % 400).alias("elev"),
            (3 + n % 2).alias("season_start"),
            F.when(n % 5 == 0, 6).otherwise(7).alias("season_end"),
            F.lpad((n % 6).cast("string"), 4, "17").alias("huc"),
        )

    @cached_property
    def station_meta(self) -> DataFrame:
        s = F.col("s_suppkey").cast("int")
        return self.table("supplier").select(
            s.alias("station"),
            F.col("s_nationkey").alias("site"),
            (30.0 + (s * 37) % 200 / 10.0).alias("lat"),
            (-118.0 + (s * 53) % 200 / 10.0).alias("lon"),
            F.col("s_acctbal").alias("elev"),
            F.concat(F.lpad((s % 6).cast("string"), 4, "17"), F.lpad((s % 10).cast("string"), 4, "0")).alias("huc"),
        )

    @cached_property
    def area_pairs(self) -> DataFrame:
        """Candidate stations of a site: those of its area."""
        sites = self.site_meta.select("site", "area")
        stations = self.station_meta.join(sites, "site").select("station", "area")
        return sites.join(stations, "area").select("site", "station")

    @cached_property
    def station_day(self) -> DataFrame:
        # Dealt by (station, day) over as many tasks as the bytes ask for: the lines of a station
        # hardly ever share a day, so combining before the shuffle holds nearly all of a split in
        # memory and saves nothing, and a task's table of days does not grow with the lines.
        lines = self.table("lineitem").select(
            F.col("l_suppkey").cast("int").alias("station"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity"
        )
        raw = lines.repartition(self.parts, "station", "d").groupBy("station", "d").agg(F.sum("l_quantity").alias("v"))
        return raw.join(self.station_meta.select("station", "site"), "station").select("station", "site", "d", "v")

    @cached_property
    def site_day(self) -> DataFrame:
        return self.station_day.groupBy("site", "d").agg(F.avg("v").alias("v"))

    @cached_property
    def station_month(self) -> DataFrame:
        days = spread(self.station_day, ["station"], self.parts)  # months and years of a station stay in its task
        return days.groupBy("station", "site", F.trunc("d", "MM").alias("t")).agg(F.sum("v").alias("v"))

    @cached_property
    def _cust_day(self) -> DataFrame:
        return self.table("orders").groupBy(
            F.col("o_custkey"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderpriority").alias("member")
        ).agg(
            F.round(F.sum("o_totalprice"), 2).alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.min("o_totalprice").alias("lo"),
            F.max("o_totalprice").alias("hi"),
        )

    @cached_property
    def order_day(self) -> DataFrame:
        """Orders by site, day and member: sum, count, least and greatest."""
        cust = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("site"))
        return (
            self._cust_day.join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("site", "d", "member")
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        )

    @cached_property
    def flow_day(self) -> DataFrame:
        return self.order_day.groupBy("site", "d").agg((F.round(F.sum("s"), 2) * KAF).alias("vol"))

    @cached_property
    def flow_month(self) -> DataFrame:
        t = F.trunc("d", "MM")
        return self.order_day.groupBy("site", t.alias("t")).agg(
            (F.round(F.sum("s"), 2) * KAF).alias("vol")
        ).select("site", water_year("t").alias("wy"), F.year("t").alias("yr"), F.month("t").alias("m"), "t", "vol")

    @cached_property
    def site_year(self) -> DataFrame:
        season = self.site_meta.select("site", "season_start", "season_end")
        return (
            self.order_day.join(season, "site")
            .where(F.month("d").between(F.col("season_start"), F.col("season_end")))
            .groupBy("site", F.year("d").alias("yr"))
            .agg((F.round(F.sum("s"), 2) * KAF).alias("vol"))
        )

    @cached_property
    def issue_grid(self) -> DataFrame:
        return scaffold(self.site_meta.select("site", "season_start", "season_end"), *self.years)

    @cached_property
    def members(self) -> DataFrame:
        """Member forecasts per site, month and member (order priority)."""
        return (
            self.order_day.where(F.month("d") <= 7)
            .groupBy("site", F.year("d").alias("yr"), F.month("d").alias("m"), "member")
            .agg(
                (F.min("lo") * KAF).alias("q10"),
                (F.round(F.sum("s"), 2) / F.sum("n") * KAF).alias("q50"),
                (F.max("hi") * KAF).alias("q90"),
            )
            .withColumn("issue_date", F.make_date("yr", "m", F.lit(1)))
        )

    @cached_property
    def truth(self) -> DataFrame:
        """Volume to score against: mean order value of the site and month, from
        the shipped lines."""
        return (
            self.station_day.groupBy("site", F.year("d").alias("yr"), F.month("d").alias("m"))
            .agg((F.avg("v") * (10000.0 * KAF)).alias("y"))
        )

    @cached_property
    def pred(self) -> DataFrame:
        """Predictions per site and issue day, with the truth."""
        day = F.dayofmonth("d")
        dd = F.when(day >= 22, 22).when(day >= 15, 15).when(day >= 8, 8).otherwise(1)
        rows = (
            self.order_day.where(F.month("d") <= 7)
            .groupBy("site", F.year("d").alias("yr"), F.month("d").alias("m"), dd.alias("dd"))
            .agg(
                (F.min("lo") * KAF).alias("q10"),
                (F.round(F.sum("s"), 2) / F.sum("n") * KAF).alias("q50"),
                (F.max("hi") * KAF).alias("q90"),
            )
        )
        return rows.join(self.truth, ["site", "yr", "m"]).withColumns(
            {"issue_date": F.make_date("yr", "m", "dd"), "md_id": md_id("m", "dd")}
        )

    @cached_property
    def contrib_wide(self) -> DataFrame:
        """Contribution columns per member, quantile, site, year and month."""
        raw = (
            self.table("lineitem")
            .groupBy(
                F.col("l_suppkey").cast("int").alias("station"),
                F.year("l_shipdate").alias("yr"),
                F.month("l_shipdate").alias("md"),
                F.col("l_linenumber").alias("member"),
                F.col("l_returnflag").alias("quantile"),
            )
            .agg(
                F.sum("l_quantity").alias("a"),
                F.round(F.sum("l_discount"), 2).alias("b"),
                F.round(F.sum("l_tax"), 2).alias("c"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        return (
            raw.join(self.station_meta.select("station", "site"), "station")
            .groupBy("member", "quantile", "site", "yr", "md")
            .agg(
                (F.sum("a") - 25.5 * F.sum("n")).alias("shap__snow"),
                F.when(F.sum("b") > 0, F.round(F.sum("b"), 2) * 100 - 5.0 * F.sum("n")).alias("shap__rain"),
                (F.round(F.sum("c"), 2) * 100 - 4.0 * F.sum("n")).alias("shap__flow_deviation_10"),
                F.sum("n").cast("double").alias("shap__elevation"),
                F.sum("a").alias("pred"),
            )
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Monthly cells (t, lat, lon, v)."""
        return self.table("lineitem").groupBy(
            F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("t"),
            (30.0 + F.col("l_partkey") % 20).alias("lat"),
            (-118.0 + F.col("l_suppkey") % 20).alias("lon"),
        ).agg(F.avg("l_quantity").alias("v"))

    @cached_property
    def boxes(self) -> DataFrame:
        return self.site_meta.select(
            "site",
            (F.col("lat") - 1.5).alias("lat_min"),
            (F.col("lat") + 2.5).alias("lat_max"),
            (F.col("lon") - 2.5).alias("lon_min"),
            (F.col("lon") + 1.5).alias("lon_max"),
        )

    @cached_property
    def polygons(self) -> DataFrame:
        """A five-sided basin with a triangular hole around each site."""

        def point(dx: float, dy: float):
            return F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))

        outer = F.array(*[point(dx, dy) for dx, dy in BASIN])
        hole = F.array(*[point(dx, dy) for dx, dy in HOLE])
        return self.site_meta.select("site", F.array(outer, hole).alias("rings"))

    @cached_property
    def index_month(self) -> DataFrame:
        """A monthly climate index from all shipped lines."""
        return self.table("lineitem").groupBy(
            F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("m")
        ).agg((F.round(F.sum("l_discount"), 2) / F.count(F.lit(1)) * 100 - 5.0).alias("val"))

    @cached_property
    def event_day(self) -> DataFrame:
        """Sub-daily events combined to one row per user and day."""
        return self.table("events").groupBy(
            F.col("user_id").cast("int").alias("user_id"), F.col("ts").cast("date").alias("d")
        ).agg(F.round(F.sum("value"), 2).alias("v"), F.count(F.lit(1)).alias("n"))


BASIN = ((-2.05, -1.55), (1.35, -1.85), (2.15, 0.45), (0.25, 2.05), (-1.85, 1.15))
HOLE = ((-0.55, -0.45), (0.65, -0.35), (0.05, 0.75))


def _edge_rows() -> str:
    rows = []
    for ring in (BASIN, HOLE):
        for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0])):
            rows.append(f"({x1}, {y1}, {x2}, {y2})")
    return ", ".join(rows)


SQL_FRAMES: dict[str, str] = {
    "years": """
SELECT unnest(generate_series(min(year(l_shipdate)), max(year(l_shipdate) + (month(l_shipdate) >= 8)::INTEGER))) AS yr
FROM lineitem""",
    "site_meta": """
SELECT n_nationkey AS site, n_name AS name, n_regionkey AS area,
  35.0::DOUBLE + (n_nationkey * 7) % 15 AS lat, -115.0::DOUBLE + (n_nationkey * 3) % 17 AS lon,
  1000.0::DOUBLE + (n_nationkey * 37) % 400 AS elev, 3 + n_nationkey % 2 AS season_start,
  CASE WHEN n_nationkey % 5 = 0 THEN 6 ELSE 7 END AS season_end,
  '171' || (n_nationkey % 6)::VARCHAR AS huc
FROM nation""",
    "station_meta": """
SELECT s_suppkey::INTEGER AS station, s_nationkey AS site,
  30.0::DOUBLE + ((s_suppkey * 37) % 200)::DOUBLE / 10.0::DOUBLE AS lat,
  -118.0::DOUBLE + ((s_suppkey * 53) % 200)::DOUBLE / 10.0::DOUBLE AS lon,
  s_acctbal AS elev, '171' || (s_suppkey % 6)::VARCHAR || '000' || (s_suppkey % 10)::VARCHAR AS huc
FROM supplier""",
    "area_pairs": """
SELECT a.site, s.station FROM site_meta a
JOIN (SELECT st.station, b.area FROM station_meta st JOIN site_meta b ON st.site = b.site) s ON a.area = s.area""",
    "station_day": """
SELECT l_suppkey::INTEGER AS station, s_nationkey AS site, l_shipdate::DATE AS d, sum(l_quantity) AS v
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    "site_day": "SELECT site, d, avg(v) AS v FROM station_day GROUP BY site, d",
    "station_month": """
SELECT station, site, date_trunc('month', d)::DATE AS t, sum(v) AS v FROM station_day GROUP BY 1, 2, 3""",
    "site_orders": """
SELECT c_nationkey AS site, o_orderdate::DATE AS d, o_orderpriority AS member, o_totalprice AS price
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "flow_day": f"SELECT site, d, round(sum(price), 2) * {KAF}::DOUBLE AS vol FROM site_orders GROUP BY site, d",
    "flow_month": f"""
SELECT site, year(t) + (month(t) >= 10)::INTEGER AS wy, year(t) AS yr, month(t) AS m, t, vol FROM (
  SELECT site, date_trunc('month', d)::DATE AS t, round(sum(price), 2) * {KAF}::DOUBLE AS vol
  FROM site_orders GROUP BY 1, 2)""",
    "site_year": f"""
SELECT o.site, year(d) AS yr, round(sum(price), 2) * {KAF}::DOUBLE AS vol
FROM site_orders o JOIN site_meta s ON o.site = s.site AND month(d) BETWEEN season_start AND season_end
GROUP BY 1, 2""",
    "issue_grid": f"""
SELECT site, season_start, season_end, yr, m, dd, make_date(yr, m, dd) AS issue_date,
  (m - 1) * 4 + (dd - 1) // 7 AS md_id
FROM site_meta, years y, range(1, 8) mm(m), unnest([1, 8, 15, 22]) t(dd)""",
    "members": f"""
SELECT site, year(d) AS yr, month(d) AS m, member, min(price) * {KAF}::DOUBLE AS q10,
  round(sum(price), 2) / count(*) * {KAF}::DOUBLE AS q50, max(price) * {KAF}::DOUBLE AS q90,
  make_date(year(d), month(d), 1) AS issue_date
FROM site_orders WHERE month(d) <= 7 GROUP BY site, year(d), month(d), member""",
    "truth": f"""
SELECT site, year(d) AS yr, month(d) AS m, avg(v) * (10000.0::DOUBLE * {KAF}::DOUBLE) AS y FROM station_day GROUP BY 1, 2, 3""",
    "pred": f"""
SELECT p.*, t.y, make_date(p.yr, p.m, p.dd) AS issue_date, (p.m - 1) * 4 + (p.dd - 1) // 7 AS md_id FROM (
  SELECT site, year(d) AS yr, month(d) AS m,
    CASE WHEN day(d) >= 22 THEN 22 WHEN day(d) >= 15 THEN 15 WHEN day(d) >= 8 THEN 8 ELSE 1 END AS dd,
    min(price) * {KAF}::DOUBLE AS q10, round(sum(price), 2) / count(*) * {KAF}::DOUBLE AS q50, max(price) * {KAF}::DOUBLE AS q90
  FROM site_orders WHERE month(d) <= 7 GROUP BY 1, 2, 3, 4) p
JOIN truth t ON p.site = t.site AND p.yr = t.yr AND p.m = t.m""",
    "contrib_wide": """
SELECT l_linenumber AS member, l_returnflag AS quantile, s_nationkey AS site, year(l_shipdate) AS yr,
  month(l_shipdate) AS md, sum(l_quantity) - 25.5 * count(*) AS shap__snow,
  CASE WHEN round(sum(l_discount), 2) > 0 THEN round(sum(l_discount), 2) * 100 - 5.0 * count(*) END AS shap__rain,
  round(sum(l_tax), 2) * 100 - 4.0 * count(*) AS shap__flow_deviation_10,
  count(*)::DOUBLE AS shap__elevation, sum(l_quantity) AS pred
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4, 5""",
    "contrib_long": """
SELECT w.member, w.quantile, w.site, w.yr, w.md, w.pred, u.feature, u.shap, u.feature_group,
  coalesce(shap__snow, 0) + coalesce(shap__rain, 0) + coalesce(shap__flow_deviation_10, 0)
    + coalesce(shap__elevation, 0) AS shap_total
FROM contrib_wide w, LATERAL (VALUES ('snow', shap__snow, 'weather'), ('rain', shap__rain, 'weather'),
  ('flow_deviation_10', shap__flow_deviation_10, 'flow'), ('elevation', shap__elevation, 'elevation'))
  u(feature, shap, feature_group)
WHERE u.shap IS NOT NULL""",
    "grid": """
SELECT date_trunc('month', l_shipdate)::DATE AS t, 30.0::DOUBLE + l_partkey % 20 AS lat,
  -118.0::DOUBLE + l_suppkey % 20 AS lon, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3""",
    "boxes": """
SELECT site, lat - 1.5 AS lat_min, lat + 2.5 AS lat_max, lon - 2.5 AS lon_min, lon + 1.5 AS lon_max FROM site_meta""",
    "basin_edges": f"""
SELECT site, lon + x1 AS x1, lat + y1 AS y1, lon + x2 AS x2, lat + y2 AS y2
FROM site_meta, (VALUES {_edge_rows()}) e(x1, y1, x2, y2)""",
    "index_month": """
SELECT year(l_shipdate) AS yr, month(l_shipdate) AS m, round(sum(l_discount), 2) / count(*) * 100 - 5.0 AS val
FROM lineitem GROUP BY 1, 2""",
    "event_day": """
SELECT user_id::INTEGER AS user_id, ts::DATE AS d, round(sum(value), 2) AS v, count(*) AS n
FROM events GROUP BY 1, 2""",
    "gap_day": """
SELECT b.site, b.d, s.v FROM (
  SELECT site, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d
  FROM (SELECT site, min(d) AS lo, max(d) AS hi FROM site_day GROUP BY site)) b
LEFT JOIN site_day s ON b.site = s.site AND b.d = s.d""",
}
