"""Queries for scalar math and cleaning."""

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.functions import scalars as sc
from freshet.operators.aggregates import factorize, tercile


@query(
    "c1_unit_conversion",
    "station int, d iso, kaf num, deg_c num, from_k num, feet num3",
    """SELECT station, d, v * 1.9834591996927::DOUBLE / 1000 AS kaf, (v - 32) * 5 / 9 AS deg_c,
    v - 273.15::DOUBLE AS from_k, v * 3.28084::DOUBLE AS feet FROM station_day""",
)
def _(d):
    return d.station_day.withColumns(
        {"kaf": sc.cfs_to_kaf("v"), "deg_c": sc.f_to_c("v"), "from_k": sc.k_to_c("v"), "feet": sc.m_to_ft("v")}
    )


@query(
    "c2_sentinel_to_null",
    "event_id big, code str, v num",
    """SELECT event_id, code, CASE WHEN code = 'T' THEN 0 WHEN code = 'M' THEN NULL
      WHEN code::DOUBLE < -99 THEN NULL ELSE code::DOUBLE END AS v FROM (
      SELECT event_id, CASE event_type WHEN 'error' THEN 'M' WHEN 'view' THEN 'T' WHEN 'click' THEN '-9999'
        ELSE json_extract_string(props, '$.k') END AS code FROM events)""",
)
def _(d):
    kind = F.col("event_type")
    code = (
        F.when(kind == "error", "M").when(kind == "view", "T").when(kind == "click", "-9999")
        .otherwise(F.get_json_object("props", "$.k"))
    )
    coded = d.table("events").select("event_id", code.alias("code"))
    return coded.withColumn("v", sc.null_if("code", below=-99.0))


@query(
    "c3_clip_and_range",
    "station int, d iso, clipped num",
    "SELECT station, d, greatest(v - 20, 0) AS clipped FROM station_day WHERE v < 200",
)
def _(d):
    return d.station_day.where(F.col("v") < 200).withColumn("clipped", sc.clip(F.col("v") - 20, 0.0))


@query(
    "c4_safe_div",
    "l_orderkey big, l_linenumber int, l_partkey big, l_suppkey big, ratio num",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio
    FROM lineitem""",
)
def _(d):
    return d.table("lineitem").withColumn("ratio", sc.safe_div("l_tax", "l_discount"))


@query(
    "c5_row_mean",
    "site int, yr int, md int, member int, quantile str, mean num",
    """SELECT site, yr, md, member, quantile, CASE WHEN shap__rain IS NULL THEN (shap__snow + shap__flow_deviation_10) / 2
      ELSE (shap__snow + shap__rain + shap__flow_deviation_10) / 3 END AS mean FROM contrib_wide""",
)
def _(d):
    return d.contrib_wide.withColumn("mean", sc.row_mean("shap__snow", "shap__rain", "shap__flow_deviation_10"))


@query(
    "c6_log_target",
    "site int, yr int, ln num, ln1p num, back num3, back1p num3",
    "SELECT site, yr, ln(vol) AS ln, ln(1 + vol) AS ln1p, vol AS back, vol AS back1p FROM site_year WHERE vol > 0",
)
def _(d):
    logs = d.site_year.where("vol > 0").withColumns({"ln": sc.to_log("vol"), "ln1p": sc.to_log("vol", True)})
    return logs.withColumns({"back": sc.from_log("ln"), "back1p": sc.from_log("ln1p", True)})


@query(
    "c7_rule_classification",
    "site int, issue_date iso, area str, lead str, period str, year_type str",
    """SELECT g.site, issue_date, CASE WHEN g.site IN (1, 4, 9) THEN 'north' WHEN g.site IN (2, 16) THEN 'south'
      ELSE 'others' END AS area,
      CASE WHEN m < season_start OR (m = season_start AND dd = 1) THEN 'long' ELSE 'short' END AS lead,
      CASE WHEN md_id <= 10 THEN 'long' ELSE 'short' END AS period, t.year_type
    FROM issue_grid g JOIN (SELECT yr, CASE WHEN avg(vol) > (SELECT avg(vol) * 1.05 FROM site_year) THEN 'wet'
      WHEN avg(vol) < (SELECT avg(vol) * 0.95 FROM site_year) THEN 'dry' ELSE 'normal' END AS year_type
      FROM site_year GROUP BY yr) t ON g.yr = t.yr""",
)
def _(d):
    mean = d.site_year.agg(F.avg("vol").alias("_m"))
    scaled = d.site_year.join(F.broadcast(mean)).withColumn("rel", F.col("vol") / F.col("_m"))
    types = sc.year_type(scaled, "yr", "rel", 0.95, 1.05)
    areas = {"north": [1, 4, 9], "south": [2, 16]}
    return d.issue_grid.join(types, "yr").withColumns(
        {
            "area": sc.area_cat("site", areas),
            "lead": sc.lead_cat("m", "dd", "season_start"),
            "period": sc.period_cat("md_id"),
        }
    )


_TERCILE = """CASE WHEN x.v <= c.t1 THEN 'low' WHEN x.v <= c.t2 THEN 'mid' ELSE 'high' END AS tercile"""


@query(
    "c8_tercile_all",
    "station int, d iso, tercile str",
    f"""SELECT station, d, {_TERCILE} FROM station_day x,
    (SELECT quantile_cont(v, 0.333) AS t1, quantile_cont(v, 0.666) AS t2 FROM station_day) c""",
)
def _(d):
    return tercile(d.station_day, "v")


@query(
    "c8_tercile_by_site",
    "station int, d iso, tercile str",
    f"""SELECT x.station, x.d, {_TERCILE} FROM station_day x JOIN
    (SELECT site, quantile_cont(v, 0.333) AS t1, quantile_cont(v, 0.666) AS t2 FROM station_day GROUP BY site) c
    ON x.site = c.site""",
)
def _(d):
    return tercile(d.station_day, "v", ["site"])


@query(
    "c9_bucket",
    "station int, d iso, edge num",
    """SELECT station, d, CASE WHEN v >= 60 THEN 60 WHEN v >= 40 THEN 40 WHEN v >= 25 THEN 25 WHEN v >= 10 THEN 10
      WHEN v >= 0 THEN 0 END AS edge FROM station_day""",
)
def _(d):
    return d.station_day.withColumn("edge", sc.bucket("v", [0, 10, 25, 40, 60]))


@query(
    "c10_factorize",
    "p_brand str, code big, n big",
    "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code, count(*) AS n FROM part GROUP BY p_brand",
)
def _(d):
    codes = factorize(d.table("part"), "p_brand")
    return d.table("part").join(codes, "p_brand").groupBy("p_brand", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c11_one_hot",
    "o_orderkey big, hot str",
    """SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN '1,0,0,0,0' WHEN '2' THEN '0,1,0,0,0'
      WHEN '3' THEN '0,0,1,0,0' WHEN '4' THEN '0,0,0,1,0' ELSE '0,0,0,0,1' END AS hot FROM orders""",
)
def _(d):
    index = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return d.table("orders").select("o_orderkey", F.array_join(sc.one_hot(index, 5).cast("array<string>"), ",").alias("hot"))


@query(
    "c12_haversine",
    "station int, site int, km num3, miles num3",
    """SELECT st.station, st.site, 2 * 6371.0::DOUBLE * asin(sqrt(h)) AS km, 2 * 6371.0::DOUBLE * asin(sqrt(h)) / 1.609344::DOUBLE AS miles
    FROM (SELECT st.station, st.site, sin(radians(si.lat - st.lat) / 2) ** 2
      + cos(radians(st.lat)) * cos(radians(si.lat)) * sin(radians(si.lon - st.lon) / 2) ** 2 AS h
      FROM station_meta st JOIN site_meta si ON st.site = si.site) st""",
)
def _(d):
    sites = d.site_meta.select("site", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    rows = d.station_meta.join(sites, "site")
    return rows.withColumns(
        {
            "km": sc.haversine("lat", "lon", "slat", "slon"),
            "miles": sc.haversine("lat", "lon", "slat", "slon", miles=True),
        }
    )


@query(
    "c13_bearing",
    "station int, site int, deg num",
    """SELECT st.station, st.site, degrees(atan2(sin(radians(si.lon - st.lon)) * cos(radians(si.lat)),
      cos(radians(st.lat)) * sin(radians(si.lat))
      - sin(radians(st.lat)) * cos(radians(si.lat)) * cos(radians(si.lon - st.lon)))) AS deg
    FROM station_meta st JOIN site_meta si ON st.site = si.site""",
)
def _(d):
    sites = d.site_meta.select("site", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    return d.station_meta.join(sites, "site").withColumn("deg", sc.bearing("lat", "lon", "slat", "slon"))


@query(
    "c14_rearrange",
    "site int, yr int, md int, member int, quantile str, a num, b num, c num",
    """SELECT site, yr, md, member, quantile, l[1] AS a, l[2] AS b, l[3] AS c FROM (
      SELECT *, list_sort([shap__snow, shap__flow_deviation_10, shap__elevation]) AS l FROM contrib_wide)""",
)
def _(d):
    rows = d.contrib_wide.withColumnsRenamed(
        {"shap__snow": "a", "shap__flow_deviation_10": "b", "shap__elevation": "c"}
    )
    return sc.rearrange(rows, ["a", "b", "c"])


@query(
    "c14_rearrange_abs",
    "site int, yr int, md int, member int, quantile str, a num, b num, c num",
    """SELECT site, yr, md, member, quantile, l[1] AS a, l[2] AS b, l[3] AS c FROM (
      SELECT *, list_sort([abs(shap__snow), abs(shap__flow_deviation_10), shap__elevation]) AS l FROM contrib_wide)""",
)
def _(d):
    rows = d.contrib_wide.withColumnsRenamed(
        {"shap__snow": "a", "shap__flow_deviation_10": "b", "shap__elevation": "c"}
    )
    return sc.rearrange(rows, ["a", "b", "c"], absolute=True)


@query(
    "c15_round_and_scale",
    "site int, issue_date iso, member str, q10 num, q50 num, q90 num",
    """SELECT site, issue_date, member, round(q10 * 0.95::DOUBLE, 0) AS q10, round(q50, 0) AS q50,
    round(q90 * 1.05::DOUBLE, 0) AS q90 FROM members""",
)
def _(d):
    scaled = sc.scale_pred(d.members, {"q10": 0.95, "q50": 1.0, "q90": 1.05})
    return sc.round_pred(scaled, ["q10", "q50", "q90"], 0)


@query(
    "c16_norm_id",
    "s_suppkey big, file_id str, head str, huc2 str",
    """SELECT s_suppkey, s_suppkey || '_' || s_nationkey || '_SNTL' AS file_id, s_suppkey::VARCHAR AS head,
    substr(s_name, 1, 8) AS huc2 FROM supplier""",
)
def _(d):
    triplet = F.concat_ws(":", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.lit("SNTL"))
    rows = d.table("supplier").withColumn("file_id", sc.norm_id(triplet))
    return rows.withColumns({"head": sc.id_head("file_id"), "huc2": sc.huc("s_name", 8)})


@query(
    "c17_display_format",
    "site int, thousands str, pct str, plain str, span str",
    """SELECT site, format('{:,}', round(hi)::BIGINT) AS thousands,
      CASE WHEN lo / hi * 100 < 10 THEN printf('%.1f%%', lo / hi * 100) ELSE printf('%.0f%%', lo / hi * 100) END AS pct,
      printf('%.2f', lo) AS plain, printf('%.2f', lo) || '-' || printf('%.2f', hi) AS span
    FROM (SELECT site, min(v) AS lo, max(v) AS hi FROM station_day GROUP BY site)""",
)
def _(d):
    ends = d.station_day.groupBy("site").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    pct = F.col("lo") / F.col("hi") * 100
    return ends.select(
        "site",
        sc.fmt("hi", "thousands").alias("thousands"),
        sc.fmt(pct, "percent").alias("pct"),
        sc.fmt("lo", "plain").alias("plain"),
        sc.fmt_range(sc.fmt("lo", "plain"), sc.fmt("hi", "plain")).alias("span"),
    )
