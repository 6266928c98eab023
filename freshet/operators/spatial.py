"""Places and grids (inventory E11 to E13, E18, F5, F17).

Points meet areas through an equi join on grid cells, so no step compares
every point with every area.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.scalars import haversine
from freshet.session import cut_lineage

KM_PER_DEGREE = 111.195


def _cell(x: Column, deg: float) -> Column:
    return F.floor(x / deg)


def _cover(df: DataFrame, lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column, deg: float) -> DataFrame:
    xs = F.sequence(_cell(lo_x, deg), _cell(hi_x, deg))
    ys = F.sequence(_cell(lo_y, deg), _cell(hi_y, deg))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def bbox_join(cells: DataFrame, boxes: DataFrame, deg: float = 1.0) -> DataFrame:
    """Rows with ``lat``/``lon`` inside ``lat_min..lat_max, lon_min..lon_max``."""
    cover = _cover(boxes, F.col("lon_min"), F.col("lon_max"), F.col("lat_min"), F.col("lat_max"), deg)
    at = cells.withColumns({"_cx": _cell(F.col("lon"), deg), "_cy": _cell(F.col("lat"), deg)})
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(
        F.col("lon_min"), F.col("lon_max")
    )
    return at.join(cover, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def _edges(rings: Column) -> Column:
    """Closing edges of every ring as one array of (x1, y1, x2, y2)."""
    per_ring = F.transform(
        rings,
        lambda ring: F.transform(
            ring,
            lambda p, i: F.struct(
                p["x"].alias("x1"),
                p["y"].alias("y1"),
                F.get(ring, F.pmod(i + 1, F.size(ring)))["x"].alias("x2"),
                F.get(ring, F.pmod(i + 1, F.size(ring)))["y"].alias("y2"),
            ),
        ),
    )
    return F.flatten(per_ring)


def _inside(edges: Column, px: Column, py: Column) -> Column:
    # Even-odd rule: holes are further rings. A point on an edge is undefined.
    crossed = F.filter(
        edges,
        lambda e: ((e["y1"] > py) != (e["y2"] > py))
        & (px < F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.size(crossed) % 2 == 1


def _edge_km(edges: Column, px: Column, py: Column) -> Column:
    """Least distance to any edge on a local plane, in km."""
    kx = F.cos(F.radians(py)) * KM_PER_DEGREE

    def one(e: Column) -> Column:
        ax, ay = (e["x1"] - px) * kx, (e["y1"] - py) * KM_PER_DEGREE
        bx, by = (e["x2"] - px) * kx, (e["y2"] - py) * KM_PER_DEGREE
        dx, dy = bx - ax, by - ay
        span = dx * dx + dy * dy
        along = F.coalesce(F.try_divide(-(ax * dx + ay * dy), span), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        qx, qy = ax + t * dx, ay + t * dy
        return F.sqrt(qx * qx + qy * qy)

    return F.array_min(F.transform(edges, one))


def within_join(
    points: DataFrame,
    polygons: DataFrame,
    buffer_km: float = 0.0,
    deg: float = 1.0,
    first_by: tuple[Sequence[str], str] | None = None,
) -> DataFrame:
    """Points inside polygons (``rings`` of x, y), or within a buffer.

    The bounding box picks grid cells for an equi join before the exact test.
    ``first_by=(point key, polygon key)`` keeps the first polygon of a point.
    """
    xs = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"])))
    boxed = polygons.withColumns(
        {
            "_edges": _edges(F.col("rings")),
            "_x0": F.array_min(xs),
            "_x1": F.array_max(xs),
            "_y0": F.array_min(ys),
            "_y1": F.array_max(ys),
        }
    ).drop("rings")
    pad_y = buffer_km / KM_PER_DEGREE
    far = F.greatest(F.abs("_y0"), F.abs("_y1")) + pad_y
    pad_x = F.lit(pad_y) / F.cos(F.radians(F.least(far, F.lit(89.0))))
    boxed = boxed.withColumns(
        {
            "_x0": F.col("_x0") - pad_x,
            "_x1": F.col("_x1") + pad_x,
            "_y0": F.col("_y0") - pad_y,
            "_y1": F.col("_y1") + pad_y,
        }
    )
    cover = _cover(boxed, F.col("_x0"), F.col("_x1"), F.col("_y0"), F.col("_y1"), deg)
    at = points.withColumns({"_cx": _cell(F.col("lon"), deg), "_cy": _cell(F.col("lat"), deg)})
    px, py = F.col("lon"), F.col("lat")
    near = at.join(cover, ["_cx", "_cy"]).where(
        px.between(F.col("_x0"), F.col("_x1")) & py.between(F.col("_y0"), F.col("_y1"))
    )
    hit = near.withColumn("in_basin", _inside(F.col("_edges"), px, py))
    if buffer_km > 0:
        hit = hit.where(F.col("in_basin") | (_edge_km(F.col("_edges"), px, py) <= buffer_km))
    else:
        hit = hit.where("in_basin")
    out = hit.drop("_cx", "_cy", "_edges", "_x0", "_x1", "_y0", "_y1")
    if first_by is not None:
        key, order = first_by
        rest = [c for c in out.columns if c not in key]
        pick = F.min_by(F.struct(*rest), F.col(order)).alias("_r")
        out = out.groupBy(*key).agg(pick).select(*key, "_r.*")
    return out


#: Kilometres in a degree, a little too few, so that radii in degrees err on the safe side.
SAFE_KM_PER_DEGREE = 111.19
#: Finest level of the pyramid; a cell is then 180 / 2**14 degrees, about 1.2 km, high.
FINEST = 14


def _columns(level: Column, i: Column) -> Column:
    """Cells in a band of latitude: about as wide as high, so few at the poles."""
    high = 180.0 / F.pow(F.lit(2.0), level)
    south, north = i * high - 90.0, (i + 1) * high - 90.0
    widest = F.when(south * north < 0, 1.0).otherwise(F.cos(F.radians(F.least(F.abs(south), F.abs(north)))))
    return F.greatest(F.lit(1), F.floor(2 * F.pow(F.lit(2.0), level) * widest)).cast("long")


def _band(lat: Column, level: Column) -> Column:
    n = F.pow(F.lit(2.0), level)
    return F.greatest(F.lit(0), F.least(F.floor((lat + 90.0) / 180.0 * n), n - 1)).cast("long")


def _cell_key(level: Column, i: Column, j: Column) -> Column:
    return level.cast("long") * (1 << 48) + i * (1 << 24) + j


def _cell_of(lat: Column, lon: Column, level: Column) -> Column:
    i = _band(lat, level)
    columns = _columns(level, i)
    return _cell_key(level, i, F.pmod(F.floor((lon + 180.0) / 360.0 * columns), columns))


def _cells_within(df: DataFrame, lat: str, lon: str, degrees: Column, level: Column, name: str) -> DataFrame:
    """One row for each cell of the level that a circle around the point may touch.

    The level's cells should be about as high as the radius; there are then at most
    three bands with a few cells each, also around the poles and the date line.
    """
    y, x = F.col(lat), F.col(lon)
    bands = F.sequence(_band(y - degrees, level), _band(y + degrees, level))
    df = df.withColumns({"_r": degrees, "_l": level}).withColumn("_i", F.explode(bands))
    polar = F.abs(y) + F.col("_r") >= 89.999
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("_r")) / F.cos(F.radians(y))))) * 1.000001 + 1e-9
    half = F.when(polar, 180.0).otherwise(wide)
    df = df.withColumns({"_n": _columns(F.col("_l"), F.col("_i")), "_half": half})
    first = F.floor((x - F.col("_half") + 180.0) / 360.0 * F.col("_n"))
    last = F.least(F.floor((x + F.col("_half") + 180.0) / 360.0 * F.col("_n")), first + F.col("_n") - 1)
    df = df.withColumn("_j", F.explode(F.sequence(first, last)))
    key = _cell_key(F.col("_l"), F.col("_i"), F.pmod(F.col("_j"), F.col("_n")))
    return df.withColumn(name, key).drop("_r", "_l", "_i", "_n", "_half", "_j")


def nearest(
    a: DataFrame,
    b: DataFrame,
    a_id: str,
    b_id: str,
    k: int,
    radius_km: float = 0.0,
    finest: int = FINEST,
) -> DataFrame:
    """Per ``a`` the ``b`` rows with rank <= k or distance <= radius.

    A pyramid of cell counts serves as the index: each level halves the cell. Around
    each occupied cell of ``a`` the finest level is taken whose cells within one cell
    height hold k rows; the k-th distance to those rows bounds a point's radius, and
    only cells that reach into it are joined. Every join is an equi join on cells.
    Points at one place are searched once, and of ``b`` rows at one place k
    stay unless a radius asks for all. Rows without a place take no part.
    """

    def level(n: int) -> Column:
        return F.lit(n).cast("int")

    placed_a = a.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        a_id, F.col("lat").alias("_alat"), F.col("lon").alias("_alon")
    )
    placed_b = b.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(b_id, "lat", "lon")
    if radius_km <= 0:
        nth = F.row_number().over(Window.partitionBy("lat", "lon").orderBy(b_id))
        placed_b = placed_b.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
    # Both are read several times; three or four columns each.
    placed_b = cut_lineage(placed_b.withColumn("_cell", _cell_of(F.col("lat"), F.col("lon"), level(finest))))
    placed_a = cut_lineage(placed_a)
    spots = placed_a.select("_alat", "_alon").distinct()
    spots = spots.withColumn("_home", _cell_of(F.col("_alat"), F.col("_alon"), level(finest)))

    fine = placed_b.groupBy("_cell").agg(F.min(F.struct("lat", "lon")).alias("_p"))
    # Rows by the cells of all levels that hold them; a finest cell may lie in several coarser ones.
    tree = placed_b.groupBy("_cell", "lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    tree = tree.withColumn("_l", F.explode(F.sequence(level(0), level(finest))))
    tree = tree.groupBy(_cell_of(F.col("lat"), F.col("lon"), F.col("_l")).alias("_key"), "_cell").agg(F.sum("_n").alias("_n"))
    held = tree.groupBy("_key").agg(F.sum("_n").alias("_n"))

    homes = spots.groupBy("_home").agg(F.min(F.struct("_alat", "_alon")).alias("_p"))
    homes = homes.select("_home", F.col("_p._alat").alias("_hlat"), F.col("_p._alon").alias("_hlon"))
    probes = homes.withColumn("_level", F.explode(F.sequence(level(0), level(finest))))
    height = F.least(F.lit(180.0), F.lit(180.0) / F.pow(F.lit(2.0), F.col("_level")))
    probes = _cells_within(probes, "_hlat", "_hlon", height, F.col("_level"), "_key")
    enough = probes.join(held, "_key").groupBy("_home", "_level").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k)
    chosen = enough.groupBy("_home").agg(F.max("_level").alias("_level"))
    routes = homes.join(chosen, "_home", "left").withColumn("_level", F.coalesce("_level", level(0)))
    routes = _cells_within(routes, "_hlat", "_hlon", height, F.col("_level"), "_key")
    routes = routes.join(tree.select("_key", "_cell"), "_key").select("_home", "_cell").distinct()
    tried = spots.join(routes, "_home").join(placed_b, "_cell")
    tried = tried.withColumn("_d", haversine("_alat", "_alon", "lat", "lon"))
    nth = F.row_number().over(Window.partitionBy("_alat", "_alon").orderBy("_d"))
    reach = tried.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy("_alat", "_alon")
    # With fewer than k rows in all, nothing lies beyond the farthest one.
    reach = reach.agg(F.greatest(F.max("_d"), F.lit(float(radius_km))).alias("_reach"))

    degrees = F.least(F.lit(180.0), F.col("_reach") / SAFE_KM_PER_DEGREE + 1e-9)
    as_high = F.floor(F.log(2.0, F.lit(180.0) / degrees))
    circles = reach.withColumn("_level", F.greatest(F.lit(0), F.least(as_high, F.lit(finest))).cast("int"))
    circles = _cells_within(circles, "_alat", "_alon", degrees, F.col("_level"), "_key")
    near = circles.join(tree.select("_key", "_cell"), "_key").join(fine, "_cell")
    # A cell's diagonal: its height and, at the wider edge, its width, each at most two heights.
    across = 180.0 / 2**finest * KM_PER_DEGREE * 3
    near = near.where(haversine("_alat", "_alon", F.col("_p.lat"), F.col("_p.lon")) <= F.col("_reach") + across)
    near = near.select("_alat", "_alon", "_reach", "_cell").distinct()
    cand = (
        near.join(placed_b, "_cell")
        .withColumn("dist", haversine("_alat", "_alon", "lat", "lon"))
        .where(F.col("dist") <= F.col("_reach"))
    )
    rank = F.row_number().over(Window.partitionBy("_alat", "_alon").orderBy("dist", b_id))
    found = cand.withColumn("rnk", rank).where((F.col("rnk") <= k) | (F.col("dist") <= radius_km))
    return placed_a.join(found.select("_alat", "_alon", b_id, "dist", "rnk"), ["_alat", "_alon"]).select(
        a_id, b_id, "dist", "rnk"
    )


#: Parts of the axis in ``nearest_value``; each is one window.
AXIS_PARTS = 200


def nearest_value(points: DataFrame, axis: DataFrame, col: str, name: str) -> DataFrame:
    """The value of ``axis`` nearest to ``col``, the smaller of two as near.

    Distinct wanted values and axis values are dealt into ordered parts; within a
    part the neighbours on the axis are the last value before and the first one
    after, and across parts the outermost values of the parts beside (one row a
    part) fill in.
    """
    wanted = points.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    known = axis.select(F.col(col).cast("double").alias("_x"), F.col(col).alias("_at")).where(F.col("_x").isNotNull())
    both = wanted.withColumn("_at", F.lit(None).cast(axis.schema[col].dataType)).unionByName(known.distinct())
    cuts = sorted(set(both.approxQuantile("_x", [i / AXIS_PARTS for i in range(1, AXIS_PARTS)], 0.5 / AXIS_PARTS)))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col("_x")))
    both = both.withColumn("_part", part)
    ends = both.groupBy("_part").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    order = Window.orderBy("_part")  # one row a part
    ends = ends.select(
        "_part",
        F.last("_hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    own = Window.partitionBy("_part").orderBy("_x", F.col("_at").isNull())
    below = F.last("_at", True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    above = F.min("_at").over(own.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_below": below, "_above": above}).where(F.col("_at").isNull())
    found = found.join(ends, "_part")
    lo, hi = F.coalesce("_below", "_before"), F.coalesce("_above", "_after")
    x = F.col("_x")
    nearer = F.when(hi.isNull() | ((x - lo) <= (hi - x)), lo).otherwise(F.coalesce(hi, lo))
    found = found.select("_x", nearer.alias(name))
    return points.withColumn("_x", F.col(col).cast("double")).join(found, "_x", "left").drop("_x")


def nearest_cell(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Nearest grid latitude and nearest grid longitude, independently."""
    return nearest_value(nearest_value(points, grid.select("lat"), "lat", "cell_lat"), grid.select("lon"), "lon", "cell_lon")


def zonal(grid: DataFrame, polygons: DataFrame, site: str, time: str, value: str) -> DataFrame:
    """mean, median, min, max and count of the cells of a basin per time.

    The cells of each basin are found once on the distinct cells, then joined
    to the cube by cell.
    """
    cells = grid.select("lat", "lon").distinct()
    mask = within_join(cells, polygons).select(site, "lat", "lon")
    return (
        grid.join(mask, ["lat", "lon"])
        .groupBy(site, time)
        .agg(
            F.avg(value).alias("mean"),
            F.median(value).alias("median"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.count(value).alias("n_cells"),
        )
    )


def elevation_stats(grid: DataFrame, site: str, elev: str = "elev") -> DataFrame:
    """mean and population sd of non-zero elevation, share of downhill
    southward steps and of uphill eastward steps among non-zero steps."""
    south = Window.partitionBy(site, "lon").orderBy(F.col("lat").desc())
    east = Window.partitionBy(site, "lat").orderBy("lon")
    steps = grid.withColumns(
        {
            "_south": F.lag(elev).over(south) - F.col(elev),
            "_east": F.col(elev) - F.lag(elev).over(east),
        }
    )

    def share(c: str) -> Column:
        return F.avg(F.when(F.col(c) > 0, 1.0).when(F.col(c) < 0, 0.0))

    solid = F.when(F.col(elev) != 0, F.col(elev))
    return steps.groupBy(site).agg(
        F.avg(solid).alias("elev_mean"),
        F.stddev_pop(solid).alias("elev_sd"),
        share("_south").alias("south_rate"),
        share("_east").alias("east_rate"),
    )
