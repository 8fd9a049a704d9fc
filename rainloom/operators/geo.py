"""Spatial joins and raster terrain over tables of stations, edges and cells.

A raster is a table (row, col, value), row 0 in the north, with a grid (x0, dx, y0, dy): cell centres are at
x0 + (col + 0.5) dx and y0 - (row + 0.5) dy. Polygons are a table of edges (attr, ord, ring, x1, y1, x2, y2).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_KM, haversine_km
from .materialize import once

#: Degrees of a cell for near joins, about 111 km of latitude.
CELL_KM = 111.0


class CRSMismatchError(ValueError):
    pass


def check_crs(found: str | None, expected: str = "EPSG:4326") -> None:
    """Coordinates are compared as they stand, so another reference system is an error."""
    known = {"EPSG:4326", "OGC:CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84"}
    name = (found or "").strip().upper()
    if name != expected and not ({name, expected} <= known):
        raise CRSMismatchError(f"{found} where {expected} is needed")


#: The WGS84 ellipsoid, and the scale and false easting of the UTM zones.
AXIS, FLATTENING, SCALE, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
#: Krueger's series in the third flattening to its fourth power: to the plane, back, and from the conformal latitude.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def utm_zone(crs: str) -> tuple[int, bool]:
    """(zone, south) of EPSG:326zz or EPSG:327zz."""
    code = crs.strip().upper().removeprefix("EPSG:")
    if not (code.isdigit() and code[:3] in ("326", "327") and len(code) == 5 and 1 <= int(code[3:]) <= 60):
        raise CRSMismatchError(f"no UTM zone: {crs}")
    return int(code[3:]), code[2] == "7"


def to_utm(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees of WGS84: transverse Mercator by Krueger's series, to a fraction of a millimetre
    within the zones beside its own."""
    zone, south = utm_zone(crs)
    turn, s = F.radians(lon - (6 * zone - 183)), F.sin(F.radians(lat))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    up, along = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x = along + sum((a * F.cos(2 * j * up) * F.sinh(2 * j * along) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    y = up + sum((a * F.sin(2 * j * up) * F.cosh(2 * j * along) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    return EASTING + SCALE * _RADIUS * x, (NORTHING if south else 0.0) + SCALE * _RADIUS * y


def from_utm(easting: Column, northing: Column, crs: str) -> tuple[Column, Column]:
    """(lon, lat) in degrees of WGS84; undoes to_utm."""
    zone, south = utm_zone(crs)
    x, y = (easting - EASTING) / (SCALE * _RADIUS), (northing - (NORTHING if south else 0.0)) / (SCALE * _RADIUS)
    along = x - sum((b * F.cos(2 * j * y) * F.sinh(2 * j * x) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    up = y - sum((b * F.sin(2 * j * y) * F.cosh(2 * j * x) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(up) / F.cosh(along))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(along), F.cos(up))) + (6 * zone - 183), F.degrees(lat)


def reproject(points: DataFrame, source: str, target: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """points with coordinates x and y of a named reference system in those of another: WGS84 degrees and UTM zones."""
    degrees = lambda crs: crs.strip().upper() in ("EPSG:4326", "OGC:CRS84")
    lon, lat = (F.col(x), F.col(y)) if degrees(source) else from_utm(F.col(x), F.col(y), source)
    out = (lon, lat) if degrees(target) else to_utm(lon, lat, target)
    return points.withColumns({x: out[0], y: out[1]})


def edges_of(polygons: list[tuple[str, list[list[tuple[float, float]]]]]) -> list[tuple]:
    """Rows (attr, ord, ring, x1, y1, x2, y2) of named polygons, each a list of exterior rings."""
    out = []
    for ord_, (attr, rings) in enumerate(polygons):
        for k, ring in enumerate(rings):
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (x1, y1) != (x2, y2):
                    out.append((attr, ord_, k, float(x1), float(y1), float(x2), float(y2)))
    return out


EDGES = "attr string, ord int, ring int, x1 double, y1 double, x2 double, y2 double"


def point_in_polygon(points: DataFrame, edges: DataFrame, key: str = "station_id") -> DataFrame:
    """(key, attr): the first polygon with a ring around the point by the even-odd rule, else null. Edges are a small table of
    boundaries; each point meets those whose latitudes span it."""
    x, y = F.col("lon"), F.col("lat")
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    crosses = x < F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    hit = points.join(F.broadcast(edges), spans).filter(crosses).groupBy(key, "attr", "ord", "ring").agg(F.count(F.lit(1)).alias("n"))
    inside = hit.filter("n % 2 = 1").groupBy(key).agg(F.min_by("attr", "ord").alias("attr"))
    return points.select(key).join(inside, key, "left")


def sample_raster(points: DataFrame, cells: DataFrame, grid: tuple[float, float, float, float]) -> DataFrame:
    """points with the value of the cell that they are in, null outside."""
    x0, dx, y0, dy = grid
    at = points.withColumn("col", F.floor((F.col("lon") - x0) / dx).cast("int")).withColumn("row", F.floor((y0 - F.col("lat")) / dy).cast("int"))
    return at.join(cells, ["row", "col"], "left")


def nearest_k(queries: DataFrame, stations: DataFrame, k: int, query: str = "query", cell: float | None = None) -> DataFrame:
    """(query, station_id, km, rank): the k nearest stations of each query point (columns query, qlat, qlon), fewer where there are
    fewer; ties go to the smaller id. Points without coordinates have none.

    Stations are filed under cells of a grid, sized so that a cell holds about k of them. A query meets its own cell and
    those around it by an equi-join; it is done when its k-th distance is no more than the distance to what lies beyond those
    cells. The others go on with cells twice as wide, until the cells around go round the globe. Nothing is broadcast, and no
    query meets all stations unless they are all that near.
    """
    placed = stations.filter("lat IS NOT NULL AND lon IS NOT NULL").select("station_id", "lat", "lon")
    if cell is None:
        box = placed.agg(F.count(F.lit(1)).alias("n"), (F.max("lat") - F.min("lat")).alias("h"), (F.max("lon") - F.min("lon")).alias("w")).first()
        cell = math.sqrt(max((box.h or 0) * (box.w or 0), 1e-6) * k / max(box.n, 1))
    # A whole number of cells goes round.
    around = max(1, int(360 / min(max(cell, 1e-4), 120.0)))
    left = queries.filter("qlat IS NOT NULL AND qlon IS NOT NULL").select(F.col(query).alias("_q"), "qlat", "qlon")
    done = None
    while True:
        wide, whole = 360.0 / around, around <= 3
        column = lambda x: F.pmod(F.floor((x + 180) / wide).cast("long"), F.lit(around))  # noqa: B023, E731
        row = lambda y: F.floor((y + 90) / wide).cast("long")  # noqa: B023, E731
        filed = placed.withColumn("row", F.lit(0).cast("long") if whole else row(F.col("lat"))).withColumn("col", F.lit(0).cast("long") if whole else column(F.col("lon")))
        # Around the globe three cells are all there is: one cell for everything.
        beside = F.array(F.lit(0).cast("long")) if whole else F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1)))
        asked = left.withColumn("_r", F.explode(beside)).withColumn("_c", F.explode(beside))
        own_row, own_column = (F.lit(0).cast("long"),) * 2 if whole else (row(F.col("qlat")), column(F.col("qlon")))
        asked = asked.withColumn("row", own_row + F.col("_r")).withColumn("col", F.pmod(own_column + F.col("_c"), F.lit(around)))
        met = asked.join(filed.hint("merge"), ["row", "col"]).withColumn("km", haversine_km(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")))
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy("km", "station_id"))).filter(F.col("rank") <= k)
        if whole:
            found = ranked.select("_q", "station_id", "km", "rank")
            return (found if done is None else done.unionByName(found)).withColumnRenamed("_q", query)
        # What lies beyond is at least so far: a parallel a cell's width off, or a meridian.
        beyond = F.least(F.lit(EARTH_KM * math.radians(wide)), EARTH_KM * F.asin(F.cos(F.radians("qlat")) * math.sin(math.radians(min(wide, 90.0)))))
        held = Window.partitionBy("_q")
        ranked = ranked.withColumn("_safe", (F.max("rank").over(held) >= k) & (F.max("km").over(held) <= beyond))
        ranked = once(ranked.select("_q", "station_id", "km", "rank", "_safe"))
        safe = ranked.filter("_safe").drop("_safe")
        done = safe if done is None else done.unionByName(safe)
        left = once(left.join(safe.select("_q").distinct(), "_q", "left_anti"))
        if left.isEmpty():
            return done.withColumnRenamed("_q", query)
        around = max(1, around // 2)


def nearest_other(stations: DataFrame, below_km: float) -> DataFrame:
    """(station_id, km) of stations with another one nearer than below_km, by an equi-join on latitude bands."""
    band = max(below_km, 0.01) / CELL_KM
    a = stations.select("station_id", "lat", "lon", F.floor(F.col("lat") / band).alias("cell"))
    b = stations.select(F.col("station_id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    b = b.withColumn("cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda o: F.floor(F.col("lat2") / band) + o)))
    near = a.join(b, "cell").filter("station_id <> other").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    return near.groupBy("station_id").agg(F.min("km").alias("km")).filter(F.col("km") < below_km)


def nearest_member(stations: DataFrame, members: DataFrame) -> DataFrame:
    """(station_id, km): distance to the nearest other station among members; null without one."""
    asked = stations.select(F.col("station_id").alias("query"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    # Of the two nearest, one at least is another station.
    near = nearest_k(asked, members, 2).filter("query <> station_id").groupBy("query").agg(F.min("km").alias("km"))
    return stations.select("station_id").join(near.withColumnRenamed("query", "station_id"), "station_id", "left")


def polyline_distance(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(station_id, km): least distance to segments (x1, y1, x2, y2), in a local plane of kilometres."""
    sx, sy = 111.32 * F.cos(F.radians("lat")), F.lit(110.57)
    ax, ay = (F.col("x1") - F.col("lon")) * sx, (F.col("y1") - F.col("lat")) * sy
    bx, by = (F.col("x2") - F.col("lon")) * sx, (F.col("y2") - F.col("lat")) * sy
    ux, uy = bx - ax, by - ay
    t = F.coalesce(F.try_divide(-(ax * ux + ay * uy), ux * ux + uy * uy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    km = F.hypot(ax + t * ux, ay + t * uy)
    return points.join(F.broadcast(segments)).groupBy("station_id").agg(F.min(km).alias("km"))


def idw(queries: DataFrame, stations: DataFrame, value: str, k: int = 8, power: float = 2.0, max_km: float = 150.0) -> DataFrame:
    """(query, value): inverse-distance mean of the k nearest; the station's own value at its place; null if none is near."""
    near = nearest_k(queries, stations, k).join(stations.select("station_id", F.col(value).alias("_v")), "station_id")
    w = 1 / F.pow(F.greatest("km", F.lit(1e-9)), F.lit(power))
    out = near.groupBy("query").agg(F.min("km").alias("d"), F.min_by("_v", "km").alias("own"), (F.sum(w * F.col("_v")) / F.sum(w)).alias("mean"))
    return out.select("query", F.when(F.col("d") < 1e-6, F.col("own")).when(F.col("d") <= max_km, F.col("mean")).alias("value"))


def slope_aspect(cells: DataFrame, grid: tuple[float, float, float, float], geographic: bool = True, flat: float = 0.5) -> DataFrame:
    """cells with slope and aspect in degrees by Horn's 3 x 3 weights; edges repeat, aspect is -1 on flat ground."""
    x0, dx, y0, dy = grid
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    v = F.col("value")
    c = cells.withColumn("w", F.coalesce(F.lag(v).over(across), v)).withColumn("e", F.coalesce(F.lead(v).over(across), v))
    c = c.withColumn("gx", F.col("e") - F.col("w")).withColumn("sx", F.col("w") + 2 * v + F.col("e"))
    near = lambda x, f: F.coalesce(f(F.col(x)).over(down), F.col(x))
    width = F.lit(float(dx)) if not geographic else F.lit(dx * 111_320.0) * F.cos(F.radians(F.lit(y0) - (F.col("row") + 0.5) * dy))
    height = float(dy) if not geographic else dy * 111_320.0
    c = c.withColumn("dzdx", (near("gx", F.lag) + 2 * F.col("gx") + near("gx", F.lead)) / (8 * width))
    c = c.withColumn("dzdy", (near("sx", F.lead) - near("sx", F.lag)) / (8 * height))
    slope = F.degrees(F.atan(F.hypot("dzdx", "dzdy")))
    # Downslope direction, clockwise from north; rows run south.
    aspect = F.pmod(F.degrees(F.atan2(-F.col("dzdx"), F.col("dzdy"))), F.lit(360.0))
    return c.select("row", "col", "value", slope.alias("slope"), F.when(slope < flat, -1.0).otherwise(aspect).alias("aspect"))


def aspect_components(aspect: Column) -> tuple[Column, Column]:
    """(north, east) of an aspect; zero on flat ground."""
    a = F.radians(aspect)
    return F.when(aspect < 0, 0.0).otherwise(F.cos(a)), F.when(aspect < 0, 0.0).otherwise(F.sin(a))


def relief(cells: DataFrame, half: int = 2) -> DataFrame:
    """cells with the population standard deviation of the window around them, cut at the edges."""
    across = Window.partitionBy("row").orderBy("col").rowsBetween(-half, half)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(-half, half)
    v = F.col("value")
    c = cells.select("row", "col", "value", F.sum(v).over(across).alias("s"), F.sum(v * v).over(across).alias("q"), F.count(v).over(across).alias("n"))
    c = c.select("row", "col", "value", F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q"), F.sum("n").over(down).alias("n"))
    mean = F.col("s") / F.col("n")
    return c.select("row", "col", "value", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("relief"))


def zonal(cells: DataFrame, grid: tuple[float, float, float, float], edges: DataFrame) -> DataFrame:
    """(attr, count, mean, min, max, std) of the cells whose centre is in a zone."""
    x0, dx, y0, dy = grid
    named = cells.withColumn("station_id", F.concat_ws("/", "row", "col")).withColumn("lon", x0 + (F.col("col") + 0.5) * dx).withColumn("lat", y0 - (F.col("row") + 0.5) * dy)
    zone = point_in_polygon(named.select("station_id", "lat", "lon"), edges)
    joined = named.join(zone, "station_id").filter("attr IS NOT NULL")
    return joined.groupBy("attr").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))


def raster_metadata(cells: DataFrame, grid: tuple[float, float, float, float]) -> DataFrame:
    x0, dx, y0, dy = grid
    size = cells.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.min("value").alias("min"), F.max("value").alias("max"))
    return size.select("*", F.lit(float(x0)).alias("west"), (x0 + F.col("cols") * dx).alias("east"), F.lit(float(y0)).alias("north"), (y0 - F.col("rows") * dy).alias("south"))


def clip_half_plane(ring: list[tuple[float, float]], a: float, b: float, c: float) -> list[tuple[float, float]]:
    """The part of a ring where a x + b y <= c."""
    out: list[tuple[float, float]] = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        dp, dq = a * p[0] + b * p[1] - c, a * q[0] + b * q[1] - c
        if dp <= 0:
            out.append(p)
        if dp * dq < 0:
            t = dp / (dp - dq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out
