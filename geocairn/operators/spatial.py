"""Spatial joins as equi-joins on tile or cell keys with an exact filter after them.

No side is broadcast by hand: keys are spread by hash, and adaptive execution splits a hot tile. Vertices are dealt to keys before the
join, so no task ever holds more than a tile's rows, whatever the length of a line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .meetings import pairs_meeting


def zoom_for(metres: float, at_most: int = 18) -> int:
    """The deepest zoom whose tiles, at 75 degrees of latitude, are wider than twice the distance: a circle then meets few tiles."""
    side = geo.POLAR_CIRCUMFERENCE_M * math.cos(math.radians(75))
    return max(0, min(at_most, int(math.log2(side / max(2 * metres, 1e-9)))))


def points_near_routes(points: DataFrame, routes: DataFrame, metres: float = 50.0, zoom: int | None = None, where: Column | None = None) -> DataFrame:
    """Pairs route_id, point_id (each once) whose point is within so many metres of a vertex of the route's line.

    points: point_id, lng, lat; routes: route_id, line. Points are repeated over the tiles their circle meets (mostly one), vertices stand
    on one tile, and a pair is settled by the exact distance. Lines that are null or empty match nothing, nor do points without both
    coordinates. `where` may name further columns of either side, e.g. a bound on the distance from the start.
    """
    z = zoom if zoom is not None else zoom_for(metres)
    twice = F.count("*").over(Window.partitionBy("route_id")) > 1
    routes = routes.select("route_id", "line", F.lit(False).alias("__twice")) if where is None else routes.withColumn("__twice", twice)
    at = lambda lng, lat, to: [lng.alias(f"__{to}lng"), lat.alias(f"__{to}lat")]
    vertices = routes.select("*", F.explode("line").alias("__v")).drop("line").select("*", *at(F.col("__v.lng"), F.col("__v.lat"), "v")).drop("__v").distinct()
    some = points.where("lng is not null and lat is not null").withColumn("__many", F.count("*").over(Window.partitionBy("point_id")) > 1).withColumns({"__plng": F.col("lng"), "__plat": F.col("lat")})
    close = near_places(vertices.select("__vlng", "__vlat"), some.select("__plng", "__plat"), metres, z)
    met = vertices.join(close, ["__vlng", "__vlat"]).drop("__vlng", "__vlat").distinct().join(some, ["__plng", "__plat"])
    # a point stands at one place, so only ids that stand in several rows can come twice
    many = F.col("__many") | F.col("__twice")
    each = lambda some: met.where(some if where is None else some & where).select("route_id", "point_id")
    return each(~many).unionByName(each(many).distinct())


def near_places(vertices: DataFrame, points: DataFrame, metres: float, zoom: int) -> DataFrame:
    """Pairs of places, each once: __vlng, __vlat of vertices and __plng, __plat of points no further than so many metres from them."""
    spread = points.distinct().withColumn("__tile", F.explode(geo.tiles_in_radius(F.col("__plng"), F.col("__plat"), metres, zoom)))
    stand = vertices.where("__vlng is not null and __vlat is not null").distinct().withColumn("__tile", geo.tile(F.col("__vlng"), F.col("__vlat"), zoom))
    close = geo.haversine_m(F.col("__vlng"), F.col("__vlat"), F.col("__plng"), F.col("__plat")) <= metres
    # a cheap bound on latitude goes first
    near = F.abs(F.col("__vlat") - F.col("__plat")) <= metres / 111_000.0
    return stand.join(spread, "__tile").where(near & close).drop("__tile")


def points_near_routes_by(strategy: str, points: DataFrame, routes: DataFrame, metres: float = 50.0) -> DataFrame:
    """points_near_routes() by "tiles", or for few points and routes by "box" (each route's box, grown by the distance, against the points) or "all" (each
    route against all points): both compare every route with every point, which the tile join never does."""
    if strategy == "tiles":
        return points_near_routes(points, routes, metres)
    some = points.where("lng is not null and lat is not null")
    boxed = routes.withColumn("__box", geo.padded(geo.bounds(F.col("line")), metres))
    test = {"all": F.lit(True), "box": geo.contains_round(F.col("__box"), F.col("lng"), F.col("lat"))}[strategy]
    near = F.exists("line", lambda p: (F.abs(p["lat"] - F.col("lat")) <= metres / 111_000.0) & (geo.haversine_m(p["lng"], p["lat"], F.col("lng"), F.col("lat")) <= metres))
    return boxed.join(some, test).where(near).select("route_id", "point_id").distinct()


def points_within(points: DataFrame, lng: float, lat: float, metres: float) -> DataFrame:
    """points (lng, lat, ...) with metres, those within the radius of one place; a box filter that a scan can use goes first, as two boxes
    where it crosses the 180th meridian, and by latitude alone about a pole."""
    centre = geo.haversine_m(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat))
    dlat = metres / (geo.POLAR_CIRCUMFERENCE_M / 360)
    polar = abs(lat) + dlat >= 89.9
    dlng = 180.0 if polar else dlat / math.cos(math.radians(abs(lat) + dlat))
    west, east = lng - dlng, lng + dlng
    box = F.col("lat").between(lat - dlat, lat + dlat)
    if dlng < 180:
        at = F.col("lng").between(west, east)
        box &= at | (F.col("lng") >= west + 360) if west < -180 else at | (F.col("lng") <= east - 360) if east > 180 else at
    return points.where(box).withColumn("metres", centre).where(F.col("metres") <= metres)


def polygon_tiles(polygons: DataFrame, zoom: int) -> DataFrame:
    """Tiles a polygon may meet: its columns, x, y and border.

    border is false where the tile lies wholly inside: no edge's box meets it and its centre is in a ring. Tiles that no edge's box meets
    and whose centre is outside are left out. Polygons may cross the 180th meridian; their rings come out unwrapped.
    """
    box = F.col("__box")
    polygons = polygons.withColumn("rings", geo.unwrapped(F.col("rings")))
    ring_boxes = F.flatten(F.transform(F.col("rings"), lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(F.least(a["lng"], b["lng"]).alias("min_lng"), F.least(a["lat"], b["lat"]).alias("min_lat"), F.greatest(a["lng"], b["lng"]).alias("max_lng"), F.greatest(a["lat"], b["lat"]).alias("max_lat")))))
    tiles = polygons.withColumn("__box", geo.bounds(F.flatten("rings"))).withColumn("__edges", ring_boxes).withColumn("__t", F.explode(geo.tiles_of_box(box, zoom)))
    tiles = tiles.withColumns({"x": F.col("__t.x"), "y": F.col("__t.y"), "__tb": geo.tile_bounds(F.col("__t.x"), F.col("__t.y"), zoom)})
    # a tile stands where the ring does, once round the world if need be
    tb = F.when((F.col("__tb.max_lng") < box["min_lng"]) & (box["max_lng"] > 180), F.struct((F.col("__tb.min_lng") + 360).alias("min_lng"), F.col("__tb.min_lat").alias("min_lat"), (F.col("__tb.max_lng") + 360).alias("max_lng"), F.col("__tb.max_lat").alias("max_lat"))).otherwise(F.col("__tb"))
    tiles = tiles.withColumn("__tb", tb).withColumn("border", F.exists("__edges", lambda e: geo.overlaps(e, F.col("__tb"))))
    centre = geo.point((F.col("__tb.min_lng") + F.col("__tb.max_lng")) / 2, (F.col("__tb.min_lat") + F.col("__tb.max_lat")) / 2)
    return tiles.where(F.col("border") | geo.in_geometry(centre["lng"], centre["lat"], F.col("rings"))).drop("__box", "__edges", "__t", "__tb")


def points_in_polygons(points: DataFrame, polygons: DataFrame, zoom: int = 8) -> DataFrame:
    """Pairs point_id, polygon_id where the point is in the polygon; points: point_id, lng, lat; polygons: polygon_id, rings.

    In tiles that lie wholly inside no geometry is tested. The rings go only with border tiles.
    """
    cover = polygon_tiles(polygons.select("polygon_id", "rings"), zoom).withColumn("rings", F.when(F.col("border"), F.col("rings")))
    at = points.select("point_id", "lng", "lat", geo.tile_x(F.col("lng"), zoom).alias("x"), geo.tile_y(F.col("lat"), zoom).alias("y"))
    inside = ~F.col("border") | geo.in_geometry_round(F.col("lng"), F.col("lat"), F.col("rings"))
    return at.join(cover, ["x", "y"]).where(inside).select("point_id", "polygon_id").distinct()


def routes_in_polygons(routes: DataFrame, polygons: DataFrame, zoom: int = 8, every: int = 1) -> DataFrame:
    """Pairs route_id, polygon_id where a vertex of the route (of every so many, and the last) is in the polygon."""
    line = geo.every(F.col("line"), every) if every > 1 else F.col("line")
    vertices = routes.select(F.col("route_id").alias("point_id"), F.explode(line).alias("v")).select("point_id", "v.lng", "v.lat")
    return points_in_polygons(vertices, polygons, zoom).withColumnRenamed("point_id", "route_id")


def paths_by_thirds(routes: DataFrame, paths: DataFrame, side: float = geo.CELL_DEGREES) -> DataFrame:
    """Pairs route_id, path_id where each third of the path (by vertex number) has a vertex in a cell next to one of the route's.

    A third without vertices (paths of one or two) counts as visited; paths without vertices match nothing.
    """
    n = F.size("line")
    cells = paths.select("path_id", n.alias("n"), F.posexplode("line").alias("pos", "p"))
    cells = cells.select("path_id", "n", F.call_function("shiftleft", F.lit(1), geo.section(F.col("pos"), F.col("n"))).alias("bit"), geo.cell(F.col("p"), side).alias("c"))
    # one row a path and cell, with the sections that have a vertex in it and those that are wanted
    cells = cells.groupBy("path_id", "c").agg(F.bit_or("bit").alias("bits"), (F.call_function("shiftleft", F.lit(1), F.least(F.max("n"), F.lit(3))) - 1).alias("want"))
    own = routes.select("route_id", F.explode("line").alias("p")).select("route_id", geo.cell(F.col("p"), side).alias("c")).distinct()
    around = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))
    return pairs_meeting(own.select("route_id", "c.row", "c.col"), cells.select("path_id", "c.row", "c.col", "bits", "want"), ("route_id", "path_id"), ("row", "col"), around)


def lines_within(a: DataFrame, b: DataFrame, metres: float = 50.0) -> DataFrame:
    """Pairs a_id, b_id of lines (a_id, line; b_id, line) that have vertices within so many metres of each other."""
    stand = lambda d, c, to: d.select(c, F.explode("line").alias("v")).select(c, F.col("v.lng").alias(f"__{to}lng"), F.col("v.lat").alias(f"__{to}lat")).distinct()
    left, right = stand(a, "a_id", "v"), stand(b, "b_id", "p").where("__plng is not null and __plat is not null")
    close = near_places(left.select("__vlng", "__vlat"), right.select("__plng", "__plat"), metres, zoom_for(metres))
    near = left.join(close, ["__vlng", "__vlat"]).select("a_id", "__plng", "__plat").distinct()
    return pairs_meeting(near, right.select("*", F.lit(1).alias("bits"), F.lit(1).alias("want")), ("a_id", "b_id"), ("__plng", "__plat"))


def area_metrics(peaks: DataFrame, areas: DataFrame, boundaries: DataFrame, zoom: int = 8) -> DataFrame:
    """Per boundary: n_peaks, tallest (name) and its elevation, and a count of areas of each type by their centroid.

    peaks: point_id, lng, lat, elevation, name; areas: point_id, lng, lat, area_type; boundaries: polygon_id, rings. Boundaries without
    any have zeros and nulls; of equally tall peaks the least name counts.
    """
    rest = ["elevation", "name", "area_type"]
    both = peaks.select(F.lit(True).alias("peak"), "point_id", "lng", "lat", "elevation", "name", F.lit(None).cast("string").alias("area_type"))
    both = both.unionByName(areas.select(F.lit(False).alias("peak"), "point_id", "lng", "lat", F.lit(None).cast(peaks.schema["elevation"].dataType).alias("elevation"), F.lit(None).cast("string").alias("name"), "area_type"))
    # boundaries are covered once, for peaks and areas together
    inside = points_in_polygons(both.withColumn("point_id", F.struct("peak", "point_id", *rest)), boundaries, zoom).select("polygon_id", "point_id.*")
    tallest = F.max_by(F.col("name"), F.struct(F.coalesce("elevation", F.lit(float("-inf"))), -F.col("point_id")))
    by_peak = inside.where("peak").groupBy("polygon_id").agg(F.count("*").alias("n_peaks"), tallest.alias("tallest"), F.max("elevation").alias("tallest_elevation"))
    by_type = inside.where("not peak").groupBy("polygon_id", "area_type").agg(F.count("*").alias("n")).groupBy("polygon_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("area_type", "n")))).alias("areas_by_type"))
    out = boundaries.select("polygon_id").join(by_peak, "polygon_id", "left").join(by_type, "polygon_id", "left")
    return out.withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
