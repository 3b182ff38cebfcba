"""Geometry on the sphere and in map tiles, as Column expressions that stay inside code generation.

A point is two columns (lng, lat) in degrees; a line or ring is an array of struct<lng, lat>; a geometry is struct<type, rings> with a
point as one ring of one point, a line as one ring, polygons by their outer rings (holes don't count). Null in gives null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Fixed value: metres of a great circle through the poles, for shifts by metres.
POLAR_CIRCUMFERENCE_M = 40_007_863.0
POINT = "struct<lng:double,lat:double>"


def point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2) * half(lng1, lng2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def distance(p: Column, q: Column) -> Column:
    return haversine_m(p["lng"], p["lat"], q["lng"], q["lat"])


def _steps(line: Column) -> Column:
    """Metres between neighbours of a line; empty for fewer than two points."""
    n = F.size(line)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), distance))


def line_length_m(line: Column) -> Column:
    return F.aggregate(_steps(line), F.lit(0.0), lambda a, x: a + x)


def max_gap_m(line: Column) -> Column:
    """The longest step; 0 without one."""
    return F.coalesce(F.array_max(_steps(line)), F.when(line.isNotNull(), F.lit(0.0)))


def distance_to_line_m(p: Column, line: Column) -> Column:
    """Least distance to a vertex of the line, its last vertex left out; null where no other is there."""
    return F.array_min(F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), lambda v: distance(p, v)))


def shift(lng: Column, lat: Column, east_m: Column, north_m: Column) -> Column:
    """The point so many metres further east and north."""
    per_degree = F.lit(POLAR_CIRCUMFERENCE_M / 360)
    return point(lng + east_m / (per_degree * F.cos(F.radians(lat))), lat + north_m / per_degree)


def bounds(line: Column) -> Column:
    """struct<min_lng, min_lat, max_lng, max_lat>."""
    lng, lat = F.transform(line, lambda p: p["lng"]), F.transform(line, lambda p: p["lat"])
    return F.struct(F.array_min(lng).alias("min_lng"), F.array_min(lat).alias("min_lat"), F.array_max(lng).alias("max_lng"), F.array_max(lat).alias("max_lat"))


def vertex_count(rings: Column) -> Column:
    """Vertices of all lines or rings together."""
    return F.aggregate(rings, F.lit(0).cast("long"), lambda n, r: n + F.size(r))


def contains(box: Column, lng: Column, lat: Column) -> Column:
    return lng.between(box["min_lng"], box["max_lng"]) & lat.between(box["min_lat"], box["max_lat"])


def contains_round(box: Column, lng: Column, lat: Column) -> Column:
    """contains() for boxes that may go beyond 180 degrees on either side."""
    return contains(box, lng, lat) | contains(box, lng + 360, lat) | contains(box, lng - 360, lat)


def unwrapped(rings: Column) -> Column:
    """Rings that cross the 180th meridian (an edge spans more than half the world) with their western longitudes 360 degrees further on, others as they are."""
    jumps = lambda r: F.exists(F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.abs(a["lng"] - b["lng"])), lambda d: d > 180)
    return F.transform(rings, lambda r: F.when(jumps(r), F.transform(r, lambda p: point(F.when(p["lng"] < 0, p["lng"] + 360).otherwise(p["lng"]), p["lat"]))).otherwise(r))


def overlaps(a: Column, b: Column) -> Column:
    return (a["min_lng"] <= b["max_lng"]) & (b["min_lng"] <= a["max_lng"]) & (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"])


def padded(box: Column, metres: float) -> Column:
    """The box grown by so many metres on each side, by the smaller cosine of its two latitudes."""
    dlat = metres / (POLAR_CIRCUMFERENCE_M / 360)
    narrow = F.greatest(F.lit(1e-6), F.least(F.cos(F.radians(box["min_lat"] - dlat)), F.cos(F.radians(box["max_lat"] + dlat))))
    dlng = F.lit(dlat) / narrow
    return F.struct((box["min_lng"] - dlng).alias("min_lng"), (box["min_lat"] - dlat).alias("min_lat"), (box["max_lng"] + dlng).alias("max_lng"), (box["max_lat"] + dlat).alias("max_lat"))


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Whether the point is in the ring, by crossings of a ray (even-odd); false for an empty ring."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = ring[i], ring[F.pmod(i - 1, n)]
        at = F.try_divide((b["lng"] - a["lng"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lng"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & F.coalesce(lng < at, F.lit(False))

    inside = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(False), lambda acc, i: acc != crosses(i))
    return F.when(n < 1, F.lit(False)).otherwise(inside)


def in_geometry(lng: Column, lat: Column, rings: Column) -> Column:
    """Whether the point is in one of the outer rings."""
    return F.exists(rings, lambda r: in_ring(lng, lat, r))


def in_geometry_round(lng: Column, lat: Column, rings: Column) -> Column:
    """in_geometry() for unwrapped() rings."""
    return in_geometry(lng, lat, rings) | (F.exists(rings, lambda r: F.exists(r, lambda p: p["lng"] > 180)) & in_geometry(lng + 360, lat, rings))


def tile_x(lng: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lng + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    phi = F.radians(lat)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n))).cast("int")


def tile(lng: Column, lat: Column, zoom: int) -> Column:
    return F.struct(tile_x(lng, zoom).alias("x"), tile_y(lat, zoom).alias("y"))


def _lat_of_row(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / float(1 << zoom)))))


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    """A tile's south-west and north-east corners as a box."""
    n = float(1 << zoom)
    return F.struct((x / n * 360.0 - 180.0).alias("min_lng"), _lat_of_row(y + 1, zoom).alias("min_lat"), ((x + 1) / n * 360.0 - 180.0).alias("max_lng"), _lat_of_row(y, zoom).alias("max_lat"))


def tile_centre(x: Column, y: Column, zoom: int) -> Column:
    b = tile_bounds(x, y, zoom)
    return point((b["min_lng"] + b["max_lng"]) / 2, (b["min_lat"] + b["max_lat"]) / 2)


def tiles_of_line(line: Column, zoom: int) -> Column:
    return F.array_distinct(F.transform(line, lambda p: tile(p["lng"], p["lat"], zoom)))


def _block(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """All tiles of a rectangle of tile numbers."""
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))))


def tiles_of_box(box: Column, zoom: int) -> Column:
    """Tiles that a box meets. A box that goes beyond 180 degrees on either side meets the columns of the other side too."""
    n = 1 << zoom
    column = lambda lng: F.floor((lng + 180.0) / 360.0 * n)
    first = F.when(box["min_lng"] < -180, column(box["min_lng"])).otherwise(F.least(F.lit(n - 1), column(box["min_lng"])))
    last = F.when(box["max_lng"] > 180, column(box["max_lng"])).otherwise(F.least(F.lit(n - 1), column(box["max_lng"])))
    columns = F.array_distinct(F.transform(F.sequence(first, F.greatest(first, F.least(last, first + (n - 1)))), lambda x: F.pmod(x, F.lit(n)).cast("int")))
    rows = F.sequence(tile_y(box["max_lat"], zoom), tile_y(box["min_lat"], zoom))
    return F.flatten(F.transform(columns, lambda x: F.transform(rows, lambda y: F.struct(x.alias("x"), y.cast("int").alias("y")))))


def tiles_in_radius(lng: Column, lat: Column, metres: float, zoom: int) -> Column:
    """Tiles that cover the circle's box, on both sides of the 180th meridian where it is crossed."""
    here = F.struct(lng.alias("min_lng"), lat.alias("min_lat"), lng.alias("max_lng"), lat.alias("max_lat"))
    return tiles_of_box(padded(here, metres), zoom)


def tiles_at(x: Column, y: Column, zoom: int, to: int) -> Column:
    """The tiles of zoom `to` that a tile of `zoom` meets: its children, itself or its parent."""
    if to <= zoom:
        return F.array(F.struct(F.shiftright(x, zoom - to).cast("int").alias("x"), F.shiftright(y, zoom - to).cast("int").alias("y")))
    d = to - zoom
    return _block(F.shiftleft(x, d), F.shiftleft(x, d) + ((1 << d) - 1), F.shiftleft(y, d), F.shiftleft(y, d) + ((1 << d) - 1))


def _middle(line: Column) -> Column:
    n = F.size(line)
    a, b = F.get(line, F.floor((n - 1) / 2).cast("int")), F.get(line, F.floor(n / 2).cast("int"))
    return point((a["lng"] + b["lng"]) / 2, (a["lat"] + b["lat"]) / 2)


def _mean(ring: Column) -> Column:
    total = F.aggregate(ring, F.struct(F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")), lambda a, p: F.struct((a["lng"] + p["lng"]).alias("lng"), (a["lat"] + p["lat"]).alias("lat")))
    n = F.nullif(F.size(ring), F.lit(0))
    return point(total["lng"] / n, total["lat"] / n)


def centroid(kind: Column, rings: Column) -> Column:
    """A point itself; a line's middle vertex (or between its middle two); of polygons the mean of the vertices (the closing one too) of
    the outer ring with most of them, the first of equals. Null for other kinds."""
    most = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), rings[0], lambda a, r: F.when(F.size(r) > F.size(a), r).otherwise(a))
    return F.when(kind.isin("Point", "LineString"), _middle(F.get(rings, F.lit(0)))).when(kind.isin("Polygon", "MultiPolygon"), _mean(most))


#: Fixed value: degrees of a side of a path-matching cell.
CELL_DEGREES = 0.0005


def cell(p: Column, side: float = CELL_DEGREES) -> Column:
    return F.struct(F.floor(p["lat"] / side).cast("int").alias("row"), F.floor(p["lng"] / side).cast("int").alias("col"))


def cells_around(p: Column, side: float = CELL_DEGREES) -> Column:
    """The point's cell and its eight neighbours."""
    c = cell(p, side)
    return F.array(*[F.struct((c["row"] + i).alias("row"), (c["col"] + j).alias("col")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def section(position: Column, n: Column, of: int = 3) -> Column:
    """Which of `of` sections the position (from 0) of n belongs to: floor(position * of / n)."""
    return F.floor(position * of / n).cast("int")


def every(line: Column, step: int) -> Column:
    """Every step-th point, and the last."""
    n = F.size(line)
    return F.filter(line, lambda p, i: (i % step == 0) | (i == n - 1))


def decimate_ring(ring: Column, step: int) -> Column:
    """Every step-th vertex of a closed ring and the last before its closing one, closed again; rings of fewer than four points, or that
    would be left with fewer than three vertices, stay as they are."""
    if step <= 1:
        return ring
    open_ = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    last = F.size(open_) - 1
    kept = F.filter(open_, lambda p, i: (i % step == 0) | ((i == last) & (p != F.get(open_, (F.floor(last / step) * step).cast("int")))))
    return F.when((F.size(ring) < 4) | (F.size(kept) < 3), ring).otherwise(F.concat(kept, F.slice(kept, 1, 1)))


def tile_units(lng: Column, lat: Column, x: Column, y: Column, zoom: int, extent: int = 4096) -> Column:
    """Whole units (0 .. extent) within the tile, linear in both degrees; null outside it."""
    b = tile_bounds(x, y, zoom)
    px = F.bround((lng - b["min_lng"]) / (b["max_lng"] - b["min_lng"]) * extent).cast("int")
    py = F.bround((b["max_lat"] - lat) / (b["max_lat"] - b["min_lat"]) * extent).cast("int")
    return F.when(contains(b, lng, lat), F.struct(px.alias("px"), py.alias("py")))


def valid_track(line: Column) -> Column:
    """The points within the world's degrees; null when fewer than two are left."""
    kept = F.filter(line, lambda p: p["lng"].between(-180.0, 180.0) & p["lat"].between(-90.0, 90.0))
    return F.when(F.size(kept) >= 2, kept)


def _spread_bits(v: Column) -> Column:
    """Bit i of the number as bit 2i: its binary digits read in base 4."""
    return F.conv(F.bin(v.cast("long")), 4, 10).cast("long")


def tile_key(x: Column, y: Column) -> Column:
    """One number for a tile, the bits of x and y in turn: the tiles below a parent are one range of it, and near tiles have near keys mostly."""
    return _spread_bits(x) + 2 * _spread_bits(y)


def parent_key(key: Column, levels: int) -> Column:
    """The key of the tile so many zooms up."""
    return F.shiftright(key, 2 * levels)
