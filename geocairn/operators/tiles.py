"""Map tiles from lines: visibility by zoom, clipping to tiles, simplification, an index of what a zoom shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, kernels, text


def clip_to_tiles(ways: DataFrame, zoom: int) -> DataFrame:
    """ways (id, line, ...) by tile: x, y, fragment (from 0 within tile and way) and line, the piece within the tile.

    A line meets at most the tiles of its box; those it doesn't enter give no piece.
    """
    spread = ways.withColumn("__t", F.explode(geo.tiles_of_box(geo.bounds(F.col("line")), zoom))).withColumns({"x": F.col("__t.x"), "y": F.col("__t.y")})
    pieces = spread.withColumn("__pieces", kernels.clip_line("line", geo.tile_bounds(F.col("x"), F.col("y"), zoom)))
    rest = [c for c in ways.columns if c != "line"]
    return pieces.select(*rest, "x", "y", F.posexplode("__pieces").alias("fragment", "line"))


def simplified(ways: DataFrame, zoom: int) -> DataFrame:
    """ways with their lines simplified for the zoom; lines left with fewer than two points go."""
    return ways.withColumn("line", kernels.simplify_line("line", text.zoom_epsilon(F.lit(zoom)))).where(F.size("line") >= 2)


def visible(ways: DataFrame, zoom: int) -> DataFrame:
    """ways (highway, footway, trail_visibility, sac_scale, ...) that are drawn at the zoom."""
    return ways.where(text.least_zoom(*[F.col(c) for c in ("highway", "footway", "trail_visibility", "sac_scale")]) <= zoom)


def tile_layer(ways: DataFrame, zoom: int) -> DataFrame:
    """What a zoom draws, by tile: filtered first, then simplified, then clipped."""
    return clip_to_tiles(simplified(visible(ways, zoom), zoom), zoom)


def zoom_index(shards: DataFrame, stored_zoom: int, zooms: range) -> DataFrame:
    """Which stored tiles (x, y, least_zoom of what they hold) a tile of each lower zoom draws from: zoom, x, y, shards.

    Folded to distinct stored tiles before they are spread over the zooms.
    """
    held = shards.groupBy("x", "y").agg(F.min("least_zoom").alias("least_zoom"))
    each = held.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms]))).where("least_zoom <= zoom")
    d = F.lit(stored_zoom) - F.col("zoom")
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), d)).cast("int")
    return each.groupBy("zoom", up("x").alias("px"), up("y").alias("py")).agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("shards")).withColumnsRenamed({"px": "x", "py": "y"})


def retile(features: DataFrame, to: int) -> DataFrame:
    """features (centroid, ...) with x, y and zoom of the tile of their centroid at another zoom."""
    c = F.col("centroid")
    return features.withColumns({"x": geo.tile_x(c["lng"], to), "y": geo.tile_y(c["lat"], to), "zoom": F.lit(to)})


def fitted(features: DataFrame, limit: int, rings: str = "rings") -> DataFrame:
    """features with their rings (or lines, as one ring each) simplified no more than it takes for them to need at most so many bytes as JSON, and
    tolerance, in degrees (-1: nothing was left out).

    Vertices are ranked once, by the tolerance at which each goes; the tolerance for a size is then looked up, in no loop of simplifications. Closed rings keep
    the two inner vertices that go last, and so stay rings. What doesn't fit with the fewest vertices is left with these.
    """
    size = lambda p: F.octet_length(F.to_json(F.array(p["lng"], p["lat"]))) + 1
    ranked = features.withColumn("__ranks", kernels.ring_ranks(rings))
    sizes = F.flatten(F.transform(rings, lambda r: F.transform(r, size)))
    brackets = 2 * F.size(rings) + 2
    found = ranked.withColumn("tolerance", kernels.fitting_tolerance(F.flatten("__ranks"), sizes.cast("array<int>"), (F.lit(limit) - brackets).cast("double")))
    kept = F.zip_with(rings, "__ranks", lambda r, k: F.filter(r, lambda p, i: F.get(k, i) > F.col("tolerance")))
    return found.withColumn(rings, kept).drop("__ranks")
