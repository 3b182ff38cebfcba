"""Queries of map tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import tiles
from .registry import lat_sql, lng_sql, place, query, tile_x_sql, tile_y_sql

_P = (lng_sql("p_partkey"), lat_sql("p_partkey"))


def _ways(t):
    """Ways of three points about the place of a part, classed by its size."""
    lng, lat = F.col("lng"), F.col("lat")
    kinds = F.array(*map(F.lit, ("primary", "tertiary", "path", "footway")))
    p = t("part").select(F.col("p_partkey").alias("id"), *place("p_partkey"), kinds[(F.col("p_size") % 4).cast("int")].alias("highway"))
    line = F.array(geo.point(lng, lat), geo.point(lng + 0.11, lat + 0.01), geo.point(lng + 0.2, lat - 0.08))
    none = F.lit(None).cast("string")
    return p.select("id", line.alias("line"), "highway", none.alias("footway"), none.alias("trail_visibility"), none.alias("sac_scale"))


@query("visible_ways", "select p_partkey as id from part where p_size % 4 in (0, 1, 2)")
def visible_ways(t):
    return tiles.visible(_ways(t), 10).select("id")


@query("tile_layer")
def tile_layer(t):
    return tiles.tile_layer(_ways(t), 9).select("id", "x", "y", "fragment", F.size("line").alias("n_points"))


@query(
    "zoom_index",
    f"""with s as (select {tile_x_sql(_P[0], 12)} as x, {tile_y_sql(_P[1], 12)} as y, min(p_size % 14) as least_zoom from part group by 1, 2)
    select z::integer as zoom, (x // (1 << (12 - z)))::integer as x, (y // (1 << (12 - z)))::integer as y, count(*) as n from s, range(6, 12) r(z) where least_zoom <= z group by 1, 2, 3""",
)
def zoom_index(t):
    p = t("part").select("p_size", *place("p_partkey"))
    shards = p.select(geo.tile_x(F.col("lng"), 12).alias("x"), geo.tile_y(F.col("lat"), 12).alias("y"), (F.col("p_size") % 14).alias("least_zoom"))
    return tiles.zoom_index(shards, 12, range(6, 12)).select("zoom", "x", "y", F.size("shards").cast("long").alias("n"))


@query("retiled", f"select p_partkey as id, {tile_x_sql(_P[0], 8)} as x, {tile_y_sql(_P[1], 8)} as y, 8 as zoom from part")
def retiled(t):
    p = t("part").select(F.col("p_partkey").alias("id"), *place("p_partkey")).select("id", geo.point(F.col("lng"), F.col("lat")).alias("centroid"))
    return tiles.retile(p, 8).drop("centroid")
