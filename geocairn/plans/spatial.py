"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, kernels, text
from ..operators import features, spatial
from .registry import BOX_SQL, boxes, lat_sql, lng_sql, metres_sql, place, query, routes, tile_x_sql, tile_y_sql

NEAR_M = 1500.0
_S = (lng_sql("s_suppkey"), lat_sql("s_suppkey"))
_E = (lng_sql("event_id"), lat_sql("event_id"))
_C = (lng_sql("c_custkey"), lat_sql("c_custkey"))


def _suppliers(t):
    return t("supplier").select(F.col("s_suppkey").alias("point_id"), *place("s_suppkey"))


def _customers(t):
    return t("customer").select(F.col("c_custkey").alias("point_id"), *place("c_custkey"), F.col("c_acctbal").alias("elevation"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("area_type"))


@query("distance_semi_join", f"select distinct user_id as route_id, s_suppkey as point_id from events, supplier where user_id is not null and {metres_sql(*_E, *_S)} <= {NEAR_M}")
def distance_semi_join(t):
    return spatial.points_near_routes(_suppliers(t), routes(t), NEAR_M)


@query(
    "distance_semi_join_bounded",
    f"""select distinct e.user_id as route_id, s_suppkey as point_id from events e, supplier, (select user_id, arg_min({_E[0]}, (ts, event_id)) as x, arg_min({_E[1]}, (ts, event_id)) as y from events group by 1) b
    where e.user_id = b.user_id and {metres_sql(*_E, *_S)} <= {NEAR_M} and {metres_sql("b.x", "b.y", *_S)} < 60000""",
)
def distance_semi_join_bounded(t):
    """Only points nearer to the route's start than a length."""
    r = routes(t).withColumn("start", F.col("line")[0])
    return spatial.points_near_routes(_suppliers(t), r, NEAR_M, where=geo.haversine_m(F.col("start.lng"), F.col("start.lat"), F.col("lng"), F.col("lat")) < 60_000)


@query("points_in_radius", f"select c_custkey as point_id, round({metres_sql('11.0::DOUBLE', '60.0::DOUBLE', *_C)}, 3) as metres from customer where {metres_sql('11.0::DOUBLE', '60.0::DOUBLE', *_C)} <= 40000")
def points_in_radius(t):
    return spatial.points_within(_customers(t), 11.0, 60.0, 40_000).select("point_id", F.round("metres", 3).alias("metres"))


def _far(key: str):
    """lng and lat of a place within a degree of the 180th meridian, on either side of it."""
    lng, lat = place(key)
    turned = F.pmod(lng + (180 - 11 + 180), F.lit(360.0)) - 180
    return [turned.alias("lng"), lat]


def _far_sql(k: str) -> str:
    return f"(({lng_sql(k)} + 349) % 360 - 180)"


@query("radius_across_meridian", f"select c_custkey as point_id, round({metres_sql('179.999::DOUBLE', '60.0::DOUBLE', _far_sql('c_custkey'), _C[1])}, 3) as metres from customer where {metres_sql('179.999::DOUBLE', '60.0::DOUBLE', _far_sql('c_custkey'), _C[1])} <= 40000")
def radius_across_meridian(t):
    return spatial.points_within(t("customer").select(F.col("c_custkey").alias("point_id"), *_far("c_custkey")), 179.999, 60.0, 40_000).select("point_id", F.round("metres", 3).alias("metres"))


@query("semi_join_across_meridian", f"select distinct user_id as route_id, s_suppkey as point_id from events, supplier where user_id is not null and {metres_sql(_far_sql('event_id'), _E[1], _far_sql('s_suppkey'), _S[1])} <= {NEAR_M}")
def semi_join_across_meridian(t):
    points = t("supplier").select(F.col("s_suppkey").alias("point_id"), *_far("s_suppkey"))
    vertices = t("events").where("user_id is not null").select(F.col("user_id").alias("route_id"), *_far("event_id"))
    lines = vertices.groupBy("route_id").agg(F.collect_list(geo.point(F.col("lng"), F.col("lat"))).alias("line"))
    return spatial.points_near_routes(points, lines, NEAR_M)


@query("points_in_polygons", f"select c_custkey as point_id, polygon_id from customer, ({BOX_SQL}) where {_C[0]} between x0 and x0 + 0.35::DOUBLE and {_C[1]} between y0 and y0 + 0.35::DOUBLE")
def points_in_polygons(t):
    return spatial.points_in_polygons(_customers(t), boxes(t), 11)


@query("routes_in_polygons", f"select distinct user_id as route_id, polygon_id from events, ({BOX_SQL}) where user_id is not null and {_E[0]} between x0 and x0 + 0.35::DOUBLE and {_E[1]} between y0 and y0 + 0.35::DOUBLE")
def routes_in_polygons(t):
    return spatial.routes_in_polygons(routes(t), boxes(t), 11)


@query(
    "paths_by_thirds",
    f"""with v as (select user_id as route_id, floor({_E[1]} / 0.05::DOUBLE) as r, floor({_E[0]} / 0.05::DOUBLE) as c from events where user_id is not null),
    p as (select o_custkey as path_id, floor({lat_sql("o_orderkey")} / 0.05::DOUBLE) as r, floor({lng_sql("o_orderkey")} / 0.05::DOUBLE) as c,
      ((row_number() over (partition by o_custkey order by o_orderkey) - 1) * 3) // count(*) over (partition by o_custkey) as section, count(*) over (partition by o_custkey) as n from orders),
    w as (select route_id, r + i as r, c + j as c from (select distinct * from v), range(-1, 2) a(i), range(-1, 2) b(j))
    select route_id, path_id from (select distinct * from w) join p using (r, c) group by route_id, path_id having count(distinct section) = least(3, min(n))""",
)
def paths_by_thirds(t):
    """Paths: the places of a customer's orders. Cells of 0.05 degrees, as places lie far apart."""
    o = t("orders").select("o_custkey", "o_orderkey", *place("o_orderkey"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "lng", "lat"))), lambda p: geo.point(p["lng"], p["lat"]))
    return spatial.paths_by_thirds(routes(t), o.groupBy(F.col("o_custkey").alias("path_id")).agg(line.alias("line")), 0.05)


@query(
    "area_metrics",
    f"""with m as (select polygon_id, c_custkey, c_acctbal, c_name, c_mktsegment from customer, ({BOX_SQL}) where {_C[0]} between x0 and x0 + 0.35::DOUBLE and {_C[1]} between y0 and y0 + 0.35::DOUBLE)
    select n_nationkey as polygon_id, count(c_custkey) as n_peaks, arg_max(c_name, (c_acctbal, -c_custkey)) as tallest, max(c_acctbal) as tallest_elevation,
      count(*) filter (c_mktsegment = 'BUILDING') as n_building, count(*) filter (c_mktsegment = 'MACHINERY') as n_machinery from nation left join m on n_nationkey = polygon_id group by 1""",
)
def area_metrics(t):
    c = _customers(t)
    out = spatial.area_metrics(c, c, boxes(t), 11)
    of = lambda k: F.coalesce(F.try_element_at("areas_by_type", F.lit(k)), F.lit(0)).alias(f"n_{k.lower()}")
    return out.select("polygon_id", "n_peaks", "tallest", "tallest_elevation", of("BUILDING"), of("MACHINERY"))


_WEST, _NORTH = "(x / 2048.0::DOUBLE * 360 - 180)", "degrees(atan(sinh(pi() * (1 - 2 * {} / 2048.0::DOUBLE))))"


@query(
    "polygon_tiles",
    f"""with b as (select polygon_id, x0, y0, x0 + 0.35::DOUBLE as x1, y0 + 0.35::DOUBLE as y1 from ({BOX_SQL})),
    t as (select *, unnest(range({tile_x_sql("x0", 11)}, {tile_x_sql("x1", 11)} + 1)) as x from b), u as (select *, unnest(range({tile_y_sql("y1", 11)}, {tile_y_sql("y0", 11)} + 1)) as y from t),
    c as (select *, {_WEST} as w, {_WEST} + 360 / 2048.0::DOUBLE as e, {_NORTH.format("y")} as n, {_NORTH.format("(y + 1)")} as s from u)
    select polygon_id, x::integer as x, y::integer as y, not (w > x0 and e < x1 and s > y0 and n < y1) as border from c""",
)
def polygon_tiles(t):
    return spatial.polygon_tiles(boxes(t), 11).select("polygon_id", "x", "y", "border")


@query(
    "line_measures",
    f"""with p as (select user_id, ts, event_id, {_E[0]} as x, {_E[1]} as y, lag({_E[0]}) over w as px, lag({_E[1]}) over w as py from events where user_id is not null window w as (partition by user_id order by ts, event_id))
    select user_id as route_id, count(*) as n_points, round(coalesce(sum({metres_sql("px", "py", "x", "y")}), 0), 2) as length_m, round(coalesce(max({metres_sql("px", "py", "x", "y")}), 0), 2) as max_gap_m,
      round(min(x), 9) as min_lng, round(max(y), 9) as max_lat from p group by 1""",
)
def line_measures(t):
    box = geo.bounds(F.col("line"))
    return routes(t).select("route_id", F.size("line").cast("long").alias("n_points"), F.round(geo.line_length_m(F.col("line")), 2).alias("length_m"), F.round(geo.max_gap_m(F.col("line")), 2).alias("max_gap_m"), F.round(box["min_lng"], 9).alias("min_lng"), F.round(box["max_lat"], 9).alias("max_lat"))


@query(
    "tile_of_point",
    f"""select c_custkey, {tile_x_sql(_C[0], 11)} as x, {tile_y_sql(_C[1], 11)} as y, {tile_x_sql(_C[0], 8)} as parent_x, {tile_y_sql(_C[1], 8)} as parent_y,
    cast(floor({_C[1]} / 0.0005::DOUBLE) as INTEGER) as cell_row from customer""",
)
def tile_of_point(t):
    up = geo.tiles_at(F.col("x"), F.col("y"), 11, 8)[0]
    c = t("customer").select("c_custkey", *place("c_custkey")).withColumns({"x": geo.tile_x(F.col("lng"), 11), "y": geo.tile_y(F.col("lat"), 11)})
    return c.select("c_custkey", "x", "y", up["x"].alias("parent_x"), up["y"].alias("parent_y"), geo.cell(geo.point(F.col("lng"), F.col("lat")))["row"].alias("cell_row"))


@query(
    "tile_corners",
    f"""with c as (select distinct {tile_x_sql(_C[0], 11)} as x, {tile_y_sql(_C[1], 11)} as y from customer)
    select x, y, round(x / 2048.0::DOUBLE * 360 - 180, 9) as min_lng, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 2048.0::DOUBLE)))), 9) as min_lat from c""",
)
def tile_corners(t):
    c = t("customer").select(*place("c_custkey")).select(geo.tile_x(F.col("lng"), 11).alias("x"), geo.tile_y(F.col("lat"), 11).alias("y")).distinct()
    b = geo.tile_bounds(F.col("x"), F.col("y"), 11)
    return c.select("x", "y", F.round(b["min_lng"], 9).alias("min_lng"), F.round(b["min_lat"], 9).alias("min_lat"))


@query(
    "shifted_points",
    f"select c_custkey, round({_C[0]} + 50 / (40007863.0::DOUBLE / 360 * cos(radians({_C[1]}))), 9) as lng, round({_C[1]} - 30 / (40007863.0::DOUBLE / 360), 9) as lat from customer",
)
def shifted_points(t):
    p = geo.shift(F.col("lng"), F.col("lat"), F.lit(50.0), F.lit(-30.0))
    return t("customer").select("c_custkey", *place("c_custkey")).select("c_custkey", F.round(p["lng"], 9).alias("lng"), F.round(p["lat"], 9).alias("lat"))


@query("box_centroids", f"select polygon_id, round(x0 + 0.14::DOUBLE, 9) as lng, round(y0 + 0.14::DOUBLE, 9) as lat from ({BOX_SQL})")
def box_centroids(t):
    """Mean of five vertices, the closing one counted."""
    p = geo.centroid(F.lit("Polygon"), F.col("rings"))
    return boxes(t).select("polygon_id", F.round(p["lng"], 9).alias("lng"), F.round(p["lat"], 9).alias("lat"))


@query(
    "tile_scan",
    f"select c_custkey, {tile_x_sql(_C[0], 11)} as x, {tile_y_sql(_C[1], 11)} as y from customer where {tile_x_sql(_C[0], 11)} >> 3 = {tile_x_sql('11.0::DOUBLE', 8)} and {tile_y_sql(_C[1], 11)} >> 3 = {tile_y_sql('60.0::DOUBLE', 8)}",
)
def tile_scan(t):
    """Points of a parent tile: a join on the tiles it expands to."""
    c = t("customer").select("c_custkey", *place("c_custkey")).select("c_custkey", geo.tile_x(F.col("lng"), 11).alias("x"), geo.tile_y(F.col("lat"), 11).alias("y"))
    asked = t("region").limit(1).select(geo.tile(F.lit(11.0), F.lit(60.0), 8).alias("p")).select(F.explode(geo.tiles_at(F.col("p.x"), F.col("p.y"), 8, 11)).alias("k")).select("k.x", "k.y")
    return c.join(asked, ["x", "y"], "left_semi").select("c_custkey", "x", "y")


@query("simplified_routes")
def simplified_routes(t):
    return routes(t).select("route_id", F.size("line").alias("n_points"), F.size(kernels.simplify_line("line", F.lit(0.05))).alias("n_kept"))


@query("clipped_routes")
def clipped_routes(t):
    box = F.struct(F.lit(10.5).alias("min_lng"), F.lit(59.5).alias("min_lat"), F.lit(11.5).alias("max_lng"), F.lit(60.5).alias("max_lat"))
    return routes(t).select("route_id", F.posexplode(kernels.clip_line("line", box)).alias("fragment", "piece")).select("route_id", "fragment", F.size("piece").alias("n_points"))


@query("way_zoom", """select p_partkey, case when k = 'primary' then 0 when k = 'tertiary' then 10 when k = 'service' then 12 when k = 'residential' then 13 when k = 'busway' then 14
    when k = 'path' then 7 + v + s when k = 'cycleway' then 10 + v + s when k = 'footway' then 11 + v + s end as zoom from (select p_partkey,
    ['primary', 'tertiary', 'service', 'residential', 'busway', 'path', 'cycleway', 'footway', 'none'][p_partkey % 9 + 1] as k, case when p_size % 3 = 0 then 2 else 0 end as v,
    case p_size % 4 when 0 then 2 when 1 then 1 else 0 end as s from part)""")  # fmt: skip
def way_zoom(t):
    kinds = F.array(*map(F.lit, ("primary", "tertiary", "service", "residential", "busway", "path", "cycleway", "footway", "none")))
    seen = F.when(F.col("p_size") % 3 == 0, "bad").otherwise("good")
    sac = F.when(F.col("p_size") % 4 == 0, "difficult_alpine_hiking").when(F.col("p_size") % 4 == 1, "alpine_hiking")
    return t("part").select("p_partkey", text.least_zoom(kinds[(F.col("p_partkey") % 9).cast("int")], F.lit(None).cast("string"), seen, sac).alias("zoom"))


@query(
    "lines_near_lines",
    f"""with a as (select distinct user_id as a_id, {_E[0]} as x, {_E[1]} as y from events where user_id is not null), b as (select o_custkey as b_id, {lng_sql('o_orderkey')} as u, {lat_sql('o_orderkey')} as v from orders),
    n as (select *, floor(v * 1000)::bigint + i as band from b, range(-1, 2) r(i))
    select distinct a_id, b_id from a join n on floor(y * 1000)::bigint = band where {metres_sql('x', 'y', 'u', 'v')} <= 80""",
)
def lines_near_lines(t):
    """Routes of users against the places of customers' orders."""
    o = t("orders").select(F.col("o_custkey").alias("b_id"), *place("o_orderkey"))
    b = o.groupBy("b_id").agg(F.collect_list(geo.point(F.col("lng"), F.col("lat"))).alias("line"))
    return spatial.lines_within(routes(t).withColumnRenamed("route_id", "a_id"), b, 80.0)


@query(
    "sampled_routes",
    f"""with v as (select user_id as route_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n, {_E[0]} as x, {_E[1]} as y from events where user_id is not null)
    select route_id, count(*) filter (i % 7 = 0 or i = n - 1) as n_sampled, any_value(n) >= 2 as is_track, count(distinct ({tile_x_sql('x', 9)}, {tile_y_sql('y', 9)})) as n_tiles from v group by 1""",
)
def sampled_routes(t):
    """Every seventh vertex and the last, whether a line is a track, and its tiles."""
    line = F.col("line")
    return routes(t).select("route_id", F.size(geo.every(line, 7)).cast("long").alias("n_sampled"), geo.valid_track(line).isNotNull().alias("is_track"), F.size(geo.tiles_of_line(line, 9)).cast("long").alias("n_tiles"))


_TRIANGLE = "select n_nationkey as polygon_id, 10.0::DOUBLE + (n_nationkey % 5) * 0.4::DOUBLE as x0, 59.0::DOUBLE + (n_nationkey // 5) * 0.4::DOUBLE as y0 from nation"


@query(
    "points_in_triangles",
    f"select c_custkey as point_id, polygon_id from customer, ({_TRIANGLE}) where {_C[1]} >= y0 and {_C[0]} >= x0 and ({_C[0]} - x0) / 0.35::DOUBLE + ({_C[1]} - y0) / 0.3::DOUBLE < 1",
)
def points_in_triangles(t):
    """Polygons whose edges are no lines of the grid."""
    n = F.col("n_nationkey")
    x, y = 10.0 + (n % 5) * 0.4, 59.0 + F.floor(n / 5) * 0.4
    ring = F.array(geo.point(x, y), geo.point(x + 0.35, y), geo.point(x, y + 0.3), geo.point(x, y))
    return spatial.points_in_polygons(_customers(t), t("nation").select(n.alias("polygon_id"), F.array(ring).alias("rings")), 11)


@query("route_regions", f"""with v as (select distinct user_id as route_id, {_E[0]} as x, {_E[1]} as y from events where user_id is not null), b as ({BOX_SQL}),
    n as (select distinct route_id, polygon_id from (select distinct route_id, {tile_x_sql('x', 9)} as tx, {tile_y_sql('y', 9)} as ty from v), b where tx between {tile_x_sql('x0', 9)} and {tile_x_sql('(x0 + 0.35::double)', 9)} and ty between {tile_y_sql('(y0 + 0.35::double)', 9)} and {tile_y_sql('y0', 9)}),
    i as (select distinct route_id, polygon_id from v, b where x between x0 and x0 + 0.35::double and y between y0 and y0 + 0.35::double),
    m as (select n.*, i.route_id is not null as inside from n left join i using (route_id, polygon_id)), c as (select route_id, count(*) as n, count(*) filter (inside) as k from m group by 1)
    select route_id, polygon_id from m join c using (route_id) where inside or n = 1 or k = 0""")  # fmt: skip
def route_regions(t):
    """Boundaries that routes go through, all vertices tested, with the rules for routes that meet one boundary alone or are in none."""
    return features.route_regions(routes(t), boxes(t), 9, None)
