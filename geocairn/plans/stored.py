"""Queries over tables kept by key and by tile, which they first fill from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import shards, tile_store, tiles
from ..sources import keyed, shared
from .registry import BOX_SQL, boxes, lat_sql, lng_sql, place, query, routes, tile_x_sql, tile_y_sql

KINDS = {"1-URGENT": 30, "2-HIGH": 180, "3-MEDIUM": 365}


def _orders(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("placed"))


def _table(rows: DataFrame, **options) -> keyed.KeyedTable:
    return keyed.KeyedTable.create(rows.sparkSession, shared.new_folder(rows.sparkSession), rows.schema, ["order_id"], **options)


@query(
    "keyed_merge",
    """select o_orderkey as order_id, o_orderstatus as status, case when o_orderpriority = '1-URGENT' then o_totalprice * 2 else o_totalprice end as price, o_orderpriority as kind, o_orderdate::timestamp as placed
    from orders where o_orderdate < '1999-01-01' and not (o_orderstatus = 'F' and o_orderpriority = '5-LOW')""",
)
def keyed_merge(t):
    """A table kept by key after a first load and three batches: new rows, patches of one column, deletes."""
    rows = _orders(t)
    table = _table(rows, buckets=32).merge(rows.where("placed < '1996-01-01'").withColumn("op", F.lit("upsert")))
    table = table.merge(rows.where("placed >= '1996-01-01' and placed < '1999-01-01'").withColumn("op", F.lit("upsert")))
    table = table.merge(rows.where("kind = '1-URGENT'").select("order_id", (F.col("price") * 2).alias("price"), F.lit("patch").alias("op")))
    return table.merge(rows.where("status = 'F' and kind = '5-LOW'").select("order_id", F.lit("delete").alias("op"))).read()


@query(
    "keyed_snapshot",
    """select o_orderkey as order_id, o_orderstatus as status, case when o_orderstatus = 'P' then o_totalprice + 1 else o_totalprice end as price, o_orderpriority as kind, o_orderdate::timestamp as placed
    from orders where o_orderdate >= '1995-01-01'""",
)
def keyed_snapshot(t):
    """A table kept by key made what a snapshot says: some rows gone, some new, some changed."""
    rows = _orders(t)
    table = _table(rows, buckets=32).merge(rows.where("placed < '1999-01-01'").withColumn("op", F.lit("upsert")))
    return table.replace(rows.where("placed >= '1995-01-01'").withColumn("price", F.when(F.col("status") == "P", F.col("price") + 1).otherwise(F.col("price")))).read()


@query(
    "keyed_expiry",
    """select o_orderkey as order_id, o_orderpriority as kind, o_orderdate::timestamp + to_days(case o_orderpriority when '1-URGENT' then 30 when '2-HIGH' then 180 when '3-MEDIUM' then 365 else 730 end) as expires
    from orders where expires > timestamp '1998-06-01'""",
)
def keyed_expiry(t):
    """Rows that are left when those have expired which their kind lets live so many days."""
    rows = _orders(t).select("order_id", "kind", keyed.expires_at(F.col("kind"), F.col("placed"), KINDS, 730).alias("expires"))
    return _table(rows, buckets=32, expires="expires").merge(rows.withColumn("op", F.lit("upsert"))).expire("1998-06-01").read()


def _features(t) -> DataFrame:
    """Stored features by order (every tenth at zoom 8, the others at 11), pairs of some under one logical id, pointers by customer, markers by nation."""
    k, far = F.col("o_orderkey"), F.lit(None).cast("string")
    rows = t("orders").select(k.alias("k"), *place(k), F.when(k % 10 == 0, 8).otherwise(11).alias("zoom"), F.concat(F.lit("peak:f"), k).alias("id"), F.when(k % 13 == 0, F.concat(F.lit("g"), F.floor(k / 26))).alias("feature_id"), far.alias("stored_id"), F.lit(False).alias("is_empty"))
    c = F.col("c_custkey")
    pointers = t("customer").select(c.alias("k"), *place(c * 31), F.lit(11).alias("zoom"), F.concat(F.lit("peak:p"), c).alias("id"), F.concat(F.lit("f"), c * 3).alias("feature_id"), F.concat(F.lit("peak:f"), c * 3).alias("stored_id"), F.lit(False).alias("is_empty"))
    n = F.col("n_nationkey")
    markers = t("nation").select(n.alias("k"), *place(n), F.lit(11).alias("zoom"), F.concat(F.lit("empty-"), n).alias("id"), far.alias("feature_id"), far.alias("stored_id"), F.lit(True).alias("is_empty"))
    both = rows.unionByName(pointers).unionByName(markers).withColumns({"kind": F.lit("peak"), "geometry": F.array(geo.point(F.col("lng"), F.col("lat")))})
    tile = lambda f, c: F.when(F.col("zoom") == 8, f(F.col(c), 8)).otherwise(f(F.col(c), 11))
    return both.withColumns({"x": tile(geo.tile_x, "lng"), "y": tile(geo.tile_y, "lat")}).drop("k")


_FEATURES_SQL = f"""f as (select 'peak:f' || o_orderkey as id, case when o_orderkey % 13 = 0 then 'g' || (o_orderkey // 26) end as feature_id, null as stored_id, case when o_orderkey % 10 = 0 then 8 else 11 end as zoom, {lng_sql('o_orderkey')} as lng, {lat_sql('o_orderkey')} as lat from orders
        union all select 'peak:p' || c_custkey, 'f' || (c_custkey * 3), 'peak:f' || (c_custkey * 3), 11, {lng_sql('(c_custkey * 31)')}, {lat_sql('(c_custkey * 31)')} from customer),
    n as (select distinct {tile_x_sql(lng_sql('n_nationkey'), 9)} as x, {tile_y_sql(lat_sql('n_nationkey'), 9)} as y from nation),
    h as (select f.*, coalesce(feature_id, substr(id, 6)) as logical_id from f join n on n.x = {tile_x_sql('lng', 9)} and n.y = {tile_y_sql('lat', 9)} where zoom = 11)"""
_FOLLOWED_SQL = "v as (select * from h where stored_id is null union all select f.*, coalesce(feature_id, substr(id, 6)) from f where id in (select stored_id from h) and stored_id is null)"


def _fetched(t, **options) -> DataFrame:
    """Features on the tiles of zoom 9 that hold a nation, from a store at zoom 11."""
    folder = shared.new_folder(t("nation").sparkSession)
    tile_store.write_features(_features(t), folder, 8)
    n = t("nation").select(*place("n_nationkey")).select(geo.tile_x(F.col("lng"), 9).alias("x"), geo.tile_y(F.col("lat"), 9).alias("y"))
    return tile_store.fetch_at_zoom(t("nation").sparkSession.read.parquet(folder), n, "peak", 9, 11, **options)


@query("tiles_across_zooms", f"with {_FEATURES_SQL}, {_FOLLOWED_SQL} select logical_id, arg_min(zoom, id)::integer as zoom, min(id) as id from v group by logical_id")
def tiles_across_zooms(t):
    """Features that tiles two zooms up show, pointers followed, each logical id once; the store's key prunes, and the geometry isn't read."""
    return _fetched(t, columns=[]).select("logical_id", "zoom", "id")


@query("pointers_across_zooms", f"with {_FEATURES_SQL} select logical_id, arg_min(stored_id is not null, (stored_id is not null, id)) as pointer, arg_min(id, (stored_id is not null, id)) as id from h group by logical_id")
def pointers_across_zooms(t):
    """The same with pointers as they are: a stored row comes before a pointer of its logical id."""
    return _fetched(t, follow_pointers=False, columns=[]).select("logical_id", F.col("stored_id").isNotNull().alias("pointer"), "id")


@query("stored_containment", f"""with b as ({BOX_SQL}), p as (select c_custkey as point_id, {lng_sql('c_custkey')} as lng, {lat_sql('c_custkey')} as lat from customer)
    select point_id, polygon_id from p join b on lng > x0 and lng < x0 + 0.35::double and lat > y0 and lat < y0 + 0.35::double where polygon_id % 2 = 0""")  # fmt: skip
def stored_containment(t):
    """Polygons of one sort that hold a place, by pointers on its tile; their geometry is fetched for border tiles only."""
    polygons = boxes(t).withColumn("sort", F.col("polygon_id") % 2)
    points = t("customer").select(F.col("c_custkey").alias("point_id"), *place("c_custkey"))
    return tile_store.containing(points, tile_store.bridge(polygons, 9), polygons, 9, F.col("sort") == 0)


@query("boundaries_on_tiles", f"""with b as ({BOX_SQL}), s as (select distinct {tile_x_sql(lng_sql('s_suppkey'), 9)} as x, {tile_y_sql(lat_sql('s_suppkey'), 9)} as y from supplier)
    select polygon_id from b where polygon_id % 3 = 1 and exists (select 1 from s where x between {tile_x_sql('x0', 9)} and {tile_x_sql('(x0 + 0.35::double)', 9)} and y between {tile_y_sql('(y0 + 0.35::double)', 9)} and {tile_y_sql('y0', 9)})""")  # fmt: skip
def boundaries_on_tiles(t):
    """Boundaries of a level on the tiles of suppliers."""
    tiles = t("supplier").select(*place("s_suppkey")).select(geo.tile_x(F.col("lng"), 9).alias("x"), geo.tile_y(F.col("lat"), 9).alias("y"))
    return tile_store.boundaries_on_tiles(boxes(t).withColumn("admin_level", F.col("polygon_id") % 3), tiles, 1, 9).select("polygon_id")


@query("bulk_fetch_report", """with a as (select distinct 'C' || (n_nationkey % 20) as code from nation), j as (select code, substr(code, 2)::integer as k from a)
    select case when k % 4 = 0 then 'skipped' when k % 7 = 3 then 'missing' when k % 5 = 1 then 'failed' else 'fetched' end as state, count(*) as n from j group by 1""")  # fmt: skip
def bulk_fetch_report(t):
    """What a bulk fetch of countries did with each code that was asked for."""
    n = F.col("polygon_id")
    code = F.concat(F.lit("c"), n)
    answers = boxes(t).where((n < 20) & (n % 7 != 3)).select(code.alias("code"), "polygon_id", F.when(n % 5 != 1, F.col("rings")).alias("rings"))
    asked = t("nation").select(F.concat(F.lit("C"), F.col("n_nationkey") % 20).alias("code"))
    spark = t("nation").sparkSession
    _, report = tile_store.bulk_fetch(spark, asked, boxes(t).where(n % 4 == 0).select(code.alias("code")), answers)
    return spark.createDataFrame([(k, v) for k, v in report.items() if k != "pointers" and v], "state string, n long")


@query("packed_shards", f"""with e as (select user_id, event_id, ts, {lng_sql('event_id')} as lng, {lat_sql('event_id')} as lat from events where user_id is not null),
        s as (select distinct {tile_x_sql(lng_sql('s_suppkey'), 11)} as x, {tile_y_sql(lat_sql('s_suppkey'), 11)} as y from supplier where s_nationkey = 3),
        l as (select user_id as id, count(*) as n_points, list(round(lng * 1e7::double)::bigint order by ts, event_id) as lngs, list(round(lat * 1e7::double)::bigint order by ts, event_id) as lats, bool_or(({tile_x_sql('lng', 11)}, {tile_y_sql('lat', 11)}) in (select (x, y) from s)) as here from e group by user_id)
    select id, n_points::integer as n_points, md5(array_to_string(lngs, ',') || ';' || array_to_string(lats, ',')) as points_md5 from l where here""")  # fmt: skip
def packed_shards(t):
    """Lines packed by tile and read back on the tiles of some suppliers, each line once, to a ten-millionth of a degree."""
    folder = shared.new_folder(t("events").sparkSession)
    shards.write_shards(shards.build_shards(routes(t).withColumnRenamed("route_id", "id"), 11), folder, 8)
    asked = t("supplier").where("s_nationkey = 3").select(*place("s_suppkey")).select(geo.tile_x(F.col("lng"), 11).alias("x"), geo.tile_y(F.col("lat"), 11).alias("y"))
    found = shards.shard_features(t("events").sparkSession.read.parquet(folder), asked)
    units = lambda c: F.array_join(F.transform("line", lambda p: F.round(p[c] * 1e7).cast("long").cast("string")), ",")
    return found.select("id", F.size("line").alias("n_points"), F.md5(F.concat(units("lng"), F.lit(";"), units("lat")).cast("binary")).alias("points_md5"))


@query("fitted_lines")
def fitted_lines(t):
    """Lines that need at most 2,000 bytes, simplified no more than that takes."""
    lines = routes(t).select("route_id", F.array("line").alias("rings"))
    out = tiles.fitted(lines, 2000)
    return out.select("route_id", "tolerance", F.size(F.col("rings")[0]).alias("n_points"))
