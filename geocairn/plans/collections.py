"""Queries of stored features, deletes, boundaries, organizers and their redirects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import features, organizers
from ..sources import tables
from .registry import BOX_SQL, VISITS_SQL, boxes, lat_sql, lng_sql, place, query, tile_x_sql, tile_y_sql, visits

_P, _S, _C, _E = ((lng_sql(k), lat_sql(k)) for k in ("p_partkey", "s_suppkey", "c_custkey", "event_id"))
_FEATURES = f"""select p_partkey as id, case when p_size % 2 = 0 then 'peak' else 'path' end as kind, {tile_x_sql(_P[0], 9)} as x, {tile_y_sql(_P[1], 9)} as y, case when p_partkey % 7 = 0 then p_partkey - 1 end as stored_id, p_partkey % 11 = 0 as is_empty from part"""
_TILES = f"select distinct {tile_x_sql(_S[0], 9)} as x, {tile_y_sql(_S[1], 9)} as y from supplier where s_suppkey % 3 = 0"


def _features(t):
    at = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "peak").otherwise("path").alias("kind"), *place("p_partkey"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") - 1).alias("stored_id"), (F.col("p_partkey") % 11 == 0).alias("is_empty"))
    return at.select("id", "kind", geo.tile_x(F.col("lng"), 9).alias("x"), geo.tile_y(F.col("lat"), 9).alias("y"), "stored_id", "is_empty")


def _tiles(t):
    at = t("supplier").where("s_suppkey % 3 = 0").select(*place("s_suppkey"))
    return at.select(geo.tile_x(F.col("lng"), 9).alias("x"), geo.tile_y(F.col("lat"), 9).alias("y"))


@query(
    "fetched_tiles",
    f"""with f as materialized ({_FEATURES}), k as (select * from f where kind = 'peak' and not is_empty), a as materialized (select k.* from k semi join ({_TILES}) using (x, y))
    select distinct id, x, y from (select * from a where stored_id is null union all select * from k where stored_id is null and id in (select stored_id from a))""",
)
def fetched_tiles(t):
    """Tiles of some suppliers; a part is a feature, every seventh a pointer, every eleventh the marker of an empty tile."""
    return features.fetch_tiles(_features(t), _tiles(t), "peak").select("id", "x", "y")


@query("missing_tiles", f"select (x + 2)::integer as x, y from ({_TILES}) t where not exists (select 1 from ({_FEATURES}) f where kind = 'path' and f.x = t.x + 2 and f.y = t.y)")
def missing_tiles(t):
    """Of the tiles two columns east of some suppliers' those without a path."""
    return features.missing_tiles(_features(t), _tiles(t).withColumn("x", F.col("x") + 2), "path")


@query("deleted_rows", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)")
def deleted_rows(t):
    gone = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return features.delete_by_key(t("orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query(
    "deleted_accounts",
    """with u as (select c_custkey from customer where c_acctbal < 0) select 'orders' as name, count(*) as n from orders where o_custkey not in (from u) union all select 'customer', count(*) from customer where c_custkey not in (from u)
    union all select 'events', count(*) from events where user_id is null or user_id not in (from u)""",
)
def deleted_accounts(t):
    """Rows left in three tables after accounts have gone."""
    users = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    left = features.delete_accounts({"orders": (t("orders"), "o_custkey"), "customer": (t("customer"), "c_custkey"), "events": (t("events"), "user_id")}, users)
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "deleted_activities",
    f"""with d as (select o_custkey as user_id, list(o_orderkey) as gone from orders where o_orderstatus = 'P' group by 1), h as (select user_id, feature_id, list_filter(activity_ids, lambda a: not list_contains(gone, a)) as ids, len(activity_ids) as n from ({VISITS_SQL}) join d using (user_id))
    select user_id, feature_id, len(ids) as n_left, case when len(ids) = 0 then 'delete' else 'patch' end as action from h where len(ids) < n""",
)
def deleted_activities(t):
    """Pending orders are deleted activities; the facts that rest on them are patched or deleted."""
    deleted = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("activity_id"))
    return features.retract_deleted(visits(t), deleted).select("user_id", "feature_id", F.size("activity_ids").alias("n_left"), "action")


@query(
    "due_boundaries",
    f"""select distinct polygon_id from (select {_C[0]} as x, {_C[1]} as y from customer where c_mktsegment in ('BUILDING', 'MACHINERY')), ({BOX_SQL}) where x between x0 and x0 + 0.35::DOUBLE and y between y0 and y0 + 0.35::DOUBLE""",
)
def due_boundaries(t):
    """Customers are changed features, of which two segments count."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "peak").when(F.col("c_mktsegment") == "MACHINERY", "protectedArea").otherwise("path")
    c = t("customer").select(F.col("c_custkey").cast("string").alias("feature_id"), kind.alias("kind"), F.lit(None).cast("string").alias("stored_id"), geo.point(*place("c_custkey")).alias("centroid"))
    return features.due_boundaries(c, boxes(t), 11)


@query("metrics_due", "select c_custkey as id from customer where c_custkey % 5 <> 0 and c_custkey % 3 <> 0 and c_custkey % 4 < 3")
def metrics_due(t):
    """Boundaries whose metrics no version, an unreadable one or an older one has made."""
    k = F.col("c_custkey")
    version = F.when(k % 4 == 3, "7").when(k % 4 == 2, "x").when(k % 4 == 1, "6")
    due = features.should_enrich(F.when(k % 5 == 0, "peak").otherwise("adminBoundary"), F.when(k % 6 == 0, "empty-1").otherwise("relation:1"), F.when(k % 6 == 3, "stored"), version, 7)
    return t("customer").where(due).select(k.alias("id"))


@query(
    "boundary_countries",
    f"""with b as (select c_custkey as polygon_id, {_C[0]} as x, {_C[1]} as y, case when c_custkey % 3 = 0 then 'SE' end as tag from customer),
    f as (select b.polygon_id, min(n.polygon_id) as country_id from b join ({BOX_SQL}) n on x between x0 and x0 + 0.35::DOUBLE and y between y0 and y0 + 0.35::DOUBLE group by 1)
    select polygon_id, country_id, coalesce(case when country_id % 4 <> 0 then chr(65 + country_id) || 'X' end, tag) as country_code from b left join f using (polygon_id)""",
)
def boundary_countries(t):
    """Customers' places as boundaries, nations as countries, every fourth without a code."""
    k, n = F.col("c_custkey"), F.col("polygon_id")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("ISO3166-2"), F.lit("se-AB"))).otherwise(F.create_map().cast("map<string,string>"))
    b = t("customer").select(k.alias("polygon_id"), geo.point(*place("c_custkey")).alias("centroid"), tags.alias("tags"))
    code = F.when(n % 4 != 0, F.concat(F.char(65 + n), F.lit("X")))
    return features.boundary_countries(b, boxes(t).withColumn("country_code", code), 11).select("polygon_id", "country_id", "country_code")


@query("coded_countries", "select c_custkey from customer where c_custkey % 3 = 0 or (c_custkey % 3 = 1 and c_custkey % 5 = 0)")
def coded_countries(t):
    """Codes may stand under any of three tags."""
    k = F.col("c_custkey")
    one = lambda name, value: F.create_map(F.lit(name), F.lit(value))
    tags = F.when(k % 3 == 0, one("ISO3166-1", "no")).when((k % 3 == 1) & (k % 5 == 0), one("ISO3166-1:alpha2", "SE")).when(k % 3 == 1, one("country_code_iso3166_1_alpha_2", "DE")).otherwise(one("name", "SE"))
    return t("customer").where(features.has_code(tags, ["ISO3166-1", "ISO3166-1:alpha2", "country_code_iso3166_1_alpha_2"], ["SE", "NO"])).select("c_custkey")


@query(
    "leveled_boundaries",
    f"select distinct polygon_id from supplier, ({BOX_SQL}) where polygon_id % 2 = 0 and {_S[0]} between x0 and x0 + 0.35::DOUBLE and {_S[1]} between y0 and y0 + 0.35::DOUBLE",
)
def leveled_boundaries(t):
    points = t("supplier").select(F.col("s_suppkey").alias("point_id"), *place("s_suppkey"))
    return features.containing_with_level(points, boxes(t).withColumn("admin_level", F.when(F.col("polygon_id") % 2 == 0, 4).otherwise(6)), 4, 11)


@query("redirect_stats", "select count(*) as n_redirects, count(*) filter (o_custkey % 3 = 0 or o_custkey <= 700) as n_existing, count(*) filter (o_custkey % 3 <> 0 and o_custkey > 700) as n_missing from orders")
def redirect_stats(t):
    redirects = t("orders").select(F.col("o_orderkey").cast("string").alias("source"), F.concat(F.lit("Org"), "o_custkey").alias("target"))
    keys = t("orders").where("o_custkey % 3 = 0 or o_custkey <= 700").select(F.concat(F.lit("oRG"), "o_custkey").alias("key"))
    return organizers.redirect_stats(redirects, keys)


@query(
    "redirect_candidates",
    "select 'facebook.com~club' || c_custkey as source, 'club' || (c_custkey // 2) || '.org' as target, 'https://www.club' || (c_custkey // 2) || '.org/a' as url from customer where c_custkey % 2 = 1 and (c_custkey // 2) % 4 = 0",
)
def redirect_candidates(t):
    """Odd customers have a page on a shared host that names a site of their own; every fourth of these sites is an organizer."""
    k = F.col("c_custkey")
    half = F.floor(k / 2).cast("string")
    paged = t("customer").where("c_custkey % 2 = 1").select(F.concat(F.lit("facebook.com~club"), k).alias("key"), F.array(F.concat(F.lit("https://www.club"), half, F.lit(".org/a")), F.concat(F.lit("https://www.club"), half, F.lit(".org/b")), F.lit("mailto:x@y.z")).alias("urls"))
    sites = t("customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("CLUB"), k, F.lit(".org")).alias("key"), F.array().cast("array<string>").alias("urls"))
    return organizers.redirect_candidates(paged.unionByName(sites))


@query(
    "confirmed_redirects",
    """with o as (select o_orderkey as id, 'a' || o_custkey % 300 as source, case when o_custkey % 7 = 0 then ' ' when o_custkey % 11 = 0 then 'A' || o_custkey % 300 else 'b' || o_custkey % 40 end as target from orders)
    select source, target, min(id)::varchar as asked, min(id)::varchar || '!' as final, target in (select 'b' || c_custkey from customer where c_custkey < 20) as target_known, source in (select 'a' || c_custkey from customer where c_custkey % 5 = 0) as already_made
    from o where trim(target) <> '' and lower(source) <> lower(target) group by source, target""",
)
def confirmed_redirects(t):
    k = F.col("o_custkey")
    target = F.when(k % 7 == 0, " ").when(k % 11 == 0, F.concat(F.lit("A"), k % 300)).otherwise(F.concat(F.lit("b"), k % 40))
    observed = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("a"), k % 300).alias("source"), target.alias("target"), F.col("o_orderkey").cast("string").alias("asked"), F.concat("o_orderkey", F.lit("!")).alias("final"))
    known = t("customer").where("c_custkey < 20").select(F.concat(F.lit("B"), "c_custkey").alias("key"))
    return organizers.confirmed_redirects(observed, known, t("customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("a"), "c_custkey").alias("source")))


@query(
    "jobs_by_event",
    "select case when c_nationkey % 2 = 1 and c_nationkey > 4 then 'e1' else 'e' || c_nationkey end as key, count(*) as n, min(c_custkey) as first_item, max(c_custkey) as last_item from customer group by 1",
)
def jobs_by_event(t):
    """Jobs' keys in two spellings; odd ones from 5 on redirect to the first."""
    n = F.col("c_nationkey")
    jobs = t("customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "e").otherwise("E"), n).alias("key"), F.col("c_custkey").alias("seq"), "c_custkey")
    redirects = t("nation").where("n_nationkey % 2 = 1 and n_nationkey > 4").select(F.concat(F.lit("e"), "n_nationkey").alias("source"), F.lit("e1").alias("target"))
    out = organizers.by_event(jobs, redirects, ["c_custkey"])
    return out.select(F.lower("key").alias("key"), F.size("items").cast("long").alias("n"), F.get("items", F.lit(0))["c_custkey"].alias("first_item"), F.element_at("items", -1)["c_custkey"].alias("last_item"))


@query("best_dates", "select o_orderkey, case when o_orderkey % 4 = 0 then '2001-05-05' when o_orderkey % 4 = 1 then greatest('2001-05-05', strftime(o_orderdate, '%Y-%m-%d')) when o_orderkey % 4 = 2 then strftime(o_orderdate, '%Y-%m-%d') else '' end as day from orders")
def best_dates(t):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").select("o_orderkey", organizers.best_date(F.when(k == 3, " ").otherwise(day), F.when(k < 2, "2001-05-05").otherwise(""), k != 0).alias("day"))


@query(
    "property_bags",
    "select c_custkey, 1 + (c_custkey % 3 <> 0 or c_custkey % 2 = 0)::int as n, coalesce(case when c_custkey % 3 <> 0 then c_name end, case when c_custkey % 2 = 0 then c_mktsegment end) as name from customer",
)
def property_bags(t):
    """A field's first source that is filled; a field none fills is left out."""
    k = F.col("c_custkey")
    bag = organizers.property_bag({"name": [F.when(k % 3 != 0, F.col("c_name")).otherwise(" "), F.when(k % 2 == 0, F.col("c_mktsegment"))], "id": [k], "none": [F.lit(None)]})
    return t("customer").select("c_custkey", bag.alias("bag")).select("c_custkey", F.size("bag").alias("n"), F.try_element_at("bag", F.lit("name")).alias("name"))


@query("best_candidates", "select l_orderkey, arg_min('u' || l_partkey, (-l_quantity, 'u' || l_partkey)) as url from lineitem group by 1")
def best_candidates(t):
    return organizers.best_candidate(t("lineitem").withColumn("url", F.concat(F.lit("u"), "l_partkey")), ["l_orderkey"], "l_quantity", "url")


@query(
    "geocoded_places",
    f"""with g as (select lower(n_name) as l, {lng_sql('n_nationkey')} as lng, {lat_sql('n_nationkey')} as lat from nation where n_nationkey % 3 <> 0)
    select c_custkey, g.lng, g.lat from customer left join nation on c_nationkey = n_nationkey left join g on l = lower(n_name) and c_custkey % 5 <> 0""",
)
def geocoded_places(t):
    """Customers at their nation's name, as a gazetteer places it; every fifth location can't be one."""
    k = F.col("c_custkey")
    named = t("customer").join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    rows = named.select("c_custkey", F.when(k % 5 == 0, F.concat(F.lit(", "), "n_name")).otherwise(F.concat(F.lit(" "), "n_name")).alias("location"), F.lit("X").alias("country"))
    gazetteer = t("nation").where("n_nationkey % 3 <> 0").select(F.lower("n_name").alias("location"), F.lit("x").alias("country"), *place("n_nationkey"))
    return organizers.geocoded(rows, gazetteer).select("c_custkey", "lng", "lat")


@query(
    "json_values",
    """select event_id, case json_type(props, '$.k') when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' when 'NULL' then 'null' end as kind, case when json_type(props, '$.k') in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(json_extract(props, '$.k') as double) end as number from events""",
)
def json_values(t):
    v = organizers.json_value(F.get_json_object("props", "$.k"))
    return t("events").select("event_id", v.alias("v")).select("event_id", "v.kind", "v.number")


@query("backfilled_ids", f"select distinct unnest(activity_ids) as id from ({VISITS_SQL}) where feature_id % 17 = 0")
def backfilled_ids(t):
    """Activities of the facts that lack a key."""
    keyed = visits(t).withColumn("key", F.when(F.col("feature_id") % 34 == 0, " ").when(F.col("feature_id") % 17 != 0, F.col("feature_id").cast("string")))
    return organizers.backfill_ids(keyed, "key", "activity_ids")


@query("moved_features", "select count(*) as scanned, count(*) filter (p_size > 25) as moved, count(*) filter (p_size <= 25) as skipped from part")
def moved_features(t):
    """Counters of a move, in one pass."""
    moved = F.col("p_size") > 25
    return t("part").agg(F.count("*").alias("scanned"), F.count_if(moved).alias("moved"), F.count_if(~moved).alias("skipped"))


@query("sorted_statuses", "select user_id, last, n from (select user_id, max(case when event_type = 'purchase' then ts end) as last, count(*) as n from events group by 1) order by n desc, last desc nulls last, user_id limit 20")
def sorted_statuses(t):
    """Three keys, missing days last."""
    by_user = t("events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"), F.count("*").alias("n"))
    return by_user.orderBy(F.desc("n"), F.desc_nulls_last("last"), "user_id").limit(20)


@query("concatenated", "select c_custkey as id, 'customer' as kind from customer union all select s_suppkey, 'supplier' from supplier union all select n_nationkey, 'nation' from nation")
def concatenated(t):
    """Three kinds of candidates in one table."""
    parts = [t(name).select(F.col(key).cast("long").alias("id"), F.lit(name).alias("kind")) for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("latest_values", "select user_id, arg_max(value, (ts, event_id)) filter (value is not null) as value, sum(value) as total from events where user_id is not null group by 1")
def latest_values(t):
    """The last value that is known, and the sum."""
    known = F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))
    return t("events").where("user_id is not null").groupBy("user_id").agg(F.max_by("value", known).alias("value"), F.sum("value").alias("total"))


@query("last_day", "select event_id from events where ts >= timestamp '2024-01-30' - interval 24 hours and ts <= timestamp '2024-01-30'")
def last_day(t):
    """The 24 hours before a given time."""
    at = F.lit("2024-01-30").cast("timestamp")
    return t("events").where((F.col("ts") >= at - F.expr("interval 24 hours")) & (F.col("ts") <= at)).select("event_id")


@query("vertex_counts", "select user_id as route_id, count(*) as n from events where user_id is not null group by 1")
def vertex_counts(t):
    from .registry import routes

    return routes(t).select("route_id", geo.vertex_count(F.array("line")).alias("n"))


@query("tag_properties", "select c_custkey, case when c_custkey % 2 = 0 then 'v' || c_custkey end as value, case when c_custkey % 3 = 0 then 'national_park' when c_custkey % 3 = 1 then 'nature_reserve' else 'protected_area' end as kind from customer")
def tag_properties(t):
    """Tags by key without case, and the kind of area they name."""
    k = F.col("c_custkey")
    name = F.create_map(F.when(k % 2 == 0, "NaMe").otherwise("title"), F.concat(F.lit("v"), k))
    area = F.when(k % 3 == 0, F.create_map(F.lit("boundary"), F.lit("national_park"))).when(k % 3 == 1, F.create_map(F.lit("leisure"), F.lit("nature_reserve"))).otherwise(F.create_map(F.lit("protect_class"), F.lit("5")))
    return t("customer").select("c_custkey", text.property_of(name, "name").alias("value"), text.area_type(area).alias("kind"))


@query(
    "element_rings",
    "select p_partkey as id, case p_partkey % 4 when 3 then null else 1 end as n_rings, case p_partkey % 4 when 0 then 5 when 1 then 4 when 2 then 5 end as n_points from part",
)
def element_rings(t):
    """Map-query answers with a relation of two outer members, ways closed and open, and a way too short for a polygon."""
    k = F.col("p_partkey").cast("string")
    node = lambda x, y: f'{{"lat":{y},"lon":{x}}}'
    a, b, c, d = node(0, 0), node(1, 0), node(1, 1), node(0, 1)
    kinds = [
        f'"type":"relation","members":[{{"type":"way","ref":1,"role":"outer","geometry":[{a},{b},{c}]}},{{"type":"way","ref":2,"role":"outer","geometry":[{a},{d},{c}]}},{{"type":"way","ref":3,"role":"inner","geometry":[{a},{b}]}}]',
        f'"type":"way","geometry":[{a},{b},{c}]', f'"type":"way","geometry":[{a},{b},{c},{d},{a}]', f'"type":"way","geometry":[{a},{b}]',
    ]
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("p_partkey") % 4 + 1).cast("int"))
    answers = t("part").select(F.concat(F.lit('{"elements":[{"id":'), k, F.lit(","), kind, F.lit("}]}")).alias("value"))
    shaped = features.element_geometry(tables.overpass_elements(answers))
    return shaped.select("id", F.when(F.col("rings").isNotNull(), F.size("rings")).alias("n_rings"), F.when(F.col("rings").isNotNull(), F.size(F.col("rings")[0])).alias("n_points"))
