"""Queries of pages, merging of listings, jobs and binary tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, pages, text
from ..operators import features, intake, jobs, merge, races, tiles, vector_tiles
from ..sources import documents
from .registry import lat_sql, lng_sql, place, query, tile_x_sql, tile_y_sql
from .tile_layers import _ways

_KM = "(5 + (c_custkey * 37 % 400) / 10.0::DOUBLE)"
_KM2 = "(5 + (s_suppkey * 53 % 400) / 10.0::DOUBLE)"


def _km(key: str, times: int):
    return 5 + (F.col(key) * times % 400).cast("double") / 10.0


@query("page_names", r"select page_id, trim(string_split_regex(trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)), '\s*[|\-—–:]{1,2}\s*')[1]) as name from pages")
def page_names(t):
    return t("pages").select("page_id", pages.page_name(F.col("html")).alias("name"))


@query(
    "page_courses",
    rf"""with a as (select page_id, regexp_extract(url, '^https?://[^/?#]+') as origin, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1)) as href,
        unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 2)) as label from pages)
    select page_id, coalesce(courses, []) as courses from pages left join (select page_id, list_sort(list(distinct origin || href)) as courses from a
        where regexp_matches(lower(href || chr(10) || label), '{"|".join(pages.COURSE_WORDS)}') and not regexp_matches(lower(href || chr(10) || label), '{"|".join(pages.OTHER_WORDS)}') group by page_id) using (page_id)""",
)
def page_courses(t):
    return t("pages").select("page_id", F.array_sort(pages.course_links(F.col("html"), F.col("url"))).alias("courses"))


@query(
    "address_distances",
    """select p_partkey, case p_size % 4 when 0 then p_size || ' km' when 1 then regexp_replace(round(p_size * 1.60934::decimal(7, 5), 1)::decimal(6, 1)::varchar, '\\.0$', '') || ' km' when 2 then '21 km' else 'backyard' end as distance from part""",
)
def address_distances(t):
    """Distances in four kinds of addresses."""
    size = F.col("p_size").cast("string")
    ways = F.array(F.concat(F.lit("https://a.se/race/"), size, F.lit("-km?x=1")), F.concat(F.lit("https://a.se/"), size, F.lit("mi/")), F.lit("https://a.se/half-marathon"), F.lit("https://a.se/Backyard-ultra/x"))
    return t("part").select("p_partkey", pages.address_distance(ways[(F.col("p_size") % 4).cast("int")]).alias("distance"))


@query(
    "listed_distances",
    f"""with l as (select unnest([1, 2, 3, 4]) as pos, unnest([10, 21, 42, 200]) as listed),
        b as (select c_nationkey, pos, listed, arg_min(c_custkey, (abs({_KM} - listed), c_custkey)) as route_id, min(abs({_KM} - listed)) > 0.25::DOUBLE * listed as far from customer, l group by c_nationkey, pos, listed)
    select customer.c_nationkey as organizer, c_custkey as route_id, coalesce(string_agg(listed || ' km', ', ' order by far, pos), '') as distances from customer left join b on c_custkey = route_id group by 1, 2""",
)
def listed_distances(t):
    """A list of distances dealt to the routes of each organiser."""
    routes = t("customer").select(F.col("c_nationkey").alias("organizer"), F.col("c_custkey").alias("route_id"), _km("c_custkey", 37).alias("km"))
    verbose = t("nation").select(F.col("n_nationkey").alias("organizer"), F.lit("10 km, 21 km; 42 km, 200 km").alias("distances"))
    return races.assign_distances(routes, verbose).withColumn("distances", F.array_join("distances", ", "))


@query(
    "absorbed_points",
    f"""with l as (select s_nationkey as organizer, s_suppkey as id, s_name as name, {_KM2} as km from supplier), p as (select c_nationkey as organizer, c_custkey + 1000000 as id, c_name as name, {_KM} as km from customer),
        m as (select p.id, p.name, arg_min(l.id, (abs(l.km - p.km), l.id)) as line_id from p join l on p.organizer = l.organizer and (l.km = p.km or abs(l.km - p.km) < 0.09::DOUBLE * greatest(l.km, p.km)) group by all)
    select l.id, coalesce(arg_max(m.name, m.id), any_value(l.name)) as name from l left join m on l.id = line_id group by l.id union all select id, name from p where id not in (select id from m)""",
)
def absorbed_points(t):
    none = F.array().cast("array<string>").alias("urls")
    lines = t("supplier").select(F.col("s_nationkey").alias("organizer"), F.col("s_suppkey").alias("id"), F.lit(True).alias("is_line"), F.array(_km("s_suppkey", 53)).alias("km"), none, F.col("s_name").alias("name"))
    points = t("customer").select(F.col("c_nationkey").alias("organizer"), (F.col("c_custkey") + 1000000).alias("id"), F.lit(False).alias("is_line"), F.array(_km("c_custkey", 37)).alias("km"), none, F.col("c_name").alias("name"))
    return races.absorb_points(lines.union(points), ["name"]).select("id", "name")


@query("write_plan", "select o_orderkey as id, case when o_orderkey % 9 = 0 or o_orderkey % 5 = 0 then 'write' when o_orderkey % 7 = 0 then 'patch' else 'skip' end as decision from orders")
def write_plan(t):
    """Orders against an earlier state that lacks some, with other names or other prices."""
    now = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("price"))
    before = now.where("id % 9 <> 0").withColumns({"name": F.when(F.col("id") % 7 == 0, F.lit("?")).otherwise(F.col("name")), "price": F.when(F.col("id") % 5 == 0, F.lit(-1.0)).otherwise(F.col("price"))})
    empty = now.select("id", F.lit("").alias("properties_hash"), F.lit("").alias("content_hash")).limit(0)
    stored = jobs.write_plan(empty, before, ["id"], ["name"], ["price"])
    return jobs.write_plan(stored, now, ["id"], ["name"], ["price"]).select("id", "decision")


@query("source_counts", "select l_returnflag as source, count(distinct l_orderkey) as n_rows, count(*) as n_entries from lineitem group by 1")
def source_counts(t):
    lists = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_partkey").alias("parts")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "parts"))).alias("found"))
    return jobs.source_counts(lists, "found")


@query("routed_events", """select c_custkey, case c_custkey % 4 when 0 then 'fetch' when 1 then 'delete' when 2 then 'close' end as action, case when c_custkey % 4 < 2 then c_custkey::varchar end as activity_id,
    case when c_custkey % 4 < 3 then c_nationkey::varchar end as user_id from customer""")  # fmt: skip
def routed_events(t):
    pick = lambda *v: F.array(*map(F.lit, v))[(F.col("c_custkey") % 4).cast("int")]
    body = F.to_json(F.struct(pick("activity", "activity", "athlete", "athlete").alias("object_type"), pick("create", "delete", "update", "update").alias("aspect_type"), F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("owner_id"), F.create_map(F.lit("authorized"), pick("true", "true", "false", "true")).alias("updates")))
    return jobs.route_events(t("customer").select("c_custkey", body.alias("body"))).drop("body")


@query("retry_times", """select event_id, strftime(case when event_id % 3 = 0 then date_trunc('day', ts) + interval 1 day else to_timestamp(floor(epoch(ts) / 900) * 900 + 900)::timestamp end, '%Y-%m-%d %H:%M:%S') as at from events""")
def retry_times(t):
    at = jobs.retry_at(F.col("ts").cast("timestamp"), F.col("event_id") % 3 == 0, F.lit(None).cast("timestamp"), F.col("event_id").cast("string"))
    return t("events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("point_tiles", f"select {tile_x_sql(lng_sql('p_partkey'), 9)} as x, {tile_y_sql(lat_sql('p_partkey'), 9)} as y, count(*) as n_features from part group by 1, 2")
def point_tiles(t):
    """Binary tiles of points; SQL counts their features, the tests read the bytes."""
    p = t("part").select(F.col("p_partkey").alias("id"), *place("p_partkey"), "p_size")
    pieces = p.select("id", geo.tile_x(F.col("lng"), 9).alias("x"), geo.tile_y(F.col("lat"), 9).alias("y"), F.lit(0).alias("fragment"), F.array(geo.point(F.col("lng"), F.col("lat"))).alias("line"), "p_size")
    return vector_tiles.encode_tiles(pieces, "parts", 9, ["p_size"]).drop("tile")


@query("line_tiles")
def line_tiles(t):
    return vector_tiles.encode_tiles(tiles.tile_layer(_ways(t), 9), "ways", 9, ["highway"])


@query(
    "near_repeats",
    """with recursive r as (select l_orderkey as organizer, l_linenumber as pos, l_returnflag as name, l_quantity::double as km from (select distinct on (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_returnflag, l_quantity from lineitem order by l_orderkey, l_linenumber, l_returnflag, l_quantity)),
        o as (select *, row_number() over (partition by organizer, name order by pos) as i from r),
        f as (select organizer, name, i, pos, [km] as kept, true as stays from o where i = 1 union all
            select o.organizer, o.name, o.i, o.pos, case when len(list_filter(kept, lambda k: abs(o.km - k) <= 0.1::double * o.km)) > 0 then kept else kept || [o.km] end, len(list_filter(kept, lambda k: abs(o.km - k) <= 0.1::double * o.km)) = 0
            from f join o on o.organizer = f.organizer and o.name = f.name and o.i = f.i + 1)
    select organizer, pos from f where stays""",
)
def near_repeats(t):
    """Lines of an order with the same flag and about the same quantity, the first of each kept."""
    x = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_returnflag", "l_quantity")).alias("v"))
    rows = x.select(F.col("l_orderkey").alias("organizer"), F.col("l_linenumber").alias("pos"), F.col("v.l_returnflag").alias("name"), F.col("v.l_quantity").cast("double").alias("km"))
    return races.drop_near_repeats(rows).select("organizer", "pos")


@query("pages_per_distance", f"""select c_nationkey as organizer, c_custkey as pos from customer qualify row_number() over (partition by c_nationkey, round_even({_KM}, 0) order by c_custkey % 3 = 0, c_custkey) = 1""")
def pages_per_distance(t):
    rows = t("customer").select(F.col("c_nationkey").alias("organizer"), F.col("c_custkey").alias("pos"), _km("c_custkey", 37).alias("km"), (F.col("c_custkey") % 3 == 0).alias("content_only"))
    return races.page_per_distance(rows).select("organizer", "pos")


@query("filled_rows", "select o_orderkey as id, case when o_orderkey % 3 = 0 then o_totalprice + 1 when o_orderkey % 2 = 0 then o_totalprice end as price from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def filled_rows(t):
    """Stored rows under new ones, some of which have no price."""
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    new = o.where("id % 3 = 0 or id % 5 = 0 and id % 2 = 0").withColumn("price", F.when(F.col("id") % 3 == 0, F.col("price") + 1))
    return merge.fill_from(o.where("id % 2 = 0"), new, ["id"], ["price"])


@query("route_labels", """select p_partkey, case when p_size % 10 = 0 then 'Run/hike' when p_size % 7 = 6 then 'Gravel bike' when p_size % 7 <> 1 then 'Run/hike' when p_size % 5 = 1 then 'Road bike' when p_size % 5 in (2, 4) then 'Mountain bike'
    when p_size % 5 = 3 then 'Gravel bike' else 'Bike' end as label from part""")  # fmt: skip
def route_labels(t):
    segments = F.array(F.lit("Ride"), F.when(F.col("p_size") % 10 == 0, "RUN"))
    return t("part").select("p_partkey", races.route_label(F.col("p_size") % 7, F.col("p_size") % 5, segments).alias("label"))


@query(
    "organizer_metadata",
    """select 'o' || c_custkey as organizer, case when c_custkey % 4 = 0 then 0 else 1 + c_custkey % 3 end as n_found, case when c_custkey % 5 > 0 then (c_custkey * 10)::varchar end as fee, (c_custkey % 6)::integer as last_slot
    from customer where c_custkey % 9 <> 0 and c_custkey % 7 <> 3""",
)
def organizer_metadata(t):
    """Organizer documents read without their routes; every ninth redirects, and every seventh has no address."""
    k = F.col("c_custkey")
    found = F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: F.struct(F.concat(F.lit("race "), i).alias("name"), F.lit("2026-05-01").alias("date")))
    routes = F.array(F.struct(F.lit("r").alias("name"), F.array(F.array(F.lit(10.5), F.lit(59.5)), F.array(F.lit(10.6), F.lit(59.6))).alias("coordinates")))
    output = F.struct(F.when(k % 5 > 0, (k * 10).cast("string")).alias("startFee"), routes.alias("routes"))
    value = F.to_json(F.struct(F.concat(F.lit("organizer:"), k).alias("id"), F.when(k % 7 != 3, F.concat(F.lit("https://"), k, F.lit(".example.org"))).alias("url"), F.when(k % 4 > 0, F.create_map(F.lit("list"), found)).alias("discovery"), F.create_map(F.lit("site"), output).alias("scrapers"), (k % 6).alias("lastMaxSlotIndex")))
    files = t("customer").select(F.concat(F.lit("o"), k).alias("organizer"), value.alias("value"))
    redirects = t("customer").where(k % 9 == 0).select(F.concat(F.lit("O"), k).alias("source"), F.lit("o1").alias("target"))
    read = documents.documents(files, "metadata", redirects)
    return read.select("organizer", F.coalesce(F.size(F.try_element_at("discovery", F.lit("list"))), F.lit(0)).cast("long").alias("n_found"), F.col("scrapers")["site"]["startFee"].alias("fee"), F.col("lastMaxSlotIndex").alias("last_slot"))


@query(
    "routed_discoveries",
    """with e as (select o_custkey as organizer, o_orderstatus as source, o_orderkey as pos from orders), r as (select *, case when organizer % 5 = 0 then organizer // 5 else organizer end as one from e),
    s as (select *, case when one % 5 = 0 and one <> 0 and organizer % 5 = 0 then one // 5 else one end as two from r), u as (select *, case when two % 5 = 0 and two <> 0 and two <> one then two // 5 else two end as three from s),
    v as (select *, case when three % 5 = 0 and three <> 0 and three <> two then three // 5 else three end as four from u), w as (select *, case when four % 5 = 0 and four <> 0 and four <> three then four // 5 else four end as five from v)
    select 'o' || five as organizer, source, 'https://' || arg_min(organizer, pos) as url, count(*) as n, min(pos) as first from w group by five, source""",
)
def routed_discoveries(t):
    """Orders as discoveries of customers; every fifth customer redirects to the one of a fifth of its number, and so on."""
    key = F.col("o_custkey")
    items = t("orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("o"), key).alias("organizer"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("https://"), key).alias("url"), F.col("o_orderkey").alias("discovery"))
    c = F.col("c_custkey")
    redirects = t("customer").where((c % 5 == 0) & (c > 0)).select(F.concat(F.lit("O"), c).alias("source"), F.concat(F.lit("o"), F.floor(c / 5)).alias("target"))
    out = documents.routed_discoveries(items, redirects)
    return out.select("organizer", "source", "url", F.size("discoveries").cast("long").alias("n"), F.col("discoveries")[0].alias("first"))


@query("merged_points")
def merged_points(t):
    """Customers as points of their nation, of about the same distance and segment one: in order of id the first that is left takes the later ones in."""
    none = F.array().cast("array<string>").alias("urls")
    points = t("customer").select(F.col("c_nationkey").alias("organizer"), F.col("c_custkey").alias("id"), F.lit(False).alias("is_line"), F.array(_km("c_custkey", 37)).alias("km"), none, F.when(F.col("c_custkey") % 8 > 0, F.col("c_mktsegment")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("fee"))
    return races.merge_points(points, ["fee"]).select("organizer", "id", "name", "fee")


#: Two sources of events, where they list them and where each field stands.
SOURCES = {
    "markers": {"items": "$.markers", "name": "$.title", "date": ["$.when", "$.day"], "country": "$.land", "lat": "$.latitude", "lng": "$.longitude", "urls": ["$.site", "$.page"]},
    "hits": {"items": "$.data.hits", "name": "$.name", "date": "$.start.date", "distance": "$.length", "race_type": "$.kind", "urls": "$.links[0]"},
}


@query(
    "jobs_from_sources",
    """select 'markers' as source, p_partkey as id, p_name as name, '2026-05-' || lpad((1 + p_partkey % 28)::varchar, 2, '0') as date, case when p_size % 2 = 0 then 'SE' end as country, p_size::double as lat, null as race_type, 'https://www.e' || p_brand || '.org/x' as url, case when p_size % 3 = 0 then 1 else 2 end as n_urls from part where p_partkey % 2 = 0
    union all select 'hits', p_partkey, p_name, '2026-06-' || lpad((1 + p_partkey % 28)::varchar, 2, '0'), null, null, 'trail', 'https://e' || p_brand || '.org', 1 from part where p_partkey % 2 = 1""",
)
def jobs_from_sources(t):
    """Events of two sources by the table of their field paths: a part is an event, odd ones of the second source."""
    k, day, home = F.col("p_partkey"), F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0"), F.concat(F.lit("https://www.e"), "p_brand", F.lit(".org/x"))
    other = F.when(F.col("p_size") % 3 == 0, F.upper(home)).otherwise(F.concat(home, F.lit("/2")))
    marker = F.struct(F.concat(F.lit(" "), "p_name").alias("title"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.concat(day, F.lit(".05.2026"))).alias("when"), F.concat(F.lit("2026-05-"), day).alias("day"), F.when(F.col("p_size") % 2 == 0, "Sweden").alias("land"), F.col("p_size").cast("string").alias("latitude"), home.alias("site"), other.alias("page"))
    hit = F.struct(F.col("p_name").alias("name"), F.struct(F.concat(F.lit("202606"), day).alias("date")).alias("start"), F.lit("10").alias("length"), F.lit("trail running").alias("kind"), F.array(F.concat(F.lit("https://e"), "p_brand", F.lit(".org"))).alias("links"))
    value = F.when(k % 2 == 0, F.to_json(F.struct(F.array(marker).alias("markers")))).otherwise(F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("data"))))
    answers = t("part").select(F.when(k % 2 == 0, "markers").otherwise("hits").alias("source"), value.alias("value"), k.alias("id"))
    # an answer's id goes with its name
    jobs_ = intake.jobs_from(answers.withColumn("value", F.regexp_replace("value", '"(title|name)":"', F.concat(F.lit('"$1":"'), F.col("id"), F.lit("~")))), SOURCES, F.lit("2026-01-01").cast("date"))
    id_, name = F.split_part("name", F.lit("~"), F.lit(1)).cast("long"), F.trim(F.split_part("name", F.lit("~"), F.lit(2)))
    return jobs_.select("source", id_.alias("id"), name.alias("name"), "date", "country", "lat", "race_type", F.col("urls")[0].alias("url"), F.size("urls").alias("n_urls"))


@query("ids_of_names", "select n.p_name as name, min(s.p_partkey) as id, count(s.p_partkey) as n from (select distinct p_name from part) n left join part s on s.p_name = n.p_name and s.p_size > 25 group by 1")
def ids_of_names(t):
    """Names of parts looked up among the large ones, written in capitals there."""
    return intake.ids_of_names(t("part").select(F.col("p_name").alias("name")), t("part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name")))


@query("work_items", "select distinct sha256('peaks|7|' || o_custkey) as message_id, 'peaks' as work, o_custkey as id from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 2)")
def work_items(t):
    """Customers with orders put on a work list once, without those that are on it already."""
    new = intake.work_items(t("orders"), "peaks", F.lit(7), "o_custkey")
    return intake.add_items(intake.work_items(t("customer").where("c_nationkey = 2"), "peaks", F.lit(7), "c_custkey"), new)


@query("visited_order", "select feature_id, times, name from (select l_partkey as feature_id, count(distinct l_orderkey) as times, any_value(p_name) as name from lineitem join part on p_partkey = l_partkey where p_size = 7 group by 1)")
def visited_order(t):
    """Features by how often they were visited, then by name, with their names."""
    visited = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("feature_id")).join(t("part").where("p_size = 7").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name")), "feature_id")
    return visited.groupBy("feature_id").agg(F.count_distinct("l_orderkey").alias("times"), F.first("name").alias("name")).orderBy(F.desc("times"), "name", "feature_id")


@query("key_order", "select c_mktsegment || '-' || c_custkey as key, row_number() over (order by c_mktsegment || '-' || c_custkey) as place from customer qualify place <= 50")
def key_order(t):
    """The first keys by their bytes."""
    keys = t("customer").select(F.concat_ws("-", "c_mktsegment", "c_custkey").alias("key")).orderBy("key").limit(50)
    return keys.withColumn("place", F.row_number().over(Window.orderBy("key")).cast("long"))


#: Whether two distances are about the same.
ROUGH_SQL = "({a} = {b} or abs({a} - {b}) < 0.09::DOUBLE * greatest({a}, {b}))"


@query(
    "route_places",
    f"""with e as (select o_custkey as organizer, o_orderkey as entry, list_distinct(list(l_quantity::DOUBLE)) as km from orders join lineitem on o_orderkey = l_orderkey group by all),
    t as (select organizer, entry, len(km) as n, unnest(km) as km from e),
    anew as (select organizer, entry from (select s.organizer, s.entry, m.entry as other, max((abs(s.km - m.km) < 1e-9)::int) as same
        from t s join t m on s.organizer = m.organizer and s.n = 1 and m.n > 1 and {ROUGH_SQL.format(a="s.km", b="m.km")} group by all) group by all having arg_min(same, other) = 0),
    r as (select o_custkey as organizer, l_orderkey * 8 + l_linenumber as route_id, ceil(l_quantity::DOUBLE / 10) * 10 as canon, l_shipdate as date, l_linenumber % 2 = 0 as has_geometry from orders join lineitem on o_orderkey = l_orderkey),
    p as (select c.organizer, c.canon, count(distinct t.entry) as places from (select distinct organizer, canon from r) c join t on c.organizer = t.organizer and {ROUGH_SQL.format(a="c.canon", b="t.km")}
        where not exists (select 1 from anew where anew.organizer = t.organizer and anew.entry = t.entry) group by all),
    k as (select r.*, greatest(1, coalesce(places, 1)) as places, row_number() over (partition by r.organizer, r.canon order by date desc, has_geometry desc, route_id) as place from r left join p using (organizer, canon))
    select organizer, canon, route_id, places from k where place <= places""",
)
def route_places(t):
    """Of a customer's routes (lines of orders) of a cluster as many as its entries (orders) have places for, but for entries that say a listed distance anew."""
    lines = t("orders").select("o_orderkey", F.col("o_custkey").alias("organizer")).join(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("km"), "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    entries = lines.groupBy("organizer", F.col("o_orderkey").alias("entry")).agg(F.collect_set("km").alias("km"))
    routes_ = lines.select("organizer", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("route_id"), (F.ceil(F.col("km") / 10) * 10).cast("double").alias("canon"), F.col("l_shipdate").alias("date"), (F.col("l_linenumber") % 2 == 0).alias("has_geometry"))
    places = races.places_per_cluster(routes_, entries)
    return races.top_per_cluster(routes_, places).join(places, ["organizer", "canon"]).select("organizer", "canon", "route_id", "places")


@query(
    "event_keys",
    """select s_suppkey, case when s_suppkey % 3 = 0 then 'ev' || s_suppkey % 50 || '.org' when s_suppkey % 5 = 1 then null when s_suppkey % 2 = 0 then 'two' || s_suppkey % 20 || '.com'
        else lower(replace(s_name, '#', '-')) || case when s_suppkey % 7 > 0 then '-' || s_suppkey % 7 || '-km' else '' end end as key,
    case when s_suppkey % 3 = 0 then 'https://www.ev' || s_suppkey % 50 || '.org/x' when s_suppkey % 5 = 1 then null when s_suppkey % 2 = 0 then 'http://two' || s_suppkey % 20 || '.com/'
        else 'name://' || lower(replace(s_name, '#', '-')) || case when s_suppkey % 7 > 0 then '-' || s_suppkey % 7 || '-km' else '' end end as url from supplier""",
)
def event_keys(t):
    """Keys of events by the first address given, of a broken one what can be read, none on an ignored host, else by name and distance."""
    k, said = F.col("s_suppkey"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    urls = [F.when(k % 3 == 0, said("https://www.ev", (k % 50).cast("string"), ".org/x")), F.when(k % 5 == 1, "https://www.test.com/a").when(k % 4 == 1, " "), F.when(k % 2 == 0, said("https://http//two", (k % 20).cast("string"), ".com/"))]
    found = text.event_key(urls, F.col("s_name"), F.when(k % 7 > 0, said((k % 7).cast("string"), " km")))
    return t("supplier").select("s_suppkey", found["key"].alias("key"), found["url"].alias("url"))


@query(
    "country_names",
    """select s_suppkey, coalesce(name, code) as country from (select s_suppkey, substr(n_name, 1, 2) as code from supplier join nation on s_nationkey = n_nationkey)
    left join (select substr(n_name, 1, 2) as code, min(n_name) as name from nation where n_nationkey % 3 <> 0 group by 1) using (code)""",
)
def country_names(t):
    """Suppliers by the name of their country: codes looked up in the table of countries, of which some are missing and some share a code."""
    code = F.substring("n_name", 1, 2)
    held = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", code.alias("code"))
    named = t("nation").where("n_nationkey % 3 <> 0").select(F.lower(code).alias("country_code"), F.col("n_name").alias("name"))
    return features.with_country_names(held, "code", named).select("s_suppkey", "country")
