"""Queries of the text functions and of the event-listing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels, text
from ..operators import races
from .registry import query

_KM = "(5 + (c_custkey * 37 % 400) / 10.0::DOUBLE)"


def _km():
    return 5 + (F.col("c_custkey") * 37 % 400).cast("double") / 10.0


@query("distance_parsing", f"""select c_custkey, round(case c_custkey % 5 when 0 then {_KM} when 1 then {_KM} * 1.60934::DOUBLE when 2 then {_KM} / 1000 when 3 then 42 else null end, 9) as km from customer""")
def distance_parsing(t):
    n = _km().cast("string")
    token = F.element_at(F.array(F.concat(n, F.lit(" km")), F.concat(n, F.lit("M")), F.concat(F.replace(n, F.lit("."), F.lit(",")), F.lit(" m")), F.lit("Marathon"), F.lit("soon")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t("customer").select("c_custkey", F.round(text.primary_km(token), 9).alias("km"))


@query("rough_equality", f"select c_custkey, ({_KM} = 20 or abs({_KM} - 20) < 0.09::DOUBLE * greatest({_KM}, 20)) as about_20 from customer")
def rough_equality(t):
    return t("customer").select("c_custkey", text.roughly_equal(_km(), F.lit(20.0)).alias("about_20"))


@query("compact_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def compact_dates(t):
    """Dates written four ways and read back."""
    d = F.col("o_orderdate")
    ways = F.array(F.date_format(d, "yyyyMMdd"), F.date_format(d, "d.M.yyyy"), F.date_format(d, "MMMM d, yyyy"), F.concat(F.lit("lördag "), F.date_format(d, "d MMMM yyyy"), F.lit(" kl. 10:00")))
    return t("orders").select("o_orderkey", text.iso_date(F.element_at(ways, (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit("2024-01-30").cast("date")).alias("day"))


@query("feature_ids", "select c_custkey, 'way:' || c_custkey as id from customer")
def feature_ids(t):
    stored = F.concat(F.when(F.col("c_custkey") % 2 == 0, "adminBoundary:4:").otherwise(""), F.lit("way:"), F.col("c_custkey"))
    return t("customer").select("c_custkey", text.feature_id(stored, "adminBoundary").alias("id"))


@query("page_hosts", r"select page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') as host from pages")
def page_hosts(t):
    return t("pages").select("page_id", text.organizer_key(F.col("url")).alias("host"))


@query("page_links", """select page_id, len(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) as n_links, regexp_extract_all(html, '(?i)href="([^"]*)"', 1)[1] as first_link from pages""")
def page_links(t):
    found = text.links(F.col("html"))
    return t("pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.get(found, F.lit(0)).alias("first_link"))


@query("page_text", r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as body from pages""")
def page_text(t):
    return t("pages").select("page_id", text.visible_text(F.col("html")).alias("body"))


@query(
    "page_titles",
    r"""select page_id, trim(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&')) as title from pages""",
)
def page_titles(t):
    return t("pages").select("page_id", kernels.unescape(text.strip_tags(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"))


@query("stems", "select page_id, regexp_replace(list_aggregate(string_split(regexp_replace(lower(h), '^www\\.', ''), '.')[:-2], 'string_agg', ''), '[^a-z0-9]', '', 'g') as stem from (select page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) as h from pages)")
def stems(t):
    return t("pages").select("page_id", text.comparable_stem(text.host(F.col("url"))).alias("stem"))


@query("nearest_discovery", f"""with r as (select c_custkey as route_id, {_KM} as km from customer), d as (select s_suppkey as discovery_id, 5 + (s_suppkey * 53 % 400) / 10.0::DOUBLE as km, s_suppkey % 2 = 0 as is_multi from supplier)
    select route_id, discovery_id from r join d on r.km = d.km or abs(r.km - d.km) < 0.09::DOUBLE * greatest(r.km, d.km) qualify row_number() over (partition by route_id order by is_multi, abs(r.km - d.km), discovery_id) = 1""")  # fmt: skip
def nearest_discovery(t):
    r = t("customer").select(F.col("c_custkey").alias("route_id"), _km().alias("km"), F.lit("all").alias("organizer"))
    d = t("supplier").select(F.col("s_suppkey").alias("discovery_id"), (5 + (F.col("s_suppkey") * 53 % 400).cast("double") / 10.0).alias("km"), (F.col("s_suppkey") % 2 == 0).alias("is_multi"), F.lit("all").alias("organizer"))
    return races.best_discovery(r, d)


@query(
    "distance_clusters",
    f"""with recursive d as (select c_nationkey as organizer, km, row_number() over (partition by c_nationkey order by km) as i from (select distinct c_nationkey, {_KM} as km from customer)),
    f as (select organizer, km, i, km as canon from d where i = 1 union all
        select d.organizer, d.km, d.i, case when d.km = f.canon or abs(d.km - f.canon) < 0.09::DOUBLE * greatest(d.km, f.canon) then f.canon else d.km end from f join d on d.organizer = f.organizer and d.i = f.i + 1)
    select organizer, km, canon from f""",
)
def distance_clusters(t):
    c = t("customer").select(F.col("c_nationkey").alias("organizer"), _km().alias("km"))
    return races.canonical_distances(c, "organizer", "km")


@query("slots", f"select c_custkey, c_nationkey || '-' || (row_number() over (partition by c_nationkey order by {_KM} nulls last, lower(c_name), c_custkey) - 1) as slot from customer")
def slots(t):
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("organizer"), _km().alias("km"), F.col("c_name").alias("name"))
    return races.slots(c, "c_custkey").select("c_custkey", "slot")
