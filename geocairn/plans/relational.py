"""Queries of scans, filters, joins, aggregates, windows, sorts, sets and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import activity, merge
from ..sources import tables
from .registry import AS_OF, VISITS_SQL, query, visits


@query("full_scan", "select r_regionkey, r_name from region")
def full_scan(t):
    return t("region")


@query("parameter_scan", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 200000")
def parameter_scan(t):
    return tables.scan(t("orders"), "select o_orderkey, o_totalprice from {rows} where o_orderstatus = :status and o_totalprice > :least", {"status": "F", "least": 200000})


@query("page_by_key", "select c_custkey, c_name from customer where c_custkey > 40 order by c_custkey limit 25")
def page_by_key(t):
    """A page of a given size (the feature)."""
    return tables.page(t("customer").select("c_custkey", "c_name"), "c_custkey", 25, after=40)


@query("point_lookup", "select c_custkey, c_name from customer where c_custkey = 7")
def point_lookup(t):
    return tables.lookup(t("customer"), {"c_custkey": 7}).select("c_custkey", "c_name")


@query("multi_get", "select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
def multi_get(t):
    return tables.multi_get(t("orders").select("o_orderkey", "o_custkey"), t("lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("ids_by_key", "select s_suppkey from supplier where s_nationkey = 3")
def ids_by_key(t):
    return tables.ids_by_key(t("supplier"), "s_suppkey", "s_nationkey", 3)


@query("missing_keys", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 200000)")
def missing_keys(t):
    return t("customer").select("c_custkey").join(t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("rows_due", "select c_custkey, max(o_orderdate) as last from customer left join orders on c_custkey = o_custkey group by 1 having last is null or last < timestamp '2001-06-01'")
def rows_due(t):
    last = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return t("customer").select("c_custkey").join(last, "c_custkey", "left").where(F.col("last").isNull() | (F.col("last") < F.lit("2001-06-01").cast("timestamp")))


@query("minute_totals", "select time_bucket(interval '5 minutes', ts) as start, round(sum(value), 4) as total from events group by 1")
def minute_totals(t):
    return merge.count_minutes(t("events"), "ts", "value", 5).select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("total", 4).alias("total"))


@query("due_activities", "select event_id from events where event_type not in ('error', 'signup') and not coalesce(value > 50, false)")
def due_activities(t):
    return t("events").where(activity.still_due("paths", F.col("event_type"), F.col("value") > 50, ("error", "signup"))).select("event_id")


@query("array_membership", f"select user_id, feature_id from ({VISITS_SQL}) where list_contains(activity_ids, 77)")
def array_membership(t):
    return visits(t).where(F.coalesce(F.array_contains("activity_ids", 77), F.lit(False))).select("user_id", "feature_id")


@query("property_tests", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where json_extract(props, '$.k') is null or cast(json_extract(props, '$.k') as bigint) < 20")
def property_tests(t):
    """A property that is not there or below a version."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t("events").select("event_id", k.alias("k")).where(F.col("k").isNull() | (F.col("k") < 20))


@query("name_search", "select p_partkey, p_name from part where (lower(p_name) like '%ring%' or lower(p_brand) like '%ring%') and starts_with(p_type, 'ECO')")
def name_search(t):
    has = lambda c: F.contains(F.lower(c), F.lower(F.lit("RING")))
    return t("part").where((has("p_name") | has("p_brand")) & F.startswith("p_type", F.lit("ECO"))).select("p_partkey", "p_name")


@query("active_days", """select user_id, count(distinct case when event_type = 'view' then ts::date end) as days_viewing, count(distinct case when event_type = 'click' then ts::date end) as days_clicking,
    count(distinct case when event_type in ('view', 'click') then ts::date end) as days_total from events where ts <= timestamp '2024-01-25' and ts > timestamp '2024-01-03' group by 1""")  # fmt: skip
def active_days(t):
    e = t("events").where(activity.in_window(F.col("ts"), "2024-01-25", "2024-01-03"))
    return activity.active_days(e, {"viewing": "view", "clicking": "click"}, kind="event_type")


@query("streaks", f"""with d as (select distinct user_id, ts::date as day from events where ts::date <= date '{AS_OF}'),
    i as (select *, day - cast(row_number() over (partition by user_id order by day) as integer) as g from d),
    r as (select user_id, count(*) as n, min(day) as first, max(day) as last from i group by user_id, g)
    select user_id, coalesce(max(case when last >= date '{AS_OF}' - 1 then n end), 0) as current_streak, max(n) as longest_streak, arg_max(first, (n, last)) as longest_start, arg_max(last, (n, last)) as longest_end
    from r group by 1""")  # fmt: skip
def streaks(t):
    return activity.streaks(t("events"), AS_OF)


@query("histogram", "select b::integer as bucket, count(s_acctbal) as n from range(10) t(b) left join supplier on cast(trunc(s_acctbal) as bigint) // 1000 = b and s_acctbal > -1000 group by 1")
def histogram(t):
    return activity.histogram(t("supplier"), "s_acctbal", 1000, 10)


@query("top_features", "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 5")
def top_features(t):
    """The five most visited (the feature)."""
    return activity.top_by_count(t("lineitem"), "l_partkey", 5)


@query("visited_features", f"""select v.user_id, v.feature_id, len(activity_ids) as times_visited, min(o_orderdate) as first, max(o_orderdate) as last from ({VISITS_SQL}) v, unnest(activity_ids) u(a)
    left join orders on o_orderkey = a and o_orderstatus <> 'P' group by all""")  # fmt: skip
def visited_features(t):
    """Evidence that isn't there counts, but has no date."""
    acts = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("activity_id"), F.col("o_orderdate").alias("ts"))
    return activity.evidence_summary(visits(t), acts, ["user_id", "feature_id"]).drop("dates")


@query("user_status", """select c_custkey as user_id, count(o_orderkey) as n_activities, max(case when o_orderstatus = 'F' then o_orderdate end) as last_login from customer left join orders on c_custkey = o_custkey group by 1""")
def user_status(t):
    o = t("orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderstatus")
    return activity.user_status(t("customer").select(F.col("c_custkey").alias("user_id")), o, o.where("o_orderstatus = 'F'"), ts="o_orderdate")


@query("counts_in_one_pass", "select user_id, count(*) as n, count(*) filter (event_type = 'error') as n_errors, count(*) filter (value > 50) as n_large, max(ts) filter (event_type = 'purchase') as last_purchase from events group by 1")
def counts_in_one_pass(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("value") > 50).alias("n_large"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_purchase"))


@query("consolidated_facts", """select o_custkey as user_id, o_orderstatus as key, arg_min(nullif(trim(o_orderpriority), ''), o_orderkey) as name, arg_min(case when o_totalprice > 100000 then o_totalprice end, case when o_totalprice > 100000 then o_orderkey end) as elevation,
    count(*) as n_ids from orders group by 1, 2""")  # fmt: skip
def consolidated_facts(t):
    o = t("orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "peak:").otherwise(""), F.col("o_orderstatus")).alias("id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("elevation"), F.array("o_orderkey").alias("ids"), "o_orderkey")
    out = activity.consolidate(o, F.regexp_replace("id", "^peak:", ""), "user_id", "name", "elevation", "ids", "o_orderkey")
    return out.select("user_id", "key", "name", "elevation", F.size("ids").cast("long").alias("n_ids"))


@query("last_write_wins", """with r as (select user_id, event_type, ts, event_type = 'error' as deleted, value, event_id from events)
    select user_id, event_type, max(ts) as updated_at, arg_max(event_type = 'error', (ts, event_id)) as deleted, arg_max(case when event_type <> 'error' then event_id::varchar end, (ts, event_id)) as value from r group by 1, 2""")  # fmt: skip
def last_write_wins(t):
    e = t("events").select("user_id", "event_type", F.col("ts").alias("updated_at"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").cast("string").alias("value"))
    old = F.col("updated_at") < F.lit("2024-01-15").cast("timestamp")
    return merge.last_write_wins(e.where(old), e.where(~old), ["user_id", "event_type"])


@query("latest_per_user", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_user(t):
    return merge.latest_per_key(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("preferred_rows", "select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_size > 25, p_partkey) = 1")
def preferred_rows(t):
    """Stored rows before pointers to them."""
    return merge.distinct_by(t("part"), F.col("p_brand"), [F.col("p_size") > 25, "p_partkey"]).select("p_brand", "p_partkey")


@query("retracted_facts", f"""select user_id, feature_id, len(list_filter(activity_ids, lambda x: x % 7 <> 0 or x >= 700)) as n_left, case when n_left = 0 then 'delete' else 'patch' end as action from ({VISITS_SQL})
    where len(list_filter(activity_ids, lambda x: x % 7 = 0 and x < 700)) > 0""")  # fmt: skip
def retracted_facts(t):
    gone = F.array(*[F.lit(x).cast("long") for x in range(0, 700, 7)])
    return merge.retract(visits(t), gone).select("user_id", "feature_id", F.size("activity_ids").alias("n_left"), "action")


@query("snapshot_diff", """with a as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 10 <> 0), b as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 0 else o_totalprice end as v from orders where o_orderkey % 11 <> 0)
    select k as id, case when a.v is null then 'insert' when b.v is null then 'delete' when a.v = b.v then 'unchanged' else 'update' end as change from a full join b using (k)""")  # fmt: skip
def snapshot_diff(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return merge.snapshot_diff(o.where("id % 10 <> 0"), o.where("id % 11 <> 0").withColumn("price", F.when(F.col("id") % 7 == 0, F.lit(0.0)).otherwise(F.col("price"))), ["id"])


@query("redirects", """with recursive c as (select c_custkey as key, c_custkey as target, 0 as d from customer union all select key, target // 2, d + 1 from c where d < 8 and target % 3 = 0 and target > 0)
    select key::varchar as key, arg_max(target, d)::varchar as target from c group by key""")  # fmt: skip
def redirects(t):
    """Keys divisible by three redirect to their half."""
    keys = t("customer").select(F.col("c_custkey").cast("string").alias("key"))
    chain = t("customer").where("c_custkey % 3 = 0 and c_custkey > 0").select(F.col("c_custkey").cast("string").alias("source"), F.floor(F.col("c_custkey") / 2).cast("string").alias("target"))
    return merge.resolve_redirects(keys, chain)


@query("first_by_priority", """select l_orderkey, arg_min(l_returnflag, l_linenumber) filter (l_returnflag <> 'N') as flag, arg_min(l_quantity, l_linenumber) filter (l_quantity > 25) as quantity from (select distinct on (l_orderkey, l_linenumber) * from
    (select l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag, max(l_quantity) as l_quantity from lineitem group by 1, 2)) group by 1""")  # fmt: skip
def first_by_priority(t):
    x = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))
    x = x.withColumns({"flag": F.when(F.col("flag") != "N", F.col("flag")), "quantity": F.when(F.col("quantity") > 25, F.col("quantity"))})
    return merge.first_by_priority(x, ["l_orderkey"], ["flag", "quantity"], F.col("l_linenumber"))


@query("fragment_numbers", "select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber, l_suppkey) - 1 as fragment from lineitem")
def fragment_numbers(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_partkey", "l_linenumber", "l_suppkey").alias("o"))
    return merge.number_fragments(x, ["l_orderkey"], "o").drop("o").withColumn("fragment", F.col("fragment").cast("long"))


@query("similar_ids", "select c_custkey as id, representative from (select c_custkey, min(c_custkey) over (partition by c_nationkey, c_mktsegment) as representative from customer) where c_custkey <> representative")
def similar_ids(t):
    """Ids that share a stem, each with the least of its group: no pair of two others is made."""
    c = t("customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    return merge.representatives(c, ["c_nationkey", "c_mktsegment"], "id").select("id", "representative").where("id <> representative")


@query("grouped_hierarchy", "select r_name, n_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def grouped_hierarchy(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("ambiguous_names", "select p_partkey, case when count(*) over (partition by lower(p_name)) > 1 then p_name || ' ' || p_size else p_name end as name from part")
def ambiguous_names(t):
    many = F.count("*").over(Window.partitionBy(F.lower("p_name"))) > 1
    return t("part").select("p_partkey", F.when(many, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).otherwise(F.col("p_name")).alias("name"))


@query("union_of_ids", "select s_nationkey as id from supplier union select c_nationkey from customer where c_acctbal < 0")
def union_of_ids(t):
    return t("supplier").select(F.col("s_nationkey").alias("id")).union(t("customer").where("c_acctbal < 0").select("c_nationkey")).distinct()


@query("sorted_users", "select user_id, n from (select user_id, count(*) as n from events group by 1) order by n desc, user_id limit 10")
def sorted_users(t):
    return activity.top_by_count(t("events").where("user_id is not null"), "user_id", 10)


@query("expired_rows", "select o_orderkey from orders where o_orderdate + interval 30 days > timestamp '2001-01-01'")
def expired_rows(t):
    """Rows whose time to live is not over."""
    o = t("orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 30 days")).alias("expires_at"))
    return tables.live(o, "2001-01-01").select("o_orderkey")
