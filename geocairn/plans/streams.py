"""Queries that run a feed to its end and read what it left."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import merge
from ..sources import shared
from ..streaming import feeds, status
from .registry import BOX_SQL, ORACLES, QUERIES, boxes, lat_sql, lng_sql, place


def _feed(spark: SparkSession, sf_dir: str):
    """The table as a stream; the brackets make a pattern of its name, as a stream reads folders or patterns, not one file."""
    return feeds.read_changes(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


def streamed_state(spark: SparkSession, sf_dir: str):
    """Last write wins over the log a stream has kept."""
    folder = shared.new_folder(spark)
    feeds.keep_log(_feed(spark, sf_dir), folder, shared.new_folder(spark), F.col("user_id").isNotNull()).awaitTermination()
    log = spark.read.parquet(folder).where("not quarantine").select("user_id", "event_type", F.col("ts").alias("updated_at"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").cast("string").alias("value"))
    return merge.last_write_wins(log.limit(0), log, ["user_id", "event_type"])


def streamed_work_lists(spark: SparkSession, sf_dir: str):
    """Events dealt to work lists; an event may be on several."""
    folder = shared.new_folder(spark)
    kind = F.col("event_type")
    lists = {"peaks": ~kind.isin("error", "signup"), "areas": kind != "error", "paths": kind.isin("view", "click") & (F.col("value") < 50)}
    feeds.fan_out(_feed(spark, sf_dir), lists, folder, shared.new_folder(spark)).awaitTermination()
    return spark.read.parquet(folder).select("event_id", "list")


def streamed_facts(spark: SparkSession, sf_dir: str):
    """User by kind of event, with the set of events as evidence."""
    folder = shared.new_folder(spark)
    match = lambda e: e.where("value >= 50").select("user_id", F.col("event_type").alias("feature_id"), "event_id")
    feeds.keep_facts(_feed(spark, sf_dir), match, folder, shared.new_folder(spark), "event_id").awaitTermination()
    sets = feeds.fact_sets(feeds.current_facts(spark, folder, "event_id"), "event_id")
    return sets.select("user_id", "feature_id", F.size("activity_ids").cast("long").alias("n"), F.array_min("activity_ids").alias("first_id"))


def streamed_windows(spark: SparkSession, sf_dir: str):
    """Counts of the hours that the watermark has closed."""
    folder = shared.new_folder(spark)
    counts = feeds.minute_counts(_feed(spark, sf_dir), "ts", ["event_type"], 60)
    feeds.append_to(counts.select(F.col("window.start").alias("start"), "event_type", "n"), folder, shared.new_folder(spark)).awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(folder)


def streamed_marks(spark: SparkSession, sf_dir: str):
    """Users and kinds of events, each marked once."""
    folder = shared.new_folder(spark)
    feeds.append_to(feeds.mark_once(_feed(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), folder, shared.new_folder(spark)).awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(folder)


def streamed_status(spark: SparkSession, sf_dir: str):
    """Activities by user, stage and feature, and by status, after a feed of finds and deletes."""
    folder, kind = shared.new_folder(spark), F.col("event_type")
    stage = F.when(kind == "view", "peaks").when(kind == "click", "paths").when(kind == "purchase", "areas")
    rows = _feed(spark, sf_dir).select("user_id", (F.col("event_id") % 11).alias("activity_id"), stage.alias("kind"), F.floor(F.col("value") / 25).cast("string").alias("feature_id"), F.col("ts").alias("at"), (kind == "error").alias("deleted"))
    status.keep_status(rows, folder, shared.new_folder(spark)).awaitTermination()
    return status.counters(spark, folder, ["user_id", "what", "name"])


def streamed_due(spark: SparkSession, sf_dir: str):
    """Boundaries that a feed of changed features makes due: events are boundaries, peaks and paths by their kind."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    folder, kind = shared.new_folder(spark), F.col("event_type")
    named = F.when(kind == "view", "peak").when(kind == "click", "adminBoundary").otherwise("path")
    changed = _feed(spark, sf_dir).select(F.col("event_id").cast("string").alias("feature_id"), named.alias("kind"), F.when(F.col("event_id") % 5 == 0, "x").alias("stored_id"), geo.point(*place("event_id")).alias("centroid"), (F.col("event_id") % 3).cast("string").alias("version"), (F.col("value") > 100).alias("forced"))
    feeds.keep_due(changed, boxes(table), folder, shared.new_folder(spark), 2, F.col("forced"), 9).awaitTermination()
    return feeds.current_due(spark, folder)


QUERIES |= {"streamed_due": streamed_due, "streamed_status": streamed_status, "streamed_state": streamed_state, "streamed_work_lists": streamed_work_lists, "streamed_facts": streamed_facts, "streamed_windows": streamed_windows, "streamed_marks": streamed_marks}
ORACLES |= {
    "streamed_due": f"""select event_id::varchar as polygon_id, 'own' as why from events where event_type = 'click' and event_id % 5 <> 0 and (event_id % 3 < 2 or value > 100)
        union all select distinct polygon_id::varchar, 'within' from events join ({BOX_SQL}) on {lng_sql('event_id')} between x0 and x0 + 0.35::double and {lat_sql('event_id')} between y0 and y0 + 0.35::double where event_type = 'view' and event_id % 5 <> 0""",
    "streamed_status": """with e as (select user_id, event_id % 11 as activity_id, case event_type when 'view' then 'peaks' when 'click' then 'paths' when 'purchase' then 'areas' end as kind, (floor(value / 25)::bigint)::varchar as name, ts, event_type = 'error' as deleted from events where user_id is not null),
        a as (select user_id, activity_id, max(case when deleted then ts end) as gone from e group by all),
        f as (select user_id, activity_id, kind, name from e join a using (user_id, activity_id) where kind is not null group by all having max(ts) > coalesce(any_value(gone), timestamp '1900-01-01')),
        s as (select a.user_id, a.activity_id, case when count(distinct kind) = 3 then 'done' when count(kind) > 0 then 'partial' when any_value(gone) is not null then 'deleted' else 'queued' end as name from a left join f using (user_id, activity_id) group by all)
        select user_id, kind as what, name, count(*) as n from f group by all union all select user_id, 'status', name, count(*) from s group by all""",
    "streamed_state": """select user_id, event_type, max(ts) as updated_at, arg_max(event_type = 'error', (ts, event_id)) as deleted, arg_max(case when event_type <> 'error' then event_id::varchar end, (ts, event_id)) as value
        from events where user_id is not null group by 1, 2""",
    "streamed_work_lists": """select event_id, 'peaks' as list from events where event_type not in ('error', 'signup') union all select event_id, 'areas' from events where event_type <> 'error'
        union all select event_id, 'paths' from events where event_type in ('view', 'click') and value < 50""",
    "streamed_facts": "select user_id, event_type as feature_id, count(distinct event_id) as n, min(event_id) as first_id from events where value >= 50 group by 1, 2",
    "streamed_windows": """select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2 having start + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)""",
    "streamed_marks": "select distinct user_id, event_type from events",
}
