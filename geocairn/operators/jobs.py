"""What to do with incoming records: event routing, retry times, write decisions by content hash, grants, counts over maps of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "object_type string, aspect_type string, object_id string, owner_id string, updates map<string,string>"


def route_events(events: DataFrame, body: str = "body") -> DataFrame:
    """events (JSON text in body) with action (fetch, delete, close; null for others and for unreadable text), activity_id and user_id."""
    e = F.from_json(body, EVENT)
    known = lambda c: F.coalesce(e[c], F.lit("")) != ""
    activity = (e["object_type"] == "activity") & known("object_id") & known("owner_id")
    action = (
        F.when(activity & e["aspect_type"].isin("create", "update"), "fetch")
        .when(activity & (e["aspect_type"] == "delete"), "delete")
        .when((e["object_type"] == "athlete") & (e["aspect_type"] == "update") & (F.lower(e["updates"]["authorized"]) == "false") & known("owner_id"), "close")
    )
    return events.select("*", action.alias("action"), F.when(action.isin("fetch", "delete"), e["object_id"]).alias("activity_id"), F.when(action.isNotNull(), e["owner_id"]).alias("user_id"))


def next_quarter_hour(now: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(now) / 900) * 900 + 900)


def retry_at(now: Column, daily: Column, started: Column, key: Column) -> Column:
    """When to try again: the next quarter of an hour; over the day's limit the next midnight, and for what began six months ago or earlier
    a second within tomorrow's last hour that the key decides."""
    tomorrow = F.date_add(F.to_date(now), 1).cast("timestamp")
    second = F.pmod(F.xxhash64(key), F.lit(3600)) + 23 * 3600
    old = started <= F.add_months(F.to_date(now), -6).cast("timestamp") + (now - F.date_trunc("day", now))
    return F.when(daily & F.coalesce(old, F.lit(False)), F.timestamp_seconds(F.unix_timestamp(tomorrow) + second)).when(daily, tomorrow).otherwise(next_quarter_hour(now))


def write_plan(stored: DataFrame, incoming: DataFrame, keys: list[str], properties: list[str], content: list[str]) -> DataFrame:
    """incoming with its hashes and decision: "skip" where both hashes equal the stored ones (properties_hash, content_hash), "patch" where
    only the properties differ, "write" otherwise."""
    digest = lambda columns: F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    fresh = incoming.withColumns({"properties_hash": digest(properties), "content_hash": digest(content)})
    old = stored.select(*keys, F.col("properties_hash").alias("__p"), F.col("content_hash").alias("__c"))
    same = F.coalesce(F.col("content_hash") == F.col("__c"), F.lit(False))
    decision = F.when(same & F.coalesce(F.col("properties_hash") == F.col("__p"), F.lit(False)), "skip").when(same, "patch").otherwise("write")
    return fresh.join(old, keys, "left").withColumn("decision", decision).drop("__p", "__c")


def scopes(granted: Column) -> Column:
    """The grants in a list set apart by commas or spaces, each once (without case) and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(granted, F.lit(""))), r"[,\s]+"), lambda s: s != "")))


def token_state(refresh: Column, access: Column, expires: Column, granted: Column, now: Column) -> list[Column]:
    """has_refresh, has_access, expires_at, expired, scopes, and a flag per common grant."""
    held = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    at = F.when(expires > 0, F.timestamp_seconds(expires))
    grants = {"read": "read", "read_all": "read_all", "activity_read": "activity:read", "activity_read_all": "activity:read_all", "activity_write": "activity:write"}
    flags = [F.array_contains(scopes(granted), g).alias(f"has_{n}") for n, g in grants.items()]
    return [held(refresh).alias("has_refresh_token"), held(access).alias("has_access_token"), at.alias("expires_at"), F.coalesce(at <= now, F.lit(False)).alias("expired"), scopes(granted).alias("scopes"), *flags]


def source_counts(rows: DataFrame, entries: str) -> DataFrame:
    """For a map of lists by source: source, n_rows (rows that have it), n_entries (list elements), the counts folded before the shuffle."""
    each = rows.select(F.explode(entries).alias("source", "__list"))
    return each.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.greatest(F.size("__list"), F.lit(0))).alias("n_entries"))


def search(rows: DataFrame, words: str | None, fields: list[str], facets: dict[str, bool | None], entries: str | None = None, source: str | None = None) -> DataFrame:
    """rows of which some field contains the words (without case), whose facet columns are non-empty or not as asked (None: either), and that
    have an entry of the source."""
    out = rows
    if words and words.strip():
        out = out.where(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(words.strip().lower())))
    for column, wanted in facets.items():
        if wanted is not None:
            filled = F.coalesce(F.size(column) > 0, F.lit(False))
            out = out.where(filled if wanted else ~filled)
    if source and entries:
        out = out.where(F.exists(F.map_keys(F.col(entries)), lambda k: F.lower(k) == source.lower()))
    return out
