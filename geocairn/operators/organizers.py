"""Organizers and their redirects: statistics, candidates, confirmation; jobs by event, property bags, places of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import merge


def redirect_stats(redirects: DataFrame, organizers: DataFrame) -> DataFrame:
    """One row: n_redirects, n_existing and n_missing targets (redirects: source, target; organizers: key), compared without case."""
    known = organizers.select(F.lower("key").alias("__k")).distinct().withColumn("__there", F.lit(True))
    met = redirects.withColumn("__k", F.lower("target")).join(known, "__k", "left")
    return met.agg(F.count("*").alias("n_redirects"), F.count("__there").alias("n_existing"), F.count_if(F.col("__there").isNull()).alias("n_missing"))


def redirect_candidates(organizers: DataFrame) -> DataFrame:
    """source, target, url: organizers (key, urls) of a page on a shared host ("~" in the key) one of whose own pages leads to the key of an
    organizer that is there; a pair once, by its least page. Pages are read as web addresses only."""
    paged = organizers.where(F.col("key").contains("~")).select(F.col("key").alias("source"), F.explode("urls").alias("url"))
    paged = paged.where(F.lower("url").rlike("^https?://")).withColumn("target", text.organizer_key(F.col("url")))
    paged = paged.where("target is not null and not contains(target, '~') and lower(target) <> lower(source)")
    there = organizers.select(F.lower("key").alias("__k")).distinct()
    met = paged.withColumn("__k", F.lower("target")).join(there, "__k", "left_semi")
    return met.groupBy("source", "__k").agg(F.min("target").alias("target"), F.min("url").alias("url")).drop("__k")


def confirmed_redirects(observed: DataFrame, organizers: DataFrame, made: DataFrame) -> DataFrame:
    """Observed redirects (id, source, target, asked, final) with two different keys, each pair once without case, the first by id: whether
    the target is a known organizer (key) and whether the source's redirect was made already (made: source)."""
    filled = observed.where((F.trim("source") != "") & (F.trim("target") != "") & (F.lower("source") != F.lower("target")))
    first = filled.groupBy(F.lower("source").alias("__s"), F.lower("target").alias("__t")).agg(F.min_by(F.struct("source", "target", "asked", "final"), "id").alias("o"))
    known = organizers.select(F.lower("key").alias("__t")).distinct().withColumn("__known", F.lit(True))
    done = made.select(F.lower("source").alias("__s")).distinct().withColumn("__made", F.lit(True))
    out = first.join(known, "__t", "left").join(done, "__s", "left")
    return out.select("o.*", F.coalesce("__known", F.lit(False)).alias("target_known"), F.coalesce("__made", F.lit(False)).alias("already_made"))


def by_event(jobs: DataFrame, redirects: DataFrame, item: list[str]) -> DataFrame:
    """key (after redirects, the least spelling of those alike without case) and items, the jobs' (key, seq and item's columns) in order of
    seq. The lists are the jobs of one event's sources."""
    ends = merge.resolve_redirects(jobs.select("key").distinct(), redirects)
    met = jobs.join(ends, "key").groupBy(F.lower("target").alias("__k"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", *item))), lambda x: F.struct(*[x[c].alias(c) for c in item]))
    return met.agg(F.min("target").alias("key"), items.alias("items")).drop("__k")


def best_date(route_date: Column, discovery_date: Column, counts: Column) -> Column:
    """The later of the two days (as text) where the route's source counts; else the discovery's. Blank days are none."""
    route = F.when(counts & (F.trim(route_date) != ""), route_date)
    return F.coalesce(F.greatest(route, F.when(F.trim(discovery_date) != "", discovery_date)), discovery_date)


def property_bag(fields: dict[str, list[Column]]) -> Column:
    """A map of each field's first value that isn't null or blank, fields without one left out."""
    first = lambda values: reduce(lambda a, b: F.coalesce(a, b), [F.when(F.trim(v.cast("string")) != "", v.cast("string")) for v in values])
    return F.map_filter(F.create_map(*[x for name, values in fields.items() for x in (F.lit(name), first(values))]), lambda k, v: v.isNotNull())


def best_candidate(rows: DataFrame, keys: list[str], score: str, url: str) -> DataFrame:
    """Of each key the url of the highest score, of equal scores the least url."""
    return rows.groupBy(*keys).agg(F.min_by(url, F.struct(-F.col(score), F.col(url))).alias(url))


def is_place(location: Column) -> Column:
    """Whether a location can be looked up: not blank, no comma in front, and a letter or digit in it."""
    return F.coalesce((F.trim(location) != "") & ~F.trim(location).startswith(",") & location.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def geocoded(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """rows (location, country) with lng and lat from the gazetteer (location, country, lng, lat), matched without case and outer blanks; null
    where it has none or the location can't be one. Of several entries the one with the least coordinates counts."""
    key = lambda c: F.lower(F.trim(c))
    places = gazetteer.groupBy(key("location").alias("__l"), F.coalesce(key("country"), F.lit("")).alias("__c")).agg(F.min(F.struct("lng", "lat")).alias("__p"))
    asked = rows.withColumns({"__l": F.when(is_place(F.col("location")), key("location")), "__c": F.coalesce(key("country"), F.lit(""))})
    return asked.join(places, ["__l", "__c"], "left").select(*rows.columns, F.col("__p.lng").alias("lng"), F.col("__p.lat").alias("lat"))


def json_value(value: Column) -> Column:
    """What a JSON value is, as struct<kind, text, number, flag>: kind is null, boolean, integer, double, string, list or object; text holds
    strings, lists and objects."""
    v = F.try_parse_json(value)
    of = F.schema_of_variant(v)
    kind = (
        F.when(of.startswith("BIGINT"), "integer").when(of.startswith("DECIMAL") | of.startswith("DOUBLE"), "double").when(of == "BOOLEAN", "boolean")
        .when(of == "STRING", "string").when(of.startswith("ARRAY"), "list").when(of.startswith("OBJECT"), "object").when(of == "VOID", "null")
    )
    return F.struct(
        kind.alias("kind"), F.when(kind.isin("string", "list", "object"), F.try_variant_get(v, "$", "string")).alias("text"),
        F.when(kind.isin("integer", "double"), F.try_variant_get(v, "$", "double")).alias("number"), F.when(kind == "boolean", F.try_variant_get(v, "$", "boolean")).alias("flag"),
    )


def backfill_ids(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """Distinct ids of the rows that lack the key (null or blank)."""
    return rows.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).select(F.explode(ids).alias("id")).distinct()
