"""Event listings from several sources made into one: matching by distance, clustering of distances, merging, numbering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import cut
from .graph import components

#: Distances that are about the same differ by less than this factor, so they lie in neighbouring steps of its logarithm.
STEP = -math.log(1 - text.ROUGH)


def nearest_of_about(asked: DataFrame, held: DataFrame) -> DataFrame:
    """organizer, km and best (rank, off, id) of each distance asked for (organizer, km) that one held (organizer, km, rank: a boolean, id) is about the same as:
    least rank first (null, false, true), then the nearest, then the least id.

    Distances are met as sets: of equal ones with a rank the least id stands for all, and of each rank only the next below and the next above are looked at, so
    the rows are as many as an organizer's different distances, however many routes have them.
    """
    ranks = (None, False, True)
    kinds = "boolean"
    some = "organizer is not null and km > 0"
    asks = asked.where(some).select("organizer", F.col("km").cast("double").alias("km"), F.lit(True).alias("__ask"), F.lit(None).cast(kinds).alias("rank"), F.lit(None).cast(held.schema["id"].dataType).alias("id"))
    rows = asks.unionByName(held.where(some).select("organizer", F.col("km").cast("double").alias("km"), F.lit(False).alias("__ask"), F.col("rank").cast(kinds).alias("rank"), "id"))
    least = [F.min(F.when(~F.col("__ask") & F.col("rank").eqNullSafe(F.lit(r).cast(kinds)), F.struct("id", "km"))).alias(f"__{i}") for i, r in enumerate(ranks)]
    sets = rows.groupBy("organizer", "km").agg(F.max("__ask").alias("__ask"), *least)
    by = Window.partitionBy("organizer").rowsBetween(Window.unboundedPreceding, 0)
    up, down = by.orderBy("km"), by.orderBy(F.desc("km"))
    found = sets.withColumns({f"__{i}{d}": F.last(f"__{i}", ignorenulls=True).over(w) for d, w in (("u", up), ("d", down)) for i in range(len(ranks))})
    of = lambda i, r, d: F.when(text.roughly_equal(F.col("km"), F.col(f"__{i}{d}.km")), F.struct(F.lit(r).cast(kinds).alias("rank"), F.abs(F.col("km") - F.col(f"__{i}{d}.km")).alias("off"), F.col(f"__{i}{d}.id").alias("id")))
    best = F.array_min(F.array(*[of(i, r, d) for i, r in enumerate(ranks) for d in "ud"]))
    return found.where("__ask").select("organizer", "km", best.alias("best")).where("best is not null")


def best_discovery(routes: DataFrame, discoveries: DataFrame) -> DataFrame:
    """Per route (organizer, route_id, km) the discovery (organizer, discovery_id, km, is_multi) of about the same distance: those with one
    distance first, then the nearest, then the least id. Settled once per distance, which its routes then look up."""
    held = discoveries.select("organizer", "km", F.col("is_multi").alias("rank"), F.col("discovery_id").alias("id"))
    asked = routes.select("organizer", "route_id", F.col("km").cast("double").alias("km"))
    found = asked.join(nearest_of_about(asked, held), ["organizer", "km"]).groupBy("organizer", "route_id").agg(F.min("best").alias("best"))
    return found.select("route_id", F.col("best.id").alias("discovery_id"))


def anchored(km: Column) -> Column:
    """For sorted distinct distances: struct<km, canon>, canon being the least distance of the cluster; a distance that isn't about the
    same as that opens the next cluster."""
    start = F.array().cast("array<struct<km:double,canon:double>>")

    def add(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))["canon"]
        return F.array_append(a, F.struct(x.alias("km"), F.when(text.roughly_equal(last, x), last).otherwise(x).alias("canon")))

    return F.aggregate(km, start, add)


def canonical_distances(rows: DataFrame, key: str, km: str) -> DataFrame:
    """key, km and canon for each distinct distance of a key."""
    sets = rows.where(F.col(km).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.col(km).cast("double"))).alias("__kms"))
    return sets.select(key, F.explode(anchored(F.col("__kms"))).alias("c")).select(key, "c.km", "c.canon")


def top_per_cluster(routes: DataFrame, per_cluster: DataFrame) -> DataFrame:
    """Of the routes (organizer, canon, date, has_geometry, route_id) of a cluster as many as it has places (organizer, canon, places; one
    at least), the latest first, then those with geometry; routes without a distance all stay."""
    rank = F.row_number().over(Window.partitionBy("organizer", "canon").orderBy(F.desc_nulls_last("date"), F.desc("has_geometry"), "route_id"))
    ranked = routes.join(per_cluster, ["organizer", "canon"], "left").withColumn("__rank", rank)
    return ranked.where(F.col("canon").isNull() | (F.col("__rank") <= F.greatest(F.lit(1), F.coalesce("places", F.lit(1))))).drop("__rank", "places")


def _steps(km: str) -> Column:
    """The step of a distance's logarithm."""
    return F.floor(F.log(km) / STEP).cast("int")


def remeasured(entries: DataFrame) -> DataFrame:
    """organizer and entry of those entries (organizer, entry, km as an array) that list one distance only and say that of another entry's list anew: the
    organizer's first entry, by `entry`, of several distances with one about the same has none that is the same."""
    each = entries.select("organizer", "entry", F.array_distinct(F.filter("km", lambda k: k > 0)).alias("km"))
    single = each.where("size(km) = 1").select("organizer", "entry", F.col("km")[0].alias("own")).withColumn("step", F.explode(F.sequence(_steps("own") - 1, _steps("own") + 1)))
    listed = each.where("size(km) > 1").select("organizer", F.col("entry").alias("other"), F.explode("km").alias("km")).withColumn("step", _steps("km"))
    met = single.join(listed, ["organizer", "step"]).where(text.roughly_equal(F.col("own"), F.col("km")))
    first = F.min(F.struct("other", (F.abs(F.col("km") - F.col("own")) >= 1e-9).alias("anew")))
    return met.groupBy("organizer", "entry").agg(first["anew"].alias("anew")).where("anew").drop("anew")


def places_per_cluster(clusters: DataFrame, entries: DataFrame) -> DataFrame:
    """organizer, canon and places for clusters (organizer, canon): how many of the organizer's entries (organizer, entry, km as an array) list a distance about
    the cluster's, but for those that only say a listed one anew (remeasured()); one at least. An equi-join on the step of the distance's logarithm."""
    each = entries.join(remeasured(entries), ["organizer", "entry"], "left_anti").select("organizer", "entry", F.explode("km").alias("km")).where("km > 0").distinct()
    each = each.withColumn("step", F.explode(F.sequence(_steps("km") - 1, _steps("km") + 1)))
    clusters = clusters.select("organizer", "canon").distinct()
    met = clusters.where("canon > 0").withColumn("step", _steps("canon")).join(each, ["organizer", "step"]).where(text.roughly_equal(F.col("canon"), F.col("km")))
    counted = met.select("organizer", "canon", "entry").distinct().groupBy("organizer", "canon").agg(F.count("*").alias("places"))
    return clusters.join(counted, ["organizer", "canon"], "left").withColumn("places", F.greatest(F.lit(1).cast("long"), F.coalesce("places", F.lit(1))))


def merge_discoveries(rows: DataFrame, fields: list[str], priority: Column, longest: tuple[str, ...] = ()) -> DataFrame:
    """One row per organizer and name (without case; rows without a name stay by themselves): of each field the first value that isn't null
    by priority, but of those named in `longest` (places, say) the longest, all urls each once, all distances each once and sorted, and the latest date. Needs id, organizer, name, urls, km, date."""
    name = F.coalesce(F.lower(F.trim("name")), F.concat(F.lit("\0"), F.col("id").cast("string")))
    grouped = rows.withColumns({"__name": name, "__p": priority}).groupBy("organizer", "__name")
    size = lambda c: (F.when(c.isNotNull(), -F.length(F.trim(c))),)
    kept = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*(size(F.col(c)) if c in longest else ()), "__p", "id"))).alias(c) for c in fields]
    return grouped.agg(F.min("id").alias("id"), *kept, F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("km")))).alias("km"), F.max("date").alias("date")).drop("__name")


def same_event_groups(rows: DataFrame) -> DataFrame:
    """rows (id, organizer, name, km as an array) with group, the least id of those that are one event: same organizer and name and a
    distance about the same, directly or through others.

    In order of distance, what is about the same as a later distance is about the same as all between, so each distance is tied to the one before it only;
    the ties of all names are closed together.
    """
    each = rows.withColumn("__name", F.lower(F.trim("name"))).where("__name is not null").select("id", "organizer", "__name", F.explode("km").alias("__km")).where("__km is not null")
    order = Window.partitionBy("organizer", "__name").orderBy("__km", "id")
    before = F.lag(F.struct("__km", "id")).over(order)
    tied = each.withColumn("__before", before).where(text.roughly_equal(F.col("__before.__km"), F.col("__km")))
    found = components(tied.select(F.col("id").alias("a"), F.col("__before.id").alias("b")))
    return rows.join(found, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")


def slots(rows: DataFrame, tie: str) -> DataFrame:
    """rows with slot, "<organizer>-<i>" in order of distance (none last), name without case and tie."""
    i = F.row_number().over(Window.partitionBy("organizer").orderBy(F.asc_nulls_last("km"), F.lower("name"), tie)) - 1
    return rows.withColumn("slot", F.concat_ws("-", F.col("organizer").cast("string"), i.cast("string")))


def assign_distances(routes: DataFrame, verbose: DataFrame) -> DataFrame:
    """organizer, route_id and distances: each listed distance of verbose (organizer, distances as text) goes to the organizer's nearest route
    (organizer, route_id, km) within 25 %, else to the nearest of all; of equally near ones the least route_id. Those within 25 % come first,
    each in the list's order. Routes are folded to one a distance, and a listed distance looks at the nearest below and above it only.
    """
    parts = verbose.select("organizer", F.posexplode(F.transform(text.distance_tokens(F.col("distances")), text.distance_km)).alias("pos", "listed")).where("listed is not null")
    at = routes.where("km is not null").groupBy("organizer", F.col("km").alias("at")).agg(F.min("route_id").alias("route_id"))
    side = F.when(F.col("route_id").isNotNull(), F.struct("at", "route_id"))
    both = at.withColumn("pos", F.lit(None).cast("int")).unionByName(parts.select("organizer", F.col("listed").alias("at"), F.lit(None).cast(at.schema["route_id"].dataType).alias("route_id"), "pos"))
    order = Window.partitionBy("organizer").orderBy("at")
    both = both.withColumns({"below": F.last(side, True).over(order), "above": F.first(side, True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("off"), F.col(f"{c}.route_id").alias("route_id"), (~F.coalesce(text.within_share(F.col("at"), F.col(f"{c}.at"), 0.25), F.lit(False))).alias("far")))
    # the nearest route is within 25 % if any is
    best = both.where("pos is not null").select("organizer", "pos", F.col("at").alias("listed"), F.array_min(F.array_compact(F.array(near("below"), near("above")))).alias("b")).where("b is not null")
    given = F.array_sort(F.collect_list(F.struct(F.col("b.far").alias("far"), "pos", text.format_km(F.col("listed")).alias("label"))))
    lists = best.groupBy("organizer", F.col("b.route_id").alias("route_id")).agg(F.transform(given, lambda g: g["label"]).alias("distances"))
    return routes.select("organizer", "route_id").join(lists, ["organizer", "route_id"], "left").withColumn("distances", F.coalesce("distances", F.array().cast("array<string>")))


def unclaimed_distances(listed: Column, claimed: Column) -> Column:
    """The listed distances about the same as none of the claimed ones, sorted, of those about the same as each other the least."""
    free = F.filter(F.array_sort(F.array_distinct(listed)), lambda x: ~F.exists(F.coalesce(claimed, F.array().cast("array<double>")), lambda c: text.roughly_equal(c, x)))
    return F.aggregate(free, F.array().cast("array<double>"), lambda a, x: F.when(F.exists(a, lambda y: text.roughly_equal(y, x)), a).otherwise(F.array_append(a, x)))


def unclaimed_labels(listed: Column, claimed: Column, labels: Column, claimed_labels: Column) -> Column:
    """unclaimed_distances() as texts, and after them the labels that aren't distances ("backyard") and that none has claimed, each once without case."""
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    free = F.array_sort(F.array_distinct(F.array_except(low(labels), low(claimed_labels))))
    return F.concat(F.transform(unclaimed_distances(listed, claimed), text.format_km), F.filter(free, lambda x: x != ""))


def absorb_points(features: DataFrame, fields: list[str]) -> DataFrame:
    """features (organizer, id, is_line, km as an array, urls, and fields) with points merged into their organizer's lines.

    A point with a distance about the same as one of a line's goes into the line with the nearest distance (least id of equals): the line
    takes the point's fields where they aren't null (of several points the greatest id's) and all its urls. Points without a line, and
    lines, stay. Lines are found once per distance, which the points then look up, so no organizer's pairs are made.
    """
    lines = features.where("is_line").select("organizer", F.explode("km").alias("km"), F.lit(False).alias("rank"), F.col("id").alias("id"))
    points = features.where("not is_line").select("organizer", "id", F.explode(F.col("km").cast("array<double>")).alias("km"))
    met = points.join(nearest_of_about(points, lines), ["organizer", "km"])
    into = met.groupBy("id").agg(F.min("best").alias("best")).select("id", F.col("best.id").alias("line_id"))
    taken = features.join(into, "id").groupBy("line_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"__{c}") for c in fields], F.flatten(F.collect_list("urls")).alias("__urls"))
    rest = features.join(into.select("id"), "id", "left_anti").join(taken, F.col("id") == F.col("line_id"), "left")
    urls = F.array_distinct(F.concat(F.coalesce("urls", F.array().cast("array<string>")), F.array_sort(F.coalesce("__urls", F.array().cast("array<string>")))))
    return rest.withColumns({**{c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}, "urls": urls}).select(*features.columns)


def drop_near_repeats(routes: DataFrame, share: float = 0.10) -> DataFrame:
    """routes (organizer, pos, name, km, ...) without those that come after a kept one of their organizer and name (without case) whose
    distance is within the share of theirs; routes without a distance all stay. Only distances travel, not the routes."""
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    listed = routes.where("km > 0").groupBy("organizer", name.alias("__name")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("km").cast("double").alias("km")))).alias("__all"))

    def add(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: text.within_share(x["km"], k["km"], share)), kept).otherwise(F.array_append(kept, x))

    start = F.array().cast(listed.schema["__all"].dataType)
    kept = listed.select("organizer", F.explode(F.aggregate("__all", start, add)).alias("k")).select("organizer", F.col("k.pos").alias("pos"))
    return routes.where("km > 0").join(kept, ["organizer", "pos"], "left_semi").select(*routes.columns).unionByName(routes.where("km is null or km <= 0"))


def page_per_distance(pages: DataFrame) -> DataFrame:
    """Of an organizer's pages (organizer, pos, km, content_only, ...) of one distance in whole kilometres one, pages made for it before those
    that only mention it, then the first; pages without a distance all stay."""
    whole = F.coalesce(F.bround("km").cast("int"), F.lit(0))
    best = pages.where(whole != 0).groupBy("organizer", whole.alias("__km")).agg(F.min(F.struct("content_only", "pos")).alias("b")).select("organizer", F.col("b.pos").alias("pos"))
    return pages.where(whole != 0).join(best, ["organizer", "pos"], "left_semi").select(*pages.columns).unionByName(pages.where(whole == 0))


def route_label(kind: Column, sub_kind: Column, segment_kinds: Column) -> Column:
    """What a planned route is for: on foot if any segment is a run, else by its kind and sub-kind."""
    foot = F.coalesce(F.exists(segment_kinds, lambda s: F.lower(s) == "run"), F.lit(False))
    bike = F.when(sub_kind == 1, "Road bike").when(sub_kind.isin(2, 4), "Mountain bike").when(sub_kind == 3, "Gravel bike").otherwise("Bike")
    return F.when(foot, "Run/hike").when(kind == 1, bike).when(kind == 6, "Gravel bike").otherwise("Run/hike")


def merge_points(features: DataFrame, fields: list[str], name: str = "name") -> DataFrame:
    """features (organizer, id, is_line, km as an array, urls, name and fields) with points of about the same distance and compatible names merged.

    In order of id a point that is left takes in every later one that shares a distance with it, about, and has its name or either has none: it takes
    fields that it lacks, in their order, and all urls. What has been taken in takes in none. Lines and points without a distance stay.

    Points alike in organizer, name and distances are one first. Of the others those that may merge meet by step of the logarithm of their distances; then, round by
    round, a point with no earlier one left about it stays, and those about it go, as many rounds as such points follow each other.
    """
    step = lambda c: F.floor(F.log(c) / STEP).cast("int")
    points = features.where("not is_line").withColumns({"__name": F.nullif(F.lower(F.trim(F.col(name))), F.lit("")), "__km": F.array_sort(F.array_distinct(F.filter("km", lambda k: k > 0)))}).where("size(__km) > 0")
    alike = ["organizer", "__name", "__km"]
    nodes = cut(points.groupBy(*alike).agg(F.min("id").alias("node")))
    each = nodes.select("organizer", "__name", "node", F.explode("__km").alias("km")).withColumn("step", step("km"))
    near = each.select("organizer", F.col("__name").alias("b_name"), F.col("node").alias("b"), F.col("km").alias("b_km"), F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"))
    same = F.coalesce(F.col("__name") == F.col("b_name"), F.lit(True))
    edges = cut(each.join(near, ["organizer", "step"]).where((F.col("node") < F.col("b")) & text.roughly_equal(F.col("km"), F.col("b_km")) & same).select(F.col("node").alias("a"), "b").distinct())
    open_, left, kept = nodes.select("node"), edges, []
    while not left.isEmpty():
        stay = cut(open_.join(left.select(F.col("b").alias("node")), "node", "left_anti"))
        gone = cut(left.join(stay, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct())
        kept.append(stay)
        done = stay.unionByName(gone)
        open_ = cut(open_.join(done, "node", "left_anti"))
        settled = done.select("node")
        left = cut(left.join(settled, F.col("a") == F.col("node"), "left_anti").join(settled, F.col("b") == F.col("node"), "left_anti"))
    stays = open_
    for s in kept:
        stays = stays.unionByName(s)
    into = edges.join(stays, F.col("a") == F.col("node"), "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("into"))
    led = nodes.join(into, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in alike], F.coalesce("into", "node").alias("__into"))
    members = points.join(led, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]).select("__into", "id", "urls", *fields)
    taken = members.groupBy("__into").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"__{c}") for c in fields], F.array_sort(F.collect_list(F.struct("id", "urls"))).alias("__urls"))
    gone = members.where("id <> __into").select("id")
    rest = features.join(gone, "id", "left_anti").join(taken, F.col("id") == F.col("__into"), "left")
    urls = F.when(F.col("__urls").isNull(), F.col("urls")).otherwise(F.array_distinct(F.flatten(F.array_compact(F.transform("__urls", lambda u: u["urls"])))))
    return rest.withColumns({**{c: F.when(F.col("__into").isNull(), F.col(c)).otherwise(F.col(f"__{c}")) for c in fields}, "urls": urls}).select(*features.columns)
