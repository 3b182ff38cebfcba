"""What comes in from outside made into jobs and work items: answers of event sources by a table of field paths, names looked up, events entered by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fields of a job that are text, numbers and addresses.
TEXTS = ("name", "date", "distance", "country", "county", "location", "race_type", "organizer", "description", "fee", "currency", "image")
NUMBERS = ("lat", "lng", "elevation_gain")


def jobs_from(answers: DataFrame, sources: dict[str, dict[str, str | list[str]]], as_of: Column) -> DataFrame:
    """One row per event of the answers (source, value: a JSON text): source, pos (its place in the answer), the fields of TEXTS and NUMBERS, urls and key.

    sources says of each source where its events stand ("items", a path to a list) and where each field is within an event: a path or several, of which the
    first that gives something counts; "urls" lists the paths of addresses, all of which are kept, each once without case, the first being the one that the
    organizer's key is made of. Dates, countries and race types are normalised where they can be read, else kept as they are. Answers that aren't
    JSON or lack the list, and events without a name and an address, give nothing. A new source is a row of the table, not code.
    """
    parts = []
    for source, paths in sources.items():
        at = lambda f, kind: _first(paths.get(f, []), kind)  # noqa: B023, E731
        items = F.try_variant_get(F.try_parse_json("value"), paths["items"], "array<variant>")
        events = answers.where(F.col("source") == source).select("source", F.posexplode(items).alias("pos", "__e"))
        urls = F.array_compact(F.array(*[_given(p, "string") for p in _listed(paths.get("urls", []))])) if paths.get("urls") else F.array().cast("array<string>")
        parts.append(events.select("source", "pos", *[at(f, "string").alias(f) for f in TEXTS], *[at(f, "double").alias(f) for f in NUMBERS], urls.alias("urls")))
    jobs = reduce(DataFrame.unionByName, parts)
    once = F.filter("urls", lambda u, i: (F.trim(u) != "") & (F.array_position(F.transform("urls", lambda v: F.lower(F.trim(v))), F.lower(F.trim(u))) == i + 1))
    jobs = jobs.withColumns({
        "name": F.nullif(F.trim("name"), F.lit("")), "date": F.coalesce(text.iso_date(F.col("date"), as_of), F.col("date")), "country": F.coalesce(text.country_code(F.col("country")), F.col("country")),
        "race_type": F.coalesce(text.race_type(F.col("race_type")), F.col("race_type")), "urls": F.transform(once, lambda u: F.trim(u)),
    })
    return jobs.withColumn("key", text.organizer_key(F.get("urls", F.lit(0)))).where("name is not null or size(urls) > 0")


def _listed(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _given(path: str, kind: str) -> Column:
    return F.try_variant_get(F.col("__e"), path, kind)


def _first(paths: str | list[str], kind: str) -> Column:
    found = [_given(p, kind) for p in _listed(paths)]
    blank = [F.when(F.trim(v) != "", v) if kind == "string" else v for v in found]
    return F.coalesce(*blank) if blank else F.lit(None).cast(kind)


def ids_of_names(names: DataFrame, features: DataFrame) -> DataFrame:
    """name, id and n for names: the least id of the features (id, name) of that name without case, and how many there are; null and 0 for none."""
    key = lambda c: F.lower(F.trim(c))
    asked = names.select("name", key("name").alias("__key")).distinct()
    held = features.select("id", key("name").alias("__key")).join(asked.select("__key").distinct(), "__key", "left_semi").groupBy("__key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return asked.join(held, "__key", "left").select("name", "id", F.coalesce("n", F.lit(0)).alias("n"))


def work_items(ids: DataFrame, work: str, run: Column, by: str = "id") -> DataFrame:
    """message_id, work and id to put on a list, each id once: the message's id follows from the list, the run and the id, so that what is put there twice is known."""
    said = F.sha2(F.concat_ws("|", F.lit(work), run.cast("string"), F.col(by).cast("string")), 256)
    return ids.where(F.col(by).isNotNull()).select(said.alias("message_id"), F.lit(work).alias("work"), F.col(by).alias("id")).dropDuplicates(["message_id"])


def add_items(listed: DataFrame, new: DataFrame) -> DataFrame:
    """The new work items that aren't listed yet."""
    return new.join(listed.select("message_id"), "message_id", "left_anti")


def by_layer(features: DataFrame, layers: dict[int, str], level: str = "admin_level") -> DataFrame:
    """Stored features (no pointers: stored_id is null, no markers of empty tiles) of the levels that have a layer, with layer."""
    named = F.create_map(*[F.lit(x) for pair in layers.items() for x in pair])
    kept = features.where(F.col(level).isin(*layers) & F.col("stored_id").isNull() & ~F.coalesce("is_empty", F.lit(False)))
    return kept.withColumn("layer", F.try_element_at(named, F.col(level).cast("int")))


def write_layers(lines: DataFrame, folder: str) -> None:
    """lines (layer, value: one GeoJSON feature) as text, a folder a layer."""
    lines.select("layer", "value").write.mode("overwrite").partitionBy("layer").text(folder)


def manual_events(events: DataFrame, as_of: Column, source: str = "manual") -> DataFrame:
    """organizer, source and discovery (name, date, distance, url) of events entered by hand (url, name, date, distance); of several of one organizer all, in no order.
    Events whose address names no host are left out."""
    found = F.struct(F.nullif(F.trim("name"), F.lit("")).alias("name"), F.coalesce(text.iso_date(F.col("date"), as_of), F.col("date")).alias("date"), "distance", F.trim("url").alias("url"))
    return events.select(text.organizer_key(F.trim("url")).alias("organizer"), F.lit(source).alias("source"), found.alias("discovery")).where("organizer is not null")
