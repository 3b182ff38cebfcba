"""Organizer documents: one JSON text each, read with the schema that a use needs, so that what it doesn't name is never made into values.

In a folder a document is `<organizer>/organizer.json`, a redirect `<organizer>/redirect.txt` (the organizer it leads to), and an assembled race
`<organizer>/races/<id>.json`; an organizer's name may hold slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge

_FOUND = "map<string, array<struct<name:string, date:string, distance:string, url:string, country:string, county:string, location:string, raceType:string>>>"
_SAID = "scrapedAtUtc:string, websiteUrl:string, imageUrl:string, logoUrl:string, extractedName:string, extractedDate:string, startFee:string, currency:string"
_ROUTES = "routes:array<struct<sourceUrl:string, name:string, distance:double, coordinates:array<array<double>>>>"
_HEAD = "id string, url string"
_TIMES = "lastScrapedUtc string, lastAssembledUtc string, lastMaxSlotIndex int"
#: The schema of each use: who an organizer is, all but the routes' geometry, everything.
USES = {
    "identity": _HEAD,
    "metadata": f"{_HEAD}, discovery {_FOUND}, scrapers map<string, struct<{_SAID}>>, {_TIMES}",
    "all": f"{_HEAD}, discovery {_FOUND}, scrapers map<string, struct<{_SAID}, {_ROUTES}>>, {_TIMES}",
}
RACE = "id string, featureId string, kind string, x int, y int, zoom int, properties map<string, string>, geometry struct<type:string, coordinates:string>"


def _files(spark: SparkSession, folder: str, name: str, below: str) -> DataFrame:
    """organizer (what stands before `below` in the path within the folder) and value (the text) of files of a name; small ones share a task."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    path = F.split_part(F.col("_metadata.file_path"), F.lit(folder.rstrip("/") + "/"), F.lit(2))
    within = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return reader.text(folder).select(within.alias("__path"), "value").where(F.contains(F.col("__path"), F.lit(below))).select(F.split_part("__path", F.lit(below), F.lit(1)).alias("organizer"), "value")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """organizer and value of the documents in a folder."""
    return _files(spark, folder, "organizer.json", "/organizer.json")


def read_redirects(spark: SparkSession, folder: str) -> DataFrame:
    """source and target of the redirects in a folder; empty ones are left out."""
    found = _files(spark, folder, "redirect.txt", "/redirect.txt")
    return found.select(F.col("organizer").alias("source"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("target")).where("target <> ''")


def read_races(spark: SparkSession, folder: str, organizer: str | None = None) -> DataFrame:
    """organizer and the fields of the races assembled for all organizers, or one, of whose folder alone is read; texts that can't be read give none."""
    below = "/races/"
    if organizer is None:
        files = _files(spark, folder, "*.json", below)
    else:
        path = f"{folder.rstrip('/')}/{organizer}"
        files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{path}{below}").select(F.lit(organizer).alias("organizer"), "value")
    return files.select("organizer", F.from_json("value", RACE).alias("r")).where("r.id is not null").select("organizer", "r.*")


def documents(files: DataFrame, use: str = "metadata", redirects: DataFrame | None = None) -> DataFrame:
    """organizer and the fields that a use names, of files (organizer, value); texts without id and url are left out, and so are organizers that redirect
    (redirects: source, target; without case)."""
    if redirects is not None:
        gone = redirects.select(F.lower("source").alias("__source")).distinct()
        files = files.join(gone, F.lower("organizer") == F.col("__source"), "left_anti")
    read = files.select("organizer", F.from_json("value", USES[use]).alias("d")).select("organizer", "d.*")
    return read.where((F.trim("id") != "") & (F.trim("url") != ""))


def routed_discoveries(items: DataFrame, redirects: DataFrame) -> DataFrame:
    """organizer, source, url and discoveries to write, for items (pos, organizer, source, url, discovery): each goes to the organizer that its own leads to;
    what comes together there keeps its order, and the url of the first."""
    ends = merge.resolve_redirects(items.select(F.col("organizer").alias("key")).distinct(), redirects)
    led = items.join(ends, F.col("organizer") == F.col("key")).withColumn("__to", F.lower("target"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "discovery"))), lambda x: x["discovery"])
    return led.groupBy("__to", "source").agg(F.min_by("target", "pos").alias("organizer"), F.min_by("url", "pos").alias("url"), listed.alias("discoveries")).select("organizer", "source", "url", "discoveries")


def patched_outputs(stored: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """incoming (keys and the fields of stored) as written over stored: of keys that are there the `kept` columns (routes) stay, all others are the new ones."""
    old = stored.select(*keys, *[F.col(c).alias(f"__{c}") for c in kept], F.lit(True).alias("__there"))
    both = incoming.join(old, keys, "left")
    return both.select(*[F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in incoming.columns])


def country_name(code: Column, names: dict[str, str]) -> Column:
    """The name that a table gives a country's code (without case), else the code itself in capitals."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.upper(), v)])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(code))), F.upper(F.trim(code)))
