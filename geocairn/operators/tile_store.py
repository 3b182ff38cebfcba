"""Stored features by tile, in order of one key that makes every parent tile a range: fetches across zooms, and pointers met by a place.

A feature is stored at one zoom, on the tile of its centroid; some stand at another zoom. Files are ranges of the key, sorted within, so that the least and
greatest key of a file or row group tell whether a fetch needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..sources.shared import cut
from . import spatial

#: Ranges that go into a scan's filter; of more, only the least and greatest key do.
MAX_RANGES = 64
#: Neighbouring keys are put together within blocks of so many.
RANGE_BLOCK = 1 << 20


def write_features(features: DataFrame, folder: str, files: int, row_group: int = 128 << 20) -> None:
    """Writes features (kind, zoom, x, y and more) in `files` ranges of kind, zoom and tile key, sorted within; row groups of so many bytes."""
    keyed = features.withColumn("tile_key", geo.tile_key(F.col("x"), F.col("y")))
    order = ["kind", "zoom", "tile_key"]
    keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group).parquet(folder)


def key_ranges(tiles: DataFrame, levels: int = 0) -> DataFrame:
    """low and high (both held) of the keys, so many zooms down, of tiles (x, y); neighbouring ones are one range."""
    keys = tiles.select(geo.tile_key(F.col("x"), F.col("y")).alias("key")).distinct().withColumn("block", F.floor(F.col("key") / RANGE_BLOCK))
    # keys that follow each other differ from their rank by the same number
    run = F.col("key") - F.row_number().over(Window.partitionBy("block").orderBy("key"))
    spans = keys.withColumn("run", run).groupBy("block", "run").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    return spans.select(F.shiftleft("a", 2 * levels).alias("low"), (F.shiftleft(F.col("b") + 1, 2 * levels) - 1).alias("high"))


def within_ranges(key: Column, ranges: DataFrame, at_most: int = MAX_RANGES) -> Column:
    """A filter that a scan can use: key in one of the ranges, or of many between the least and the greatest. It may let more through."""
    found = ranges.orderBy("low").limit(at_most + 1).collect()
    if not found:
        return F.lit(False)
    if len(found) > at_most:
        ends = ranges.agg(F.min("low"), F.max("high")).first()
        return key.between(ends[0], ends[1])
    test = key.between(found[0]["low"], found[0]["high"])
    for r in found[1:]:
        test |= key.between(r["low"], r["high"])
    return test


def fetch_at_zoom(features: DataFrame, tiles: DataFrame, kind: str, zoom: int, stored_zoom: int, follow_pointers: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The features of a kind that tiles (x, y) of a zoom show, once for each logical id, with logical_id.

    features: id, feature_id (null or blank: the id without its kind), kind, zoom, x, y, tile_key, lng, lat (the centroid's), stored_id (of pointers), is_empty.
    Features at stored_zoom count by the tile of their centroid at the asked zoom; those stored at the asked zoom by their own tile. Markers of empty tiles
    are left out. Pointers are followed to the row they point to, wherever it stands, or stay as they are. Of a logical id a stored row comes before a
    pointer, then the least id, then the least tile. columns, if given, are all that is read besides (a slim fetch leaves the geometry out).

    Parents become ranges of the key, which reach the scan; lower tiles are looked up by their parents at stored_zoom.
    """
    tiles = tiles.select("x", "y").distinct()
    needed = ["id", "feature_id", "kind", "zoom", "x", "y", "tile_key", "lng", "lat", "stored_id", "is_empty"]
    kept = needed + [c for c in (features.columns if columns is None else columns) if c not in needed]
    of_kind = features.where(F.col("kind") == kind).select(*kept)
    asked = tiles.select(geo.tile_key(F.col("x"), F.col("y")).alias("__asked"))
    up = stored_zoom - zoom
    if up >= 0:
        ranges = key_ranges(tiles, up)
    else:
        ranges = key_ranges(tiles.select(F.shiftright("x", -up).alias("x"), F.shiftright("y", -up).alias("y")))
    stored = of_kind.where((F.col("zoom") == stored_zoom) & within_ranges(F.col("tile_key"), ranges))
    shown = stored.withColumn("__asked", geo.tile_key(geo.tile_x(F.col("lng"), zoom), geo.tile_y(F.col("lat"), zoom)))
    here = shown.join(asked, "__asked", "left_semi").select(*kept)
    if up:
        exact = of_kind.where((F.col("zoom") == zoom) & within_ranges(F.col("tile_key"), key_ranges(tiles))).withColumn("__asked", F.col("tile_key"))
        here = here.unionByName(exact.join(asked, "__asked", "left_semi").select(*kept))
    here = here.where(~F.coalesce("is_empty", F.lit(False)))
    if follow_pointers:
        pointed = here.where("stored_id is not null").select(F.col("stored_id").alias("id")).distinct()
        real = of_kind.where("stored_id is null").join(pointed, "id", "left_semi")
        here = here.where("stored_id is null").unionByName(real.select(*kept))
    bare = F.when(F.trim("feature_id") != "", F.col("feature_id"))
    here = here.withColumn("logical_id", F.coalesce(bare, text.feature_id(F.col("id"), kind)))
    best = F.min_by(F.struct(*kept), F.struct(F.col("stored_id").isNotNull(), "id", "zoom", "x", "y"))
    return here.groupBy("logical_id").agg(best.alias("__f")).select("logical_id", "__f.*")


def bridge(polygons: DataFrame, zoom: int) -> DataFrame:
    """polygon_id, x, y, border: the tiles that polygons (polygon_id, rings) meet; border is false where the tile lies wholly inside. It holds no geometry."""
    return spatial.polygon_tiles(polygons.select("polygon_id", "rings"), zoom).select("polygon_id", "x", "y", "border")


def containing(points: DataFrame, pointers: DataFrame, polygons: DataFrame, zoom: int, where: Column | None = None) -> DataFrame:
    """Pairs point_id, polygon_id where the polygon holds the point: points (point_id, lng, lat), pointers as bridge() gives them for the stored polygons
    (polygon_id, rings and more), of which `where` may ask more.

    Pointers on the points' tiles come first. In tiles that lie inside nothing more is read; only for border tiles the geometry is fetched, by id.
    """
    placed = points.select("point_id", "lng", "lat", geo.tile_x(F.col("lng"), zoom).alias("x"), geo.tile_y(F.col("lat"), zoom).alias("y"))
    met = placed.join(pointers.select("polygon_id", "x", "y", "border"), ["x", "y"])
    if where is not None:
        met = met.join(polygons.where(where).select("polygon_id"), "polygon_id", "left_semi")
    met = cut(met.select("point_id", "polygon_id", "lng", "lat", "border"))
    tested = met.where("border").join(polygons.select("polygon_id", "rings"), "polygon_id").where(geo.in_geometry_round(F.col("lng"), F.col("lat"), geo.unwrapped(F.col("rings"))))
    return met.where("not border").select("point_id", "polygon_id").unionByName(tested.select("point_id", "polygon_id")).distinct()


def boundaries_on_tiles(boundaries: DataFrame, tiles: DataFrame, level: int, zoom: int = 8) -> DataFrame:
    """boundaries (polygon_id, admin_level, rings and more) of a level that meet any of the tiles (x, y), each once."""
    of_level = boundaries.where(F.col("admin_level") == level)
    met = bridge(of_level, zoom).join(tiles.select("x", "y").distinct(), ["x", "y"], "left_semi").select("polygon_id").distinct()
    return of_level.join(met, "polygon_id", "left_semi")


def bulk_fetch(spark: SparkSession, asked: DataFrame, stored: DataFrame, answers: DataFrame, zoom: int = 8) -> tuple[DataFrame, dict[str, int]]:
    """Rows to store for asked countries (code) and a report, from one pass.

    stored: code of the boundaries that are there already, which are skipped. answers: what the source gave, code, polygon_id, rings (null where it failed
    or gave nothing). Rows: a stored row (border null) of each boundary fetched, and a pointer (x, y, border) for each tile that it meets. The report counts codes
    skipped, fetched, failed and missing, and the pointers.
    """
    wanted = asked.select(F.upper("code").alias("code")).distinct()
    old = wanted.join(stored.select(F.upper("code").alias("code")).distinct().withColumn("__old", F.lit(True)), "code", "left")
    given = answers.groupBy(F.upper("code").alias("code")).agg(F.min_by(F.struct("polygon_id", "rings"), F.struct(F.col("rings").isNull(), "polygon_id")).alias("a"))
    state = F.when(F.col("__old"), "skipped").when(F.col("a").isNull(), "missing").when(F.col("a.rings").isNull(), "failed").otherwise("fetched")
    judged = cut(old.join(given, "code", "left").select("code", state.alias("state"), "a.polygon_id", "a.rings"))
    found = judged.where("state = 'fetched'")
    pointers = bridge(found.select("polygon_id", "rings"), zoom).join(found.select("polygon_id", "code"), "polygon_id")
    rows = found.select("code", "polygon_id", F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("boolean").alias("border"), "rings")
    rows = cut(rows.unionByName(pointers.select("code", "polygon_id", "x", "y", "border", F.lit(None).cast(found.schema["rings"].dataType).alias("rings"))))
    counts = dict(judged.groupBy("state").count().collect())  # four numbers
    report = {k: counts.get(k, 0) for k in ("skipped", "fetched", "failed", "missing")}
    return rows, report | {"pointers": rows.where("x is not null").count()}
