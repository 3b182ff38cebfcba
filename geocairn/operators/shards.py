"""Shards: lines packed by the tiles that they meet, read back with each line once, whichever of its tiles are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, packed


def build_shards(lines: DataFrame, zoom: int) -> DataFrame:
    """lines (id, line and more) on every tile that they have a vertex on: x, y, id, packed (bytes) and the other columns.

    A line is packed once and then dealt to its tiles; lines that are null or empty are on none.
    """
    rest = [c for c in lines.columns if c not in ("id", "line")]
    made = lines.where(F.size("line") > 0).select("id", packed.pack_line("line").alias("packed"), F.explode(geo.tiles_of_line(F.col("line"), zoom)).alias("t"), *rest)
    return made.select(F.col("t.x").alias("x"), F.col("t.y").alias("y"), "id", "packed", *rest)


def write_shards(shards: DataFrame, folder: str, files: int) -> None:
    """In ranges of the tiles' key, sorted, so that tiles near each other are in one file and others are passed over."""
    keyed = shards.withColumn("tile_key", geo.tile_key(F.col("x"), F.col("y")))
    keyed.repartitionByRange(files, "tile_key").sortWithinPartitions("tile_key", "id").write.parquet(folder)


def shard_features(shards: DataFrame, tiles: DataFrame) -> DataFrame:
    """id, line and the other columns of the lines on any of the tiles (x, y), each id once: from its least tile. Only rows that stay are unpacked."""
    here = shards.join(tiles.select("x", "y").distinct(), ["x", "y"], "left_semi")
    rest = [c for c in shards.columns if c not in ("x", "y", "tile_key", "id", "packed")]
    once = here.groupBy("id").agg(F.min_by(F.struct("packed", *rest), F.struct("x", "y")).alias("f"))
    return once.select("id", packed.unpack_line("f.packed").alias("line"), *[F.col(f"f.{c}").alias(c) for c in rest])
