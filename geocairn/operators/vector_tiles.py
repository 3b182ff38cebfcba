"""Binary vector tiles (the public vector tile format, version 2): one layer per tile from lines or points already cut to tiles.

Projection to tile units runs as Column expressions. A tile's features share its keys and values: these are numbered by an aggregate, each feature is
then written by itself against its tile's numbers, wherever it is, and only the finished bytes of a tile come together. A tile with very many
features is many tasks until then. A tile holds what a map shows at its zoom, so clip and simplify first.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import geo

EXTENT = 4096


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value) -> bytes:
    """A field of a message: whole numbers as varints, floats as 8 bytes, bytes with their length."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    return varint(number << 3) + varint(value)


def tagged(value) -> bytes:
    """A property's value by its type."""
    if isinstance(value, bool | np.bool_):
        return field(7, int(value))
    if isinstance(value, int | np.integer):
        return field(4, int(value))
    if isinstance(value, float | np.floating):
        return field(3, float(value))
    return field(1, str(value).encode())


def commands(points: np.ndarray) -> bytes:
    """Move to the first point, line to each of the others; steps are zigzag-coded."""
    steps = np.diff(points, axis=0, prepend=0)
    coded = (steps << 1) ^ (steps >> 63)
    numbers = [1 | 1 << 3, *coded[0].tolist()]
    if len(points) > 1:
        numbers += [2 | (len(points) - 1) << 3, *coded[1:].ravel().tolist()]
    return b"".join(map(varint, numbers))


def layer(name: str, ids, lines, properties: dict[str, list], extent: int = EXTENT) -> bytes:
    """A tile of one layer; null properties are left out of their feature."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    features = []
    for i, points in enumerate(lines):
        tags = [(keys.setdefault(k, len(keys)), values.setdefault(tagged(column[i]), len(values))) for k, column in properties.items() if not pd.isna(column[i])]
        packed = b"".join(varint(n) for pair in tags for n in pair)
        features.append(field(1, int(ids[i])) + (field(2, packed) if packed else b"") + field(3, 2 if len(points) > 1 else 1) + field(4, commands(points)))
    body = field(15, 2) + field(1, name.encode()) + b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, v) for v in values) + b"".join(field(2, f) for f in features)
    return field(3, body + field(5, extent))


@F.arrow_udf(BinaryType())
def _tagged(value: pa.Array) -> pa.Array:
    """A property's value as its bytes; null for null and for what is no number."""
    return pa.array([None if v is None or (isinstance(v, float) and v != v) else tagged(v) for v in value.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def _feature(id_: pa.Array, px: pa.Array, py: pa.Array, tags: pa.Array) -> pa.Array:
    """A feature's bytes as a field of its layer: id, numbers of keys and values in turn, kind and commands."""
    out = []
    for i, x, y, t in zip(id_.to_pylist(), px, py, tags.to_pylist(), strict=True):
        points = np.column_stack([x.values.to_numpy(), y.values.to_numpy()]).astype(np.int64)
        packed = b"".join(map(varint, t or []))
        out.append(field(2, field(1, int(i)) + (field(2, packed) if packed else b"") + field(3, 2 if len(points) > 1 else 1) + field(4, commands(points))))
    return pa.array(out, pa.binary())


def _joined(features: pa.StructArray) -> bytes:
    """The features' bytes, each n times, as they stand in Arrow's memory: none becomes an object."""
    n, each = features.flatten()
    each = each.cast(pa.large_binary()).take(pa.array(np.repeat(np.arange(len(n)), n.to_numpy(zero_copy_only=False))))
    if not len(each):
        return b""
    first, last = np.frombuffer(each.buffers()[1], np.int64)[[each.offset, each.offset + len(each)]]
    return each.buffers()[2][int(first) : int(last)].to_pybytes()


def _numbered(tags: DataFrame, column: str) -> DataFrame:
    """x, y, the column's distinct values on the tile and no, from 0 in order of the first feature and property that holds each."""
    first = tags.groupBy("x", "y", column).agg(F.min(F.struct("__id", "fragment", "__tie", "pos")).alias("__first"))
    return first.withColumn(f"__no_{column}", F.row_number().over(Window.partitionBy("x", "y").orderBy("__first")) - 1).drop("__first")


def encode_tiles(pieces: DataFrame, name: str, zoom: int, properties: list[str], id_column: str = "id", extent: int = EXTENT, zipped: bool = False) -> DataFrame:
    """x, y, n_features and tile (bytes, gzip-compressed if zipped) of each tile that holds any of the pieces (id, x, y, fragment, line, ...).

    Points outside their tile are left out. A line of one point is written as a point; one that had more and keeps fewer than two goes. Null properties, and such
    that are no number, are left out of their feature. Features stand in order of id and fragment, keys and values in order of the first feature that has them, so
    the bytes depend on the rows alone.
    """
    unit = lambda p: geo.tile_units(p["lng"], p["lat"], F.col("x"), F.col("y"), zoom, extent)
    projected = pieces.withColumn("__units", F.filter(F.transform("line", unit), lambda u: u.isNotNull()))
    projected = projected.where((F.size("__units") >= 2) | ((F.size("__units") == 1) & (F.size("line") == 1)))
    flat = lambda c: F.transform("__units", lambda u: u[c]).alias(f"__{c}")
    values = [F.struct(F.lit(c).alias("key"), _tagged(F.col(c)).alias("value")) for c in properties]
    tags = F.filter(F.array(*values), lambda t: t["value"].isNotNull()) if values else F.array().cast("array<struct<key:string,value:binary>>")
    rows = projected.select("x", "y", F.col(id_column).cast("long").alias("__id"), "fragment", flat("px"), flat("py"), tags.alias("__tags"))
    # rows that are alike in all are one from here on, with their number
    rows = rows.withColumn("__tie", F.xxhash64("__px", "__py", F.transform("__tags", lambda t: F.struct(t["key"], t["value"])))).groupBy(*rows.columns, "__tie").agg(F.count("*").alias("__n"))
    each = rows.select("x", "y", "__id", "fragment", "__tie", F.posexplode("__tags").alias("pos", "__t")).select("x", "y", "__id", "fragment", "__tie", "pos", F.col("__t.key").alias("key"), F.col("__t.value").alias("value"))
    keys, held = _numbered(each, "key"), _numbered(each, "value")
    of = ["x", "y", "__id", "fragment", "__tie"]
    numbers = each.join(keys, ["x", "y", "key"]).join(held, ["x", "y", "value"]).groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("pos", "__no_key", "__no_value"))).alias("__t"))
    numbers = numbers.select(*of, F.flatten(F.transform("__t", lambda t: F.array(t["__no_key"], t["__no_value"]))).alias("__numbers"))
    written = rows.join(numbers, of, "left").select(*of, "__n", _feature(F.col("__id"), F.col("__px"), F.col("__py"), F.col("__numbers")).alias("bytes"))
    tiles = written.groupBy("x", "y").agg(F.sum("__n").alias("n_features"), F.array_sort(F.collect_list(F.struct("__id", "fragment", "__tie", "__n", "bytes"))).alias("__f"))
    listed = lambda d, c: d.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct(f"__no_{c}", c))).alias(f"__{c}s")).select("x", "y", F.transform(f"__{c}s", lambda v: v[c]).alias(f"__{c}s"))
    whole = tiles.join(listed(keys, "key"), ["x", "y"], "left").join(listed(held, "value"), ["x", "y"], "left")

    @F.arrow_udf(BinaryType())
    def assembled(features: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for f, k, v in zip(features, keys.to_pylist(), values.to_pylist(), strict=True):
            body = field(15, 2) + field(1, name.encode()) + b"".join(field(3, x.encode()) for x in k or []) + b"".join(field(4, x) for x in v or [])
            tile = field(3, body + _joined(f.values) + field(5, extent))
            out.append(gzip.compress(tile, mtime=0) if zipped else tile)
        return pa.array(out, pa.binary())

    slim = F.transform("__f", lambda f: F.struct(f["__n"].alias("n"), f["bytes"].alias("bytes")))
    return whole.select("x", "y", "n_features", assembled(slim, "__keys", "__values").alias("tile"))
