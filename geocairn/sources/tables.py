"""Reading stored collections: scans, pages, lookups, live rows, GPX and GeoJSON; all filters reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, kernels


def scan(rows: DataFrame, sql: str, args: dict) -> DataFrame:
    """A SQL query over {rows} with named parameters."""
    return rows.sparkSession.sql(sql, args=args, rows=rows)


def page(rows: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """The next page in order of a unique key; the last key of a page is the token for the next."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


def lookup(rows: DataFrame, key: dict) -> DataFrame:
    """The rows of a key (none if it isn't there)."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def multi_get(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids, each key once; which side is broadcast, if any, is left to the size statistics."""
    return rows.join(ids.select(key), key, "left_semi").dropDuplicates([key])


def ids_by_key(rows: DataFrame, id_column: str, key: str, value) -> DataFrame:
    """Ids of the rows with that value; the column has to exist."""
    if key not in rows.columns:
        raise ValueError(f"no column {key}")
    return rows.where(F.col(key) == F.lit(value)).select(id_column)


def live(rows: DataFrame, as_of, expires: str = "expires_at") -> DataFrame:
    return rows.where(F.col(expires).isNull() | (F.col(expires) > F.lit(as_of).cast("timestamp")))


def resolve_pointers(rows: DataFrame, id_column: str = "id", stored: str = "stored_id") -> DataFrame:
    """Stored rows, and for pointers (stored isn't null) the row they point to; pointers to nothing go, and each id comes once."""
    real = rows.where(F.col(stored).isNull())
    met = real.join(rows.where(F.col(stored).isNotNull()).select(F.col(stored).alias(id_column)), id_column, "left_semi")
    return real.unionByName(met).dropDuplicates([id_column])


#: Tracks of more points than this are simplified by so many degrees.
DENSE_POINTS, DENSE_EPSILON = 2000, 0.0001


def tracks(files: DataFrame, gpx: str = "value") -> DataFrame:
    """files with name and line of a GPX text, by its track or route points in any namespace; lines of very many points are simplified. line
    is null for fewer than two points, and both are for a text that isn't well-formed."""
    read = files.withColumn("__track", kernels.read_track(gpx))
    line = geo.valid_track(F.col("__track.line"))
    thinned = kernels.simplify_line(line, F.when(F.size(line) > DENSE_POINTS, F.lit(DENSE_EPSILON)).otherwise(F.lit(0.0)))
    return read.withColumns({"name": F.col("__track.name"), "line": thinned}).drop("__track")


def overpass_elements(files: DataFrame, value: str = "value") -> DataFrame:
    """One row per element of map-query answers (JSON texts): type, id, lng, lat, tags, nodes as a line, and outers, the lines of a relation's
    outer members."""
    path = "array<struct<lat:double,lon:double>>"
    schema = f"elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:{path},members:array<struct<type:string,ref:bigint,role:string,geometry:{path}>>>>"
    e = files.select(F.explode(F.from_json(value, schema)["elements"]).alias("e"))
    line = lambda nodes: F.transform(F.filter(nodes, lambda p: p.isNotNull()), lambda p: geo.point(p["lon"], p["lat"]))
    outers = F.transform(F.filter("e.members", lambda m: (m["role"] == "outer") & m["geometry"].isNotNull()), lambda m: line(m["geometry"]))
    return e.select("e.type", "e.id", F.col("e.lon").alias("lng"), F.col("e.lat").alias("lat"), "e.tags", line(F.col("e.geometry")).alias("line"), outers.alias("outers"))


def geojson_features(rows: DataFrame, id_column: str, kind: str, rings: str, properties: list[str]) -> DataFrame:
    """value: one GeoJSON feature a row, ready for a text sink."""
    pairs = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lng"], p["lat"])))
    line, outer = pairs[0], F.transform(pairs, lambda r: F.array(r))
    geometry = lambda c: F.to_json(F.struct(F.col(kind).alias("type"), c.alias("coordinates")))
    shape = F.when(F.col(kind) == "Point", geometry(line[0])).when(F.col(kind) == "LineString", geometry(line)).when(F.col(kind) == "Polygon", geometry(pairs)).otherwise(geometry(outer))
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_column).cast("string").alias("id"), F.struct(*properties).alias("properties")))
    return rows.select(F.concat(F.expr("''"), F.regexp_replace(head, r"\}$", ""), F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def replace_slice(rows: DataFrame, folder: str, partition: str) -> None:
    """Overwrites only the partitions that rows hold, in one commit."""
    rows.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(folder)


def uploads(files: DataFrame, content: str = "content") -> DataFrame:
    """files with gpx, the uploaded text: what was sent in base64 (white space in it allowed) decoded, anything else as it is."""
    packed = F.regexp_replace(content, r"\s", "")
    decoded = F.when(packed.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (packed != ""), F.try_to_binary(packed, F.lit("base64")))
    return files.withColumn("gpx", F.coalesce(F.try_validate_utf8(decoded.cast("string")), F.col(content)))


def entries(files: DataFrame, field: str, schema: str, value: str = "value") -> DataFrame:
    """One row per element of the list `field` of JSON texts, its fields as columns by the schema; texts without the list give none."""
    found = F.from_json(value, f"{field} array<struct<{schema}>>")[field]
    return files.select(F.explode(found).alias("__e")).select("__e.*")
