"""Tables kept by key: rows in Parquet folders by bucket of their key, and versions that say which folder holds each bucket.

A merge reads and rewrites the buckets that its changes touch and no others, into a folder of its own, and then puts down one small file, the new
version. Until that file is there nothing has happened: a merge that fails, or loses the race to another one, leaves the older version as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut


class Conflict(RuntimeError):
    """Another writer has put down the version that this one was to be."""


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def expires_at(kind: Column, written: Column, days: dict[str, int], default: int) -> Column:
    """When a row of a kind expires that was written then: so many days later by its kind."""
    by_kind = F.create_map(*[F.lit(x) for pair in days.items() for x in pair]) if days else F.create_map().cast("map<string,int>")
    return written + F.make_dt_interval(F.coalesce(F.try_element_at(by_kind, kind), F.lit(default)))


class KeyedTable:
    """One table in `folder`: `versions/<number>.json` beside `data/<name>/__bucket=<b>/`.

    keys tell rows apart (nulls are equal to each other). buckets is fixed when the table is made: choose it so that a bucket is a file or a few.
    expires names a column of times after which rows are gone. Versions are numbered one by one; the file system has to refuse a rename onto an existing
    file, as HDFS does, for two writers at a time to be told apart.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder = spark, folder
        self.version = self.versions()[-1] if version is None else version
        said = json.loads(self._load(self.version))
        self.schema, self.keys, self.buckets, self.expires = StructType.fromJson(said["schema"]), said["keys"], said["buckets"], said["expires"]
        #: Of each bucket that holds rows: folder, rows, low and high (of the expiry, in seconds), never (rows that don't expire).
        self.parts: dict[int, dict] = {int(b): p for b, p in said["parts"].items()}

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int = 64, expires: str | None = None) -> KeyedTable:
        """An empty table, as version 0."""
        table = cls.__new__(cls)
        table.spark, table.folder, table.schema, table.keys, table.buckets, table.expires, table.version, table.parts = spark, folder, schema, keys, buckets, expires, -1, {}
        return table._publish({})

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path = self._path("versions")
        return sorted(int(f.getPath().getName()[:-5]) for f in self._files(path).listStatus(path) if f.getPath().getName().endswith(".json"))

    def _load(self, version: int) -> str:
        path = self._path(f"versions/{version:012d}.json")
        stream = self._files(path).open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, parts: dict[int, dict]) -> KeyedTable:
        number = self.version + 1
        said = {"schema": self.schema.jsonValue(), "keys": self.keys, "buckets": self.buckets, "expires": self.expires, "parts": parts}
        draft, final = self._path(f"versions/{uuid.uuid4()}.draft"), self._path(f"versions/{number:012d}.json")
        files = self._files(final)
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {number} of {self.folder} is there already")
        return KeyedTable(self.spark, self.folder, number)

    # reading

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of this version; of some buckets only."""
        folders = [f"{self.folder}/{p['folder']}" for b, p in sorted(self.parts.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def lookup(self, **key) -> DataFrame:
        """The row of a key, from its bucket's files alone."""
        types = {f.name: f.dataType for f in self.schema}
        held = self.spark.range(1).select(*[F.lit(key[k]).cast(types[k]).alias(k) for k in self.keys]).select(bucket_of(self.keys, self.buckets)).first()[0]
        rows = self.read([held])
        for k in self.keys:
            rows = rows.where(F.col(k).eqNullSafe(F.lit(key[k]).cast(types[k])))
        return rows

    def multi_get(self, ids: DataFrame) -> DataFrame:
        """The rows whose keys are among ids (the key columns), from their buckets alone."""
        ids = cut(ids.select(*self.keys).distinct())
        held = [r[0] for r in ids.select(bucket_of(self.keys, self.buckets)).distinct().collect()]  # at most self.buckets numbers
        wanted = ids.withColumnsRenamed({k: f"__{k}" for k in self.keys})
        return self.read(held).join(wanted, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_semi")

    # writing

    def _replace(self, rows: DataFrame, buckets: list[int], gone: list[int] | None = None) -> KeyedTable:
        """The next version: rows are all rows of those buckets, and the buckets `gone` hold none."""
        name = f"data/{uuid.uuid4()}"
        dealt = rows.withColumn("__bucket", bucket_of(self.keys, self.buckets))
        dealt.repartition(max(1, len(buckets)), "__bucket").sortWithinPartitions("__bucket", *self.keys).write.partitionBy("__bucket").parquet(f"{self.folder}/{name}")
        parts = {b: p for b, p in self.parts.items() if b not in {*buckets, *(gone or [])}}
        written = self.spark.read.schema(StructType([*self.schema, *dealt.select("__bucket").schema])).parquet(f"{self.folder}/{name}")
        ends = F.unix_seconds(F.col(self.expires).cast("timestamp")) if self.expires else F.lit(None).cast("long")
        for r in written.groupBy("__bucket").agg(F.count("*").alias("rows"), F.min(ends).alias("low"), F.max(ends).alias("high"), F.count_if(ends.isNull()).alias("never")).collect():
            parts[r["__bucket"]] = {"folder": f"{name}/__bucket={r['__bucket']}", "rows": r["rows"], "low": r["low"], "high": r["high"], "never": r["never"]}
        return self._publish(parts)

    def merge(self, changes: DataFrame, op: str = "op", order: str | None = None) -> KeyedTable:
        """The table with changes applied: rows of its columns (those left out are null) and op.

        upsert puts the whole row down; patch sets the columns that aren't null, of a row that is there; delete takes the row away. Several changes of
        one key apply in `order` (of equal ones patches after upserts, deletes last). Each key's changes are folded before they are shuffled, as the value
        of a column is that of the last change that says something of it.
        """
        values = [c for c in self.schema.names if c not in self.keys]
        given = [F.col(c).cast(f.dataType).alias(c) if c in changes.columns else F.lit(None).cast(f.dataType).alias(c) for c, f in zip(self.schema.names, self.schema, strict=True)]
        rank = F.when(F.col(op) == "delete", 2).when(F.col(op) == "patch", 1).when(F.col(op) == "upsert", 0)
        named = changes.select(*given, rank.alias("__op"), (F.col(order) if order else F.lit(0)).alias("__order"))
        named = cut(named.where("__op is not null"))
        touched = sorted(r[0] for r in named.select(bucket_of(self.keys, self.buckets)).distinct().collect())  # at most self.buckets numbers
        if not touched:
            return self
        old = self.read(touched).select(*self.schema.names, F.lit(0).alias("__op"), F.lit(None).cast(named.schema["__order"].dataType).alias("__order"), F.lit(0).alias("__new"))
        both = old.unionByName(named.withColumn("__new", F.lit(1)))
        at = F.struct("__new", "__order", "__op", F.xxhash64(*[F.col(v).cast("string") for v in values]) if values else F.lit(0))
        whole = F.col("__op") != 1
        last = [F.max_by(F.when(whole | F.col(c).isNotNull(), F.struct(F.when(F.col("__op") != 2, F.col(c)).alias("v"))), F.when(whole | F.col(c).isNotNull(), at)).alias(c) for c in values]
        there = F.max_by(F.col("__op") != 2, F.when(whole, at)).alias("__there")
        state = both.groupBy(*self.keys).agg(*last, there).where("__there")
        return self._replace(state.select(*[c if c in self.keys else F.col(f"{c}.v").alias(c) for c in self.schema.names]), touched)

    def replace(self, snapshot: DataFrame) -> KeyedTable:
        """The table as the snapshot says (one row a key): buckets in which no row differs aren't rewritten."""
        names = self.schema.names
        values = F.struct(*[c for c in names if c not in self.keys])
        side = lambda rows, mark: rows.select(*self.keys, F.struct(values.alias("v"), F.lit(True).alias("is")).alias(mark))
        old, new = side(self.read(), "__old"), side(snapshot.select(*[F.col(c).cast(f.dataType).alias(c) for c, f in zip(names, self.schema, strict=True)]), "__new").withColumnsRenamed({k: f"__{k}" for k in self.keys})
        met = old.join(new, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "full_outer")
        met = met.select(*[F.when(F.col("__new").isNull(), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in self.keys], "__old", "__new")
        differs = met.where(~F.col("__old.v").eqNullSafe(F.col("__new.v")) | F.col("__old").isNull() | F.col("__new").isNull())
        return self.merge(differs.select(*self.keys, "__new.v.*", F.when(F.col("__new").isNull(), "delete").otherwise("upsert").alias("op")))

    def expire(self, as_of) -> KeyedTable:
        """The table without the rows whose time to expire isn't after as_of: buckets of which all rows have expired go unread, those of which none
        has stay as they are, and only mixed ones are rewritten."""
        if not self.expires:
            raise ValueError("the table has no column of times to expire")
        now = self.spark.range(1).select(F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6).first()[0]
        due = {b: p for b, p in self.parts.items() if p["low"] is not None and p["low"] <= now}
        gone = [b for b, p in due.items() if p["high"] + 1 <= now and not p["never"]]
        mixed = [b for b in due if b not in set(gone)]
        if not due:
            return self
        kept = self.read(mixed).where(F.col(self.expires).isNull() | (F.col(self.expires) > F.lit(as_of).cast("timestamp")))
        return self._replace(kept, mixed, gone)

    def vacuum(self, keep: int = 1) -> int:
        """Removes the folders that none of the last `keep` versions up to this one names, and the older versions; their number."""
        kept = [v for v in self.versions() if v <= self.version][-keep:]
        used = {p["folder"].split("/")[1] + "/" + p["folder"].split("/")[2] for v in kept for p in json.loads(self._load(v))["parts"].values()}
        data, gone = self._path("data"), 0
        files = self._files(data)
        for v in self.versions():
            if v < kept[0]:
                files.delete(self._path(f"versions/{v:012d}.json"), False)
        for run in files.listStatus(data) if files.exists(data) else []:
            for part in files.listStatus(run.getPath()):
                name = f"{run.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used:
                    files.delete(part.getPath(), True)
                    gone += 1
        return gone
