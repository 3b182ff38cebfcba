"""Change feeds as Structured Streaming: fan-out to work lists, facts kept up by batch, latest state, windowed counts.

Each batch writes a folder of its own number and overwrites it when it is repeated, so a restart from the checkpoint changes nothing.
Facts are rows (user, feature, activity); reprocessing an activity replaces its rows, as the view takes those of its last batch only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import features


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder (or one file), so many to a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(stream: DataFrame, lists: dict[str, Column], folder: str, checkpoint: str) -> StreamingQuery:
    """Rows to <folder>/<name> for each list whose predicate they meet. A batch is read once: its rows are marked with their lists and
    written by list."""

    def each(batch: DataFrame, number: int) -> None:
        named = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in lists.items()]), lambda x: x.isNotNull())
        batch.withColumn("list", F.explode(named)).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/batch_id={number}")

    return _start(stream, each, checkpoint)


def keep_facts(stream: DataFrame, match: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, activity: str = "activity_id") -> StreamingQuery:
    """Appends what match(batch) finds (user_id, feature_id, activity id), and a row without a feature for each activity of the batch, so
    that one which no longer meets anything takes its older facts back."""

    def each(batch: DataFrame, number: int) -> None:
        found = match(batch).select("user_id", "feature_id", activity)
        seen = batch.select("user_id", F.lit(None).cast(found.schema["feature_id"].dataType).alias("feature_id"), activity).distinct()
        found.unionByName(seen).write.mode("overwrite").parquet(f"{folder}/batch_id={number}")

    return _start(stream, each, checkpoint)


def current_facts(spark: SparkSession, folder: str, activity: str = "activity_id") -> DataFrame:
    """The facts of each activity's last batch."""
    log = spark.read.parquet(folder)
    last = log.groupBy(activity).agg(F.max("batch_id").alias("batch_id"))
    return log.join(last, [activity, "batch_id"]).where("feature_id is not null").select("user_id", "feature_id", activity).distinct()


def fact_sets(facts: DataFrame, activity: str = "activity_id") -> DataFrame:
    """One row per user and feature with the set of its activities."""
    return facts.groupBy("user_id", "feature_id").agg(F.array_sort(F.collect_set(activity)).alias("activity_ids"))


def keep_due(stream: DataFrame, boundaries: DataFrame, folder: str, checkpoint: str, current: int, forced: Column | None = None, zoom: int = 8) -> StreamingQuery:
    """A feed of changed features (feature_id, kind, stored_id, centroid, version) made into boundaries whose metrics are due, polygon_id and why, in <folder>: a boundary that
    changed itself and was made by an older version than `current` or is forced ("own"), and boundaries that hold a changed peak or area ("within").

    What a repeated batch says is said again under its own number, so that current_due() has each boundary once.
    """
    always = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("forced", always)
        own = batch.where(features.should_enrich(F.col("kind"), F.col("feature_id"), F.col("stored_id"), F.when(~F.col("forced"), F.col("version")), current))
        within = features.due_boundaries(batch.select("feature_id", "kind", "stored_id", "centroid"), boundaries, zoom)
        ids = own.select(F.col("feature_id").cast("string").alias("polygon_id"), F.lit("own").alias("why")).unionByName(within.select(F.col("polygon_id").cast("string"), F.lit("within").alias("why")))
        ids.distinct().write.mode("overwrite").parquet(f"{folder}/batch_id={number}")

    return _start(stream, each, checkpoint)


def current_due(spark: SparkSession, folder: str) -> DataFrame:
    """polygon_id and why of the boundaries due, each once a reason."""
    return spark.read.parquet(folder).select("polygon_id", "why").distinct()


def keep_log(stream: DataFrame, folder: str, checkpoint: str, good: Column | None = None) -> StreamingQuery:
    """Rows as they come to <folder>; rows that don't meet `good` go to quarantine=true and are left out by readers that ask for false."""

    def each(batch: DataFrame, number: int) -> None:
        bad = F.lit(False) if good is None else ~F.coalesce(good, F.lit(False))
        batch.withColumn("quarantine", bad).write.mode("overwrite").partitionBy("quarantine").parquet(f"{folder}/batch_id={number}")

    return _start(stream, each, checkpoint)


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with a watermark; times without a zone are taken in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def mark_once(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key, for counters that may count a stage once; state is kept until the watermark passes."""
    return _timed(stream, ts, late).dropDuplicatesWithinWatermark(keys)


def minute_counts(stream: DataFrame, ts: str, by: list[str], minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by key; rows later than the watermark are left out."""
    return _timed(stream, ts, late).groupBy(F.window(ts, f"{minutes} minutes"), *by).agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """What a stream with a watermark gives off, as Parquet: rows that nothing later can change, each once, a repeated batch not twice."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
