"""Per-user aggregates over activities: active days, streaks, histograms, tops, and joins of facts with their evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sport types that never count for peaks, paths or areas.
COMMON_EXCLUDED = (
    "VirtualRide", "VirtualRun", "VirtualRow", "WeightTraining", "Yoga", "Crossfit", "Elliptical", "StairStepper", "HighIntensityIntervalTraining", "Dance", "Pilates",
    "PhysicalTherapy", "Badminton", "Basketball", "Squash", "TableTennis", "Tennis", "Racquetball", "Pickleball", "Soccer", "Cricket",
)
WATER_SPORTS = ("Swim", "Canoeing", "Kayaking", "Rowing", "Sail", "Surfing", "Windsurf", "Kitesurf", "StandUpPaddling")
EXCLUDED = {
    "paths": (*COMMON_EXCLUDED, *WATER_SPORTS, "AlpineSki", "Snowboard", "BackcountrySki", "IceSkate"),
    "peaks": (*COMMON_EXCLUDED, *WATER_SPORTS, "AlpineSki", "Snowboard"),
    "areas": COMMON_EXCLUDED,
}


def in_window(ts: Column, before=None, after=None) -> Column:
    """ts <= before and ts > after; a bound that is None doesn't hold."""
    tests = [ts <= F.lit(before)] * (before is not None) + [ts > F.lit(after)] * (after is not None)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def still_due(stage: str, sport: Column, done: Column, excluded=None) -> Column:
    """Whether an activity is to be worked on for the stage: its sport isn't excluded (null isn't) and the stage isn't done."""
    return ~F.coalesce(sport.isin(*(excluded or EXCLUDED[stage])), F.lit(False)) & ~F.coalesce(done, F.lit(False))


def active_days(activities: DataFrame, kinds: dict[str, str], user: str = "user_id", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """Per user: days_<name> (distinct days with that kind) for each of kinds, and days_total over all of them together."""
    day = F.to_date(ts)
    counts = [F.count_distinct(F.when(F.col(kind) == k, day)).alias(f"days_{name}") for name, k in kinds.items()]
    return activities.groupBy(user).agg(*counts, F.count_distinct(F.when(F.col(kind).isin(*kinds.values()), day)).alias("days_total"))


def streaks(activities: DataFrame, as_of, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Per user: current_streak (days in a row up to as_of or the day before, else 0), longest_streak and when it began and ended.

    Activities after as_of don't count. Of equally long streaks the last is named.
    """
    days = activities.select(user, F.to_date(ts).alias("day")).where(F.col("day") <= F.lit(as_of)).distinct()
    island = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(user).orderBy("day"))))
    runs = island.groupBy(user, "island").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    live = F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), 1)
    longest = F.max(F.struct("n", "last", "first"))
    out = runs.groupBy(user).agg(F.coalesce(F.max(F.when(live, F.col("n"))), F.lit(0)).alias("current_streak"), longest.alias("best"))
    return out.select(user, "current_streak", F.col("best.n").alias("longest_streak"), F.col("best.first").alias("longest_start"), F.col("best.last").alias("longest_end"))


def histogram(values: DataFrame, value: str, width: int, buckets: int) -> DataFrame:
    """bucket 0 .. buckets - 1 and n, zero buckets included; a bucket is the value over width, cut towards zero. Nulls and values beyond
    the buckets are left out."""
    spark = values.sparkSession
    bucket = F.expr(f"cast(`{value}` as bigint) div {width}").cast("int")
    counted = values.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_by_count(facts: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with the most rows; of equal counts the least key."""
    return facts.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def evidence_summary(facts: DataFrame, activities: DataFrame, keys: list[str], ids: str = "activity_ids", activity: str = "activity_id", ts: str = "ts") -> DataFrame:
    """facts (keys, ids as an array) with times_visited (size of ids), and first, last and dates of those activities that exist."""
    each = facts.select(*keys, F.explode_outer(ids).alias(activity)).join(activities.select(activity, F.col(ts).alias("__ts")), activity, "left")
    dates = each.groupBy(*keys).agg(F.min("__ts").alias("first"), F.max("__ts").alias("last"), F.sort_array(F.collect_list("__ts")).alias("dates"))
    return facts.select(*keys, F.size(ids).alias("times_visited")).join(dates, keys)


def user_status(users: DataFrame, activities: DataFrame, logins: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """users with n_activities (0 without any) and last_login (null without any), ids compared without case.

    Both counts are folded by user before the join, so each user meets one row a side.
    """
    low = F.lower(F.col(user).cast("string"))
    counted = activities.groupBy(low.alias("__a")).agg(F.count("*").alias("n_activities"))
    seen = logins.groupBy(low.alias("__b")).agg(F.max(ts).alias("last_login"))
    out = users.withColumn("__u", low).join(counted, F.col("__u") == F.col("__a"), "left").join(seen, F.col("__u") == F.col("__b"), "left")
    return out.withColumn("n_activities", F.coalesce("n_activities", F.lit(0))).drop("__u", "__a", "__b")


def consolidate(facts: DataFrame, key: Column, user: str, name: str, measure: str, ids: str, order: str) -> DataFrame:
    """One row per user and normalised key: the first name that isn't blank and the first measure that isn't null (by `order`), and all
    activity ids together, each once and sorted."""
    filled = F.when(F.trim(F.col(name)) != "", F.col(name))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    grouped = facts.withColumn("__key", key).groupBy(user, "__key")
    out = grouped.agg(first(filled).alias(name), first(F.col(measure)).alias(measure), F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))).alias(ids))
    return out.withColumnRenamed("__key", "key")
