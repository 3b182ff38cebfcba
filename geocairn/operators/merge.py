"""Merges: latest row per key, last write wins, retraction of evidence, snapshot differences, redirect chains, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], by: list[str | Column]) -> DataFrame:
    """The row of each key that is greatest by `by` (nulls least); all columns stay. Folded before the shuffle, so a hot key is no large task."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("__r")).select("__r.*")


def distinct_by(rows: DataFrame, key: Column, prefer: list[str | Column]) -> DataFrame:
    """One row per key, the one that is least by `prefer`: stored rows (false) before pointers to them (true), say."""
    return rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*prefer)).alias("__r")).select("__r.*")


def last_write_wins(current: DataFrame, incoming: DataFrame, keys: list[str], updated: str = "updated_at", deleted: str = "deleted", value: str = "value") -> DataFrame:
    """The state after the incoming rows: of each key the greatest `updated`; an incoming row wins a tie with the current one, a tie among
    incoming rows goes to the greatest value. A deleted row stays as a tombstone without its value.

    An aggregate, not a window: each side is folded before the shuffle.
    """
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(updated, deleted, value), F.struct(updated, "__new", F.coalesce(F.col(deleted), F.lit(False)), F.coalesce(F.col(value).cast("string"), F.lit("")))).alias("__r"))
    return best.select(*keys, F.col(f"__r.{updated}").alias(updated), F.col(f"__r.{deleted}").alias(deleted), F.when(~F.coalesce(F.col(f"__r.{deleted}"), F.lit(False)), F.col(f"__r.{value}")).alias(value))


def retract(facts: DataFrame, gone: Column, ids: str = "activity_ids") -> DataFrame:
    """Facts that hold an id of the array `gone`: their ids without those, each once, and action: delete where none is left, else patch."""
    left = F.array_distinct(F.array_except(F.col(ids), gone))
    hit = F.coalesce(F.arrays_overlap(F.col(ids), gone), F.lit(False))
    return facts.where(hit).withColumn(ids, left).withColumn("action", F.when(F.size(ids) == 0, "delete").otherwise("patch"))


def row_hash(columns: list[str]) -> Column:
    """128 bits of the columns' values (nulls told apart from all others), whatever the session's settings are."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(1), *marked).alias("b")) if columns else F.lit(True)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: insert, update, delete or unchanged, by a hash of all other columns of `new`."""
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*keys, row_hash(rest).alias("__old"))
    b = new.select(*keys, row_hash(rest).alias("__new"))
    change = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("update")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def upsert_facts(facts: DataFrame, found: DataFrame, keys: list[str], ids: str = "activity_ids") -> DataFrame:
    """facts with the ids of `found` added, and new facts; other columns are the old row's, else the new one's."""
    rest = [c for c in facts.columns if c not in (*keys, ids)]
    both = facts.withColumn("__o", F.lit(0)).unionByName(found.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    keep = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__o"))).alias(c) for c in rest]
    return both.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))).alias(ids), *keep).select(*facts.columns)


def resolve_redirects(keys: DataFrame, redirects: DataFrame, depth: int = 8) -> DataFrame:
    """keys (key) with target, where the chain of redirects (source, target; without case) from key ends, at most so many steps on; a
    chain that runs into a circle stops before the repeated key. Sources redirect once: of several targets the least counts.

    The chains are followed among the redirects alone, step by step as joins, and the keys meet their ends once; a circle is seen by the
    keys passed, which are at most `depth`.
    """
    to = redirects.groupBy(F.lower("source").alias("__s")).agg(F.min("target").alias("__t"))
    ends = to.select(F.col("__s").alias("__key"), F.col("__s").alias("__end"), F.array("__s").alias("__seen"), F.lit(False).alias("__gone"))
    for _ in range(depth):
        met = ends.join(to, F.lower("__end") == F.col("__s"), "left")
        go = F.col("__t").isNotNull() & ~F.coalesce(F.array_contains("__seen", F.lower("__t")), F.lit(False))
        ends = met.select("__key", F.when(go, F.col("__t")).otherwise(F.col("__end")).alias("__end"), F.when(go, F.array_append("__seen", F.lower("__t"))).otherwise(F.col("__seen")).alias("__seen"), (F.col("__gone") | go).alias("__gone"))
    moved = ends.where("__gone").select("__key", "__end")
    return keys.join(moved, F.lower("key") == F.col("__key"), "left").select("key", F.coalesce("__end", "key").alias("target"))


def first_by_priority(rows: DataFrame, keys: list[str], fields: list[str], priority: Column) -> DataFrame:
    """Of each field the value that isn't null of the row with the least priority."""
    return rows.withColumn("__p", priority).groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__p"))).alias(c) for c in fields])


def number_fragments(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with fragment, 0, 1, ... within equal keys."""
    return rows.withColumn("fragment", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def count_minutes(rows: DataFrame, ts: str, value: str, minutes: int = 1) -> DataFrame:
    """Tumbling windows: start and the sum of value."""
    return rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "total")


def representatives(rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """rows with representative, the least id of those with equal keys; folded before the shuffle, so a large group is no large task."""
    least = rows.groupBy(*keys).agg(F.min(id_column).alias("representative"))
    return rows.join(least, keys)


def fill_from(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key of either side: each field from the incoming row, or the existing one's where the incoming has none."""
    old = existing.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])
    return incoming.select(*keys, *fields).join(old, keys, "full").select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in fields])
