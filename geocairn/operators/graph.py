"""Connected components by smallest label, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per endpoint of an edge: id, component (the smallest id reachable). Ids are whole numbers; edges have no direction.

    A round gives each vertex the least label among its neighbours' and its own, then the label of that label; stars end in two rounds,
    chains in about the logarithm of their length. Each round is kept in the shared folder, so a lost executor costs one round.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = shared.cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = shared.cut(pairs.groupBy("x").agg(F.least("x", F.min("y")).alias("label")))
    while True:
        near = pairs.join(labels.select(F.col("x").alias("y"), F.col("label").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
        lower = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "other").alias("via"))
        jump = labels.select(F.col("x").alias("via"), F.col("label").alias("further"))
        after = shared.cut(lower.join(jump, "via", "left").select("x", "old", F.least("via", F.coalesce("further", "via")).alias("label")))
        done = after.where("old != label").isEmpty()
        labels = after.select("x", "label")
        if done:
            return labels.select(F.col("x").alias("id"), F.col("label").alias("component"))
