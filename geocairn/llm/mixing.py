"""Mixing sources to target weights by systematic sampling.

A source's target is shared out by weight and stops at `max_repeat` times the source's size. Each document of a source then
expects target / size copies. Documents stand in a fixed order within their source (size class, then a hash of the id, then the
id); the running sum of the expected copies plus one random offset of the source gives a copy at every whole number it crosses.

The running sum never gathers a source: its documents are dealt into small runs of neighbours in that order, the runs are counted,
and a document's place is the count of what stands before its run plus its place within the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
SEED = 7
#: Documents in a run of neighbours, about.
RUN_ROWS = 64


def _source_key(source: Column) -> Column:
    """Text that sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _size_class(size: Column) -> Column:
    """Whole-number class of a size: its bit length and the three bits after the first."""
    bits = F.length(F.bin(size)).cast("long")
    return F.when(size < 16, size).otherwise(bits * 8 + F.expr("shiftright(__size, cast(length(bin(__size)) as int) - 4)").bitwiseAND(F.lit(7).cast("long")))


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(docs: DataFrame, size: str = "size", source: str = "source", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source: __key, source_size, target.

    The total, total_share times all sizes, is shared by weight; a share stops at max_repeat times its source's size and what it
    leaves goes to the others by weight. With sources in the order of cap / weight, the common share per weight unit is the largest
    of (total - caps before) / weights from here on. One row per source is all that is ordered here, never documents.
    """
    totals = docs.groupBy(_source_key(F.col(source)).alias("__key")).agg(F.sum(F.coalesce(F.col(size), F.lit(0)).cast("long")).alias("source_size"))
    every = Window.partitionBy()
    ranked = totals.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy("__key")) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(max_repeat)))
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__key").rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(every) * F.lit(float(total_share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    level = ranked.withColumn("__share", share).withColumn("__level", F.max("__share").over(every))
    return level.select("__key", "source_size", F.least(F.col("__cap"), F.col("__level") * F.col("__w")).alias("target"))


def mix_sources(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: float = MAX_REPEAT, seed: int = SEED, run_rows: int = RUN_ROWS) -> DataFrame:
    """docs with source_size, target (both of its source) and copies (0 up to max_repeat, rounded up).

    Null sizes count as 0; null sources form one source, last in order; null ids sort first; rows that repeat are sampled each on its
    own; an empty table gives an empty result; other columns pass through, but for older ones named as the three new ones, which are
    replaced (names that start with "__" are the operator's own). A source whose sizes sum to 0 gets no copies. The order, and so the result, depends on nothing but the rows.
    """
    docs = docs.drop("source_size", "target", "copies")
    names = quoted(docs.columns)
    keyed = docs.withColumns({"__size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "__key": _source_key(F.col(source)), "__md": F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))})
    keyed = keyed.withColumn("__class", _size_class(F.col("__size")))
    by_class = ["__key", "__class"]
    runs = keyed.groupBy(*by_class).agg(F.count("*").alias("__n"))
    runs = runs.withColumn("__runs", F.ceil(F.col("__n") / run_rows)).withColumn("__class_before", F.coalesce(F.sum("__n").over(Window.partitionBy("__key").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.join(source_targets(docs, size, source, weights, total_share, max_repeat), "__key").select(*by_class, "__runs", "__class_before", "source_size", "target")
    dealt = keyed.join(runs, by_class).withColumn("__run", F.floor(F.conv(F.substring("__md", 1, 8), 16, 10).cast("long") * F.col("__runs") / F.lit(4294967296.0)))
    by_run = [*by_class, "__run"]
    counted = keyed.select(*by_class, "__md").join(runs.select(*by_class, "__runs"), by_class).withColumn("__run", F.floor(F.conv(F.substring("__md", 1, 8), 16, 10).cast("long") * F.col("__runs") / F.lit(4294967296.0))).groupBy(*by_run).agg(F.count("*").alias("__n"))
    counted = counted.select(*by_run, F.coalesce(F.sum("__n").over(Window.partitionBy(*by_class).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__run_before"))
    placed = dealt.join(counted, by_run).withColumn("__place", F.col("__class_before") + F.col("__run_before") + F.row_number().over(Window.partitionBy(*by_run).orderBy("__md", doc_id)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(f"{seed}:"), F.col("__key")))
    copies = F.floor(rate * F.col("__place") + offset) - F.floor(rate * (F.col("__place") - 1) + offset)
    return placed.select(*names, "source_size", "target", copies.cast("long").alias("copies"))


def emit_copies(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as `copies` says, without that column."""
    return mixed.where(F.col(copies) > 0).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).drop("__copy", copies)
