"""The document pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns it was given; the last returns packed
pieces. What a stage decides takes effect: rejected documents go, boilerplate lines are out of the texts, one document of each
near-duplicate class stays, and a document appears as often as the mix takes it.

Every stage takes nulls in any column, empty and very long texts, rows that repeat, empty tables and further columns of any name (but such that start with
"__"), as its operator says: rows of one id stay or go together in the rules and in the near-duplicate join and lose the same lines, and a document whose
text is null or empty doesn't pass the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, lines, mixing, near, packing, quality


def _through(docs: DataFrame, new: tuple[str, ...], stage) -> DataFrame:
    """stage(docs), with docs' own columns of the names that the stage's operator adds put by under other names meanwhile."""
    aside = {c: f"__own_{c}" for c in new if c in docs.columns}
    out = stage(docs.withColumnsRenamed(aside))
    return out.drop(*aside).withColumnsRenamed({b: a for a, b in aside.items()}).select(*common.quoted(docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines out of the texts, n_chars brought up to date; a document of which nothing is left goes."""

    def stage(docs: DataFrame) -> DataFrame:
        out = lines.dedup_lines(docs, min_words=1).where((F.col("n_removed") == 0) | (common.n_words(F.col("text")) > 0))
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return _through(docs, ("n_lines", "n_removed", "removed"), stage)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = docs.withColumn("__words", common.n_words(F.col("text")))
    return _through(sized, ("source_size", "target", "copies"), lambda d: mixing.emit_copies(mixing.mix_sources(d, size="__words"))).drop("__words")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.token_file("byte_bpe_50k.json"), context=packing.CONTEXT, max_loss=packing.MAX_LOSS)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]
#: SQL has no form of the estimates, of set similarity over all pairs or of the packing; tests/llm/test_pipeline.py holds every stage and run()
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of documents one after the other; each stage's rows are written and read again before the next one."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
