"""What several operators share: reading tables, cutting lineage, words and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, new_folder

__all__ = ["cut", "discard", "fold", "keep", "n_words", "new_folder", "quoted", "stored", "table"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the cluster's shared folder and read back, and its folder there."""
    folder = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def keep(df: DataFrame) -> DataFrame:
    """df written as Parquet to the cluster's shared folder and read back, where later reads need only some of its columns."""
    return stored(df)[0]


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder of stored() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fold(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return crc_of(doc_id) % of


def quoted(names) -> list[str]:
    """Column names as select() takes them, whatever characters they hold."""
    return ["`" + x.replace("`", "``") + "`" for x in names]
