"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

A HyperLogLog sketch of the sites of each line (by hash) merges by aggregation. What a sketch puts clearly above or below the bound is
settled; lines near it get an exact distinct count. Boilerplate is taken out of every document but its first (least id, then line
number), so no text leaves the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, quoted

#: Sites on which a line must stand.
MIN_SITES = 6
#: The default; the query and the pipeline take every line that isn't blank (1 word).
MIN_WORDS = 5
LG_K = 12
#: Sketches of so few sites err by less than this share of the bound, or by one.
MARGIN = 0.1
#: Parts that the places of one line are dealt into where they meet what is known of the line.
SALT = 16


def _meet(lines: DataFrame, known: DataFrame, line: str, place: tuple[str, ...]) -> DataFrame:
    """lines joined with known (one row per line): a line that stands on a third of all places goes to SALT tasks, not one."""
    salted = lines.withColumn("__salt", F.pmod(F.xxhash64(*place), F.lit(SALT)).cast("int"))
    return salted.join(known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [line, "__salt"]).drop("__salt")


def spread_lines(lines: DataFrame, line: str = "line", site: str = "site", order: tuple[str, ...] = (), min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """One row per line that stands on at least min_sites sites: the line, n_sites (exact near the bound, else the sketch's estimate)
    and first, its first place in `order`. A null site is a site of its own. Lines are told apart by value; hash them first."""
    key = F.xxhash64(F.col(site).isNull(), F.col(site))
    sketched = lines.groupBy(line).agg(F.hll_sketch_agg(key, F.lit(lg_k)).alias("__sketch"), F.count("*").alias("__n"), F.min(F.struct(*order)).alias("first"))
    # a line can't be on more sites than it has places
    sketched = sketched.where(F.col("__n") >= min_sites).withColumn("n_sites", F.hll_sketch_estimate("__sketch")).drop("__sketch", "__n")
    slack = max(1.0, margin * min_sites)
    sketched = cut(sketched.where(F.col("n_sites") >= min_sites - slack))
    near = sketched.where(F.col("n_sites") <= min_sites + slack).select(line)
    exact = _meet(lines, near, line, order).select(line, F.col(site).alias("__site")).distinct().groupBy(line).agg(F.count("*").alias("__exact"))
    settled = sketched.join(exact, line, "left").withColumn("n_sites", F.coalesce("__exact", "n_sites")).drop("__exact")
    return cut(settled.where(F.col("n_sites") >= min_sites))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the boilerplate lines out of their text, and n_lines, n_removed and removed (their numbers from 0), all columns kept.

    Lines are what stands between "\\n"; they are compared without the white space around them and count from min_words words on. Null
    text stays null with no lines; documents are told apart by id (rows of one id, a null one too, lose the same line numbers); an empty
    table gives an empty result; older columns named as the three new ones are replaced. A line that repeats within its first document
    stays there once.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    names = docs.columns
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.transform(F.split(body, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")))
    placed = docs.select(F.col(doc_id).alias("__doc"), F.col(site).alias("site"), F.posexplode(trimmed).alias("pos", "__line"))
    placed = placed.where(n_words(F.col("__line")) >= min_words)
    # 128 bits tell lines apart: two of 10^12 differing lines share them with a probability of about 10^-15
    lines = cut(placed.select("__doc", "site", "pos", F.struct(F.xxhash64("__line").alias("a"), F.xxhash64(F.lit(1), "__line").alias("b")).alias("line")))
    spread = spread_lines(lines, "line", "site", ("__doc", "pos"), min_sites)
    gone = _meet(lines, spread.select("line", "first"), "line", ("__doc", "pos")).where(~(F.col("__doc").eqNullSafe(F.col("first.__doc")) & (F.col("pos") == F.col("first.pos"))))
    gone = gone.groupBy("__doc").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    out = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("__doc")), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    all_lines = F.split(F.col(text).cast("string"), "\n")
    kept = F.when(F.size("removed") == 0, F.col(text).cast("string")).otherwise(F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("removed", i)), "\n"))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long")
    return out.withColumns({"n_lines": n_lines, "n_removed": F.size("removed").cast("long")}).withColumn(text, kept).select(*quoted(names), "n_lines", "n_removed", "removed")
