"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Centroids are fitted to a bounded sample; every vector is then put in the cell of its nearest centroid, and also compared within every
other cell that could hold a vector near enough. A vector y of cell j is no nearer to centroid i than to j, so it lies beyond the
hyperplane between them; x, of cell i, can be within an angle t of y only if its own angle to that hyperplane is at most t. That test is
exact: no pair is lost, whatever the centroids are.

Equal vectors form one class and only their first is compared. A cell is dealt into blocks, of its own vectors and of those compared with
them; one block of each is a unit of work, which returns counts of links and local components, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components, local_roots

THRESHOLD = 0.9
#: Vectors to fit the centroids to, at most: those whose ids have the least hashes.
SAMPLE_ROWS = 65_536
#: Vectors a cell is meant to hold, and cells at most, which bounds the centroids that are sent to tasks.
CELL_ROWS, MAX_CELLS = 2048, 16_384
STEPS = 4
#: Vectors of a cell, and vectors compared with them, in a unit of work.
OWN_BLOCK, OTHER_BLOCK = 4096, 4096
#: Single precision may be off by less than this; what it leaves is settled in double precision.
SLACK = 1e-4


def _unit_rows(batch) -> np.ndarray:
    """Rows of a list column (all of one length) scaled to length 1, in double precision."""
    x = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost or overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(sample: DataFrame, cells: int, steps: int = STEPS) -> np.ndarray:
    """Centroids of length 1, by Lloyd steps on `sample` (id, vector; vectors of one length), starting from its first rows by hash."""
    first = sample.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").toArrow()
    centres = _unit_rows(first.column(0)) if first.num_rows else np.empty((0, 1))
    for _ in range(steps if len(centres) > 1 else 0):

        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(centres)
            for batch in batches:
                x = _unit_rows(batch.column(0))
                for a in range(0, len(x), 512):
                    np.add.at(total, (x[a : a + 512] @ centres.T).argmax(axis=1), x[a : a + 512])
            cell = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array([v.tobytes() for v in total[cell]], pa.binary())], names=["cell", "total"])

        def add(part: pa.Table) -> pa.Table:
            return pa.table({"cell": part.column("cell")[:1], "total": pa.array([sum(np.frombuffer(v, float) for v in part.column("total").to_pylist()).tobytes()], pa.binary())})

        # one row a cell and task, and one a cell to the driver, which holds the centroids anyway
        rows = sample.select("vector").mapInArrow(sums, "cell long, total binary").groupBy("cell").applyInArrow(add, "cell long, total binary").toArrow()
        moved = np.zeros_like(centres)
        for cell, total in zip(rows.column("cell").to_pylist(), rows.column("total").to_pylist(), strict=True):
            moved[cell] = np.frombuffer(total, float)
        size = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, moved / np.maximum(size, 1e-9), centres)
    return centres


def place(classes: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """classes (id, weight, vector) with cell and visits, the later cells that may hold a vector near enough, its own first.

    Pairs of two cells are compared in the later one. Vectors of another length than the centroids' have a cell for each length."""
    sine = np.sqrt(1 - threshold * threshold) if threshold > 0 else 1.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                column = part.column(part.schema.get_field_index("vector"))
                size = np.asarray(column.value_lengths())
                cell, visits = -size.astype(np.int64), [[-int(n)] for n in size]
                usual = np.flatnonzero(size == centres.shape[1]) if len(centres) else []
                if len(usual):
                    near = _unit_rows(column.take(pa.array(usual))) @ centres.T
                    own = near.argmax(axis=1)
                    gap = near[np.arange(len(own)), own][:, None] - near
                    wide = np.sqrt(np.maximum(0, 2 - 2 * centres[own] @ centres.T)) + 1e-7
                    reach = (gap <= sine * wide + 1e-9) & (np.arange(len(centres))[None, :] > own[:, None])
                    cell[usual] = own
                    for k, i in enumerate(usual):
                        visits[i] = [int(own[k]), *np.flatnonzero(reach[k]).tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(visits, pa.list_(pa.int64()))], names=[*part.schema.names, "cell", "visits"])

    return classes.mapInArrow(task, f"id long, weight long, vector {classes.schema['vector'].dataType.simpleString()}, cell long, visits array<long>")


def _compare(threshold: float):
    """For a block of a cell's own vectors and a block of vectors compared with them: id, links (rows) and root (an id of its component)."""

    def unit(data: pa.Table) -> pa.Table:
        own = data.filter(pc.equal(data.column("own"), True))
        others = data.filter(pc.equal(data.column("own"), False))
        ids, roots, links = [], [], []
        if own.num_rows and others.num_rows:
            y, x = _unit_rows(own.column("vector")), _unit_rows(others.column("vector"))
            y32, x32 = y.astype(np.float32), x.astype(np.float32)
            y_id, x_id = own.column("id").to_numpy(), others.column("id").to_numpy()
            y_w, x_w = own.column("weight").to_numpy(), others.column("weight").to_numpy()
            abroad = others.column("home").to_numpy() != data.column("cell")[0].as_py()
            y_links = np.zeros(len(y), np.int64)
            for a in range(0, len(x), 512):
                part = slice(a, a + 512)
                near = x32[part] @ y32.T >= threshold - SLACK
                near &= x_id[part, None] != y_id[None]
                i, j = np.nonzero(near)
                if len(i) * 8 > near.size:
                    near &= x[part] @ y.T >= threshold
                elif len(i):
                    near[i, j] = np.einsum("ij,ij->i", x[part][i], y[j]) >= threshold
                r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(r):
                    continue
                near = near[np.ix_(r, c)]
                names = np.concatenate([x_id[part][r], y_id[c]])
                of_rows, of_columns = local_roots(near)
                ids += [x_id[part][r], y_id[c]]
                roots += [names[of_rows], names[of_columns]]
                links += [near @ y_w[c], near[abroad[part][r]].T @ x_w[part][r][abroad[part][r]]]
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.table({"id": pa.array(join(ids), pa.int64()), "links": pa.array(join(links).astype(np.int64), pa.int64()), "root": pa.array(join(roots), pa.int64())})

    return unit


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links: other vectors with a cosine of at least threshold, equal ones included; component_id: the least id reachable by links, its
    own included; kept: vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. A null id has no component (null), is kept, and links only with equal vectors; rows of
    one id share one vector's links; an empty table gives an empty result; other columns are ignored.
    """
    raw = F.col(embedding)
    sound = raw.isNotNull() & ~F.exists(raw, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(raw, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), raw).alias("vector"))
    classes = cut(rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    firsts = classes.where("id is not null").select("id", "weight", "vector")
    lengths = firsts.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").limit(1).collect()
    n, usual = (lengths[0]["k"], lengths[0]["n"]) if lengths else (0, 0)
    cells = max(1, min(MAX_CELLS, -(-n // cell_rows)))
    sample = cut(firsts.where(F.size("vector") == usual).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("id", "vector"))
    placed = cut(place(firsts, fit_cells(sample, cells), threshold))

    visits = placed.select("id", "weight", "vector", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n_own")).join(visits.groupBy("cell").agg(F.count("*").alias("n_other")), "cell")
    sizes = sizes.select("cell", F.ceil(F.col("n_own") / OWN_BLOCK).cast("int").alias("own_blocks"), F.ceil(F.col("n_other") / OTHER_BLOCK).cast("int").alias("other_blocks"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = placed.select("id", "weight", "vector", F.col("cell").alias("home"), "cell").join(sizes, "cell").withColumns({"a": block("own_blocks"), "own": F.lit(True)}).withColumn("b", spread("other_blocks"))
    other = visits.join(sizes, "cell").withColumns({"b": block("other_blocks"), "own": F.lit(False)}).withColumn("a", spread("own_blocks"))
    columns = ["cell", "a", "b", "own", "home", "id", "weight", "vector"]
    compared = cut(own.select(*columns).unionByName(other.select(*columns)).groupBy("cell", "a", "b").applyInArrow(_compare(threshold), "id long, links long, root long"))

    found = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "id", "left").join(found, "id", "left").select("vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    sound_rows = rows.where("vector is not null").join(by_class, "vector").select("vec_id", "n_links", "component_id")
    out = sound_rows.unionByName(rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
