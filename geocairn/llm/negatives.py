"""Hard-negative mining by dual-tree search: the rows of other labels that score next to an anchor's positives.

Two trees of bounded size are fitted to samples, one over the anchors, one over all candidates, and every row is put in its leaf. A node knows
the box of its rows and a ball about them; the two give an interval for the inner product of any anchor of one node with any candidate of another.
From the roots down, a pair of nodes goes as soon as its interval can't meet what the anchors of the node still need, so whole groups of anchors
drop whole groups of candidates at once. Pairs of leaves that are left are dealt into blocks; within two blocks trees of their own prune once more,
and what remains is scored exactly, in whole numbers.

What anchors still need comes from a first pass over the leaves next to them: the k-th best score found there is a lower bound of the true one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

POSITIVES, NEGATIVES = 5, 10
#: A negative scores from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Rows that a tree is fitted to, at most: those whose ids have the least hashes.
SAMPLE_ROWS = 65_536
#: Rows a leaf of the candidates, and one of the anchors, is meant to hold, and splits from the root to a leaf at most.
LEAF_ROWS, ANCHOR_ROWS, MAX_DEPTH = 2048, 256, 10
#: Rows of a leaf in one block, candidates' and anchors'.
BLOCK = 8192
#: Leaves next to a group of anchors that the first pass looks at.
FIRST_LEAVES = 2
#: Rows of a leaf of the trees within blocks.
SMALL_LEAF, SMALL_ANCHORS = 256, 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole(column) -> np.ndarray:
    """Rows of a list column, all of one length, as whole numbers: floor(SCALE * x), in double precision."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1 if len(x) and len(x[0]) else 0) * SCALE)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; such as no 64-bit number holds stop at the ends of the range."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in a], object) @ np.array([[int(v) for v in row] for row in b], object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class Nodes:
    """Boxes, centres and radii of some nodes, row by row."""

    def __init__(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray):
        self.low, self.high, self.centre, self.radius = low, high, centre, radius
        self.size = np.sqrt((centre * centre).sum(axis=1))

    def interval(self, i: np.ndarray, other: Nodes, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of a row of nodes i with one of the other's nodes j, widened by what rounding may lose."""
        down, up = np.empty(len(i)), np.empty(len(i))
        for at in range(0, len(i), 4096):
            part = slice(at, at + 4096)
            a, b = i[part], j[part]
            corners = [x[a] * y[b] for x in (self.low, self.high) for y in (other.low, other.high)]
            box_down, box_up = np.minimum.reduce(corners).sum(axis=1), np.maximum.reduce(corners).sum(axis=1)
            middle = (self.centre[a] * other.centre[b]).sum(axis=1)
            with np.errstate(invalid="ignore"):  # nodes without rows
                swing = self.radius[a] * other.size[b] + other.radius[b] * self.size[a] + self.radius[a] * other.radius[b]
            slack = 1 + 1e-9 * (np.abs(middle) + swing + np.abs(box_down) + np.abs(box_up))
            down[part] = np.maximum(box_down, middle - swing) - slack
            up[part] = np.minimum(box_up, middle + swing) + slack
        return down, up


class Tree:
    """A complete tree of so many levels of splits: node i of a level splits at a place of one coordinate into nodes 2i and 2i + 1 of the next."""

    def __init__(self, sample: np.ndarray, depth: int):
        """Splits the sample at the median of its most spread coordinate; nodes without rows split nothing."""
        self.depth, self.splits, self.centres = depth, [], []
        groups = [np.arange(len(sample))]
        for _ in range(depth):
            axes, cuts, parts = [], [], []
            for rows in groups:
                x = sample[rows]
                axis = int(x.var(axis=0).argmax()) if len(rows) and x.shape[1] else 0
                at = float(np.median(x[:, axis])) if len(rows) and x.shape[1] else 0.0
                left = x[:, axis] < at if x.shape[1] else np.ones(len(rows), bool)
                axes.append(axis)
                cuts.append(at)
                parts += [rows[left], rows[~left]]
            self.splits.append((np.array(axes), np.array(cuts)))
            groups = parts
        self.centres = np.array([sample[rows].mean(axis=0) if len(rows) else np.zeros(sample.shape[1]) for rows in groups])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for axes, cuts in self.splits:
            at = 2 * at + (x[np.arange(len(x)), axes[at]] >= cuts[at] if x.shape[1] else 0)
        return at


def node_pairs(anchors: Nodes, candidates: Nodes, need: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of two complete trees that have to meet: pairs from the roots down whose interval reaches what some anchor of the leaf needs
    (need) and isn't all above what any can use (most)."""

    def levels(leaves: Nodes) -> list[Nodes]:
        out = [leaves]
        while len(out[0].low) > 1:
            x = out[0]
            low, high = np.minimum(x.low[::2], x.low[1::2]), np.maximum(x.high[::2], x.high[1::2])
            empty = np.isinf(x.radius) & (x.radius < 0)
            shares = np.where(empty, 0.0, 1.0)
            n = np.maximum(shares[::2] + shares[1::2], 1)
            centre = (x.centre[::2] * shares[::2, None] + x.centre[1::2] * shares[1::2, None]) / n[:, None]
            far = lambda k: np.where(empty[k::2], -np.inf, np.sqrt(((x.centre[k::2] - centre) ** 2).sum(axis=1)) + x.radius[k::2])
            out.insert(0, Nodes(low, high, centre, np.maximum(far(0), far(1))))
        return out

    def folded(values: np.ndarray, by) -> list[np.ndarray]:
        out = [values]
        while len(out[0]) > 1:
            out.insert(0, by(out[0][::2], out[0][1::2]))
        return out

    a_levels, c_levels, needs, mosts = levels(anchors), levels(candidates), folded(need, np.minimum), folded(most, np.maximum)
    i, j, s, t = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        alive = np.isfinite(a_levels[s].radius[i]) & np.isfinite(c_levels[t].radius[j])
        i, j = i[alive], j[alive]
        down, up = a_levels[s].interval(i, c_levels[t], j)
        stay = (up >= needs[s][i]) & (down <= mosts[s][i])
        i, j = i[stay], j[stay]
        deeper_a, deeper_c = s + 1 < len(a_levels), t + 1 < len(c_levels)
        if not deeper_a and not deeper_c:
            return i, j
        if deeper_a:
            i, j, s = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), s + 1
        if deeper_c:
            i, j, t = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), t + 1


def placed(rows: DataFrame, leaf_rows: int, n: int, usual: int) -> tuple[DataFrame, Tree, Nodes]:
    """rows (id, label, vector and more) with leaf; the tree, fitted to a sample; and its leaves' bounds over all rows. Vectors of another
    length than `usual` have a leaf, below 0, for each length."""
    head = rows.where(F.size("vector") == usual).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").toArrow()
    sample = whole(head.column(0)) if head.num_rows else np.zeros((0, usual))
    tree = Tree(sample, max(0, min(MAX_DEPTH, int(np.ceil(np.log2(max(1, n) / leaf_rows))))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            size = np.asarray(column.value_lengths(), np.int64)
            leaf = -1 - size
            at = np.flatnonzero(size == usual)
            if len(at):
                leaf[at] = tree.leaf(whole(column.take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = cut(rows.mapInArrow(deal, f"{schema}, leaf long"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(tree.centres.shape, np.inf), np.full(tree.centres.shape, -np.inf)
        radius = np.full(len(low), -np.inf)
        for batch in batches:
            x, leaf = whole(batch.column(1)), batch.column(0).to_numpy()
            np.minimum.at(low, leaf, x)
            np.maximum.at(high, leaf, x)
            np.maximum.at(radius, leaf, np.sqrt(((x - tree.centres[leaf]) ** 2).sum(axis=1)))
        met = np.flatnonzero(radius >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array([np.concatenate([low[i], -high[i], -radius[i : i + 1]]).tobytes() for i in met], pa.binary())], names=["leaf", "least"])

    def least(part: pa.Table) -> pa.Table:
        return pa.table({"leaf": part.column("leaf")[:1], "least": pa.array([np.minimum.reduce([np.frombuffer(v) for v in part.column("least").to_pylist()]).tobytes()], pa.binary())})

    found = dealt.where("leaf >= 0").select("leaf", "vector").mapInArrow(bounds, "leaf long, least binary").groupBy("leaf").applyInArrow(least, "leaf long, least binary").toArrow()
    low, high, radius = np.zeros(tree.centres.shape), np.zeros(tree.centres.shape), np.full(len(tree.centres), -np.inf)
    for leaf, values in zip(found.column("leaf").to_pylist(), found.column("least").to_pylist(), strict=True):
        v = np.frombuffer(values)
        low[leaf], high[leaf], radius[leaf] = v[:usual], -v[usual:-1], -v[-1]
    return dealt, tree, Nodes(low, high, tree.centres, radius)


def _clusters(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Rows of x in groups of at most so many, split at medians of the most spread coordinate; equal rows are cut anywhere."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        part = x[at]
        by = part[:, part.var(axis=0).argmax()].argsort(kind="stable") if part.shape[1] else np.arange(len(at))
        stack += [at[by[: len(at) // 2]], at[by[len(at) // 2 :]]]
    return out


def _small_nodes(x: np.ndarray, groups: list[np.ndarray]) -> Nodes:
    centre = np.array([x[g].mean(axis=0) for g in groups]).reshape(len(groups), x.shape[1])
    radius = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centre, strict=True)])
    return Nodes(np.array([x[g].min(axis=0) for g in groups]), np.array([x[g].max(axis=0) for g in groups]), centre, radius)


def _best(scores: np.ndarray, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's usable scores the k best, earlier columns first where they tie: row and column."""
    many = np.flatnonzero(usable.sum(axis=1) > k)
    if len(many):
        kth = np.partition(np.where(usable[many], scores[many], _LEAST), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        usable[many] &= scores[many] >= kth[:, None]
    i, j = np.nonzero(usable)
    by = np.lexsort((j, -scores[i, j], i))
    i, j = i[by], j[by]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k]


def _search(k: int, same: bool):
    """For a block of anchors with slots (slot, low, high, need) and a block of candidates: of each slot the k best usable candidates.

    Usable: of the anchor's label (same) or of another, not the anchor, with a score from low to high and not below need."""

    def unit(data: pa.Table) -> pa.Table:
        mine, theirs = data.filter(pc.equal(data.column("own"), True)), data.filter(pc.equal(data.column("own"), False)).sort_by("id")
        out = {"anchor_id": [], "slot": [], "score": [], "id": []}
        if mine.num_rows and theirs.num_rows:
            a, b = whole(mine.column("vector")), whole(theirs.column("vector"))
            a_id, b_id, a_label, b_label = mine.column("id").to_numpy(), theirs.column("id").to_numpy(), mine.column("label").to_numpy(), theirs.column("label").to_numpy()
            lists = mine.column("slots").combine_chunks()
            counts = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            slot, low, high, need = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("slot", "low", "high", "need"))
            of = np.repeat(np.arange(len(a)), counts)
            least = np.maximum(low, need)
            groups, leaves = _clusters(a, SMALL_ANCHORS), _clusters(b, SMALL_LEAF)
            down, up = (v.reshape(len(groups), -1) for v in _small_nodes(a, groups).interval(np.repeat(np.arange(len(groups)), len(leaves)), _small_nodes(b, leaves), np.tile(np.arange(len(leaves)), len(groups))))
            for g, rows in enumerate(groups):
                slots = np.flatnonzero(np.isin(of, rows))
                if not len(slots):
                    continue
                stay = np.flatnonzero((up[g] >= least[slots].min()) & (down[g] <= high[slots].max()))
                if not len(stay):
                    continue
                columns = np.sort(np.concatenate([leaves[n] for n in stay]))  # in order of their ids
                scores = inner(a[rows], b[columns])
                at = np.searchsorted(np.sort(rows), of[slots])
                scores = scores[np.argsort(rows)][at]
                usable = (a_label[of[slots]][:, None] == b_label[columns][None, :]) == same
                usable &= (a_id[of[slots]][:, None] != b_id[columns][None, :]) & (scores >= least[slots][:, None]) & (scores <= high[slots][:, None])
                i, j = _best(scores, usable, k)
                out["anchor_id"].append(a_id[of[slots[i]]])
                out["slot"].append(slot[slots[i]])
                out["score"].append(scores[i, j])
                out["id"].append(b_id[columns[j]])
        return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for c, v in out.items()})

    return unit


def _leading(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and slot, with rank from 1. A key has k rows of each block at most, cut to k before they are shuffled."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """What _search finds for blocks of the pairs of leaves (a_leaf, c_leaf); anchors have slots."""
    blocks = lambda rows, leaf, n: rows.groupBy(F.col("leaf").alias(leaf)).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    met = pairs.join(blocks(anchors, "a_leaf", "a_blocks"), "a_leaf").join(blocks(candidates, "c_leaf", "c_blocks"), "c_leaf")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = anchors.withColumnRenamed("leaf", "a_leaf").join(met, "a_leaf").withColumns({"a": block("a_blocks"), "own": F.lit(True)}).withColumn("b", spread("c_blocks"))
    theirs = candidates.withColumnRenamed("leaf", "c_leaf").join(met, "c_leaf").withColumns({"b": block("c_blocks"), "own": F.lit(False)}).withColumn("a", spread("a_blocks"))
    columns = ["a_leaf", "a", "c_leaf", "b", "own", "id", "label", "vector"]
    slots = mine.schema["slots"].dataType.simpleString()
    both = mine.select(*columns, "slots").unionByName(theirs.select(*columns, F.lit(None).cast(slots).alias("slots")))
    return both.groupBy("a_leaf", "a", "c_leaf", "b").applyInArrow(_search(k, same), "anchor_id long, slot long, score long, id long")


def _pairs(spark, i: np.ndarray, j: np.ndarray) -> DataFrame:
    """Pairs of leaves, at most 4 ** MAX_DEPTH."""
    return spark.createDataFrame(pa.table({"a_leaf": pa.array(i, pa.int64()), "c_leaf": pa.array(j, pa.int64())}))


def dual_search(anchors: DataFrame, a_nodes: Nodes, candidates: DataFrame, c_nodes: Nodes, k: int, same: bool) -> DataFrame:
    """For anchors (id, label, vector, leaf, slots) the k best usable candidates (id, label, vector, leaf) of each slot: anchor_id, slot, score,
    id, rank. A first pass meets the leaves next to each group of anchors; the second all others that could still matter."""
    spark = anchors.sparkSession
    na, nc = len(a_nodes.low), len(c_nodes.low)
    _, up = a_nodes.interval(np.repeat(np.arange(na), nc), c_nodes, np.tile(np.arange(nc), na))
    full = np.isfinite(a_nodes.radius)[:, None] & np.isfinite(c_nodes.radius)[None, :]
    up = np.where(full, up.reshape(na, nc), -np.inf)
    next_to = np.argsort(-up, axis=1)[:, :FIRST_LEAVES]
    i, j = np.repeat(np.arange(na), next_to.shape[1]), next_to.ravel()
    i, j = i[full[i, j]], j[full[i, j]]
    odd = anchors.where("leaf < 0").select(F.col("leaf").alias("a_leaf"), F.col("leaf").alias("c_leaf")).distinct()
    first = cut(_leading(_met(anchors, candidates, _pairs(spark, i, j).unionByName(odd), k, same), k))

    # what each slot still needs: the score of its k-th, which the first pass found
    kth = first.where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), "slot", F.col("score").alias("kth"))
    slots = anchors.where("leaf >= 0").select("id", "leaf", F.explode("slots").alias("s")).select("id", "leaf", "s.slot", "s.low", "s.high", "s.need")
    slots = cut(slots.join(kth, ["id", "slot"], "left").withColumn("need", F.greatest("need", F.coalesce("kth", F.lit(_LEAST)))).drop("kth"))
    needs = slots.groupBy("leaf").agg(F.min(F.greatest("low", "need")).alias("need"), F.max("high").alias("most")).toArrow().to_pydict()
    need, most = np.full(na, np.inf), np.full(na, -np.inf)
    need[needs["leaf"]], most[needs["leaf"]] = needs["need"], needs["most"]
    x, y = node_pairs(a_nodes, c_nodes, need, most)
    met = np.zeros((na, nc), bool)
    met[x, y] = True
    met[i, j] = False
    held = slots.groupBy("id").agg(F.collect_list(F.struct("slot", "low", "high", "need")).alias("slots"))
    others = _met(anchors.where("leaf >= 0").drop("slots").join(held, "id"), candidates, _pairs(spark, *np.nonzero(met)), k, same)
    return cut(_leading(first.drop("rank").unionByName(others), k))


def mine_negatives(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, leaf_rows: int = LEAF_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """For each anchor, the rows that meet is_anchor, and each of its positives the hardest negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    A score is the inner product of floor(SCALE * x); higher ones come first, ties by the lesser id. Positives: the first rows of the anchor's
    label but itself. Negatives: the first rows of another label that score from low to high hundredths of the positive's score.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. Repeated rows count once; of several rows of one id
    the one of the least label, then vector. Vectors of different lengths don't meet. An anchor without positives, and a positive without
    negatives, give no rows; so does an empty table. Other columns are ignored. Scores that no 64-bit number holds stop at its ends.
    """
    raw = F.col(embedding)
    sound = raw.isNotNull() & ~F.exists(raw, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), raw.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    usable = cut(usable.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.label", "r.vector", "r.anchor"))
    sizes = usable.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("k"), F.count_if("anchor").alias("a")).orderBy(F.desc("k"), "n").limit(1).collect()
    usual, n, n_anchors = (sizes[0]["n"], sizes[0]["k"], sizes[0]["a"]) if sizes else (0, 0, 0)

    candidates, _, c_nodes = placed(usable.select("id", "label", "vector"), leaf_rows, n, usual)
    anchors, _, a_nodes = placed(usable.where("anchor").select("id", "label", "vector"), anchor_rows, n_anchors, usual)
    slot = lambda number, low, high: F.struct(number.cast("long").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"), low.cast("long").alias("need"))
    every = F.array(slot(F.lit(0), F.lit(_LEAST), F.lit(_MOST)))
    best = dual_search(anchors.withColumn("slots", every), a_nodes, candidates, c_nodes, positives, True)
    best = best.select(F.col("anchor_id").alias("id"), F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * p / 100
    asked = best.groupBy("id").agg(F.collect_list(slot(F.col("slot"), F.ceil(share(low)), F.floor(share(high)))).alias("slots"))
    found = dual_search(anchors.join(asked, "id"), a_nodes, candidates, c_nodes, negatives, False)
    out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(best.withColumnRenamed("id", "anchor_id"), ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
