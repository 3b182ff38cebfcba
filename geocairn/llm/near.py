"""N-gram Jaccard join over a MinHash LSH forest, with exact verification.

A document is its set of five-word shingles. Documents of equal sets form one class, of which only the first goes on. Each tree of the
forest is a prefix trie of signatures: sequences of minhashes, those with a common prefix standing together when sorted. Matched prefixes are
shortened from the full depth until a pair at the threshold shares one in some tree with the target probability. From there on they are
shortened only for documents that may have more links than were found, as verified links of theirs show that few trees caught: until,
by the number of such links, no more than a tenth of a link is expected to be missed.

The sorted signatures of a trie node are walked once, with a bounded number of leaders: a document goes with a leader that is almost the
same, else it becomes one, and is tied to each leader of which it may be near a follower. So a chain of weakly alike texts that meet
by their prefixes doesn't become one group. A node of very many documents is dealt into parts, which are walked side by side; the leaders of
its parts meet as a smaller node, and so on, until what is left fits one walk. Documents tied together, directly or through others, form candidate groups. A group is dealt
into blocks, and each pair of blocks is one unit of work: it intersects the shingle sets of all its pairs exactly and returns, for each
class, the number of documents it links to and the local component it is in. So no pair is ever a row, and a group of any size is spread over tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, keep, quoted, stored
from .graph import components, local_roots
from .words import BASE, mix, shingle_sets

SHINGLE = 5
THRESHOLD = 0.8
#: Trees, minhashes in a signature, and the probability that a pair at the threshold meets before evidence decides.
TREES, DEPTH, RECALL = 48, 12, 0.999
#: Minhashes by which two signatures of a node are compared, and leaders that a node has at most; beyond these its rest is one group.
MARKS, LEADERS = 256, 256
#: Likeness of signatures at which a document goes with a leader.
SAME = 0.97
#: Documents of a node that are walked by one task, about; a larger node is walked in parts.
PART = 4096
#: A link that no more trees than these caught shows that others may have been missed; so many may be, by expectation, in the end.
FEW_TREES, MISSED = 1, 0.1
#: Documents whose trie nodes (trees * 16 bytes each), and ids of documents, that are broadcast, at most.
BROADCAST_DOCS, BROADCAST_IDS = 10_000, 250_000
#: Classes in a block, and about in a unit of small groups; bytes of text likewise.
BLOCK, BLOCK_BYTES = 1024, 1 << 25
#: Shingles in this many of a unit's sets and more are counted by matrix products, others by their lists.
DENSE = 24
SEED = 11


def shared_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which two sets at the threshold meet in some tree with probability `recall`, from full depth down."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def tie_level(threshold: float, same: float = SAME, marks: int = MARKS, level: int = 0) -> float:
    """Share of equal minhashes at which a document is tied to a leader.

    One within `threshold` of a follower is, by the triangle inequality of Jaccard distances, within threshold + (the follower's own
    similarity) - 1 of its leader; both similarities may be five standard errors below what the signatures show. Where leaders of parts
    meet, each of the two stands for followers of its own at every level passed, so there are two more such steps a level."""
    low = lambda s: s - 5 * (max(0.0, s * (1 - s)) / marks) ** 0.5
    return max(0.0, low(max(0.0, threshold + (1 + 2 * level) * (low(same) - 1))))


class Signer:
    """The minhashes of all trees, one after the other, a byte each."""

    def __init__(self, trees: int, depth: int, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.flip = random.integers(0, 2**32, trees * depth, dtype=np.uint32)
        self.times = random.integers(0, 2**32, trees * depth, dtype=np.uint32) | np.uint32(1)
        self.room = np.empty((128, trees * depth), np.uint32)

    def __call__(self, shingles: np.ndarray) -> bytes:
        low = ((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32))[:, None]
        least = np.full(len(self.flip), 2**32 - 1, np.uint32)
        with np.errstate(over="ignore"):
            for a in range(0, len(low), len(self.room)):
                x = np.bitwise_xor(low[a : a + len(self.room)], self.flip, out=self.room[: len(low) - a])
                x *= self.times
                np.minimum(least, x.min(axis=0), out=least)
            return (mix(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n (shingles), set_a and set_b (128 bits that name the set), signature (trees * depth bytes) and bytes of the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signer = Signer(trees, depth)
        for batch in batches:
            n, a, b, signed, size = [], [], [], [], []
            texts = batch.column(1)
            for k in range(0, len(texts), 64):
                part = texts[k : k + 64].to_pylist()
                size += map(len, part)
                for s in shingle_sets(part, shingle):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    a.append(int.from_bytes(d[:8], "little", signed=True))
                    b.append(int.from_bytes(d[8:], "little", signed=True))
                    signed.append(signer(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, a, b)), pa.array(signed, pa.binary()), pa.array(size, pa.int64())], names=["doc_id", "n", "set_a", "set_b", "signature", "bytes"])

    return rows.mapInArrow(task, "doc_id long, n long, set_a long, set_b long, signature binary, bytes long")


def trie_nodes(signed: DataFrame, shared: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """id and node, a hash of the first `shared` minhashes of the id's signature in each tree, with the tree in its lowest bits."""
    bits = (trees - 1).bit_length()
    hashed = lambda t: F.shiftleft(F.xxhash64(t, F.substring("signature", t * depth + 1, F.lit(shared))), bits).bitwiseOR(t.cast("long"))
    return signed.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), hashed)).alias("node"))


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """The rows of nodes (id, node) whose node holds another id too, with the node's least id and its number of rows."""
    held = nodes.groupBy("node").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("size")).where("least != most")
    return nodes.join(held.select("node", "least", "size"), "node")


def small(rows: DataFrame, n: int, bound: int) -> DataFrame:
    """rows, to be broadcast where their number n is known to be within the bound."""
    return F.broadcast(rows) if n <= bound else rows


def _walk(least: float, leaders: int):
    """Walks rows (node, part, parts, id, marks) in order of node and part: a tie of id a to id b, and with null b an id that goes on
    to the next level, as it leads or as the leaders of its part were full. A part that is its whole node has no next level: what
    finds the leaders full goes with the first of them there."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = None, 0
        marks, names, tied = np.empty((leaders, MARKS), np.uint8), np.empty(leaders, np.int64), np.empty(leaders, np.int64)
        for batch in batches:
            own, part, parts, ids = (batch.column(k).to_numpy() for k in range(4))
            signs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
            nodes, a, b = [], [], []
            for i in range(len(ids)):
                if (own[i], part[i]) != at:
                    at, count = (own[i], part[i]), 0
                sign, best, met = signs[i], 0.0, np.empty(0, np.int64)
                if count:
                    alike = np.count_nonzero(marks[:count, : len(sign)] == sign, axis=1) / len(sign)
                    best = alike.max()
                    near = alike >= least
                    if best < SAME and count == leaders and parts[i] == 1:
                        near[0] = True
                    met = np.unique(tied[:count][near])
                    for k in met:  # leaders that are tied already need one tie
                        nodes.append(own[i])
                        a.append(ids[i])
                        b.append(names[k])
                    if len(met) > 1:
                        tied[:count][np.isin(tied[:count], met)] = met[0]
                if best < SAME:
                    if count < leaders:
                        marks[count, : len(sign)], names[count], tied[count] = sign, ids[i], met[0] if len(met) else count
                        count += 1
                    if parts[i] > 1:
                        nodes.append(own[i])
                        a.append(ids[i])
                        b.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, a, b)], names=["node", "a", "b"])

    return walk


def ties(signed: DataFrame, nodes: DataFrame, threshold: float, trees: int = TREES, depth: int = DEPTH, leaders: int = LEADERS, part: int = PART) -> DataFrame:
    """Pairs a, b of ids of a trie node (id, node, least: the node's least id, size: its rows, counted where missing) that may be
    near, each of them or through the node's leaders.

    The least id is the node's first leader, so that a group of near copies is tied to few ids whatever the trees. Nodes of more than
    `part` rows are walked in parts, and what leads there is walked again. A node that doesn't shrink to half its rows by that holds
    many texts that differ: all that is left of it is tied to the least id, which takes no walk."""
    tree = F.col("node").bitwiseAND(F.lit((1 << (trees - 1).bit_length()) - 1)).cast("int")
    signs = signed.select("id", "signature")
    if "size" not in nodes.columns:
        nodes = nodes.join(nodes.groupBy("node").agg(F.count("*").alias("size")), "node")
    found: DataFrame | None = None
    for level in itertools.count():
        held = nodes.withColumn("parts", F.ceil(F.col("size") / part).cast("int")).join(signs, "id").select(
            "node", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "parts", "id", (F.col("id") != F.col("least")).alias("later"),
            F.substring("signature", 1, MARKS).alias("marks"), F.substring(F.col("signature"), tree * depth + 1, F.lit(depth)).alias("sequence"),
        )
        in_order = held.repartition("node", "part").sortWithinPartitions("node", "part", "later", "sequence", "id").select("node", "part", "parts", "id", "marks")
        walked = cut(in_order.mapInArrow(_walk(tie_level(threshold, level=level), leaders), "node long, a long, b long"))
        pairs = walked.where("a != b").select("a", "b").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        left = walked.where("b is null").select("node", F.col("a").alias("id"))
        if left.isEmpty():
            return found.distinct() if level else found
        before = nodes.groupBy("node").agg(F.max("size").alias("before"))
        now = left.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("size")).join(before, "node")
        left = cut(left.join(now, "node"))
        differ = F.col("size") * 2 > F.col("before")
        found = found.unionByName(left.where(differ & (F.col("id") != F.col("least"))).select(F.col("id").alias("a"), F.col("least").alias("b")))
        nodes = left.where(~differ).drop("before")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    values = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(*values)
    at = [np.searchsorted(shared, v) for v in values]
    for side in (0, 1):
        found = (at[side] < len(shared)) & (shared[np.minimum(at[side], len(shared) - 1)] == values[side]) if len(shared) else np.zeros(len(at[side]), bool)
        order = np.argsort(at[side][found], kind="stable")
        owner[side], at[side] = owner[side][found][order], at[side][found][order]
    counts = [np.bincount(x, minlength=len(shared)) for x in at]
    dense = counts[0] + counts[1] >= DENSE
    columns = np.flatnonzero(dense)
    for c in range(0, len(columns), 4096):
        place = np.full(len(shared), -1)
        place[columns[c : c + 4096]] = np.arange(len(columns[c : c + 4096]))
        x = []
        for side, n in ((0, len(a)), (1, len(b))):
            m = np.zeros((n, len(columns[c : c + 4096])), np.float32)
            k = place[at[side]]
            m[owner[side][k >= 0], k[k >= 0]] = 1
            x.append(m)
        out += (x[0] @ x[1].T).astype(np.int64)
    if not dense.all():
        lists = np.flatnonzero(~dense)
        first = [np.concatenate([[0], np.cumsum(c)[:-1]]) for c in counts]
        for c in range(0, len(lists), 65536):
            k = lists[c : c + 65536]
            size = counts[0][k] * counts[1][k]
            which = np.repeat(np.arange(len(k)), size)
            step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            i = owner[0][first[0][k][which] + step // counts[1][k][which]]
            j = owner[1][first[1][k][which] + step % counts[1][k][which]]
            out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each set of a and each of b have a Jaccard similarity of the threshold or more; empty sets link with nothing."""
    out = np.zeros((len(a), len(b)), bool)
    size = [np.array([len(s) for s in x]) for x in (a, b)]
    for i in range(0, len(a), 512):
        for j in range(0, len(b), 512):
            both = intersections(a[i : i + 512], b[j : j + 512])
            union = size[0][i : i + 512, None] + size[1][None, j : j + 512] - both
            out[i : i + 512, j : j + 512] = (both > 0) & (both >= threshold * union - 1e-9 * union)
    return out


def prefixes(signatures: list[bytes], trees: int, shared: int) -> np.ndarray:
    """By signature and tree a hash of the first `shared` minhashes."""
    sequences = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), trees, -1)
    out = np.zeros(sequences.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shared):
            out = mix(out * BASE + sequences[:, :, k])
    return out


def _few(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links (rows against columns) no more than FEW_TREES trees caught; a, b: the nodes of the rows and of the columns, by tree."""
    out = np.zeros_like(links)
    i, j = np.nonzero(links)
    for k in range(0, len(i), 65536):
        part = slice(k, k + 65536)
        out[i[part], j[part]] = np.count_nonzero(a[i[part]] == b[j[part]], axis=1) <= FEW_TREES
    return out


def _verify(threshold: float, shingle: int, trees: int, shared: int):
    """For a unit (all pairs of two blocks of one group, or whole small groups): id, links (documents), few (classes whose link few
    trees caught) and root (an id of its component)."""

    def unit(data: pa.Table) -> pa.Table:
        group, block, ids, weight = (data.column(c).to_numpy() for c in ("grp", "block", "id", "weight"))
        sets = shingle_sets(data.column("text").to_pylist(), shingle)
        nodes = prefixes(data.column("signature").to_pylist(), trees, shared)
        low = data.column("low")[0].as_py()
        out: list[tuple] = []
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            a, b = own[block[own] == low], own[block[own] != low]
            if len(b):
                links = linked([sets[i] for i in a], [sets[i] for i in b], threshold)
                few = _few(links, nodes[a], nodes[b])
                ra, rb = local_roots(links)
                names = np.concatenate([ids[a], ids[b]])
                out += zip(ids[a], links @ weight[b], few.sum(axis=1), names[ra], strict=True)
                out += zip(ids[b], links.T @ weight[a], few.sum(axis=0), names[rb], strict=True)
            elif data.column("high")[0].as_py() == low:
                links = linked([sets[i] for i in a], [sets[i] for i in a], threshold)
                np.fill_diagonal(links, False)
                ra, _ = local_roots(links | np.eye(len(a), dtype=bool))
                out += zip(ids[a], links @ weight[a], _few(links, nodes[a], nodes[a]).sum(axis=1), ids[a][ra], strict=True)
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "links", "few", "root"])

    return unit


def verified(texts: DataFrame, groups: DataFrame, signed: DataFrame, threshold: float, shingle: int, shared: int, trees: int, block: int) -> DataFrame:
    """All pairs within each group (id, component) compared exactly: id, links, few, root by unit. signed: id, weight, signature, bytes."""
    sizes = groups.join(signed.select("id", "bytes"), "id").groupBy("component").agg(F.count("*").alias("__size"), F.sum("bytes").alias("__bytes"))
    members = groups.join(sizes, "component").join(signed.select("id", "weight", "signature"), "id")
    blocks = F.greatest(F.ceil(F.col("__size") / block), F.least(F.col("__size"), F.ceil(F.col("__bytes") / BLOCK_BYTES))).cast("int")
    members = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    alone = F.col("blocks") == 1
    total, size = groups.join(signed.select("id", "bytes"), "id").agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bins = 1 + max(total * 4 // block, size * 4 // BLOCK_BYTES)
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(alone, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("key"), F.when(alone, F.lit(0)).otherwise(F.lit(1)).alias("kind"),
        F.col("component").alias("grp"), "id", "weight", "signature", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    texts = texts.join(small(groups.select("id"), total, BROADCAST_IDS), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    return units.join(texts, "id").groupBy("kind", "key", "low", "high").applyInArrow(_verify(threshold, shingle, trees, shared), "id long, links long, few long, root long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_links, class_id, kept, n_shingles.

    n_links: other documents at the threshold or above, copies included; class_id: the least doc_id reachable by links, its own
    included; kept: doc_id = class_id. A text of fewer than five words has one shingle of all its words; null and empty texts have
    none and link with nothing. A null id gets no class (null) and is kept, and its document is linked only with exact copies; rows of
    one id share one document's links, so each of them is kept if one is; an empty table gives an empty result; other columns are
    ignored.
    """
    whole, folder = stored(signatures(docs, doc_id, text, shingle, trees, depth))
    signed = cut(whole.drop("signature", "bytes"))
    filled = whole.where("n > 0")
    classes = cut(signed.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.count("*").alias("weight")))
    of_id = classes.groupBy("id").agg(F.max("weight").alias("weight"))
    first = filled.select(F.col("doc_id").alias("id"), "signature", "bytes").join(of_id, "id").groupBy("id")
    first = keep(first.agg(F.max("weight").alias("weight"), F.max_by("signature", F.struct("bytes", "signature")).alias("signature"), F.max("bytes").alias("bytes")))
    discard(docs.sparkSession, folder)  # from here on only the first of each class has a signature
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    shared = shared_depth(threshold, trees, depth, recall)
    nodes = trie_nodes(first, shared, trees, depth)
    groups = components(ties(first, shared_nodes(nodes), threshold, trees, depth))
    compared = cut(verified(texts, groups, first, threshold, shingle, shared, trees, block))
    results, roots = cut(compared.groupBy("id").agg(F.sum("links").alias("links"), F.sum("few").alias("few"))), compared.select("id", "root")
    doubtful = results.where("few > 0").select("id", "few")
    n_doubtful, n_few = doubtful.agg(F.count("*"), F.coalesce(F.sum("few"), F.lit(0))).first()
    shorter = shared
    while n_few and shorter > 1 and (shorter == shared or n_few * (1 - threshold**shorter) ** trees > MISSED):
        shorter -= 1
    if shorter < shared:  # for the doubtful documents alone
        theirs = trie_nodes(first.join(doubtful.select("id"), "id"), shorter, trees, depth).select("node").distinct()
        nodes = cut(trie_nodes(first, shorter, trees, depth).join(small(theirs, n_doubtful, BROADCAST_DOCS), "node", "left_semi"))
        new = ties(first, shared_nodes(nodes), threshold, trees, depth)
        of = groups.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
        new = cut(new.join(of, "a", "left").join(of.withColumnsRenamed({"a": "b", "of_a": "of_b"}), "b", "left").where("of_a is null or of_b is null or of_a != of_b").select("a", "b"))
        if not new.isEmpty():  # groups that grew are compared anew
            groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new))
            grown = groups.join(new.select(F.col("a").alias("id")), "id", "left_semi").select("component").distinct()
            touched = cut(groups.join(grown, "component", "left_semi"))
            compared = cut(verified(texts, touched, first, threshold, shingle, shorter, trees, block))
            anew = compared.groupBy("id").agg(F.sum("links").alias("links"), F.sum("few").alias("few"))
            results = cut(anew.unionByName(results.join(touched, "id", "left_anti")))
            roots = compared.select("id", "root").unionByName(roots.join(touched.select("id"), "id", "left_anti"))

    found = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_class = classes.join(results, "id", "left").join(found, "id", "left").select("set_a", "set_b", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("class_id"))
    out = signed.join(by_class, ["set_a", "set_b"], "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", F.coalesce(F.col("weight") - 1 + F.col("links"), F.lit(0)).alias("n_links"), class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns."""
    dropped = near_duplicates(docs, doc_id, **options).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, F.col(doc_id) == F.col("__dropped"), "left_anti").select(*quoted(docs.columns))
