"""Hidden Markov language model: Baum-Welch counts from all partitions, exact scores by scaled forward recursion.

A latent state emits a word class, the class a word. The most frequent words are classes of their own; the others share classes by
a hash. Within a class a word has its own probability in every state: its expected count there plus its share of the class's
count, so that each training word has emissions of its own and what isn't a training word has the share of one unseen word.
log P(text) is that of the forward recursion over the whole text.

Texts are encoded once, many to a block: class numbers, and the block's rarer words listed once. A step of Baum-Welch runs over the
blocks and yields sums, never texts; the last one also yields the expected counts of each block's rarer words. These are summed by word and
handed back to the blocks that hold the word, once, with which the blocks are scored.

Long texts are computed in pieces side by side without being cut: the product of a piece's steps takes what comes before it to what comes after, so
each piece starts from the exact forward vector and ends with the exact backward one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, keep

STATES, STEPS = 6, 4
#: Words with a class of their own, at most, and classes of the others: bounds of the tables that are sent to tasks.
HEAD, CLASSES = 57_344, 8000
#: Tokens of the pieces that are computed side by side, and of all those in memory at a time.
PIECE, CHUNK = 512, 1 << 19
#: Tokens of a block of texts, about, and bytes of the rarer words it lists; a longer text is a block by itself.
BLOCK_TOKENS, BLOCK_BYTES = 1 << 22, 1 << 26
#: Weight of the plain class shares in each state's emissions, in tokens.
PRIOR = 500.0
#: Weight of a rarer word's share of its class beside its expected counts in a state, in shares of the class's count.
EVEN = 0.5
#: Expected counts of the rarer words are summed in whole numbers of this part, so that sums depend on no order.
UNIT = 256
SEED = 5
END = b""
#: Longer words go by their digest, bytes of text that are split at a time.
LONG_WORD, SLICE = 256, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]|$")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of the text, A-Z lowered, in lists of bounded size; the end comes in the last one."""
    at = 0
    while at < len(text):
        to = _SPACE.search(text, min(at + SLICE, len(text))).start()
        words = text[at:to].lower().split()
        if words and max(map(len, words)) > LONG_WORD:
            words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.sha256(w).digest() for w in words]
        at = to + 1
        if at >= len(text):
            words.append(END)
        yield words
    if not text:
        yield [END]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary, END for a text's end) and n, over docs (text as binary); each task sums its own first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                for words in tokens(t.as_py()):
                    counts.update(words)
                    if len(counts) > 500_000:
                        yield sums()
        yield sums()

    return docs.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_level(words: DataFrame, head: int) -> int:
    """The lowest level of counts (16 to a doubling) such that no more than `head` words are on it or above.

    Only the number of words of each level goes to the driver, a thousand rows at most, so nothing there grows with the corpus."""
    least, total = 1 << 20, 0
    for r in sorted(words.groupBy("level").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["level"]):
        total += r["k"]
        if total > head:
            break
        least = r["level"]
    return least


def hash_class(word: bytes) -> int:
    return zlib.crc32(word) % CLASSES


def _hash_class(word):
    return F.crc32(word) % CLASSES


def cut_pieces(lengths: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of these lengths, one after the other, in pieces: begin and end of each piece, and whether it opens its text."""
    n = -(-lengths // piece)
    text = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ends = np.cumsum(lengths)
    begin = (ends - lengths)[text] + number * piece
    return begin, np.minimum(begin + piece, ends[text]), number == 0


def time_major(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' items by position: index of each item, width of each position, its start, and the pieces' order, longest first."""
    lengths = end - begin
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    width = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    starts = np.concatenate([[0], np.cumsum(width)])
    position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.empty(lengths.sum(), np.int64)
    at[starts[position] + np.repeat(np.arange(len(lengths)), lengths)] = np.repeat(begin[order], lengths) + position
    return at, width, starts, order


class Texts:
    """Class numbers of many texts (flat) and their lengths; tail: the number of each rarer word among them, ratios: factors of its
    emissions by that number (K each)."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, piece: int = PIECE, head: int | None = None, tail: np.ndarray | None = None, ratios: np.ndarray | None = None):
        self.flat, self.lengths, self.ratios = flat, np.asarray(lengths, np.int64), ratios
        self.own = None
        if tail is not None:
            self.own = np.full(len(flat), -1, np.int64)
            self.own[flat >= head] = tail
        self.begin, self.end, self.opens = cut_pieces(self.lengths, piece)

    def chunks(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """The pieces `which` in runs of about CHUNK tokens."""
        run = (np.cumsum(self.end[which] - self.begin[which]) - 1) // CHUNK
        for part in np.split(which, np.flatnonzero(np.diff(run)) + 1):
            if len(part):
                yield part

    def emissions(self, model: Model, at: np.ndarray) -> np.ndarray:
        e = model.emit[:, self.flat[at]]
        if self.ratios is not None:
            k = self.own[at]
            e[:, k >= 0] *= self.ratios[k[k >= 0]].T
        return e


class Model:
    """start (K), move (K, K) and emit (K, classes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """States that stay as they are and emit the classes' shares with random weights, from which Baum-Welch starts."""
        noise = np.exp(np.random.default_rng(seed).normal(0, 1, (states, len(shares))))
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        emit = shares * noise
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def borders(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By piece (K each): the forward vector at the end of the piece before it (0 where it opens a text), the state's probability
        before its first item, and the backward vector after its last one, scaled to that end's forward vector."""
        n, states = len(texts.begin), len(self.start)
        before, prior, after = np.zeros((n, states)), np.tile(self.start, (n, 1)), np.ones((n, states))
        last = np.append(texts.opens[1:], True)
        several = np.flatnonzero(~(texts.opens & last))
        first, product = np.empty((n, states)), np.empty((n if len(several) else 0, states, states))
        for part in texts.chunks(several):
            at, width, starts, order = time_major(texts.begin[part], texts.end[part])
            e = texts.emissions(self, at)
            first[part[order]] = e[:, : width[0]].T
            product[part[order]] = self._products(e, width, starts)
        for p in several[texts.opens[several]]:
            q = p + 1
            a = product[p] @ (self.start * first[p])
            ends = [a / a.sum()]
            while q < n and not texts.opens[q]:
                before[q] = ends[-1]
                prior[q] = ends[-1] @ self.move
                a = product[q] @ (prior[q] * first[q])
                ends.append(a / a.sum())
                q += 1
            b = np.ones(states)
            for k in range(q - 1, p - 1, -1):
                after[k] = b / (ends[k - p] @ b)
                b = self.move @ (first[k] * (after[k] @ product[k]))
                b /= b.max()
        return before, prior, after

    def _products(self, e: np.ndarray, width: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each piece the product of the steps after its first item, to a common factor: (pieces, to, from)."""
        states = len(self.start)
        a = np.repeat(np.eye(states)[:, None, :], width[0], axis=1)
        out = np.empty((width[0], states, states))
        move = self.move.T.copy()
        for t in range(1, len(width)):
            n = width[t]
            out[n : a.shape[1]] = a[:, n:].transpose(1, 0, 2)
            a = (move @ a[:, :n].reshape(states, -1)).reshape(states, n, states)
            a *= e[:, starts[t] : starts[t + 1], None]
            if t % 8 == 0:
                a /= a.max(axis=(0, 2))[None, :, None]
        out[: a.shape[1]] = a.transpose(1, 0, 2)
        return out

    def log10(self, texts: Texts) -> np.ndarray:
        """log10 probability of each whole text, by the scaled forward recursion."""
        _, prior, _ = self.borders(texts)
        by_piece = np.zeros(len(texts.begin))
        move = self.move.T.copy()
        for part in texts.chunks(np.arange(len(texts.begin))):
            at, width, starts, order = time_major(texts.begin[part], texts.end[part])
            e = texts.emissions(self, at)
            a, total = prior[part[order]].T, np.zeros(len(part))
            for t, n in enumerate(width):
                a = (move @ a[:, :n] if t else a) * e[:, starts[t] : starts[t + 1]]
                scale = a.sum(axis=0)
                a /= scale
                total[:n] += np.log10(scale)
            by_piece[part[order]] = total
        return np.add.reduceat(by_piece, np.flatnonzero(texts.opens)) if len(by_piece) else by_piece

    def expected(self, texts: Texts, kinds: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts (K), moves (K, K), emissions (K, classes) and of each of `kinds` rarer words (kinds, K)."""
        before, prior, after = self.borders(texts)
        start, moves, emissions, words = np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit), np.zeros((kinds, len(self.start)))
        move = self.move.T.copy()
        for part in texts.chunks(np.arange(len(texts.begin))):
            at, width, starts, order = time_major(texts.begin[part], texts.end[part])
            emit = texts.emissions(self, at)
            alpha, scale = emit.copy(), np.empty(len(at))
            a = prior[part[order]].T
            for t, n in enumerate(width):
                here = alpha[:, starts[t] : starts[t + 1]]
                here *= move @ a[:, :n] if t else a
                scale[starts[t] : starts[t + 1]] = s = here.sum(axis=0)
                here /= s
                a = here
            ends = after[part[order]].T
            beta = ends[:, : width[-1]]
            for t in range(len(width) - 1, -1, -1):
                here, n = slice(starts[t], starts[t + 1]), width[t]
                ahead = emit[:, here] * beta / scale[here]
                moves += (alpha[:, starts[t - 1] : starts[t - 1] + n] if t else before[part[order]].T) @ ahead.T
                alpha[:, here] *= beta
                if t:
                    earlier = ends[:, : width[t - 1]].copy()
                    earlier[:, :n] = self.move @ ahead
                    beta = earlier
            start += alpha[:, : width[0]][:, texts.opens[part[order]]].sum(axis=1)
            items = texts.flat[at]
            emissions += np.stack([np.bincount(items, g, self.emit.shape[1]) for g in alpha])
            if kinds:
                k = texts.own[at]
                words += np.stack([np.bincount(k[k >= 0], g[k >= 0], kinds) for g in alpha], axis=1)
        return start, moves * self.move, emissions, words


def encode(rows: DataFrame, number: dict[bytes, int], known: np.ndarray, base: np.ndarray) -> DataFrame:
    """rows (doc_id, held_out, text as binary) in blocks: block, doc_id, held_out, n_tokens, head_known and head_base of each row, classes
    (16-bit numbers of all tokens), vocab (the block's words without a number, each once) and tail (32-bit index in vocab of each such token)."""
    n_head = len(known)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        ids, per_row, classes, tails, vocab, slots, size, listed = [], [], [], [], {}, [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal block, ids, per_row, classes, tails, vocab, slots, size, listed
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            held, *numbers = zip(*per_row, strict=True)
            arrays = [
                pa.array([block]), one(pa.concat_arrays(ids)), one(pa.array(held, pa.bool_())), *(one(pa.array(x, k)) for x, k in zip(numbers, (pa.int64(), pa.int64(), pa.float64()), strict=True)),
                pa.array([np.concatenate(classes).tobytes()], pa.binary()), pa.array([np.concatenate([np.empty(0, "<u4"), *tails]).tobytes()], pa.binary()), one(pa.array(list(vocab), pa.binary())),
            ]
            ids, per_row, classes, tails, vocab, slots, size, listed = [], [], [], [], {}, [], 0, 0
            block += 1
            return pa.RecordBatch.from_arrays(arrays, names=["block", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "classes", "tail", "vocab"])

        for batch in batches:
            for i, t in enumerate(batch.column(2)):
                n = known_here = 0
                base_here = 0.0
                for words in tokens(t.as_py()):
                    found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                    rest = np.flatnonzero(found < 0)
                    common = found[found >= 0]
                    n, known_here, base_here = n + len(words), known_here + int((known[common] > 0).sum()), base_here + float(base[common].sum())
                    if len(rest):
                        tail = [words[k] for k in rest]
                        for w in dict.fromkeys(tail):
                            if w not in vocab:
                                vocab[w] = len(vocab)
                                slots.append(n_head + hash_class(w))
                                listed += len(w)
                        index = np.fromiter(map(vocab.__getitem__, tail), "<u4", len(tail))
                        tails.append(index)
                        found[rest] = [slots[k] for k in index]
                    classes.append(found.astype("<u2"))
                ids.append(batch.column(0).slice(i, 1))
                per_row.append((batch.column(1)[i].as_py(), n, known_here, base_here))
                size += n
                if size >= BLOCK_TOKENS or listed >= BLOCK_BYTES:
                    yield row()
        if per_row:
            yield row()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"block long, doc_id array<{kind}>, held_out array<boolean>, n_tokens array<long>, head_known array<long>, head_base array<double>, classes binary, tail binary, vocab array<binary>")


def _flat(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False)


def _of_block(batch: pa.RecordBatch, i: int, n_head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """classes, lengths, whether each text is held out, and index of the rarer words, of the i-th block."""
    return np.frombuffer(batch.column("classes")[i].as_py(), "<u2"), _flat(batch, "n_tokens", i), _flat(batch, "held_out", i).astype(bool), np.frombuffer(batch.column("tail")[i].as_py(), "<u4")


def baum_welch(encoded: DataFrame, shares: np.ndarray, n_head: int, states: int = STATES, steps: int = STEPS) -> tuple[Model, np.ndarray, DataFrame]:
    """The model after so many steps over the blocks' texts that aren't held out, the last step's expected counts of the classes from
    n_head on (classes, K), and the words of these: block, index, word, n (times in the block) and v0, v1, ..., that step's expected counts in
    parts of UNIT. Each step gives every rarer word its class's emissions; the last one's counts give it its own."""
    model = Model.first(shares, states)
    names = [f"v{k}" for k in range(states)]
    for step in range(steps):
        last = step == steps - 1

        def task(batches: Iterator[pa.RecordBatch], model: Model = model, last: bool = last) -> Iterator[pa.RecordBatch]:
            start, move, emit = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
            head_names = ["slot", "block", "at", "word", "n", *names]
            for batch in batches:
                for i in range(batch.num_rows):
                    flat, lengths, held, tail = _of_block(batch, i, n_head)
                    learnt = np.repeat(~held, lengths)
                    tail = tail[learnt[flat >= n_head]]
                    kinds = len(batch.column("vocab")[i]) if last else 0
                    if not learnt.any():
                        sums, words = None, np.zeros((kinds, len(start)))
                    else:
                        *sums, words = model.expected(Texts(flat[learnt], lengths[~held], head=n_head, tail=tail if last else None), kinds)
                        start, move, emit = start + sums[0], move + sums[1], emit + sums[2]
                    if kinds:
                        parts, n = np.rint(words * UNIT).astype(np.int64), np.bincount(tail, minlength=kinds)
                        if sums is not None:  # the class sums are those of the parts, so that they add up
                            of = np.zeros(kinds, np.int64)
                            of[tail] = flat[learnt & (flat >= n_head)]
                            own = np.stack([np.bincount(of[n > 0], v[n > 0], emit.shape[1]) for v in parts.T]) / UNIT
                            emit[:, n_head:] += own[:, n_head:] - sums[2][:, n_head:]
                        vocab = batch.column("vocab")[i].values
                        yield pa.RecordBatch.from_arrays([pa.nulls(kinds, pa.int32()), pa.array(np.full(kinds, batch.column("block")[i].as_py())), pa.array(np.arange(kinds, dtype=np.int32)), vocab, pa.array(n), *(pa.array(v.astype(np.float32)) for v in parts.T)], names=head_names)
            used = np.flatnonzero(emit.any(axis=0))
            # rows of the emission table by class, of the moves at -1 - state, the starts at -1 - K
            slots = np.concatenate([used, -1 - np.arange(len(move)), [-1 - len(move)]])
            values = np.concatenate([emit[:, used].T, move, start[None]])
            k = len(slots)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), *(pa.array(v.astype(np.float32)) for v in values.T)], names=head_names)

        fields = ", ".join(f"{v} float" for v in names)
        counted = encoded.select("block", "held_out", "n_tokens", "classes", "tail", "vocab").mapInArrow(task, f"slot int, block long, at int, word binary, n long, {fields}")
        if last:
            counted = keep(counted)
        sums = counted.where("slot is not null").groupBy("slot").agg(*[F.sum(v).alias(v) for v in names]).toArrow()
        slot, value = sums.column("slot").to_numpy(), np.stack([sums.column(v).to_numpy() for v in names], axis=1)
        emit = np.zeros_like(model.emit)
        emit[:, slot[slot >= 0]] = value[slot >= 0].T
        in_class = emit[:, n_head:].T.copy()
        emit += PRIOR * shares
        move, start = np.full_like(model.move, 1e-3), np.full_like(model.start, 1e-3)
        for s, v in zip(slot[slot < 0], value[slot < 0], strict=True):
            if s == -1 - states:
                start += v
            else:
                move[-1 - s] += v
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return model, in_class, counted.where("word is not null").select("block", "at", "word", "n", *names)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, steps: int = STEPS, head: int = HEAD, even: float = EVEN) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id as text) mod 5 isn't 1. Null text counts as empty (one token, the end); a null id counts as
    the empty text; rows that repeat are learnt and scored each on its own; with no training rows all words are unseen; an empty table
    gives an empty result; other columns are ignored. Words of more than 256 bytes are told apart by their SHA-256.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == 1).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = keep(word_counts(rows.where("not held_out")))
    n_train, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.octet_length("word") > 0).withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    least = head_level(words, head)
    frequent = words.where(F.col("level") >= least).select("word", "n").collect()  # head rows at most
    frequent.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    number = {END: 0} | {bytes(r["word"]): k for k, r in enumerate(frequent, 1)}
    ends = counts.where(F.octet_length("word") == 0).collect()
    known = np.array([ends[0]["n"] if ends else 0, *(r["n"] for r in frequent)], float)
    n_head = len(known)
    # CLASSES rows at most
    classes = words.where(F.col("level") < least).groupBy(_hash_class("word").alias("class")).agg(F.sum("n").alias("class_n"), F.count("*").alias("class_kinds")).collect()
    class_n, class_kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        class_n[r["class"]], class_kinds[r["class"]] = r["class_n"], r["class_kinds"]
    shares = np.concatenate([known, class_n]) + 0.5
    shares /= shares.sum()
    whole = n_train + 0.5 * (n_kinds + 1)
    encoded = keep(encode(rows, number, known, np.log10((known + 0.5) / whole)))
    model, in_class, own = baum_welch(encoded, shares, n_head, states, steps)

    # what all blocks know of a word goes to each block that holds it: a word has one row a block, so no group is large
    names = [f"v{k}" for k in range(states)]
    every = Window.partitionBy("word")
    own = own.select("block", "at", *[F.sum(c).over(every).alias(c) for c in ("n", *names)])
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def score(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for batch in blocks.to_batches():
            for i in range(batch.num_rows):
                flat, lengths, held, tail = _of_block(batch, i, n_head)
                n, v = np.zeros(len(found)), np.zeros((len(found), states))
                at = found.column("at").to_numpy()
                n[at], v[at] = found.column("n").to_numpy(), np.stack([found.column(c).to_numpy() for c in names], axis=1) / UNIT
                of = np.zeros(len(found), np.int64)
                of[tail] = flat[flat >= n_head] - n_head
                share = (n + 0.5) / (class_n + 0.5 * (class_kinds + 1))[of]
                weight = np.maximum(even * class_n, 1e-9)[of, None]
                texts = Texts(flat, lengths, head=n_head, tail=tail, ratios=(v / share[:, None] + weight) / (in_class[of] + weight))
                # by text: sums over the rarer words
                text = np.repeat(np.arange(len(lengths)), lengths)[flat >= n_head]
                total = lambda x, text=text, tail=tail, lengths=lengths: np.bincount(text, x[tail], len(lengths))
                out.append(
                    pa.table(
                        [
                            batch.column("doc_id")[i].values, pa.array(held), pa.array(lengths), pa.array(_flat(batch, "head_known", i) + total((n > 0).astype(float)).astype(np.int64)), pa.array(np.full(len(lengths), int(n_train))),
                            pa.array(_flat(batch, "head_base", i) + total(np.log10((n + 0.5) / whole))), pa.array(model.log10(texts) + total(np.log10(share))),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )
                )
        return pa.concat_tables(out)

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return encoded.drop("vocab").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, schema)
