"""Packing tokenised examples into fixed-length sequences by vector bin packing.

An example is a vector: its tokens, one segment, its loss-bearing tokens, which follow those that are only context. A sequence has a limit on
each. One sequence is filled at a time: of the examples that still fit, the one with the largest dot product of its vector and the room
left (both as shares of the limits) goes in, until none fits. Where examples may be cut, a gap of at least `min_piece` tokens is closed with
the start of the example of which most goes in under all limits: when no more loss-bearing tokens may go in, that is an example's context.

Each task packs the documents of its own input partition, in pools of bounded size that hand their unfilled sequence on to the next
pool: no document moves to another task, so nothing is shuffled, no source or group can be hot, and a lost task is redone from its
input alone. Only the last sequences of a task are left with gaps; cutting them at powers of two, which need no padding, closes these.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

END = 1
LIMIT = 2048
MAX_SEGMENTS = 128
#: In the query: share of a document at its start that is only context, and loss-bearing tokens in a sequence at most.
CONTEXT, MAX_LOSS = 0.25, 1664
#: Weight of loss-bearing tokens in the dot product: examples that bear much loss go in first, so that the context which others have left over fills
#: the gaps beside them, rather than being used up by examples that need no more.
LOSS_WEIGHT = 4.0
#: A shorter gap is padded rather than closed by cutting an example.
MIN_PIECE = 8
#: A pool of examples packed together: so many at most, and so many tokens.
POOL_EXAMPLES, POOL_TOKENS = 4096, 1 << 22
#: Words whose ids a worker remembers, and characters of each at most.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
#: Fixed value: how byte-level BPE of this family splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class WordwiseTokenizer:
    """Ids of whole texts from a byte-level BPE file of the tokenizers library, each distinct word encoded once.

    Such a tokenizer never joins a character other than white space with a space that follows it, so a text falls into pieces that
    start at such spaces and whose ids don't depend on each other. tiktoken, given the file's own vocabulary, encodes the pieces: its
    ids are the same and it takes half the time. Pieces in which a special token could stand go through the file's tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        plain = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: these stand for themselves, the others follow from 256
        byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(shown))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in plain.items()}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ids: dict[str, bytes] = {}

    def encode(self, pieces: list[str]) -> list[bytes]:
        plain, special = self.plain.encode_ordinary, self.special
        return [array("I", self.tokenizer.encode(p, add_special_tokens=False).ids if special and special.search(p) else plain(p)).tobytes() for p in pieces]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        heads, rest = [], []
        for t in texts:
            if re.search(r"\s ", t):
                head, *words = re.split(r"(?<=\S)(?= )", t)
                words = [w[1:] for w in words]
            else:
                head, *words = t.split(" ")
            heads.append(head)
            rest.append(words)
        heads = self.encode(heads)
        known, new = self.ids, set().union(*rest)
        long = [w for w in new if len(w) > CACHE_CHARS]
        new.difference_update(long)
        used = list(new) if len(known) + len(new) > CACHE_WORDS else []
        new.difference_update(known)
        if used and len(known) + len(new) > CACHE_WORDS:
            known = {w: known[w] for w in used if w in known}
        known.update(zip(new, self.encode([" " + w for w in new]), strict=True))
        self.ids = known
        if long:
            known = known | dict(zip(long, self.encode([" " + w for w in long]), strict=True))
        return [h + b"".join([known[w] for w in words]) for h, words in zip(heads, rest, strict=True)]


def token_file(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fill(items: list[list[int]], limits: tuple[int, int, int], loss, min_piece: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[list[int]]]:
    """Sequences of (example, start, length) from [example, start, length] items, and what a later pool has still to place.

    loss(example, start, length) is a piece's loss-bearing tokens. min_piece 0: nothing is cut. An item that
    fits no empty sequence stands alone. Items of equal vectors are interchangeable: the first of them goes in first.
    """
    kinds: dict[tuple[int, int], list] = {}
    for x in reversed(items):
        kinds.setdefault((x[2], loss(*x)), []).append(tuple(x))
    order = sorted(kinds, reverse=True)
    tokens, bears = (np.array([k[d] for k in order], dtype=np.int64) for d in (0, 1))
    stacks = [kinds[k] for k in order]
    there = np.ones(len(order), dtype=bool)
    n_left, done = len(items), []
    while n_left:
        room, segments, room_loss, sequence = limits[0], limits[1], limits[2], []

        def take(k: int):
            nonlocal n_left
            x = stacks[k].pop()
            n_left -= 1
            if not stacks[k]:
                there[k] = False
            return x

        while n_left and segments:
            a = int(np.searchsorted(-tokens, -room))  # kinds stand by tokens, most first
            fits = there[a:] & (bears[a:] <= room_loss)
            dots = np.where(fits, tokens[a:] * (room / limits[0] ** 2) + bears[a:] * (LOSS_WEIGHT * room_loss / limits[2] ** 2) + segments / limits[1] ** 2, -1.0)
            k = int(np.argmax(dots)) if len(dots) else 0
            if not len(dots) or dots[k] < 0:
                if sequence:
                    break
                a, k = 0, int(np.argmax(there))  # it exceeds a limit by itself, so it stands alone
            x = take(a + k)
            room, segments, room_loss = room - x[2], segments - 1, room_loss - int(bears[a + k])
            sequence.append(x)
        while min_piece and room >= min_piece and segments and n_left:
            # how much of each kind's example goes in from its start: its context, and as much more as bears loss
            goes = np.where(there, np.minimum(np.minimum(tokens, room), tokens - bears + room_loss), 0)
            k = int(np.argmax(goes))
            gap = int(goes[k])
            if gap < min_piece:
                break
            e, start, length = take(k)
            sequence.append((e, start, gap))
            room, segments, room_loss = room - gap, segments - 1, room_loss - loss(e, start, gap)
            if gap == length:
                continue
            start, length = start + gap, length - gap
            kind = (length, loss(e, start, length))
            k = int(np.searchsorted(-tokens, -length))
            while k < len(tokens) and tokens[k] == length and bears[k] > kind[1]:
                k += 1
            if k == len(tokens) or (int(tokens[k]), int(bears[k])) != kind:
                tokens, bears, there = np.insert(tokens, k, kind[0]), np.insert(bears, k, kind[1]), np.insert(there, k, False)
                stacks.insert(k, [])
            stacks[k].append((e, start, length))
            there[k] = True
            n_left += 1
        if not n_left and not last and room >= max(1, min_piece):
            return done, [list(x) for x in sequence]
        done.append(sequence)
    return done, []


def at_powers_of_two(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces, cut so that every sequence's tokens are a power of two."""
    out, left = [], sum(x[2] for x in sequence)
    pieces = list(sequence)[::-1]
    while left:
        room, now = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            e, start, length = pieces.pop()
            take = min(room, length)
            now.append((e, start, take))
            room -= take
            if take < length:
                pieces.append((e, start + take, length - take))
        out.append(now)
    return out


def cut_long(example: int, length: int, limit: int) -> tuple[list[list[tuple[int, int, int]]], list[list[int]]]:
    """Sequences that the example fills alone, and the rest as an item."""
    whole = [[(example, s, limit)] for s in range(0, length - limit + 1, limit)]
    rest = length - len(whole) * limit
    return whole, [[example, length - rest, rest]] if rest else []


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", loss_from: str | None = None, context: float = 0.0, limit: int = LIMIT, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, min_piece: int = MIN_PIECE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A document is its ids and then END. Its tokens from index loss_from (a column; null: 0) on bear loss; without such a column those
    after the first share `context` of them. At most
    limit tokens, max_segments pieces and max_loss loss-bearing tokens (default: limit) go into a sequence, which is padded to limit
    unless its tokens are a power of two. min_piece 0 keeps documents that fit a sequence whole.

    Null text counts as empty (one token, END); a null id passes through; rows that repeat are packed each on its own; an empty table
    gives an empty result; other columns are ignored. A sequence's id is its task's number times 2^40 plus its own within the task.
    """
    from pyspark.sql import functions as F

    max_loss = max_loss or limit
    if min_piece == 0 and max_loss < limit:
        raise ValueError("documents that are kept whole need max_loss of at least limit")
    start = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(None).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), start.alias("loss_from"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenize = _tokenizer(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        ids: dict[int, tuple] = {}  # examples of the pool: doc_id, ids, first token that bears loss
        items: list[list[int]] = []
        n_examples = n_sequences = 0
        whole: list = []
        limits = (limit, max_segments, max_loss)

        def loss(e: int, s: int, n: int) -> int:
            return max(0, s + n - max(s, ids[e][2]))

        def emit(sequences: list) -> pa.RecordBatch:
            nonlocal n_sequences
            out = []
            for pieces in sequences:
                at, total = 0, sum(x[2] for x in pieces)
                for e, s, n in pieces:
                    doc, own, _ = ids[e]
                    out.append((doc, s, n, zlib.crc32(own[4 * s : 4 * (s + n)]), len(own) // 4, first + n_sequences, at, total))
                    at += n
                n_sequences += 1
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 8)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def pool(last: bool) -> pa.RecordBatch:
            nonlocal items, whole, ids
            done, items = fill(items, limits, loss, min_piece, last)
            if last and min_piece:
                done = [part for x in done for part in (at_powers_of_two(x) if sum(y[2] for y in x) <= limit - min_piece else [x])]
            out = emit(whole + done)
            whole, ids = [], {x[0]: ids[x[0]] for x in items}
            return out

        tokens = 0
        for batch in batches:
            texts, docs_, starts = (batch.column(i).to_pylist() for i in (1, 0, 2))
            for a in range(0, len(texts), 256):
                for doc, own, begin in zip(docs_[a : a + 256], tokenize(texts[a : a + 256]), starts[a : a + 256], strict=True):
                    own += END.to_bytes(4, "little")
                    ids[n_examples] = (doc, own, int(len(own) // 4 * context) if begin is None else begin)
                    if max_loss >= limit:
                        full, rest = cut_long(n_examples, len(own) // 4, limit)
                        whole += full
                        items += rest
                    else:  # pieces short enough for the limit on loss too
                        items += [[n_examples, s, min(max_loss, len(own) // 4 - s)] for s in range(0, len(own) // 4, max_loss)]
                    n_examples += 1
                    tokens += len(own) // 4
                    if len(items) >= POOL_EXAMPLES or tokens >= POOL_TOKENS:
                        yield pool(False)
                        tokens = 0
        yield pool(True)

    return rows.mapInArrow(task, SCHEMA)


_TOKENIZERS: dict[str, WordwiseTokenizer] = {}


def _tokenizer(path: str) -> WordwiseTokenizer:
    """One per worker, kept from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordwiseTokenizer(path)
    return _TOKENIZERS[path]
