"""Periodic runs of words: maximal stretches that repeat themselves, found on a harmonic grid.

A stretch of period p and at least 2p words covers two neighbouring points jp and (j+1)p of the grid of step p. For each p and j the words that
agree forward from the two points and backward from them (longest common extensions) give the whole stretch; over all p these are about n ln n
queries. Extensions are range minima over the common prefixes of neighbours in a suffix array, of the words and of the words reversed.

Many texts go through the arrays at a time: words of different texts are different symbols, so no extension leaves its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Words that a run has at least.
MIN_RUN = 12
#: Words that go through the arrays together; a longer text goes alone.
BATCH_WORDS = 1 << 18
#: Points of the grid that are looked at together.
GRID = 1 << 21
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Extensions:
    """Longest common extensions of any two places of a sequence of symbols: suffix array, common prefixes of neighbours, range minima."""

    def __init__(self, heads: np.ndarray, order: np.ndarray):
        """heads: of each place the number of places with lesser symbols; order: the places in order of their symbols."""
        n = len(heads)
        rank, levels = heads.astype(np.int32), []
        size = np.bincount(rank, minlength=n)
        open_ = order[size[rank[order]] > 1]  # places whose rank others share
        while True:
            levels.append(rank)
            if not len(open_):
                break
            step, rank = 1 << (len(levels) - 1), rank.copy()
            after = open_ + step
            following = np.where(after < n, levels[-1][np.minimum(after, n - 1)], -1).astype(np.int64)
            key = levels[-1][open_].astype(np.int64) * (n + 1) + following + 1
            by = np.argsort(key)
            open_, key = open_[by], key[by]
            head = np.diff(key, prepend=-1) != 0
            group = np.diff(key // (n + 1), prepend=-1) != 0
            at = np.arange(len(key), dtype=np.int32)
            rank[open_] += np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            alone = head & np.append(head[1:], True)
            open_ = open_[~alone]
        self.rank = rank
        suffixes = np.empty(n, np.int32)
        suffixes[rank] = np.arange(n, dtype=np.int32)
        common = np.zeros(n, np.int32)
        i = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1 if n > 1 else np.empty(0, np.int64)
        a, b = suffixes[i - 1].astype(np.int64), suffixes[i].astype(np.int64)
        shared = np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            inside = np.maximum(x, y) < n
            same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
            shared += same.astype(np.int64) << k
        common[i] = shared
        self.minima = [common]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Symbols that agree from x and y on (x != y)."""
        p, q = self.rank[x], self.rank[y]
        low, high = np.minimum(p, q) + 1, np.maximum(p, q)
        power = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(x), np.int32)
        for k in range(int(power.max(initial=-1)) + 1):
            if k == len(self.minima):
                last, half = self.minima[-1], 1 << (k - 1)
                self.minima.append(np.minimum(last[:-half], last[half:]))
            at = np.flatnonzero(power == k)
            if len(at):
                out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k) + 1])
        return out


def _symbols(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and order, as Extensions takes them, of words that are numbered within all texts: equal words of two texts are told apart."""
    keys = np.repeat(np.arange(len(lengths), dtype=np.int64) << 32, lengths) | codes
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=-1) != 0
    heads = np.empty(len(keys), np.int64)
    heads[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return heads, order


def _grid(starts: np.ndarray, lengths: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places jp of each text and the step p, for every p up to half the text, so many at a time."""
    half = lengths // 2
    text = np.repeat(np.arange(len(lengths)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (lengths[text] - 1) // period
    ends = np.cumsum(points)
    a = 0
    while a < len(points):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        n = points[a:b]
        step = np.repeat(period[a:b], n)
        j = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[text[a:b]], n) + j * step, step
        a = b


def find_runs(codes: np.ndarray, lengths: np.ndarray, min_run: int = MIN_RUN, size: int = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (over all texts), length and smallest period of every run of texts that stand one after the other, by start, then period."""
    n = len(codes)
    starts = np.cumsum(lengths) - lengths
    heads, order = _symbols(codes, lengths)
    ahead = behind = None
    found = []
    usable = lengths >= min_run
    for x, p in _grid(starts[usable], lengths[usable], size):
        y = x + p
        on = heads[x] == heads[y]
        back = (heads[x - 1] == heads[y - 1]) & (x > 0)
        at = np.flatnonzero(on | back)
        if not len(at):
            continue
        if ahead is None:
            ahead = Extensions(heads, order)
            behind = Extensions(heads[::-1], n - 1 - order)
        x, y, p, on, back = x[at], y[at], p[at], on[at], back[at]
        forward, backward = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        forward[on] = ahead(x[on], y[on])
        backward[back] = behind(n - x[back], n - y[back])
        hit = (forward + backward >= p) & (forward + backward + p >= min_run)
        if hit.any():
            start, period = (x - backward)[hit], p[hit]
            first = np.unique(start << 32 | period, return_index=True)[1]  # start and period settle the length
            found.append(np.stack([start, (p + forward + backward)[hit], period])[:, first])
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    start, length, period = start[first], length[first], period[first]  # one stretch has its smallest period
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _runs_of(words: list[list[bytes]], min_run: int) -> tuple[pa.Array, list[bytes]]:
    """For texts given as words: their runs, and their words joined without those that repeat."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    column = np.empty(len(flat), object)
    column[:] = flat
    start, length, period = find_runs(pd.factorize(column)[0].astype(np.int64), lengths, min_run)
    ends = np.cumsum(lengths)
    text = np.searchsorted(ends, start, "right")
    offsets = np.searchsorted(text, np.arange(len(words) + 1))
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    joined = [b" ".join(w) for w in words]
    for i in np.unique(text):
        joined[i] = b" ".join(column[ends[i] - lengths[i] : ends[i]][kept[ends[i] - lengths[i] : ends[i]]])
    at = start - (ends - lengths)[text] if len(start) else start
    values = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), joined


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN, batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per row of docs: its id, n_words, runs (start, length, period, by start, then period; starts count words from 0) and collapsed,
    the text's words joined by one space without those that a run repeats: any word after the first period of a run that holds it.

    A run is a stretch of words whose smallest period q fits at least twice, of at least min_run words, that can't be extended. Words are what
    stands between ASCII white space. Null and empty texts have no words, no runs and an empty collapsed text. Rows that repeat, null ids and
    rows of one id are each answered for themselves; other columns are ignored; an empty table gives an empty result.

    A text is the unit of work: it takes about 400 bytes a word in its task, whatever the other texts; nothing is shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, words, n = 0, [], 0
            for i in range(batch.num_rows):
                words.append(texts[i].as_py().split())
                n += len(words[-1])
                if n >= batch_words or i + 1 == batch.num_rows:
                    runs, joined = _runs_of(words, min_run)
                    counts = pa.array([len(w) for w in words], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(words)), counts, runs, pa.array(joined, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
                    at, words, n = i + 1, [], 0

    return rows.mapInArrow(task, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of the greatest length; of several the first, then that of the smallest period."""
    later = lambda a, b: F.when(a["length"] != b["length"], a["length"] < b["length"]).when(a["start"] != b["start"], a["start"] > b["start"]).otherwise(a["period"] > b["period"])
    return F.get(F.array_sort(runs, lambda a, b: F.when(later(a, b), 1).when(later(b, a), -1).otherwise(0)), 0)


def repeated_tail(text: Column, seed: Column, min_repeats: int = 3) -> Column:
    """The text with its words from a place on replaced by the first of them, over and over, for every tenth seed: place and period follow
    from the seed. A planted run for measuring what finds runs."""
    g = F.floor(seed / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))

    def tiled(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (min_repeats + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " "))

    # the words are bound once: within the inner function they would be read out of the text again for each word
    return F.when(F.pmod(seed, F.lit(10)) == 0, F.coalesce(F.get(F.transform(F.array(words), tiled), 0), text)).otherwise(text)
