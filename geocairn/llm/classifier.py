"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text gives a vector of statistics, computed once and kept. The trees are fitted to a bounded sample of the labelled rows and
flattened into arrays, through which all documents of a batch step at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold
from .words import SLICE, slices, windows, word_hashes

#: Labelled rows to fit to, at most: those whose ids have the least hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SHRINK = 80, 4, 64, 0.15, 2.0
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "word_length_spread", "upper", "digits", "marks", "symbols", "bars", "calls", "beyond_ascii", "lines_per_word", "distinct_words", "words_again", "distinct_windows", "short_words", "ends")

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 line end, 6 mark, 7 symbol, 8 bar, 9 call, 10 beyond ASCII, 11 full stop
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ",;:'\"()-?/", "#*$%&<>@_=+~^\\{}[]", "|", "!"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:], _CLASS[ord(".")] = 10, 11


def _words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length in bytes and hash of each word."""
    starts, h = word_hashes(joined)
    space = np.concatenate([_CLASS[np.frombuffer(joined, np.uint8)] // 2 == 2, [True]])
    return starts, np.flatnonzero(space[1:] & ~space[:-1]) + 1 - starts, h


def _row(h: np.ndarray, size: np.ndarray, c: np.ndarray, n_bytes: int) -> tuple[float, ...]:
    """FEATURES of a text with these word hashes and lengths, counts of byte classes and bytes."""
    n, total, w = max(1, len(h)), max(1, n_bytes), windows(h, 5)
    return (
        np.log1p(len(h)), size.mean() if len(h) else 0, size.std() if len(h) else 0, c[2] / total, c[3] / total, c[6] / total, c[7] / total, c[8] / n, c[9] / n,
        c[10] / total, c[5] / n, len(np.unique(h)) / n, (h[1:] == h[:-1]).sum() / n, len(np.unique(w)) / max(1, len(w)), (size <= 3).sum() / n, c[11] / n,
    )


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES per text, ratios of nothing being 0. Texts are read whole, short ones many at a time, a long one in pieces."""
    out = np.zeros((len(texts), len(FEATURES)))
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE:
            counts = np.zeros(12, np.int64)
            for a in range(0, len(texts[at]), SLICE):
                counts += np.bincount(_CLASS[np.frombuffer(texts[at][a : a + SLICE], np.uint8)], minlength=12)
            parts = [_words(p)[1:] for p in slices(texts[at])]
            out[at] = _row(np.concatenate([h for _, h in parts]), np.concatenate([n for n, _ in parts]), counts, len(texts[at]))
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= SLICE:
            size += len(texts[to]) + 1
            to += 1
        joined = b" ".join(texts[at:to])
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        text = np.repeat(np.arange(to - at), np.diff(ends, prepend=0))[: len(joined)]
        counts = np.bincount(text * 12 + _CLASS[np.frombuffer(joined, np.uint8)], minlength=12 * (to - at)).reshape(-1, 12)
        counts[:-1, 4] -= 1  # the spaces between texts
        starts, sizes, h = _words(joined)
        bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
        for i in range(at, to):
            own = slice(bounds[i - at], bounds[i - at + 1])
            out[i] = _row(h[own], sizes[own], counts[i - at], len(texts[i]))
        at = to
    return out


def document_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the array of FEATURES. Null text counts as empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                x = features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Trees:
    """Complete binary trees in arrays: at inner node k of tree t, x[feature[t, k]] > cut[t, k] goes to 2k + 2, else to 2k + 1."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return 1 / (1 + np.exp(-(self.start + self.leaf[trees, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, shrink: float = SHRINK) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins. Ties go to the first feature and lowest cut."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    model = Trees(start, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    logit = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * bins + binned[f]
                gs, hs = (np.bincount(at, v, width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h))
                left = gs[:, : len(e)] ** 2 / (hs[:, : len(e)] + shrink)
                right = (gs[:, -1:] - gs[:, : len(e)]) ** 2 / (hs[:, -1:] - hs[:, : len(e)] + shrink)
                gain = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + shrink)
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                model.feature[t, first : first + width][better] = f
                model.cut[t, first : first + width][better] = e[k][better]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        model.leaf[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + shrink)
        logit += model.leaf[t][leaf]
    return model


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Learns from at most train_rows labelled rows whose crc32(doc_id as text) mod 5 isn't 0. Null labels teach nothing; of several
    labels of one id the largest counts; where all labels are alike, or there are none, every score is their smoothed share. A null
    id is scored, not learnt from; rows that repeat are scanned and learnt from each on its own; an empty table gives an empty result;
    other columns are ignored.
    """
    known = cut(document_features(docs, doc_id, text))
    marks = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    sample = known.join(marks.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id")).select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    model = fit(x, sample.column("y").to_numpy().astype(float))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                score = model(part.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = known.mapInArrow(task, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
