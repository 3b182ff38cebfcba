"""Hashes of words and of word windows, many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
#: Bytes of text that are hashed at a time.
SLICE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]|$")


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word (run of bytes other than ASCII white space)."""
    c = np.frombuffer(text + b" ", np.uint8)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((c[~space].astype(np.uint64) + np.uint64(1)) * POWERS[within & 4095], first)
        return starts, mix(sums ^ mix(lengths.astype(np.uint64)))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * BASE + h[k : k + len(out)])
    return out


def slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SLICE bytes that end before white space (or hold one longer word)."""
    a = 0
    while a < len(text):
        end = _SPACE.search(text, min(a + SLICE, len(text))).start()
        yield text[a:end]
        a = max(end, a + 1)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer than n words has one shingle of all its words, an empty one
    none. Short texts are hashed many at a time, a long one in pieces."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE:
            hashes = [np.concatenate([word_hashes(part)[1] for part in slices(texts[at])])]
            at += 1
        else:
            to, size = at, 0
            while to < len(texts) and size + len(texts[to]) <= SLICE:
                size += len(texts[to]) + 1
                to += 1
            starts, h = word_hashes(b" ".join(texts[at:to]))
            bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[at:to])]))
            hashes = [h[bounds[i] : bounds[i + 1]] for i in range(to - at)]
            at = to
        out += [np.unique(windows(h, min(n, max(1, len(h))))) for h in hashes]
    return out
