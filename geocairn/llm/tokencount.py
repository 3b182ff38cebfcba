"""Token counts without tokens: Viterbi over unigram vocabulary matches that only carries scores and piece counts.

A unigram tokenizer cuts a text into the pieces of the greatest total score. An Aho-Corasick automaton gives, at each character, the
vocabulary pieces that end there, longest first; the best path to that character takes the piece with the greatest sum, and of equal
sums the one that starts first, which is the longest. A character that is no piece of its own costs an unknown piece: the least score
less 10. Unknown characters count as their bytes where the vocabulary has all byte pieces, else a run of them counts as one.

No piece of the usual vocabularies holds a space mark after another character, so a text falls into words, each counted once per
worker; a vocabulary that has such pieces is applied to whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers, and characters of each at most.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Number of tokens of a text under a unigram vocabulary; the text is prefixed with a space mark, as are its words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        names = {p for p, _ in pieces}
        self.longest = max([1, *map(len, names)])
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$") if not any(re.search(f"[^{MARK}]{MARK}", p) for p in names) else re.compile(".+", re.DOTALL)
        self.known: dict[str, int] = {}

    def path(self, word: str) -> int:
        """Tokens of the best path over a whole word, without memory of others. Only as many places as the longest piece spans are held."""
        n, held = len(word), self.longest + 1
        best, count, fused = [0.0] * held, [0] * held, [False] * held
        ends = self.find.iter(word)
        end, hit = next(ends, (n, None))
        for done in range(n):
            best_score, start, unknown, single = None, 0, False, False
            here = []
            while hit is not None and end == done:
                here.append(hit)
                end, hit = next(ends, (n, None))
            here.sort(reverse=True)  # longest first: of equal sums the first to start wins
            for length, score in here:
                sum_ = score + best[(done + 1 - length) % held]
                if best_score is None or sum_ > best_score:
                    best_score, start = sum_, done + 1 - length
                single |= length == 1
            if not single:
                sum_ = self.unknown + best[done % held]
                if best_score is None or sum_ > best_score:
                    best_score, start, unknown = sum_, done, True
            at, before = (done + 1) % held, start % held
            best[at] = best_score
            if not unknown:
                count[at] = count[before] + 1
            elif self.bytes:
                count[at] = count[before] + len(word[start : done + 1].encode("utf-8", "surrogatepass"))
            else:
                count[at] = count[before] + (0 if fused[before] else 1)
            fused[at] = unknown
        return count[n % held]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        words = self.split.findall(MARK + text.replace(" ", MARK))
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in known and len(w) <= CACHE_CHARS}
            if len(known) + len(new) > CACHE_WORDS:
                known = self.known = {w: known[w] for w in set(words) & known.keys()}
            for w in new:
                known[w] = self.path(w)
            return sum(known[w] if len(w) <= CACHE_CHARS else self.path(w) for w in words)


_COUNTERS: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    """One per worker, kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, n_tokens of the whole text.

    Null and empty texts have no tokens; a null id passes through; rows that repeat are counted each on its own; an empty table gives an
    empty result; other columns are ignored. Nothing is shuffled. Sums of scores are taken in double precision.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model_path)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long")
