"""Queries and stages on rows that their SQL leaves out."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from geocairn.llm import hmm
from geocairn.llm.queries import QUERIES


def test_short_lines_on_many_sites_go(spark, tmp_path):
    rows = [(i, f"own {i}\nAll rights reserved.\n \nEnd", "en", f"s{i % 8}" if i != 7 else None, 0) for i in range(8)]
    rows += [(20 + i, f"other {i}\nOn five sites", "en", f"s{i % 5}", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: []} | {i: [1, 3] for i in range(1, 8)} | {20 + i: [] for i in range(10)}
    texts = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, str(tmp_path)).collect()}
    assert texts[0] == rows[0][1] and texts[7] == "own 7\n " and texts[25] == rows[13][1]


def test_rarer_words_have_emissions_of_their_own(spark):
    """Two kinds of texts whose words all share one class: only emissions by word tell the kinds apart."""
    a, b = [f"a{k}same" for k in range(40)], [f"b{k}same" for k in range(40)]
    pick = lambda words, i: " ".join(words[(i * 7 + j * j) % 40] for j in range(60))
    rows = [(i, pick(a if i % 2 else b, i)) for i in range(400)]
    got = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), states=2, head=0).collect()
    held = [r for r in got if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert held and gain > 0.2


def plain_scores(texts, head, states, steps):
    """score_texts() text by text and step by step: forward and backward sums over whole texts, every word's emissions written out."""
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    split = {i: [*(w for w in re.split("[\\x20\\x09-\\x0d]+", t.lower()) if w), ""] for i, t in texts.items()}
    count = Counter(w for i in learn for w in split[i])
    level = lambda w: math.floor(math.log2(count[w]) * 16)
    by_level, top = sorted({level(w) for w in count if w}, reverse=True), []
    for at in by_level:
        here = [w for w in count if w and level(w) == at]
        if len(top) + len(here) > head:
            break
        top += here
    top = ["", *sorted(top, key=lambda w: (-count[w], w.encode()))]
    number = {w: k for k, w in enumerate(top)}
    slot = lambda w: number.get(w, len(top) + zlib.crc32(w.encode()) % hmm.CLASSES)
    class_n, kinds = Counter(), Counter()
    for w in count:
        if w not in number:
            class_n[slot(w)] += count[w]
            kinds[slot(w)] += 1
    shares = np.array([count[w] for w in top] + [class_n[len(top) + k] for k in range(hmm.CLASSES)]) + 0.5
    shares /= shares.sum()
    first = hmm.Model.first(shares, states)
    start, move, emit = first.start, first.move, first.emit

    def forward(e):
        out = [start * e[0]]
        for x in e[1:]:
            out.append((out[-1] @ move) * x)
        return out

    for step in range(steps):
        starts, moves, emits, own = np.zeros(states), np.zeros((states, states)), np.zeros_like(emit), defaultdict(lambda: np.zeros(states))
        for i in learn:
            e = [emit[:, slot(w)] for w in split[i]]
            alpha, beta = forward(e), [np.ones(states)]
            for x in e[:0:-1]:
                beta.insert(0, move @ (x * beta[0]))
            total = alpha[-1].sum()
            for t, w in enumerate(split[i]):
                gamma = alpha[t] * beta[t] / total
                emits[:, slot(w)] += gamma
                own[w] = own[w] + gamma
                if t:
                    moves += np.outer(alpha[t - 1], e[t] * beta[t]) * move / total
            starts += alpha[0] * beta[0] / total
        if step == steps - 1:
            own = {w: np.rint(v * hmm.UNIT) / hmm.UNIT for w, v in own.items() if w not in number}
            emits[:, len(top) :] = 0
            for w, v in own.items():
                emits[:, slot(w)] += v
        in_class = emits
        emit = emits + hmm.PRIOR * shares
        emit = emit / emit.sum(axis=1, keepdims=True)
        start = (starts + 1e-3) / (starts + 1e-3).sum()
        move = (moves + 1e-3) / (moves + 1e-3).sum(axis=1, keepdims=True)

    def emission(w):
        s = slot(w)
        if w in number:
            return emit[:, s]
        share = (count[w] + 0.5) / (class_n[s] + 0.5 * (kinds[s] + 1))
        weight = max(hmm.EVEN * class_n[s], 1e-9)
        return emit[:, s] * (own.get(w, 0) + share * weight) / (in_class[:, s] + weight)

    return {i: math.log10(forward([emission(w) for w in ws])[-1].sum()) for i, ws in split.items()}


@pytest.mark.parametrize("head,parts,off", [(6, 1, 1e-4), (0, 1, 1e-4), (500, 1, 1e-4), (6, 5, 0.02)])
def test_scores_equal_those_of_a_plain_model(spark, head, parts, off):
    """Whole scores against a plain run of training and forward recursion, with several words to a class; in several blocks expected counts are rounded apart."""
    r = random.Random(11)
    shared = defaultdict(list)
    for k in range(3000):
        shared[hmm.hash_class(b"rare%d" % k)].append(f"rare{k}")
    rare = [w for ws in shared.values() if len(ws) > 1 for w in ws][:40]
    topics = [[f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]]
    texts = {i: " ".join(r.choice(topics[i % 2]) if r.random() < 0.8 else r.choice(rare) for _ in range(r.randrange(30))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts, "doc_id")
    got = {r["doc_id"]: r["score"] for r in hmm.score_texts(docs, states=3, steps=3, head=head).collect()}
    want = plain_scores(texts, head, 3, 3)
    assert set(got) == set(want)
    for i, w in want.items():
        assert abs(got[i] - w) <= off * (1 + len(texts[i].split())), (i, got[i], w)
