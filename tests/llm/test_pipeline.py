"""The document pipeline and each of its stages against plain versions of them."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, WORD, jaccard_links, plain_distances, plain_mix, prose, roots

import corpus_pipeline
from geocairn.llm import packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def document(i, text, source, lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="module")
def rows():
    out = [document(i, prose(i, 30 + i) + "\nShared by all of the sites\n" + prose(900 + i, 12), f"s{i % 8}", ("en", "de")[i % 2]) for i in range(48)]
    out += [document(100 + k, " ".join(prose(5000, 150).split()[: 150 - k % 3]), f"s{k % 4}") for k in range(9)]
    out += [document(200 + k, "Shared by all of the sites", "s1") for k in range(3)]  # too short for the rules
    out += [document(210, "\n".join(["Shared by all of the sites"] * 3 + [prose(6, 14)]), None), document(211, "one two " * 40, "s2")]
    out += [document(212, " ".join(f"$#{w}&" for w in prose(3, 50).split()), "s2"), document(213, None, "s3"), document(214, "", "s3"), document(215, prose(77, 40), None, None), document(216, prose(78, 5000, 3000), "s0")]
    return out


def plain_rules(rows):
    kept, vectors, judged = [], [], []
    for r in rows:
        t = r[1] or ""
        w = re.findall(WORD, t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = len({j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
        if len(w) < 10 or 100 * again > 20 * len(w):
            continue
        full = [x for x in t.split("\n") if re.search(WORD, x)]
        n, chars, marks = len(w) + 20, sum(map(len, w)) + 100, sum(t.count(x) for x in "#*$%&|<>")
        vectors.append([math.log((chars - marks) / n), math.sqrt(marks / n), math.sqrt((sum(x in quality.CAPITALS for x in t) + 1) / chars), math.sqrt((len(full) - len(set(full))) / (len(full) + 10)), math.sqrt(again / n)])
        judged.append(r)
    d2 = plain_distances(np.array(vectors), [r[2] for r in judged], [r[3] for r in judged])
    kept = [r for r, d in zip(judged, d2, strict=True) if d <= quality.BOUND]
    return kept


def plain_lines(rows):
    places = {}
    for r in rows:
        for k, line in enumerate((r[1] or "").split("\n")):
            if re.search(WORD, line):
                places.setdefault(line.strip(" \t\x0b\x0c\r"), []).append((r[0], k, r[3]))
    gone = set()
    for p in places.values():
        if len({s for _, _, s in p}) >= 6:
            gone |= {(d, k) for d, k, _ in p} - {min((d, k) for d, k, _ in p)}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for k, x in enumerate(lines) if (r[0], k) not in gone]
        if len(left) == len(lines):
            out.append(r)
        elif re.search(WORD, text := "\n".join(left)):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def plain_near(rows):
    rows = sorted(rows, key=lambda r: r[0])
    return [r for i, (r, root) in enumerate(zip(rows, roots(jaccard_links(rows)), strict=True)) if root == i]


def plain_mixing(rows):
    copies, _ = plain_mix([(r[0], len(re.findall(WORD, r[1] or "")), r[3]) for r in rows])
    return [r for i, r in enumerate(rows) for _ in range(copies[i])]


def packed(pieces, rows):
    """Whether the pieces hold each token of each row once, within the limits."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.token_file("byte_bpe_50k.json"))
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    seen, sequences = Counter(), {}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        seen.update((p["doc_id"], k) for k in range(p["start"], p["start"] + p["length"]))
        sequences.setdefault(p["sequence_id"], []).append(p)
    times = Counter(r[0] for r in rows)
    assert seen == Counter({(d, k): times[d] for d in times for k in range(len(ids[d]))})
    assert all(sum(p["length"] for p in s) <= 2048 for s in sequences.values())
    return True


PLAIN = [plain_rules, plain_lines, plain_near, plain_mixing]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_run_and_its_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = rows
    for (_, stage), plain in zip(corpus_pipeline.STAGES, PLAIN, strict=False):
        got = stage(spark, spark.createDataFrame(now, SCHEMA).repartition(2), str(tmp_path))
        assert got.columns == COLUMNS
        after = plain(now)
        assert after != now and in_order(got.collect()) == in_order(after)
        now = after
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(now, SCHEMA), str(tmp_path)).collect()
    assert packed(last, now) and packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), now)


def test_stages_take_empty_tables_repeated_rows_and_clashing_columns(spark, rows, tmp_path):
    clashing = ["size", "copies", "target", "source_size", "n_lines", "removed", "n_removed", "weight", "id", "kept", "component", "block", "class", "site", "line", "first", "label", "x0", "n", "distance2"]
    for given in ([], [*rows[:3], *rows[:2], (None, rows[1][1], None, None, None), document(400, "own words " + prose(1, 30), "s1")]):
        plain = spark.createDataFrame(given, SCHEMA)
        crowded = plain.withColumns({c: F.lit(7) for c in clashing})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some, more = stage(spark, plain, str(tmp_path)), stage(spark, crowded, str(tmp_path))
            assert more.columns == crowded.columns and in_order(more.select(*COLUMNS).collect()) == in_order(some.collect())
            assert all(r[c] == 7 for r in more.select(*[f"`{c}`" for c in clashing]).collect() for c in clashing)
        assert corpus_pipeline.STAGES[-1][1](spark, crowded, str(tmp_path)).isEmpty() == (not given)
