"""Licence scans: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser.

One automaton holds every phrase as words between single spaces; a text is brought to that form (A-Z lowered, everything else but
digits, letters and characters outside ASCII taken as a gap), so a match is a place where the phrase's words stand one after the
other. Where the tag phrase matches, the expression after the tag is parsed from the text as it stands: WITH binds tighter than AND,
AND tighter than OR. Its identifiers and exceptions are looked up in a catalogue, which gives each licence one label whether it was found by
tag or by notice; others are "unknown", and LicenseRef- identifiers "licenseref". Each task scans its own rows; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: More notice phrases; these add labels only.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Licence families: how freely each lets a text be used, its versions, and the forms its identifiers take ("{}" stands for the version).
FAMILIES = {
    "mit": (1.0, ("",), ("mit",)), "apache-2": (1.0, ("",), ("apache-2.0", "apache-2")), "apache": (1.0, ("1.0", "1.1"), ("apache-{}",)), "bsd": (1.0, ("1", "2", "3", "4"), ("bsd-{}-clause",)),
    "0bsd": (1.0, ("",), ("0bsd",)), "isc": (1.0, ("",), ("isc",)), "bsl-1.0": (1.0, ("",), ("bsl-1.0",)), "zlib": (1.0, ("",), ("zlib",)), "unlicense": (1.0, ("",), ("unlicense",)), "mit-0": (1.0, ("",), ("mit-0",)),
    "cc0": (1.0, ("1.0",), ("cc0-{}",)), "wtfpl": (1.0, ("",), ("wtfpl",)), "psf": (1.0, ("2.0",), ("psf-{}",)), "python": (1.0, ("2.0",), ("python-{}",)), "ncsa": (1.0, ("",), ("ncsa",)), "postgresql": (1.0, ("",), ("postgresql",)),
    "afl": (1.0, ("1.1", "1.2", "2.0", "2.1", "3.0"), ("afl-{}",)), "artistic": (0.9, ("1.0", "2.0"), ("artistic-{}",)), "x11": (1.0, ("",), ("x11",)), "ofl": (0.9, ("1.0", "1.1"), ("ofl-{}",)), "blueoak": (1.0, ("1.0.0",), ("blueoak-{}",)),
    "cc-by": (0.9, ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc-by-{}",)), "cc-by-sa": (0.6, ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc-by-sa-{}",)), "cc-by-nd": (0.2, ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc-by-nd-{}",)),
    "cc-by-nc": (0.2, ("",), ("cc-by-nc", "cc-by-nc-1.0", "cc-by-nc-2.0", "cc-by-nc-2.5", "cc-by-nc-3.0", "cc-by-nc-4.0")), "cc-by-nc-sa": (0.2, ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc-by-nc-sa-{}",)), "cc-by-nc-nd": (0.1, ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc-by-nc-nd-{}",)),
    "mpl": (0.7, ("1.0", "1.1", "2.0"), ("mpl-{}",)), "epl": (0.7, ("1.0", "2.0"), ("epl-{}",)), "cddl": (0.7, ("1.0", "1.1"), ("cddl-{}",)), "cpl": (0.7, ("1.0",), ("cpl-{}",)), "eupl": (0.6, ("1.0", "1.1", "1.2"), ("eupl-{}",)), "ms-pl": (0.9, ("",), ("ms-pl",)), "ms-rl": (0.7, ("",), ("ms-rl",)),
    "lgpl": (0.6, ("2.0", "2.1", "3.0"), ("lgpl-{}", "lgpl-{}+", "lgpl-{}-only", "lgpl-{}-or-later")), "gpl": (0.4, ("1.0", "2.0", "3.0"), ("gpl-{}", "gpl-{}+", "gpl-{}-only", "gpl-{}-or-later")), "agpl": (0.3, ("1.0", "3.0"), ("agpl-{}", "agpl-{}+", "agpl-{}-only", "agpl-{}-or-later")),
    "sspl": (0.2, ("1.0",), ("sspl-{}",)), "busl": (0.2, ("1.1",), ("busl-{}",)), "public-domain": (1.0, ("",), ("public-domain",)), "all-rights-reserved": (0.0, ("",), ("all-rights-reserved",)), "none": (0.0, ("",), ("none",)), "noassertion": (0.5, ("",), ("noassertion",)),
}
#: Identifier to label: the family's where it has no versions, else the identifier itself.
LABELS = {form.format(v): label if versions == ("",) else form.format(v) for label, (_, versions, forms) in FAMILIES.items() for v in versions for form in forms}
GRADES = {label: g for label, (g, _, _) in FAMILIES.items()} | {form.format(v): g for g, versions, forms in FAMILIES.values() for v in versions for form in forms}
#: What may stand after WITH.
EXCEPTIONS = {
    "autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "bootloader-exception", "classpath-exception-2.0", "ecos-exception-2.0", "font-exception-2.0", "freertos-exception-2.0", "gcc-exception-2.0",
    "gcc-exception-3.1", "libtool-exception", "linux-syscall-note", "llvm-exception", "openssl-exception", "openvpn-openssl-exception", "qt-gpl-exception-1.0", "qt-lgpl-exception-1.1", "u-boot-exception-2.0", "wxwindows-exception-3.1",
}
UNKNOWN, REFERENCE = "unknown", "licenseref"
UNKNOWN_GRADE = 0.5
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"

_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EXPRESSION = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|/|[a-z0-9][a-z0-9.+:_-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """The longest well-formed licence expression at the start, in postfix order; None if there is none.

    A closing bracket too many or a word that no operator joins ends the expression, so prose after a tag is left out. A slash between identifiers, as in
    old tags, is an OR. Takes time in proportion to the text.
    """
    out: list[str] = []
    best: tuple[int, list[str]] | None = None  # operands and operators so far, and the operators that are still to come
    stack: list[str] = []
    operand_next, at, brackets = True, 0, 0
    while m := _TOKEN.match(expression, re.compile(r"\s*").match(expression, at).end()):
        at, token = m.end(), m.group() if m.group() != "/" else "or"
        if operand_next:
            if token == "(":
                stack.append(token)
                brackets += 1
                continue
            if token == ")" or token in _BINDS:
                break
            out.append(token.rstrip(".") or token)
            operand_next = False
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
            brackets -= 1
        elif token in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            break
        if not operand_next and not brackets:  # at most one operator of each rank is on the stack
            best = len(out), stack[::-1]
    return None if best is None else out[: best[0]] + best[1]


def label_of(identifier: str) -> str:
    """The catalogue's label of an identifier (lower case); a later version of a licence, "+", is the licence itself."""
    if identifier.startswith(("licenseref-", "documentref-")):
        return REFERENCE
    return LABELS.get(identifier) or LABELS.get(identifier.removesuffix("+")) or UNKNOWN


def grade(label: str) -> float:
    return GRADES.get(label, UNKNOWN_GRADE)


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """The grade of an expression (OR: the better side, AND: the worse one, WITH: that of its licence) and its licences' labels."""
    stack: list[tuple[float, str]] = []
    labels: list[str] = []
    for x in postfix:
        if x not in _BINDS:
            stack.append((grade(label_of(x)), x))
            labels.append(label_of(x))
            continue
        (b, exception), (a, licence) = stack.pop(), stack.pop()
        if x == "with":
            labels.pop()
            labels[-1] += " with " + (exception if exception in EXCEPTIONS else UNKNOWN)
        stack.append(({"or": max, "and": min, "with": lambda a, b: a}[x](a, b), licence))
    return stack[0][0], set(labels)


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for kind, phrases in (("base", base), ("notice", notices), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                key = f" {phrase} "
                old = self.find.get(key, ())
                self.find.add_word(key, (*old, (kind, label, len(key))))
        self.find.make_automaton()

    def __call__(self, text: bytes) -> tuple:
        words = text.translate(_FORM).split()
        form = " " + b" ".join(words).decode("latin-1") + " "
        n_base, base, more, grades, parsed, starts, tagged = 0, set(), set(), [], [], [], False
        at = word = 0
        found = sorted((end - n + 1, kind, label) for end, hits in self.find.iter(form) for kind, label, n in hits)
        for start, kind, label in found:
            if kind == "base":
                word += form.count(" ", at, start)
                at = start
                n_base += 1
                starts.append(word)
                base.add(label)
            elif kind == "tag":
                tagged = True
                continue
            more.add(label)
            grades.append(grade(label))
        if tagged:
            for m in _EXPRESSION.finditer(text.lower()):
                if postfix := parse(m[1].decode("utf-8", "replace")):
                    g, labels = evaluate(postfix)
                    more |= labels
                    grades.append(g)
                    parsed.append(" ".join(postfix))
        return len(words), n_base, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(more)), min(grades, default=0.0), "; ".join(parsed)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions (postfix, "; " between).

    score is the grade of what the text says about its licence, 0 where it says nothing: several statements hold together, so the
    least free counts; within an expression OR takes the better side and AND the worse. Null text counts as empty (no words, no
    places, null first and last word, empty labels, score 0); a null id passes through; rows that repeat are scanned each on its own;
    an empty table gives an empty result; other columns are ignored.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(base, notices)
        for batch in batches:
            out = list(zip(*(scan(x.as_py()) for x in batch.column(1)), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
