"""Licence scan: Aho-Corasick over words, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnflow.llm.common import map_batches, table

#: Phrases that the base scan counts, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, matched like the base ones; they only add labels.
NOTICE_PHRASES = {
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words that open a licence expression ("SPDX-License-Identifier: ...").
TAG_WORDS = ("spdx", "license", "identifier")
#: First words of identifiers in expressions and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd",
    "isc": "isc", "epl": "epl", "bsl": "bsl", "cc": "cc", "unlicense": "unlicense", "zlib": "zlib", "0bsd": "bsd",
    "cc0": "cc0", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd",
    "cpl": "cpl", "eupl": "eupl", "ofl": "ofl", "wtfpl": "wtfpl", "python": "python", "psf": "python", "postgresql": "postgresql",
    "ncsa": "ncsa", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "osl": "osl", "afl": "afl", "ecl": "ecl", "blueoak": "blueoak", "odbl": "odbl", "mulanpsl": "mulanpsl", "upl": "upl",
}
#: Labels that allow use without copyleft or further conditions; others are judged false.
PERMISSIVE = frozenset(
    {"mit", "apache", "bsd", "isc", "bsl", "zlib", "unlicense", "cc-by", "cc0", "wtfpl", "python", "postgresql", "ncsa", "afl", "ecl", "blueoak", "mulanpsl", "upl", "ms-pl"}
)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Lower-cases A-Z and turns everything that is no word byte into a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard over identifiers, ``and/or/with`` and brackets; None if ill-formed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or operand_next:
                return None
            stack.pop()
        elif token in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def label_of(identifier: str) -> str | None:
    """The label of an identifier such as ``gpl-2.0-only``."""
    parts = identifier.rstrip("+").split("-")
    names = ("-".join(parts[:k]) for k in range(len(parts), 0, -1))
    return next((IDENTIFIERS[n] for n in names if n in IDENTIFIERS), None)


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """Labels an expression names, and whether an allowed choice satisfies it."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            label = label_of(token)
            stack.append(({label} if label else set(), label in allowed))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append((left[0] | right[0], left[1] or right[1]))
        elif token == "and":
            stack.append((left[0] | right[0], left[1] and right[1]))
        else:  # an exception adds permissions to the licence on its left
            stack.append(left)
    return stack[-1]


#: Shape of a licence or exception identifier in lower case, also of one that no list knows.
_IDENTIFIER = re.compile(r"(?:documentref-[a-z0-9.-]+:)?[a-z0-9][a-z0-9.-]*\+?")


#: Pieces of an expression: brackets, words, and the end of the line.
_PIECE = re.compile(r"\n|[()]|[^\s()]+")


def read_expression(text: str, start: int) -> list[str]:
    """Tokens of the expression on the rest of the line, up to the first that cannot belong to it."""
    tokens: list[str] = []
    operand_next, open_brackets = True, 0
    for found in _PIECE.finditer(text, start):
        raw = found[0].lower()
        if raw == "\n":
            break
        token = raw.strip("\"'`,;*/")
        token = token if token in ("(", ")") else token.rstrip(".")
        if token == ")" and not open_brackets:
            break
        known = token in PRECEDENCE or token in ("(", ")") or (operand_next and bool(token) and (label_of(token) or tokens[-1:] == ["with"] or _IDENTIFIER.fullmatch(token)))
        if not known or (token in PRECEDENCE and operand_next):
            break
        tokens.append(token)
        operand_next = token in PRECEDENCE or token == "("
        open_brackets += (token == "(") - (token == ")")
    while tokens and tokens[-1] in PRECEDENCE:
        tokens.pop()
    return tokens


@lru_cache(maxsize=4)
def automaton(extra: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """One automaton over base phrases, notice phrases and the tag; words are bracketed by spaces."""
    found = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("base", BASE_PHRASES.items()), ("notice", extra), ("tag", [(" ".join(TAG_WORDS), "")])):
        for phrase, label in phrases:
            key = f" {phrase} "
            entries.setdefault(key, []).append((kind, label, len(key)))
    for key, values in entries.items():
        found.add_word(key, tuple(values))
    found.make_automaton()
    return found


#: Lower-cases A-Z only, so that places in the result are places in the text.
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


@lru_cache(maxsize=1)
def tag_automaton() -> ahocorasick.Automaton:
    """The tag as it is written, for its places in a text."""
    found = ahocorasick.Automaton()
    found.add_word("spdx-license-identifier:", True)
    found.make_automaton()
    return found


def tag_positions(text: str) -> Iterator[int]:
    """Where expressions start: after each identifier tag."""
    for end, _ in tag_automaton().iter(text.translate(_LOWER)):
        yield end + 1


def scan(text: str, machine: ahocorasick.Automaton) -> tuple:
    """Counts, positions, labels and score of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace") if words else ""
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    miss = 1.0
    seen_at, seen_words, tagged = 0, 0, False
    for end, values in machine.iter(joined):
        for kind, label, length in values:
            if kind == "base":
                start = end - length + 1
                # Starts of matches do not fall by more than a phrase; count words from the last one on.
                if start >= seen_at:
                    seen_words += joined.count(" ", seen_at, start)
                else:
                    seen_words -= joined.count(" ", start, seen_at)
                seen_at = start
                n_base += 1
                first = seen_words if first is None else min(first, seen_words)
                last = seen_words if last is None else max(last, seen_words)
                base.add(label)
                miss *= 1.0 - 0.9
            elif kind == "notice":
                labels.add(label)
                miss *= 1.0 - 0.7
            else:
                tagged = True
    if tagged:
        for at in tag_positions(text):
            postfix = to_postfix(read_expression(text, at))
            if postfix:
                named, permissive = evaluate(postfix)
                labels |= named
                miss *= 1.0 - (0.99 if permissive else 0.95)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 - miss


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """Licence phrases and expressions of every text.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score`` per input row. Words are runs of ASCII letters, digits and
    anything beyond ASCII, after A-Z is lower-cased. ``n_base`` counts the places of
    base phrases; ``labels`` adds those of notice phrases and of expressions after
    an identifier tag, which a shunting-yard parser orders and evaluates. ``score``
    is a noisy-or of the evidence, 0 without any.

    Null or empty text: no words, counts 0, null positions, empty labels, score 0.
    Repeated rows each give a row, other columns are ignored, and no rows give no
    rows. One pass, no shuffle; memory follows the longest text.
    """
    narrow = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    extra = tuple((NOTICE_PHRASES if notices is None else notices).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(extra)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [scan(text.as_py() or "", machine) for text in batch.column("text")]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return map_batches(narrow, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8(spark, sf_dir):
    """Scans all ``documents``; see :func:`scan_licenses`."""
    return scan_licenses(table(spark, sf_dir, "documents"))
