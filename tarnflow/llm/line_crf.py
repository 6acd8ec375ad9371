"""Quality rules by line labels: a linear-chain conditional random field marks content and boilerplate.

A text is a sequence of lines. What a line is made of (length, symbols, capitals, figures,
how it ends, repetitions) falls into bins, one weight each; the field adds weights for
neighbouring labels. It is trained in numpy on a bounded sample of labelled documents, whose lines all carry the
label of their document, and Viterbi decoding labels the lines of every text. The share of words in content
lines decides whether a document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import map_batches, table

#: Labelled documents of each kind in the training sample, and the longest text among them.
SAMPLE_EACH = 500
SAMPLE_CHARS = 20_000
#: Lines of a training sequence; longer texts give several.
SEQUENCE = 64
STEPS = 150
RATE = 0.1
RIDGE = 1e-3
#: Words in content lines, of all words, from which a document is kept.
CONTENT_SHARE = 0.5
#: Base rules.
LEAST_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20

SEPARATOR, LOWER, UPPER, DIGIT, SYMBOL, STOP, OTHER, LEAD, CONTINUED = range(9)
_CLASSES = bytes(
    SEPARATOR if b == 0x20 or 0x09 <= b <= 0x0D
    else CONTINUED if 0x80 <= b <= 0xBF
    else LEAD if b >= 0xC0
    else LOWER if 0x61 <= b <= 0x7A
    else UPPER if 0x41 <= b <= 0x5A
    else DIGIT if 0x30 <= b <= 0x39
    else SYMBOL if chr(b) in "#*$%&|<>"
    else STOP if chr(b) in ".!?:;"
    else OTHER
    for b in range(256)
)
#: Upper bounds of the bins of each measure of a line.
BINS = {
    "words": (1.5, 2.5, 5.5, 10.5, 20.5, 50.5),
    "word_length": (2.5, 4, 5.5, 7, 9, 12),
    "symbols": (1e-9, 0.02, 0.05, 0.1, 0.2),
    "capitals": (1e-9, 0.03, 0.1, 0.3, 0.6),
    "digits": (1e-9, 0.02, 0.05, 0.2, 0.5),
    "others": (1e-9, 0.02, 0.05, 0.1, 0.2),
    "stops": (1e-9, 0.03, 0.1, 0.3, 0.7),
    "repeats": (1e-9, 0.1, 0.3, 0.6, 0.9),
    "echoes": (1e-9, 0.05, 0.2, 0.5),
    "ends": (0.5,),
    "begins": (0.5, 1.5),
    "duplicate": (0.5,),
    "first": (0.5,),
}
_OFFSETS = dict(zip(BINS, np.cumsum([0, *[len(b) + 1 for b in BINS.values()]]).tolist(), strict=False))
N_WEIGHTS = sum(len(b) + 1 for b in BINS.values())


@dataclass
class Texts:
    """What is measured of several texts: base figures, and the lines that hold a word."""

    base: np.ndarray  # (texts, 5): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    begin: np.ndarray  # first line of each text, and the end
    words: np.ndarray  # of each line
    bins: np.ndarray  # (lines, measures): which weights a line has


def repeated(words: list[bytes]) -> np.ndarray:
    """Which words of a text lie in a window of WINDOW words that it has twice or more."""
    marks = np.zeros(len(words), bool)
    n = len(words) - WINDOW + 1
    if n < 2:
        return marks
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        total = (total ^ hashes[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    order = np.argsort(total)
    same = total[order[1:]] == total[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for k in range(WINDOW):
        marks[k : n + k] |= twice
    return marks


def measure(texts: list[bytes]) -> Texts:
    """Base figures of texts and the bins of their lines.

    Word repetitions are found by 64-bit hashes; all else is exact counting over bytes.
    """
    base = np.zeros((len(texts), 5), np.int64)
    repeats, echoes, duplicate, n_lines = [], [], [], []
    for k, text in enumerate(texts):
        words = text.split()  # bytes split at exactly the separators asked for
        marks = repeated(words)
        repeats.append(marks)
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        echoes.append(np.concatenate([[False], hashes[1:] == hashes[:-1]])[: len(words)])
        seen: set[bytes] = set()
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        for line in lines:
            duplicate.append(line in seen)
            seen.add(line)
        n_lines.append(len(lines))
        base[k, 0], base[k, 3], base[k, 4] = len(words), len(lines) - len(seen), marks.sum()
    begin = np.concatenate([[0], np.cumsum(n_lines)]).astype(np.int64)

    joined = b"\n".join(texts) + b"\n"
    data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_CLASSES), np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    line_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    counts = np.bincount(line_of * 9 + kind, minlength=9 * len(ends)).reshape(-1, 9)
    text_of = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
    visible = counts.sum(1) - counts[:, SEPARATOR] - counts[:, CONTINUED]  # code points in words
    base[:, 1] = np.bincount(text_of, weights=visible, minlength=len(texts))
    base[:, 2] = np.bincount(text_of, weights=counts[:, SYMBOL], minlength=len(texts))

    inside = kind != SEPARATOR
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    word_line = line_of[starts]
    used = np.flatnonzero(visible)
    words = np.bincount(word_line, minlength=len(ends))[used]

    def per_line(flags: list[np.ndarray]) -> np.ndarray:
        return np.bincount(word_line, weights=np.concatenate([np.zeros(0), *flags]), minlength=len(ends))[used] / np.maximum(1, words)

    counts, size = counts[used], visible[used].astype(float)
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))  # last byte of each word
    last = np.zeros(len(ends), np.int64)
    last[line_of[stops]] = kind[stops]
    first = np.zeros(len(ends), np.int64)
    first[word_line[::-1]] = kind[starts[::-1]]
    letters = counts[:, LOWER] + counts[:, UPPER]
    place = np.zeros(len(used))
    place[begin[:-1][np.diff(begin) > 0]] = 1
    measures = {
        "words": words,
        "word_length": size / np.maximum(1, words),
        "symbols": counts[:, SYMBOL] / size,
        "capitals": counts[:, UPPER] / np.maximum(1, letters),
        "digits": counts[:, DIGIT] / size,
        "others": counts[:, OTHER] / size,
        "stops": counts[:, STOP] / np.maximum(1, words),
        "repeats": per_line(repeats),
        "echoes": per_line(echoes),
        "ends": last[used] == STOP,
        "begins": np.where(first[used] == UPPER, 0, np.where((first[used] == LOWER) | (first[used] == LEAD), 1, 2)),
        "duplicate": np.array(duplicate, float),
        "first": place,
    }
    bins = np.stack([np.searchsorted(np.array(bounds), measures[name]) + _OFFSETS[name] for name, bounds in BINS.items()], 1)
    return Texts(base, begin, words, bins)


@dataclass
class Field:
    """Weights of boilerplate against content for each bin, of neighbouring labels, and of the first label."""

    weights: np.ndarray  # (N_WEIGHTS,)
    moves: np.ndarray  # (2, 2)
    start: np.ndarray  # (2,)


def _sums(scores: np.ndarray, field: Field, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (B, T, 2) of labels and (B, 2, 2) of moves, and the log of the sum over all labellings."""
    batch, steps = scores.shape
    unary = np.stack([np.zeros_like(scores), scores], 2)
    ahead, behind = np.empty_like(unary), np.zeros_like(unary)
    ahead[:, 0] = unary[:, 0] + field.start
    for t in range(1, steps):
        step = np.logaddexp(ahead[:, t - 1, :1] + field.moves[0], ahead[:, t - 1, 1:] + field.moves[1]) + unary[:, t]
        ahead[:, t] = np.where((t < length)[:, None], step, ahead[:, t - 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    moved = np.zeros((batch, 2, 2))
    for t in range(steps - 2, -1, -1):
        onward = (behind[:, t + 1] + unary[:, t + 1])[:, None, :] + field.moves[None]
        inside = t + 1 < length
        moved += np.where(inside[:, None, None], np.exp(ahead[:, t, :, None] + onward - total[:, None, None]), 0)
        behind[:, t] = np.where(inside[:, None], np.logaddexp(onward[:, :, 0], onward[:, :, 1]), 0)
    labels = np.exp(ahead + behind - total[:, None, None]) * (np.arange(steps)[None] < length[:, None])[:, :, None]
    return labels, moved, total


def train_field(texts: list[bytes], bad: list[bool], steps: int = STEPS) -> Field | None:
    """Maximise the likelihood of the labels by Adam; None without lines of both kinds."""
    found = measure(texts)
    label = np.repeat(np.array(bad, np.int64), np.diff(found.begin))
    if len(np.unique(label)) < 2:
        return None
    rows, length, truth = [], [], []
    for begin, end in zip(found.begin.tolist(), found.begin[1:].tolist(), strict=False):
        for k in range(begin, end, SEQUENCE):
            rows.append(np.arange(k, k + SEQUENCE).clip(max=end - 1))
            length.append(min(SEQUENCE, end - k))
    rows, length = np.stack(rows), np.array(length)
    real = np.arange(SEQUENCE)[None] < length[:, None]
    truth = label[rows]
    seen = np.bincount(found.bins[rows[real]].ravel(), weights=np.repeat(truth[real], len(BINS)), minlength=N_WEIGHTS)
    inner = real[:, 1:]
    moves = np.bincount((2 * truth[:, :-1] + truth[:, 1:])[inner], minlength=4).reshape(2, 2)
    start = np.bincount(truth[:, 0], minlength=2)
    field = Field(np.zeros(N_WEIGHTS), np.zeros((2, 2)), np.zeros(2))
    parts = [field.weights, field.moves, field.start]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        labels, moved, _ = _sums(field.weights[found.bins[rows]].sum(2), field, length)
        expected = np.bincount(found.bins[rows[real]].ravel(), weights=np.repeat(labels[:, :, 1][real], len(BINS)), minlength=N_WEIGHTS)
        gradients = [seen - expected, moves - moved.sum(0), start - labels[:, 0].sum(0)]
        for part, gradient, m, v in zip(parts, gradients, first, second, strict=True):
            gradient = gradient / len(label) - RIDGE * part
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            part += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def decode(field: Field, scores: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The best labels (1: boilerplate) of lines, of which each text has a stretch; all texts advance together."""
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    size, at = size[order], begin[:-1][order]
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts longer than t lines
    best = np.zeros((active[0], 2)) + field.start
    best[:, 1] += scores[at[: active[0]]]
    back: list[np.ndarray] = []
    for t in range(1, len(active)):
        paths = best[: active[t], :, None] + field.moves[None]
        from_bad = paths[:, 1] > paths[:, 0]
        back.append(from_bad)
        best[: active[t]] = np.where(from_bad, paths[:, 1], paths[:, 0])
        best[: active[t], 1] += scores[at[: active[t]] + t]
    now = (best[:, 1] > best[:, 0]).astype(np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        labels[at[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return labels


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, each: int) -> tuple[list[bytes], list[bool]]:
    """Texts and whether they are bad: at most ``2 * each`` labels, chosen by a hash of the id, and their documents.

    The chosen ids are few by construction, so they go to the documents and not these to them. Of
    rows that share an id all count, up to twice as many rows as labels.
    """
    keyed = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    rank = F.xxhash64("id", F.lit(5))
    chosen = [keyed.where(F.col("label") == k).orderBy(rank, "id").limit(each) for k in (0, 1)]
    texts = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").orderBy(F.xxhash64("id", "text"), "id", "text", "label").limit(4 * each).collect()
    return [r["text"].encode() for r in rows], [r["label"] == 0 for r in rows]


def label_documents(documents: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE, with_lines: bool = False) -> DataFrame:
    """Base figures, base verdict and verdict of every text.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share`` per row,
    and with ``with_lines`` also ``lines``, an array of ``line, content`` of the lines that hold a word. A
    document is kept unless it fails the base rules or too few of its words are in content lines. Null text
    counts as empty and is not kept; without a field all lines are content. Repeated rows each
    give a row, null ids stay, other columns are ignored, no rows give no rows.
    """
    narrow = documents.select(documents[id_col].alias("doc_id"), F.coalesce(documents[text_col], F.lit("")).cast("binary").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, content_share double"
    if with_lines:
        schema += ", lines array<struct<line: string, content: boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = measure(texts)
            n_words, n_repeat = found.base[:, 0], found.base[:, 4]
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
            bad = decode(field, field.weights[found.bins].sum(1), found.begin) if field else np.zeros(len(found.words), np.int64)
            owner = np.repeat(np.arange(len(texts)), np.diff(found.begin))
            content = np.bincount(owner, weights=found.words * (1 - bad), minlength=len(texts)) / np.maximum(1, n_words)
            columns = [batch.column("doc_id"), *map(pa.array, np.ascontiguousarray(found.base.T)), pa.array(failed), pa.array(~failed & (content >= share)), pa.array(content)]
            if with_lines:
                lines = [x.decode("utf-8", "replace") for t in texts for x in t.split(b"\n") if x and not x.isspace()]
                pairs = pa.StructArray.from_arrays([pa.array(lines, pa.string()), pa.array(bad == 0, pa.bool_())], ["line", "content"])
                columns.append(pa.ListArray.from_arrays(found.begin.astype(np.int32), pairs))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept", "content_share", *["lines"] * with_lines])

    return map_batches(narrow, run, schema)


def apply_rules(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_each: int = SAMPLE_EACH, with_lines: bool = False
) -> DataFrame:
    """Train on a sample of the documents that ``labels`` names (1: good, 0: bad), then label all; see :func:`label_documents`."""
    texts, bad = labelled_sample(documents, labels, id_col, text_col, label_col, sample_each)
    return label_documents(documents, train_field(texts, bad) if texts else None, id_col, text_col, with_lines=with_lines)


def op11(spark, sf_dir):
    """Applies base rules and line labels to all ``documents``; see :func:`apply_rules`."""
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
