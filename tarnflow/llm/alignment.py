"""Alignment of two tokenizers over the same bytes.

A text is encoded twice, and the byte offsets where tokens of both end cut its tokens
into groups. Groups are found by pointer jumping: every token points to the token that overlaps
it and reaches farthest right, pointers are doubled until none changes, and the token at
which a pointer then rests names the group. Tokens of one group are linked.

Both tokenizers always begin a token at a blank that follows a visible character, so a text
falls into chunks that can be encoded and aligned one by one. Each different chunk
is looked at once per batch, all of them in one numpy pass, and frequent ones are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import map_batches, materialize, table

#: Before these blanks a chunk begins: neither tokenizer has a token across such a place. (A blank alone is
#: no chunk: the second tokenizer puts none before an empty text.)
CUT = re.compile(r"(?<=[\w!-~])(?= (?s:.))")
VISIBLE = re.compile(r"[\w!-~]").match
#: Chunks that a worker remembers (speed only), and the longest that it does.
REMEMBERED = 150_000
LONGEST = 200
#: Pairs of ids (16 bytes each) that may be broadcast; more are joined.
BROADCAST_PAIRS = 1 << 19
#: Chunks that are encoded in one go.
TOGETHER = 1024
#: Links of a group from which its ids are counted before they are paired.
MANY_LINKS = 1 << 12
#: Ids of the second tokenizer in a pair's number ``first * PAIR + second``.
PAIR = 1 << 24


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def rest_of_pointers(start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """For each token of the first kind, then of the second: the token of the second kind at which its group ends.

    Tokens are given by byte offsets over one common stretch. A token points to the one of the
    other kind that holds its last byte, unless that ends no later than itself; of two that end
    together the second kind's is last, and points to itself.
    """
    n = len(start)
    up = np.searchsorted(other_start, end, "left") - 1 + n
    down = np.searchsorted(start, other_end, "left") - 1
    beyond = end[down] > other_end
    to = np.concatenate([up, np.where(beyond, down, np.arange(len(other_end)) + n)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to - n
        to = further


class Alignments:
    """Alignments of chunks, numbered from 0: sums, the groups as text, and linked id pairs with how often each occurs."""

    def __init__(self) -> None:
        self.sums = np.zeros((0, 4), np.int64)  # tokens of both, groups, links
        self.good = np.zeros(0, bool)
        self.texts: list[str] = []
        self.begin = np.zeros(1, np.int64)  # of a chunk's pairs
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def extend(self, more: Alignments) -> Alignments:
        out = Alignments()
        out.sums, out.good = np.concatenate([self.sums, more.sums]), np.concatenate([self.good, more.good])
        out.texts = self.texts + more.texts
        out.begin = np.concatenate([self.begin, more.begin[1:] + self.begin[-1]])
        out.pairs, out.times = np.concatenate([self.pairs, more.pairs]), np.concatenate([self.times, more.times])
        return out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sum of values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(keys) else values


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``begin[k], begin[k] + 1, ...``, ``count[k]`` of them, for all k in turn."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Aligner:
    """Two tokenizers and the chunks that they have aligned."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        self.first = tokenizers.Tokenizer.from_file(bytes_path)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        of = byte_of_char()
        named = {i: t for t, i in self.first.get_vocab(with_added_tokens=False).items()}
        pieces = [(self.second.id_to_piece(i), self.second.is_byte(i)) for i in range(self.second.get_piece_size())]
        self.bytes_of = [
            [bytes(of[c] for c in named[i]) if i in named else b"" for i in range(max(named, default=-1) + 1)],
            [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces],
        ]
        self.sizes = [np.array(list(map(len, b)), np.int64) for b in self.bytes_of]
        self.names = [np.array(list(map(str, range(len(b)))), object) for b in self.bytes_of]
        self.local = not any(re.search("[^▁]▁", p) for p, _ in pieces)
        self.known: dict[str, int] = {}
        self.held = Alignments()

    def tokens(self, kind: int, chunks: list[str], plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks in turn, how many each has, and whether they give the chunk back; if not, it has none.

        The first ``plain`` chunks end where a next one may begin, so many are encoded as one text.
        """
        table, size = self.bytes_of[kind], self.sizes[kind]
        texts, counts, at = [], [], 0
        while at < len(chunks):
            n = min(TOGETHER, plain - at) if at < plain else 1
            texts.append("".join(chunks[at : at + n]))
            counts.append(n)
            at += n
        ids, lengths, good, at = [], [], [], 0
        for text, n in zip(texts, counts, strict=True):
            if kind == 0:
                own = self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids
            else:
                own = self.second.encode([text[1:]], num_threads=1)[0]
            own = np.array(own, np.int64)
            if b"".join(map(table.__getitem__, own.tolist())) == text.encode():
                bounds = np.cumsum([len(c.encode()) for c in chunks[at : at + n]])
                lengths.append(np.diff(np.searchsorted(np.cumsum(size[own]), bounds, "right"), prepend=0))
                good.append(np.ones(n, bool))
                ids.append(own)
            elif n > 1:  # some of these chunks: each by itself
                for part, many, ok in (self.tokens(kind, [c], 0) for c in chunks[at : at + n]):
                    ids.append(part), lengths.append(many), good.append(ok)
            else:
                lengths.append(np.zeros(1, np.int64)), good.append(np.zeros(1, bool))
            at += n
        return tuple(np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((ids, np.int64), (lengths, np.int64), (good, bool)))

    def align(self, chunks: list[str], plain: int) -> Alignments:
        """Each begins with the blank that the second tokenizer puts before a text by itself; see :meth:`tokens`."""
        out = Alignments()
        (first, n_ids, ok), (second, n_others, also) = (self.tokens(kind, chunks, plain) for kind in range(2))
        out.good = ok & also
        first, second = first[np.repeat(out.good, n_ids)], second[np.repeat(out.good, n_others)]
        n_ids, n_others = n_ids * out.good, n_others * out.good
        end, other_end = np.cumsum(self.sizes[0][first]), np.cumsum(self.sizes[1][second])
        rest = rest_of_pointers(end - self.sizes[0][first], end, other_end - self.sizes[1][second], other_end)
        last, group = np.unique(rest, return_inverse=True)  # groups in order
        size, other_size = np.bincount(group[: len(first)], minlength=len(last)), np.bincount(group[len(first) :], minlength=len(last))
        chunk_of = np.repeat(np.arange(len(chunks)), n_others)[last] if len(last) else last
        n_groups = np.bincount(chunk_of, minlength=len(chunks))
        links = np.zeros(len(chunks), np.int64)
        np.add.at(links, chunk_of, size * other_size)
        out.sums = np.stack([n_ids, n_others, n_groups, links], 1)

        begin, other_begin = np.cumsum(size) - size, np.cumsum(other_size) - other_size
        names, other_names = self.names[0][first].tolist(), self.names[1][second].tolist()
        parts = [
            f"{','.join(names[i : i + n])}|{','.join(other_names[j : j + m])}"
            for i, n, j, m in zip(begin.tolist(), size.tolist(), other_begin.tolist(), other_size.tolist(), strict=True)
        ]
        bounds = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        out.texts = [";".join(parts[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]

        many = size * other_size > MANY_LINKS
        few = ~many[group[: len(first)]]
        own = group[: len(first)][few]
        a = np.repeat(first[few], other_size[own])
        b = second[spread(other_begin[own], other_size[own])]
        codes, owner, times = [a * PAIR + b], [np.repeat(chunk_of[own], other_size[own])], [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(many).tolist():
            (x, n), (y, m) = (np.unique(ids[k : k + c], return_counts=True) for ids, k, c in ((first, begin[g], size[g]), (second, other_begin[g], other_size[g])))
            codes.append((x[:, None] * PAIR + y).ravel())
            times.append((n[:, None] * m).ravel())
            owner.append(np.full(len(codes[-1]), chunk_of[g]))
        # A chunk's number fits above the pair's: at most some millions of chunks in a batch.
        code, who = np.concatenate(codes), np.concatenate(owner)
        order = np.lexsort((code, who))
        code, who, times = code[order], who[order], np.concatenate(times)[order]
        head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (who[1:] != who[:-1])])) if len(code) else np.zeros(0, np.int64)
        out.pairs, out.times = code[head], np.add.reduceat(times, head) if len(code) else times
        out.begin = np.concatenate([[0], np.cumsum(np.bincount(who[head], minlength=len(chunks)))])
        return out

    def documents(self, texts: list[str | None]) -> list[pa.Array]:
        """Columns of one batch: sums, digest of the groups, linked pairs and how often each occurs."""
        split = [(CUT.split(f" {t}") if self.local else [f" {t}"]) if t else [] for t in texts]
        known, held = self.known, len(self.known)
        new = list({c for chunks in split for c in chunks if c not in known})
        # A chunk can be followed by another if it ends as CUT asks; only the last of a text may not.
        new.sort(key=lambda c: not VISIBLE(c[-1]))
        found = self.held
        if new:
            found = found.extend(self.align(new, sum(bool(VISIBLE(c[-1])) for c in new)))
            known.update(zip(new, range(held, len(found.good)), strict=True))
        n = np.array(list(map(len, split)), np.int64)
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if len(known) <= REMEMBERED and max(map(len, new), default=0) <= LONGEST:
            self.held = found
        else:  # once full, what came first are mostly the frequent ones
            for c in new:
                del known[c]
        owner = np.repeat(np.arange(len(texts)), n)
        bad = np.bincount(owner, weights=~found.good[flat], minlength=len(texts)) > 0
        flat, owner, n = flat[~bad[owner]], owner[~bad[owner]], n * ~bad
        sums = np.stack([np.bincount(owner, weights=found.sums[flat, k], minlength=len(texts)) for k in range(4)]).astype(np.int64)
        groups, ends = list(map(found.texts.__getitem__, flat.tolist())), np.cumsum(n).tolist()
        digests = [hashlib.sha256(";".join(groups[end - k : end]).encode()).hexdigest() if k else "" for k, end in zip(n.tolist(), ends, strict=True)]
        width = max(1, len(found.good))
        key, often = summed(owner * width + flat, np.ones(len(flat), np.int64))
        row, chunk = key // width, key % width
        count = found.begin[chunk + 1] - found.begin[chunk]
        at = spread(found.begin[chunk], count)
        # Pairs under 2**41, so one number holds document and pair for batches of up to 2**22 rows.
        code, times = summed(np.repeat(row, count) * (1 << 41) + found.pairs[at], np.repeat(often, count) * found.times[at])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(code >> 41, minlength=len(texts)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (code & ((1 << 41) - 1), times)]
        return [*map(pa.array, sums), pa.array(digests, pa.string()), *lists]


@lru_cache(maxsize=1)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One per worker, so that what it remembers serves all its tasks."""
    return Aligner(bytes_path, pieces_path)


def aligned(documents: DataFrame, id_col: str, text_col: str, bytes_path: str, pieces_path: str) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` per row; ``row`` tells rows apart."""
    narrow = documents.select(F.monotonically_increasing_id().alias("row"), documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(bytes_path, pieces_path)
        for batch in batches:
            columns = both.documents(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], names=names)

    return map_batches(narrow, run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, docs, best``: in how many documents a pair is linked, and whether no pair of its first id is in more.

    Counted inside tasks before anything is dealt out; a first id has at most as many pairs as the second
    vocabulary has ids.
    """
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    of_first = Window.partitionBy(F.floor(F.col("pair") / PAIR))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(of_first))


def align_tokenizers(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_path: str | None = None, pieces_path: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """Align a byte-level and a piece vocabulary over all texts: a row per document, and the table of linked id pairs.

    Documents have ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; the links of a document are all
    pairs of a first and a second token of one group. ``n_best`` counts links whose pair is in as
    many documents as any pair of its first id, ``count_sum`` adds the documents of each link's pair.
    Pairs have ``first_id, second_id, docs, best``. Null and empty texts, and texts that one of the
    tokenizers does not give back byte for byte, have no tokens: zeros and an empty digest. Repeated rows each
    give a row and count as documents of their own, null ids stay null, other columns are ignored, no rows give no
    rows. Counts are joined to documents where these are, unless there are too many pairs to be sent
    to every task; then both are dealt by pair. The result is the same.
    """
    bytes_path, pieces_path = bytes_path or public_tokenizers.path("byte_bpe_50k.json"), pieces_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = materialize(aligned(documents, id_col, text_col, bytes_path, pieces_path), "aligned")
    counts = materialize(pair_counts(rows), "aligned-pairs")
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = rows.select(*own, F.inline_outer(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    few = counts.count() <= broadcast_pairs
    with_counts = links.join(F.broadcast(counts) if few else counts.hint("merge"), "pair", "left")
    total = {"n_best": F.sum(F.when(F.col("best"), F.col("times"))), "count_sum": F.sum(F.col("times") * F.col("docs"))}
    result = with_counts.groupBy(*own).agg(*[F.coalesce(f, F.lit(0)).cast("long").alias(name) for name, f in total.items()])
    pairs = counts.select(F.floor(F.col("pair") / PAIR).cast("int").alias("first_id"), (F.col("pair") % PAIR).cast("int").alias("second_id"), "docs", "best")
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs


def op13(spark, sf_dir):
    """Aligns the two vocabularies over all ``documents``; see :func:`align_tokenizers`."""
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
