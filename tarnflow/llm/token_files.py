"""Token ids in binary files: a static range asymmetric numeral system.

One table of symbol frequencies, counted over all documents, codes every block. A
block holds whole documents in ascending id order and is independent: it has its own
checksum and can be decoded anywhere. Inside a block the ids are dealt to
``LANES`` interleaved coder states that advance together as one numpy vector; the
states are saved at checkpoints, so decoding can also start at any of these.

Block layout (little-endian): header ``magic, version, lanes, checkpoint interval,
tokens, documents, words, crc32 of everything after the header``; tokens per document
(uint32); for every checkpoint the word offset (uint32) and the lane states (uint64);
then the emitted 32-bit words.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import map_batches, materialize, table

#: Frequencies sum to 2**PRECISION. A vocabulary must be smaller than that.
PRECISION = 20
LANES = 1024
#: Steps (of LANES ids) between two checkpoints.
INTERVAL = 128
#: A block closes with the document that brings it to so many ids.
BLOCK_IDS = 1 << 19
HEADER = struct.Struct("<4sHHIIIII")
MAGIC = b"TRNS"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64((1 << PRECISION) - 1)
_BITS = np.uint64(PRECISION)


def scale_counts(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to ``2**precision``; every id that occurs keeps at least 1."""
    total = int(counts.sum())
    size = 1 << precision
    if not total:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than the precision allows")
    scaled = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
    order = np.argsort(-scaled, kind="stable")
    over = int(scaled.sum()) - size
    if over <= 0:
        scaled[order[0]] -= over
    else:
        for k in order:  # the largest give, none below 1
            give = min(over, int(scaled[k]) - 1)
            scaled[k] -= give
            over -= give
            if not over:
                break
    return scaled.astype(np.uint32)


class Model:
    """Coding tables of one frequency table."""

    def __init__(self, freqs: np.ndarray) -> None:
        self.freqs = freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64)
        self.symbols = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Words and checkpoints (word offset, states) in decoding order."""
        steps = -(-len(ids) // LANES)
        states = np.full(LANES, _LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        emitted = 0
        for step in range(steps - 1, -1, -1):
            row = ids[step * LANES : (step + 1) * LANES]
            n = len(row)
            freq, x = self.freqs[row], states[:n]
            full = x >= (freq << np.uint64(63 - PRECISION))
            if full.any():
                words = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out.append(words[::-1])
                emitted += len(words)
                x = np.where(full, x >> _WORD, x)
            high = x // freq
            states[:n] = (high << _BITS) + (x - high * freq) + self.starts[row]
            if step % INTERVAL == 0:
                marks.append((emitted, states.copy()))
        words = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
        return words, [(emitted - at, s) for at, s in reversed(marks)]

    def decode(self, words: np.ndarray, states: np.ndarray, offset: int, n_ids: int) -> np.ndarray:
        """``n_ids`` ids from a checkpoint."""
        ids = np.empty(n_ids, np.uint32)
        states = states.copy()
        at = offset
        for begin in range(0, n_ids, LANES):
            n = min(LANES, n_ids - begin)
            x = states[:n]
            slot = x & _MASK
            row = self.symbols[slot]
            ids[begin : begin + n] = row
            x = self.freqs[row] * (x >> _BITS) + slot - self.starts[row]
            low = x < _LOW
            need = int(np.count_nonzero(low))
            if need:
                x[low] = (x[low] << _WORD) | words[at : at + need]
                at += need
            states[:n] = x
        return ids


def pack_block(model: Model, documents: list[np.ndarray]) -> bytes:
    """One block of documents as bytes."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    words, marks = model.encode(ids)
    body = b"".join(
        [
            np.array([len(d) for d in documents], "<u4").tobytes(),
            np.array([at for at, _ in marks], "<u4").tobytes(),
            b"".join(s.astype("<u8").tobytes() for _, s in marks),
            words.astype("<u4").tobytes(),
        ]
    )
    return HEADER.pack(MAGIC, 1, LANES, INTERVAL, len(ids), len(documents), len(words), zlib.crc32(body)) + body


def unpack_block(model: Model, block: bytes, first: int = 0, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and tokens per document of a block; ``first``/``count`` choose checkpoints to decode from."""
    magic, version, lanes, interval, n_ids, n_docs, n_words, check = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or version != 1 or lanes != LANES or zlib.crc32(body) != check:
        raise ValueError("damaged block")
    span = lanes * interval
    n_marks = -(-n_ids // span)
    sizes = np.frombuffer(body, "<u4", n_docs)
    offsets = np.frombuffer(body, "<u4", n_marks, 4 * n_docs)
    states = np.frombuffer(body, "<u8", n_marks * lanes, 4 * (n_docs + n_marks)).reshape(n_marks, lanes)
    words = np.frombuffer(body, "<u4", n_words, 4 * (n_docs + n_marks) + 8 * n_marks * lanes)
    last = n_marks if count is None else min(n_marks, first + count)
    parts = [model.decode(words, states[k], int(offsets[k]), min(span, n_ids - k * span)) for k in range(first, last)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), sizes


#: Distinct words whose ids a worker remembers; beyond it no more are added, which changes speed only.
REMEMBERED = 1_200_000
#: Pieces that together are the text: white space and word characters, or white space, ASCII punctuation
#: and the word characters after it ("'s" may not be cut).
PIECE = re.compile(r"[ \n\t\r]*(?:[^ \n\t\r!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+[^ \n\t\r!-/:-@\[-`{-~]*)|[ \n\t\r]+")
#: Characters with which the cuts would not be safe: white space beyond ASCII, controls, symbols beyond ASCII.
ODD = re.compile(r"[^\w\x20-\x7e\n\t\r]")
#: Stands between new pieces that are encoded together; it is odd, so no piece holds it.
SEPARATOR = "\x00"


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # special strings in a text are ordinary text
    return found


def load_splitter(path: str):
    """The same tokenizer with SEPARATOR as a token of its own, and the id of that."""
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(path)
    found.add_special_tokens([AddedToken(SEPARATOR, special=True, normalized=False)])
    return found, found.token_to_id(SEPARATOR)


class WordEncoder:
    """Whole texts to ids (as little-endian bytes), remembering the ids of words.

    No alternative of the pre-tokenizer's pattern joins a non-space with a space after
    it, or a letter or digit with punctuation after it, and none looks behind. So a
    text falls into pieces, and the ids of a text are the ids of these in a row. Only
    pieces not met before go through the tokenizer, all of a batch in one call with a
    separator between them that has an id of its own. Texts with characters for which
    this is not certain go through it whole.
    """

    def __init__(self, path: str, dtype: str = "<u2") -> None:
        self.tokenizer = load_tokenizer(path)
        self.splitter, self.between = load_splitter(path)
        self.dtype = np.dtype(dtype)
        self.known: dict[str, bytes] = {}

    def _encode_new(self, pieces: list[str]) -> Iterator[bytes]:
        ids = np.array(self.splitter.encode_batch_fast([SEPARATOR.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        packed, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        begin = 0
        for end in [*np.flatnonzero(ids == self.between).tolist(), len(ids)]:
            yield packed[size * begin : size * end]
            begin = end + 1

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        odd = [bool(ODD.search(t)) for t in texts]
        split = [[] if whole else PIECE.findall(t) for whole, t in zip(odd, texts, strict=True)]
        found = [list(map(known.get, pieces)) for pieces in split]
        new = list({p for pieces, ids in zip(split, found, strict=True) if None in ids for p, i in zip(pieces, ids, strict=True) if i is None})
        fresh: dict[str, bytes] = {}
        if new:
            fresh = dict(zip(new, self._encode_new(new), strict=True))
            if len(known) + len(fresh) <= REMEMBERED:  # once full, what came first are mostly the frequent words
                known.update(fresh)
        return [
            self._encode_whole(text) if whole else b"".join(ids if None not in ids else [fresh[p] if i is None else i for p, i in zip(pieces, ids, strict=True)])
            for whole, text, pieces, ids in zip(odd, texts, split, found, strict=True)
        ]


@lru_cache(maxsize=1)
def word_encoder(path: str, dtype: str) -> WordEncoder:
    """One encoder per worker, so that its memory serves all its tasks."""
    return WordEncoder(path, dtype)


def tokenize_sorted(documents: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``part, seq, doc_id, ids`` with ids as bytes, documents in ascending order over parts.

    Range partitioning is on the raw rows: its sample reads ids of documents, no tokens.
    There are as many ranges as the input has splits, so their size does not grow with it.
    """
    narrow = documents.select(documents[id_col].alias("doc_id"), F.coalesce(documents[text_col], F.lit("")).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    width = 2 if max(load_tokenizer(tokenizer_path).get_vocab_size(), end_id) <= 1 << 16 else 4
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), narrow.rdd.getNumPartitions())
    ordered = narrow.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = word_encoder(tokenizer_path, f"<u{width}")
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                n = piece.num_rows
                columns = [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(seq, seq + n, dtype=np.int64)),
                    piece.column("doc_id"),
                    pa.array(np.full(n, width, np.int32)),
                    pa.array([ids + end for ids in encoder.encode(piece.column("text").to_pylist())], pa.binary()),
                ]
                seq += n
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "width", "ids"])

    return map_batches(ordered, run, f"part int, seq long, doc_id {kind}, width int, ids binary")


def _ids(width: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{width}").astype(np.uint32)


def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How often each id occurs in batches of ``width, ids``: all documents of a batch are counted at once, not a table for each."""
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            more = np.bincount(_ids(width, b"".join(batch.column("ids").filter(pa.array(widths == width)).to_pylist())))
            if len(more) > len(counts):
                counts = np.pad(counts, (0, len(more) - len(counts)))
            counts[: len(more)] += more
    return counts


def count_ids(tokens: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs, counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tally(batches)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    return map_batches(tokens.select("width", "ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(
    documents: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, np.ndarray]:
    """Tokenize all texts and write them as coded blocks; returns the written table and the frequencies.

    The table (Parquet in the shared folder, one file per range of ids) has a row per
    block: ``part, block, doc_ids, n_ids, payload``. Frequencies are counted over all
    documents; their table has an entry per id of the vocabulary, so it may be sent to
    every task. Null text counts as empty and still gets its end id; repeated ids
    are written once per row, in the order of their texts; no rows give no block.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    # Written once: the frequencies need all of it before the first block can be coded.
    tokens = materialize(tokenize_sorted(documents, path, end_id, id_col, text_col), "tokens")
    counted = count_ids(tokens).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    freqs = scale_counts(counts)
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(freqs)
        held: list[np.ndarray] = []
        ids: list = []
        part, first, size = 0, 0, 0

        def close() -> pa.RecordBatch:
            block = pack_block(model, held)
            columns = [
                pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(id_type)),
                pa.array([size], pa.int64()), pa.array([block], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_ids", "n_ids", "payload"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            columns = [batch.column(n) for n in ("part", "seq", "doc_id", "width", "ids")]
            for p, seq, doc, width, packed in zip(*columns, strict=True):
                if held and (size >= BLOCK_IDS or p.as_py() != part):
                    yield close()
                    held, ids, size = [], [], 0
                if not held:
                    part, first = p.as_py(), seq.as_py()
                held.append(_ids(width.as_py(), packed.as_py()))
                ids.append(doc.as_py())
                size += len(held[-1])
        if held:
            yield close()

    schema = f"part int, block long, doc_ids array<{kind}>, n_ids long, payload binary"
    return materialize(map_batches(tokens, run, schema), "token-files", "none"), freqs


def read_files(files: DataFrame, freqs: np.ndarray) -> DataFrame:
    """Read blocks back: ``doc_id, start, n_tokens, ids_crc32`` per document.

    ``start`` is the number of ids in all documents before it: a running sum over
    blocks inside parts, another over the parts, and the place inside the block.
    """
    kind = dict(files.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(freqs)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes = unpack_block(model, batch.column("payload")[row].as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                data = ids.astype("<u4").tobytes()
                checks = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                columns = [
                    pa.array(np.full(n, batch.column("part")[row].as_py(), np.int32)),
                    pa.array(np.full(n, batch.column("block")[row].as_py(), np.int64)),
                    batch.column("doc_ids")[row].values,
                    pa.array(ends - sizes),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(checks, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    decoded = map_batches(files.select("part", "block", "doc_ids", "payload"), run, f"part int, block long, doc_id {kind}, inside long, n_tokens long, ids_crc32 long"
    )
    sizes = files.select("part", "block", "n_ids")
    before_block = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(before_block), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("part_start"))
    starts = blocks.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    return decoded.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6(spark, sf_dir):
    """Writes the token ids of all ``documents`` and reads them back; see :func:`write_files`."""
    files, freqs = write_files(table(spark, sf_dir, "documents"))
    return read_files(files, freqs)
