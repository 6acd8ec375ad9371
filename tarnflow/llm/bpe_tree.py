"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are short. Parts are encoded on their own and
neighbours are joined on the way up: the join of ``a`` and ``b`` re-encodes a
window around the seam and keeps all tokens outside it.

Why the kept tokens are right: the split pattern has no alternative that
matches a non-space followed by a space, and no look-behind. A position between
a non-space and a space is therefore a piece boundary whatever surrounds it, and
pieces on either side do not depend on the other side. A window that ends at
such cuts on both sides settles the seam; it grows, doubling, until it does or
until it covers a whole part. Ids and counts form a monoid under this join
(the empty text is its unit), so any bracketing gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tarnflow.llm.common import map_batches, table

#: Characters of a part that is encoded without further halving.
LEAF_CHARS = 256
#: Characters of the first window tried on each side of a seam.
FIRST_WINDOW = 32
#: Ids decoded as one leaf of the decoding tree.
LEAF_IDS = 256
#: A non-space before a space. Python's \\s holds all that the pattern calls space, so this never errs.
CUT = re.compile(r"\S(?=[ \n\t\r])")


@lru_cache(maxsize=2)
def load_encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once per worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def last_cut(text: str) -> int | None:
    """The last position between a non-space and a space."""
    at = None
    for found in CUT.finditer(text):
        at = found.end()
    return at


def first_cut(text: str) -> int | None:
    """The first position between a non-space and a space."""
    found = CUT.search(text)
    return found.end() if found else None


def encode_leaf(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    return encoding.encode_to_numpy(text, disallowed_special=())


def join_ids(encoding: tiktoken.Encoding, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
    """Ids of ``left + right`` from the ids of both."""
    if not left or not right:
        return left_ids if left else right_ids
    size, start = FIRST_WINDOW, 0
    while size < 2 * len(left):
        base = max(0, len(left) - size)
        cut = last_cut(left[base:])
        if cut is not None:
            start = base + cut
            break
        size *= 2
    size, end = FIRST_WINDOW, len(right)
    while size < 2 * len(right):
        cut = first_cut(right[:size])
        if cut is not None:
            end = cut
            break
        size *= 2
    dropped = len(encode_leaf(encoding, left[start:])) if start else len(left_ids)
    skipped = len(encode_leaf(encoding, right[:end])) if end < len(right) else len(right_ids)
    seam = encode_leaf(encoding, left[start:] + right[:end])
    return np.concatenate([left_ids[: len(left_ids) - dropped], seam, right_ids[skipped:]])


def encode_tree(encoding: tiktoken.Encoding, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
    """Ids of a text by halving; equal to encoding it in one go."""
    if len(text) <= leaf_chars:
        return encode_leaf(encoding, text)
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join_ids(encoding, left, encode_tree(encoding, left, leaf_chars), right, encode_tree(encoding, right, leaf_chars))


def decode_tree(encoding: tiktoken.Encoding, ids: np.ndarray, leaf_ids: int = LEAF_IDS) -> bytes:
    """Bytes of ids: concatenation up the tree."""
    if len(ids) <= leaf_ids:
        return encoding.decode_bytes(ids.tolist())
    half = len(ids) // 2
    return decode_tree(encoding, ids[:half], leaf_ids) + decode_tree(encoding, ids[half:], leaf_ids)


def encode_documents(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    pattern: str | None = None,
    with_payload: bool = False,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """Encode every text, decode the ids again, and digest both.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` per input row, and
    with ``with_payload`` also ``ids`` (array of ints) and ``decoded`` (the text).
    Null text counts as empty: no ids, digests of nothing. Repeated rows each give a
    row, a null id stays null, other columns are ignored, no rows give no
    rows. Work is row by row, without a shuffle; memory follows the longest text.
    """
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    narrow = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_payload:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for batch in batches:
            counts, id_digests, digests, all_ids, texts = [], [], [], [], []
            for text in batch.column("text"):
                ids = encode_tree(encoding, text.as_py() or "", leaf_chars)
                decoded = decode_tree(encoding, ids)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                digests.append(hashlib.sha256(decoded).hexdigest())
                if with_payload:
                    all_ids.append(ids.astype(np.int32))
                    texts.append(decoded.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_payload:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(narrow, run, schema)


def op3(spark, sf_dir):
    """Encodes and decodes all ``documents``; see :func:`encode_documents`."""
    return encode_documents(table(spark, sf_dir, "documents"))
