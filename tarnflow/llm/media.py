"""Media columns: interleaved sequences of text and media references, resolved by digest.

HTML is read into an ordered array of structs, each a text or a reference to
a payload by its digest. Payloads live in a table of their own; a join on the
digest brings what is known of a payload back to the reference, whose position
and caption never leave it, so sequences can be put together again in order.

Payloads are stored as 8-bit mono PCM (RIFF/WAVE): one byte, one sample.
"""

from __future__ import annotations

import hashlib
import html as html_text
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import map_batches, materialize, table
from tarnflow.llm.html_tokens import tokens

#: Payloads are padded with zero bytes to a positive multiple of this.
BLOCK = 64
SAMPLE_RATE = 8000
#: Fixed layout: RIFF header, 16-byte PCM format chunk, data chunk header.
WAVE_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"
RAW = frozenset({"script", "style"})
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements that hold text within a line; every other tag ends the text before it.
INLINE = frozenset("a abbr b bdi bdo cite code em i kbd mark q s samp small span strong sub sup time u var".split())
MEDIA = frozenset({"img", "audio", "video", "source", "embed"})
SCHEME = "sha256:"


def to_wave(payload: bytes) -> bytes:
    """Wrap bytes as 8-bit PCM samples."""
    n = len(payload)
    head = WAVE_HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n)
    return head + payload


def from_wave(stored: bytes) -> bytes:
    """The samples of a stored form; raises ValueError if it is not one of ours."""
    fields = WAVE_HEADER.unpack_from(stored)
    payload = stored[WAVE_HEADER.size :]
    if fields[0] != b"RIFF" or fields[10] != 8 or fields[12] != len(payload):
        raise ValueError("not an 8-bit PCM payload")
    return payload


def describe(payload: bytes) -> str:
    """Signal features of the samples: mean, root mean square around the middle, zero crossings, entropy."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    levels = np.arange(256)
    n = len(samples)
    mean = float(counts @ levels) / n
    rms = float(np.sqrt(counts @ (levels - 128.0) ** 2 / n))
    loud = samples >= 128
    crossings = int(np.count_nonzero(loud[1:] != loud[:-1]))
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return f"mean={mean:.6f};rms={rms:.6f};crossings={crossings};entropy={entropy:.6f}"


def parse_sequence(page: str) -> list[dict]:
    """Texts and media references of a page, in order."""
    items: list[dict] = []
    text: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            items.append({"pos": len(items), "kind": "text", "text": joined, "digest": None, "caption": None})

    for words, tag, end, written in tokens(page, RAW):
        if words is not None:
            text.append(html_text.unescape(words))
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in MEDIA and not end:
            attributes = {a[1].lower(): html_text.unescape(next((v for v in a.groups()[1:] if v is not None), "")) for a in _ATTRIBUTE.finditer(written)}
            source = attributes.get("src", "")
            if source:
                digest = source.removeprefix(SCHEME) if source.startswith(SCHEME) else None
                items.append({"pos": len(items), "kind": "media", "text": None if digest else source, "digest": digest, "caption": attributes.get("alt", attributes.get("title"))})
    flush()
    return items


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Read HTML into ``id_col, sequence`` (array of ordered text and media structs).

    Null or empty HTML gives an empty sequence; repeated rows each give a row; other
    columns are ignored.
    """
    narrow = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html"))
    kind = dict(narrow.dtypes)["id"]
    item = pa.struct([("pos", pa.int32()), *[(n, pa.string()) for n in ("kind", "text", "digest", "caption")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_sequence(h.as_py() or "") for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(item))], names=["id", "sequence"])

    return map_batches(narrow, run, f"id {kind}, sequence array<{ITEM}>").withColumnRenamed("id", id_col)


def store_payloads(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a padded payload in stored form: ``doc_id, n_bytes, digest, media``.

    The bytes are written to a table in the shared folder and read from there by all
    that follows. Null text counts as empty: one block of zeros.
    """
    narrow = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # small slices bound what a batch holds twice
                part = batch.slice(k, 256)
                sizes, digests, media = [], [], []
                for text in part.column("text"):
                    raw = (text.as_py() or "").encode("utf-8")
                    payload = raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))
                    sizes.append(len(raw))
                    digests.append(hashlib.sha256(payload).hexdigest())
                    media.append(to_wave(payload))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "digest", "media"])

    return materialize(map_batches(narrow, run, f"doc_id {kind}, n_bytes long, digest string, media binary"), "media-store")


def read_payloads(stored: DataFrame) -> DataFrame:
    """Read stored bytes back and describe them, one row per digest.

    ``digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature``. Copies of a payload are read wherever they lie and reduced to one row by
    a partial aggregation, so only digests and figures are shuffled, never payloads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest"), batch.column("media"), strict=True):
                form = media.as_py()
                payload = from_wave(form)
                rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(form), hashlib.sha256(form).hexdigest(), describe(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    described = map_batches(stored.select("digest", "media"), run, schema)
    figures = [c for c in described.columns if c != "digest"]
    # All copies of a digest have the same figures; max of a struct is a plain hash or sort aggregate.
    distinct = described.groupBy("digest").agg(F.max(F.struct(*figures)).alias("of"))
    # Written, so that both sides of the join are dealt afresh and Spark may split a hot digest.
    return materialize(distinct.select("digest", "of.*"), "media-figures")


def resolve(sequences: DataFrame, id_col: str, figures: DataFrame) -> DataFrame:
    """Join every media reference with what is known of its payload.

    One row per item, ``id_col, pos, kind, text, digest, caption`` and the
    columns of ``figures`` (null for texts and for references without a payload). The join
    is a plain equi-join on the digest: a hot digest is split by adaptive execution.
    """
    items = sequences.select(id_col, F.explode("sequence").alias("item")).select(id_col, "item.*")
    return items.join(figures, "digest", "left")


def reassemble(resolved: DataFrame, id_col: str) -> DataFrame:
    """Put resolved items back into one ordered array per document (``id_col, sequence``)."""
    columns = [c for c in resolved.columns if c not in (id_col, "pos")]
    packed = resolved.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("sequence"))
    return packed


def page_of(text: Column) -> Column:
    """A text as a page: its paragraphs as blocks, after the first of them the reference to its payload."""
    content = F.coalesce(text, F.lit(""))
    n_bytes = F.octet_length(content)
    short = F.pmod(-n_bytes, F.lit(BLOCK)) + F.when(n_bytes == 0, BLOCK).otherwise(0)
    digest = F.sha2(F.concat(F.encode(content, "utf-8"), F.unhex(F.repeat(F.lit("00"), short))), 256)
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest, F.lit('" alt="'), n_bytes.cast("string"), F.lit('"></figure>'))
    shown = F.replace(F.replace(F.replace(content, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # The first mark is a paragraph's end with the figure behind it, later ones are ends alone.
    first = F.regexp_instr(shown, F.lit("\n\n"))
    cut = F.when(first > 0, first - 1).otherwise(F.char_length(shown)).cast("int")
    rest = F.replace(F.substring(shown, cut + 1, F.char_length(shown)), F.lit("\n\n"), F.lit("</p><p>"))
    return F.concat(F.lit("<article><p>"), F.substring(shown, F.lit(1), cut), F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def op10(spark, sf_dir):
    """Stores the payloads of all ``documents`` and reads them back through media references.

    Every document becomes a page of its own paragraphs, with a reference to its payload
    after the first and its number of bytes as caption. Pages are parsed into sequences,
    references are resolved by digest, and the figures returned with ``media_pos``, the
    reference's place, and ``n_texts``, the number of texts around it.
    Null text is stored as empty; repeated documents give a row each.
    """
    documents = table(spark, sf_dir, "documents")
    pages = documents.select("doc_id", page_of(F.col("text")).alias("html"))
    sequences = interleave(pages, "doc_id", "html")
    media = F.filter("sequence", lambda item: item["kind"] == "media")
    # Texts stay behind: only references are joined.
    references = sequences.select(F.struct("doc_id", (F.size("sequence") - F.size(media)).cast("long").alias("n_texts")).alias("of"), media.alias("sequence"))
    resolved = resolve(references, "of", read_payloads(store_payloads(documents)))
    return resolved.select(
        "of.doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        F.col("pos").cast("long").alias("media_pos"), "of.n_texts",
    )
