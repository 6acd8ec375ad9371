"""The registered queries over whole tables, against plain versions of what they promise."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from tarnflow.llm import bpe_tree, media, queries


@pytest.fixture(scope="module")
def documents(sf_dir):
    rows = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    return [(int(i), t if isinstance(t, str) else "", lang) for i, t, lang in zip(rows["doc_id"], rows["text"], rows["lang"], strict=True)]


def rows_of(spark, sf_dir, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    def digits(found):
        return re.sub("[^0-9]", "", found)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda f: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda f: all(int(p) <= 255 for p in f.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda f: 13 <= len(digits(f)) <= 19 and luhn(digits(f))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda f: 9 <= len(digits(f)) <= 15),
    }
    return {kind: [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m[0])] for kind, (pattern, good) in kinds.items()}


def test_op1(spark, sf_dir, documents):
    found = rows_of(spark, sf_dir, "op1_pii_spans")
    assert len(found) == len(documents)
    for i, text, _ in documents:
        base, row = base_spans(text), found[i]
        listed = [s for spans in base.values() for s in spans]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(len(s) for s in base.values())
        assert row.base_sha256 == sha(",".join(listed).encode())
        assert set(listed) <= set(row.spans.split(",") if row.spans else [])


def test_op2(spark, sf_dir, documents):
    found = rows_of(spark, sf_dir, "op2_language_id")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in documents}
    assert {i: r.held_out for i, r in found.items()} == held
    learned = {lang for i, text, lang in documents if lang is not None and text and not held[i]}
    for i, text, _ in documents:
        lettered = any(c.isalpha() for c in text)
        assert found[i].lang_pred in learned if lettered else found[i].lang_pred == "und"
        assert 0 <= found[i].score <= 1
    tried = [(found[i].lang_pred, lang) for i, text, lang in documents if held[i] and lang is not None and found[i].lang_pred != "und"]
    assert np.mean([a == b for a, b in tried]) > 0.9


def test_op3(spark, sf_dir, documents):
    found = rows_of(spark, sf_dir, "op3_bpe_tree")
    encoding: tiktoken.Encoding = bpe_tree.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, text, _ in documents:
        ids = encoding.encode_ordinary(text)
        assert tuple(found[i])[1:4] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))


def test_op4(spark, sf_dir):
    found = rows_of(spark, sf_dir, "op4_embedding_dedup")
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    good = [(int(i), np.asarray(v, np.float64)) for i, v in zip(table["vec_id"], table["embedding"], strict=True) if v is not None and len(v)]
    good = [(i, v / np.linalg.norm(v)) for i, v in good if np.isfinite(v).all() and v.any()]
    matrix = np.stack([v for _, v in good])
    cosine = matrix @ matrix.T
    least = {i: int((row > 0.9 + 1e-9).sum()) - 1 for (i, _), row in zip(good, cosine, strict=True)}
    most = {i: int((row > 0.9 - 1e-9).sum()) - 1 for (i, _), row in zip(good, cosine, strict=True)}
    assert len(found) == len(table) and all(r.n_links <= most.get(i, 0) for i, r in found.items())
    assert sum(r.n_links for r in found.values()) >= 0.98 * sum(least.values())
    assert all(r.kept == (i == r.component_id) and r.component_id <= i for i, r in found.items())
    assert all((r.n_links > 0) == (least[i] > 0) for i, r in found.items() if i in least and least[i] == most[i] and least[i] > 3)


def test_op6(spark, sf_dir, documents):
    found = rows_of(spark, sf_dir, "op6_token_files")
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for i, text, _ in documents:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert tuple(found[i])[1:4] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark, sf_dir, documents):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    found = rows_of(spark, sf_dir, "op8_license_scan")
    for i, text, _ in documents:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase]
        row, places, labels = found[i], [k for k, _ in at], {label for _, label in at}
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert row.base_labels == ",".join(sorted(labels)) and labels <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1


def test_op10(spark, sf_dir, documents):
    found = rows_of(spark, sf_dir, "op10_media_columns")
    assert len(found) == len(documents)
    for i, text, _ in documents:
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored, row = media.to_wave(payload), found[i]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(raw), len(payload), sha(payload))
        assert (row.tail_crc32, row.media_bytes, row.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), sha(stored))
        assert row.feature == media.describe(payload)
        blocks = [bool(b.split()) for b in text.split("\n\n")]
        assert (row.media_pos, row.n_texts) == (int(blocks[0]), sum(blocks))


def test_pages_keep_texts_and_payloads_apart(spark):
    texts = ["<b>one</b> & two\n\n  three \n\n\n\n<img src='x'>", None, "", "\n\nfour", "a\0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pages = df.select("doc_id", media.page_of(df["text"]).alias("html"))
    sequences = {r.doc_id: r.sequence for r in media.interleave(pages, "doc_id", "html").collect()}
    stored = {r.doc_id: r.digest for r in media.store_payloads(df).collect()}
    kinds = [["text", "media", "text", "text"], ["media"], ["media"], ["media", "text"], ["text", "media"]]
    assert [[item.kind for item in sequences[k]] for k in range(5)] == kinds
    assert [item.text for item in sequences[0]] == ["<b>one</b> & two", None, "three", "<img src='x'>"]
    assert all([item.digest for item in sequences[k] if item.kind == "media"] == [stored[k]] for k in range(5))
