"""Alignment of two tokenizers, against a plain version that cuts at common byte offsets."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tarnflow.llm import alignment, queries

SHORT = ["", " ", "a", " a", "a ", "two  words\n\n next\t\ttab", "<|endoftext|> <s> </s> <unk>", "a▁b", "▁", "ａ１ é é", "\x00\x01 \r\n", "\U0001f600\U0001f468‍\U0001f469 中文字 \xa0x \x1c\x85 ​y", "don't we'll 12345 3.14!!! ((x))", "word " * 400, "a" * 5000, "ab" * 900 + " " * 300 + "x", "1" * 3000]


@pytest.fixture(scope="module")
def plain():
    first = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in shown}
    of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
    first_bytes = {i: bytes(of[c] for c in t) for t, i in vocabulary.items()}

    def second_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
        ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in ([first_bytes[i] for i in a], [second_bytes(i) for i in b])]
        if not b"".join(first_bytes[i] for i in a) == f" {text}".encode() == b"".join(second_bytes(i) for i in b):
            return []
        cuts, out = sorted(set(ends[0]) & set(ends[1])), []
        i = j = 0
        for cut in cuts:
            n, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            out.append((a[i:n], b[j:m]))
            i, j = n, m
        return out

    return groups


def expected(rows, groups):
    """Result rows, in the order of ``rows``."""
    found = [groups(text) for _, text in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in found]
    docs = Counter(pair for link in links for pair in link)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc_id, _), g, link in zip(rows, found, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        n_best = sum(n for (a, b), n in link.items() if docs[a, b] == best[a])
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(link.values()), n_best, sum(n * docs[p] for p, n in link.items()), digest))
    return out, docs


def test_op13(spark, sf_dir, plain):
    table = pd.read_parquet(f"{sf_dir}/documents.parquet")
    rows = [(int(i), t if isinstance(t, str) else None) for i, t in zip(table["doc_id"], table["text"], strict=True)]
    assert sorted(map(tuple, queries.QUERIES["op13_tokenizer_alignment"](spark, sf_dir).collect())) == sorted(expected(rows, plain)[0])


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_edges(spark, plain, most):
    """Nulls, empties, repeats and clashing names; counts joined or sent."""
    rows = [(k, t) for k, t in enumerate(SHORT)] + [(3, None), (None, "null id"), (4, " a"), (4, " a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "pair", "pairs", "times", "docs", "best", "n_a")}).repartition(3)
    found, pairs = alignment.align_tokenizers(df, broadcast_pairs=most)
    wanted, docs = expected(rows, plain)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert {(r.first_id, r.second_id): r.docs for r in pairs.collect()} == dict(docs)
    assert alignment.align_tokenizers(df.where("doc_id < 0"))[0].count() == 0


def test_chunks_equal_whole_texts(plain, monkeypatch):
    """Random texts in batches, with memory that fills up and groups that are counted before they are paired."""
    monkeypatch.setattr(alignment, "REMEMBERED", 60)
    monkeypatch.setattr(alignment, "MANY_LINKS", 2)
    rnd = random.Random(5)
    parts = ["the", " and", "  ", "\n", "\t", " ", ".", ",", "'s", "né", "中文", "\U0001f600", "▁", "12", "<s>", "\xa0", "\x85", "​", "Word", "ö́", "!!", "_", "\x1f"]
    both = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert both.local
    for _ in range(30):
        texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(25)]
        columns = [c.to_pylist() for c in both.documents(texts)]
        for text, n_a, n_b, n_groups, n_links, digest, pairs, times in zip(texts, *columns, strict=True):
            g = plain(text)
            link = Counter(a * alignment.PAIR + b for x, y in g for a in x for b in y)
            listed = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
            assert (n_a, n_b, n_groups, n_links) == (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(link.values()))
            assert digest == (hashlib.sha256(listed.encode()).hexdigest() if g else "") and dict(zip(pairs, times, strict=True)) == dict(link)


def test_pointers_find_components():
    """Random token borders: pointer jumping gives the stretches between common ends."""
    rnd = np.random.default_rng(2)
    for _ in range(200):
        total = int(rnd.integers(1, 60))
        ends = [np.array(sorted({*rnd.integers(1, total + 1, rnd.integers(1, 12)).tolist(), total})) for _ in range(2)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        rest = alignment.rest_of_pointers(starts[0], ends[0], starts[1], ends[1])
        cuts = np.array(sorted(set(ends[0].tolist()) & set(ends[1].tolist())))
        assert np.array_equal(ends[1][rest], np.concatenate([cuts[np.searchsorted(cuts, e)] for e in ends]))
