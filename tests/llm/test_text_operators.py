"""Operators that treat each text on its own: brute force, edge cases, odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import bpe_tree, html_main, langid, licenses, media, pii, queries, token_files

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (None, "MIT License\nmail me@example.com"), (5, "é中\U0001f600 \x1c\x85\xa0 ok " * 3), (6, "word " * 30_000), (7, "1" * 20_000), (8, "a" * 20_000)]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empties, repeats, long texts, and columns whose names clash with results."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    return df.withColumns({c: F.lit("other") for c in ("n_tokens", "score", "labels", "digest", "lang_pred", "base", "found", "k", "candidates", "ids", "vector", "n", "size")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def fuzz(seed, alphabet, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(most))) for _ in range(n)]


# Byte-level BPE


def test_tree_equals_whole_encoding():
    encoding = bpe_tree.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for k, text in enumerate(fuzz(1, ["a", "b", " ", "  ", "\n", "\t", "'s", "té", "1", "2", ".", "!", "中", "　", "\x1c", "\x85", "​", "\U0001f600", "word"], 1500, 120)):
        ids = bpe_tree.encode_tree(encoding, text, leaf_chars=1 + k % 13)
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert bpe_tree.decode_tree(encoding, ids, 3) == text.encode()


def test_bpe_rows(edges, empty):
    encoding = bpe_tree.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def row(doc_id, text):
        ids = encoding.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = [tuple(r) for r in bpe_tree.encode_documents(edges, leaf_chars=100).collect()]
    assert sorted(got, key=repr) == sorted([row(*e) for e in EDGES], key=repr)
    payload = bpe_tree.encode_documents(edges.where("doc_id = 5"), with_payload=True).first()
    assert payload.decoded == EDGES[6][1] and len(payload.ids) == payload.n_tokens
    assert bpe_tree.encode_documents(empty).count() == 0


# Licences


def plain_scan(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    hits = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE_PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({label for _, label in hits}))


def test_license_scan_equals_plain(spark, edges, empty):
    texts = fuzz(2, ["MIT ", "license ", "License", "Apache ", "GENERAL ", "public ", "é", "-", ". ", "cc", "\x00", "\n"], 800, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        assert tuple(r)[1:6] == plain_scan(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    got = sorted((r.doc_id or 0, *tuple(r)[1:6]) for r in licenses.scan_licenses(edges).where("doc_id <> 5 or doc_id is null").fillna(-1).collect())
    assert len(got) == len(EDGES) - 1 and all(x[2] == (1 if x[0] == -1 else 0) for x in got)
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    "expression, labels, allowed",
    [
        ("MIT", {"mit"}, True),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, False),
        ("MIT OR GPL-3.0", {"mit", "gpl"}, True),
        ("MIT AND GPL-3.0", {"mit", "gpl"}, False),
        ("GPL-3.0 AND MIT OR Apache-2.0", {"gpl", "mit", "apache"}, True),
        ("GPL-3.0 AND (MIT OR Apache-2.0)", {"gpl", "mit", "apache"}, False),
    ],
)
def test_license_expressions(expression, labels, allowed):
    postfix = licenses.to_postfix(licenses.read_expression(expression, 0))
    assert licenses.evaluate(postfix) == (labels, allowed)
    found = licenses.scan(f"# SPDX-License-Identifier: {expression}\nfoo", licenses.automaton(tuple(licenses.NOTICE_PHRASES.items())))
    assert set(found[5].split(",")) == labels


@pytest.mark.parametrize(
    "expression, labels, allowed",
    [
        ("Artistic-2.0 OR GPL-2.0", {"gpl"}, False),
        ("CDDL-1.0 OR MIT", {"mit"}, True),
        ("MIT AND Foo", {"mit"}, False),
        ("(LicenseRef-own AND MIT) OR DocumentRef-x:LicenseRef-y */", {"mit"}, False),
        ("MIT -->", {"mit"}, True),
    ],
)
def test_license_expressions_with_unknown_operands(expression, labels, allowed):
    assert licenses.evaluate(licenses.to_postfix(licenses.read_expression(expression, 0))) == (labels, allowed)
    found = licenses.scan(f"# SPDX-License-Identifier: {expression}\nfoo", licenses.automaton(()))
    assert set(found[5].split(",")) == labels and found[6] == pytest.approx(0.99 if allowed else 0.95)


def test_license_tags_after_letters_that_change_length():
    machine = licenses.automaton(tuple(licenses.NOTICE_PHRASES.items()))
    assert licenses.scan("\u0130" * 4 + " # SPDX-License-Identifier: MIT", machine)[5] == "mit"
    assert licenses.scan("spdx-license-identifier: CC-BY-4.0 OR EUPL-1.2+", machine)[5:] == ("cc-by,eupl", pytest.approx(0.99))
    assert licenses.scan("x SPDX-License-Identifier: CC0-1.0", machine)[5] == "cc0" and licenses.scan("SPDX-License-Identifier: CC-BY-NC-4.0", machine)[5:] == ("cc-by-nc", pytest.approx(0.95))
    many = licenses.scan("mit license " * 100 + "\n# SPDX-License-Identifier: GPL-2.0", machine)
    assert many[5] == "gpl,mit" and many[6] == 1.0


def test_ill_formed_expressions():
    assert licenses.to_postfix(["mit", "or"]) is None and licenses.to_postfix(["(", "mit"]) is None and licenses.to_postfix(["mit", "mit"]) is None and licenses.to_postfix([]) is None


# Token files


def test_coder_round_trip():
    for n in (0, 1, token_files.LANES - 1, token_files.LANES + 1, 400_000):
        ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
        model = token_files.Model(token_files.scale_counts(np.bincount(ids, minlength=50_001)))
        block = token_files.pack_block(model, [ids[: n // 3], ids[n // 3 :]])
        got, sizes = token_files.unpack_block(model, block)
        assert (got == ids).all() and sizes.tolist() == [n // 3, n - n // 3]
        span = token_files.LANES * token_files.INTERVAL
        if n > 2 * span:
            assert (token_files.unpack_block(model, block, 2, 1)[0] == ids[2 * span : 3 * span]).all()
            damaged = bytearray(block)
            damaged[-5] ^= 1
            with pytest.raises(ValueError):
                token_files.unpack_block(model, bytes(damaged))


def test_remembered_words_equal_the_tokenizer():
    encoder = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = fuzz(3, ["a", "b", " ", "\n", "'s", "té", "1", "²", "_", ".", "!!", "中", "€", "　", "\x1c", "\xa0", "é", "<|endoftext|>", "\U0001f600"], 1500, 60)
    wanted = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(i, "<u2").tolist() for i in encoder.encode(texts)] == [w.ids for w in wanted]


def test_token_files_rows(edges, empty):
    files, freqs = token_files.write_files(edges)
    got = token_files.read_files(files, freqs).orderBy("start").collect()
    tokenizer = token_files.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for r, (doc_id, text) in zip(got, sorted(EDGES, key=lambda e: (e[0] is not None, e[0], e[1] or "")), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files, freqs = token_files.write_files(empty)
    assert token_files.read_files(files, freqs).count() == 0


# Media


def test_media_rows(edges, empty):
    stored = media.store_payloads(edges)
    figures = {r.digest: r for r in media.read_payloads(stored).collect()}
    for r in stored.collect():
        payload = media.from_wave(bytes(r.media))
        assert len(payload) % 64 == 0 and len(payload) >= max(64, r.n_bytes) and figures[r.digest].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert figures[r.digest].media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and figures[r.digest].tail_crc32 == zlib.crc32(payload[-64:])
    assert media.store_payloads(empty).count() == 0 and media.read_payloads(media.store_payloads(empty)).count() == 0


def test_sequences_keep_places_and_captions(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    page = f"<body><p>one &amp; <b>two</b></p><img src='sha256:{digest}' alt='a &lt; b'><script>no()</script><p>three</p><video src=http://x/y title=clip></video><img alt='none'></body>"
    sequences = media.interleave(spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string"), "id", "html")
    by_id = {r.id: r.sequence for r in sequences.collect()}
    assert [tuple(i) for i in by_id[1]] == [(0, "text", "one & two", None, None), (1, "media", None, digest, "a < b"), (2, "text", "three", None, None), (3, "media", "http://x/y", None, "clip")]
    assert by_id[2] == [] and by_id[3] == []
    resolved = media.resolve(sequences, "id", spark.createDataFrame([(digest, 7)], "digest string, size long"))
    again = media.reassemble(resolved, "id").first()
    assert [(i.pos, i.size) for i in again.sequence] == [(0, None), (1, 7), (2, None), (3, None)]


# Personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    found = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((pii.KINDS.index(kind), m.start(), m.end()))
    return found


def test_base_spans_equal_plain(spark, edges, empty):
    alphabet = ["@", ".", "a", "b1", "-", "+", "_", "%", " ", "1", "22", "255", "256", "4", "(", ")", "é", "\U0001f600", "\n", "x@y.z", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 555-1234", "0", "00", "call (555) 234-5678 "]
    df = spark.createDataFrame(list(enumerate(fuzz(4, alphabet, 1500, 60))), "doc_id long, text string").union(edges.select("doc_id", "text"))
    for r in pii.find_spans(df, keep=("text",)).collect():
        base, found = [tuple(s) for s in r.base], [tuple(s) for s in r.found]
        assert base == plain_spans(r.text)
        assert set(base) <= set(found) and found == sorted(found)
    assert pii.find_spans(edges).count() == len(EDGES) and pii.find_spans(empty).count() == 0


def test_redaction_and_native_plan(spark, edges, empty):
    df = spark.createDataFrame([(1, "é mail bob@x.com, call +1 (555) 555-1234 now", "k"), (2, None, "k")], "doc_id long, text string, source string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["é mail <EMAIL>, call <PHONE> now", None]
    assert pii.redact(empty).columns == empty.columns
    plan = pii.find_candidates(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Scan)", plan)


def test_label_model_learns_reliabilities(spark):
    """Votes drawn from known labelers: those that are right more often get more weight."""
    rnd, counts = random.Random(5), {}
    for _ in range(4000):
        truth = rnd.random() < 0.4
        votes = tuple(1 if (truth if rnd.random() < right else not truth) else -1 for right in (0.95, 0.9, 0.85, 0.8, 0.55))
        counts[votes] = counts.get(votes, 0) + 1
    model = pii.fit_label_model(spark.createDataFrame([(0, list(v), n) for v, n in counts.items()], "k int, votes array<int>, n long")).first().model
    assert abs(model.pi - 0.4) < 0.05
    for j, right in enumerate((0.95, 0.9, 0.85, 0.8, 0.55)):
        assert abs(model.alpha[j] - right) < 0.06 and abs(model.beta[j] - (1 - right)) < 0.06


# Language


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, keep=("lang",)).withColumn("held_out", langid.held_out()).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in found)


def test_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    way = langid.Direction(rng.normal(size=(6, langid.PAD + 1)), rng.normal(size=(6, 2)))
    data, target = rng.integers(0, 5, (4, 3)), rng.normal(size=(4, 2, 3)).astype(np.float32)

    def loss():
        return float((langid._forward(way, data, range(4))[0].astype(float) * target).sum())

    d_table, d_rec = langid._backward(way, data, langid._forward(way, data, range(4))[1], target)
    for array, grad in ((way.inputs, d_table), (way.recurrent, d_rec)):
        for at in [(0, 1), (2, 0), (5, 1)]:
            array[at] += 1e-3
            up = loss()
            array[at] -= 2e-3
            down = loss()
            array[at] += 1e-3
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-2


def test_language_edges(edges, empty):
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(edges.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))).collect()}
    assert len(found) == 9 and found[1] == found[2] == found[3] == found[7] == ("und", 0.0) and found[6][0] in ("aa", "bb")
    assert {r.lang_pred for r in langid.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(empty).count() == 0


def trained():
    rng = np.random.default_rng(3)
    return langid.train_network([bytes(rng.choice(list(alphabet), 50)) for alphabet in (b"abcde ", b"defgh ") for _ in range(40)], [0] * 40 + [1] * 40, ["aa", "bb"], hidden=4, steps=25)


def test_pool_equals_plain_network():
    """Pieces of all lengths side by side: each as its own run of the training network gives it, alone or in company."""
    network, rng = trained(), np.random.default_rng(4)
    labeler = langid.Labeler(network)
    texts = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (0, 1, 2, 255, 256, 257, 300, 700, 5, 90)] + [bytes(3), b"\xff\x00a"]

    def plain(text):
        total = np.zeros(2)
        for k in range(0, len(text), langid.SPAN):
            data = np.frombuffer(text[k : k + langid.SPAN], np.uint8).astype(np.intp)[:, None]
            states = np.concatenate([langid._forward(way, data, order)[0] for way, order in zip(network.ways, (range(len(data)), range(len(data) - 1, -1, -1)), strict=True)], 1)
            share = np.exp(network.output @ states + network.bias)
            total += (share / share.sum(1, keepdims=True)).sum((0, 2))
        return total / max(1, len(text))

    together = labeler.pool(texts)
    assert np.abs(together - np.stack([plain(t) for t in texts])).max() < 1e-5
    assert np.abs(together - np.concatenate([labeler.pool([t]) for t in texts])).max() < 1e-6


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first, second = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, trained()).collect()} for df in (docs, docs.repartition(13)))
    assert {i: p for i, (p, _) in first.items()} == {i: p for i, (p, _) in second.items()}
    assert max(abs(first[i][1] - second[i][1]) for i in first) < 1e-6


def test_most_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}", "abc"[min(2, k // 4)]) for k in range(9)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    assert langid.training_sample(docs, "doc_id", "text", "lang", 100)[2] == ["a", "b"]


# Pages

PAGE = "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=/a>menu</a></ul></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>one  two<br>three <b>four</b><p>five</p><div class='comments'><p>me too</p></div></article><footer>&copy; x</footer>"


def test_main_text(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (4, "u", "<p>" + "long " * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    trained = html_main.train(spark.read.parquet(f"{sf_dir}/pages.parquet").union(pages.drop("text")))
    found = sorted((tuple(r) for r in html_main.extract(pages, trained).collect()), key=repr)
    text = "Head & more\n\none two three four\n\nfive"
    assert found[:2] == [(1, "u", text, len(text))] * 2 and found[2] == (2, None, "", 0) and found[3] == (3, "u", "", 0)
    none = pages.limit(0)
    assert html_main.extract(none, html_main.train(none)).count() == 0


def test_main_text_without_blocks_and_after_closed_svg(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    trained = html_main.train(pages)
    assert html_main.main_text("Some <b>text</b><br>more", trained) == "Some text more"
    assert {"one", "three"} <= set(html_main.main_text("<!doctype html>\n one <p>two</p> three\n", trained).split("\n\n"))
    icon = "<svg class='a>b' viewBox=\"0 0\" />"
    for source in (PAGE, *[r.html for r in pages.limit(20).collect()]):
        wanted = html_main.main_text(source, trained)
        assert html_main.main_text(source.replace("<article>", f"<article>{icon}"), trained) == wanted
        assert html_main.main_text(source.replace("<article>", "<article><svg><path/>no</svg>"), trained) == wanted


def test_main_text_of_all_pages(spark, sf_dir):
    """The article of every page, against its own marks."""
    import html

    found = {r.page_id: r.text for r in queries.QUERIES["op9_html_main_text"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert found[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_messages_give_exact_marginals():
    """Sum-product on a small tree against the sum over all labellings."""
    import itertools
    import math

    model = html_main.TreeModel({"tag=p": (1.0, 9.0), "tag=li": (5.0, 1.0), "#nodes": (20.0, 10.0), "#edge0": (9.0, 3.0), "#edge1": (2.0, 8.0), "#root": (5.0, 1.0)})
    page = html_main.Page("<div><p>a</p><ul><li>x<li>y</ul></div><p>b</p>")
    own = [sum(model.weights.get(f, 0.0) for f in fs) for fs in page.features()]
    own[0] += model.root
    total, yes = 0.0, [0.0] * len(own)
    for labels in itertools.product((0, 1), repeat=len(own)):
        weight = math.exp(sum(own[k] * x for k, x in enumerate(labels)) + sum(model.edges[labels[page.parents[k]]][labels[k]] for k in range(1, len(own))))
        total += weight
        yes = [y + weight * x for y, x in zip(yes, labels, strict=True)]
    assert all(abs(y / total - m) < 1e-9 for y, m in zip(yes, model.marginals(page), strict=True))
