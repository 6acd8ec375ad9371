"""Broken and hostile texts take linear time, and the linear tokenizer reads what the plain expression reads."""

import random
import re
import time

from tarnflow.llm import html_main, licenses, media
from tarnflow.llm.html_tokens import tokens

#: Reads the same tokens, in quadratic time.
PLAIN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<(?P<raw>script|style|template|noscript|textarea|title|svg|iframe|object|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)


def plain(source):
    out = []
    for m in PLAIN.finditer(source):
        if m["text"] is not None:
            out.append((m["text"], "", False, ""))
        elif m["tag"] is not None:
            out.append((None, m["tag"].lower(), bool(m["end"]), m["attrs"]))
    return out


def test_tokens_equal_the_plain_expression():
    rnd = random.Random(6)
    parts = ["<a", "<p>", "</p>", "<script", "</script>", "</SCRIPT >", "<svg", "/>", ">", "<", '"', "'", " x=", "text", "<!--", "-->", "<!", "<![CDATA[", "]]>", "<?", "</", "<title>", "</title>", "<b class='q'>", "é", "\n", "<div id=\"a>b\">", "/", "<select-x>", "<svg:path>"]
    for _ in range(6000):
        source = "".join(rnd.choices(parts, k=rnd.randrange(12)))
        assert list(map(tuple, tokens(source, html_main.RAW))) == plain(source), source


def seconds(run, *texts):
    began = time.perf_counter()
    for text in texts:
        run(text)
    return time.perf_counter() - began


def test_broken_pages_take_linear_time():
    n = 1 << 20
    for piece in ("<script ", "<a ", "<a '", '<p "', "<svg/", "<!", "<![CDATA[", "<title>", "</x ", "<", "<a '\">"):
        page = piece * (n // len(piece))
        assert seconds(lambda p: sum(1 for _ in tokens(p, html_main.RAW)), page) < 6, piece
    assert seconds(media.parse_sequence, "<script " * (n // 8)) < 6
    assert seconds(html_main.Page, "<a '\">" * (n // 6)) < 10


def test_long_licence_lines_take_linear_time():
    machine = licenses.automaton(tuple(licenses.NOTICE_PHRASES.items()))
    tags = "SPDX-License-Identifier: MIT " * 20_000
    brackets = "SPDX-License-Identifier: " + "(" * 60_000 + "MIT" + ")" * 60_000
    assert seconds(lambda t: licenses.scan(t, machine), tags, brackets) < 8
    assert licenses.read_expression("SPDX-License-Identifier: (MIT OR Apache-2.0) AND x\nGPL-2.0", 24) == ["(", "mit", "or", "apache-2.0", ")", "and", "x"]


def test_many_matches_of_one_text(spark):
    from tarnflow.llm import pii

    took = []
    for n in (4_000, 16_000):
        df = spark.createDataFrame([(1, "10.0.0.1 é " * n)], "doc_id long, text string")
        began = time.perf_counter()
        row = df.select(pii.F.expr(pii._matches("text", pii.BASE["ip"], pii.GUARD["ip"])).alias("x")).first()
        took.append(time.perf_counter() - began)
        assert [s.s for s in row.x] == [11 * k for k in range(n)]
        assert (row.x[0].l, row.x[1].l, row.x[-1].r) == ("", " é ", " é ")
    assert took[1] < 8 * max(0.5, took[0])


def test_sketches_bound_what_sets_differ_in():
    import numpy as np

    from tarnflow.llm import jaccard

    rng = np.random.default_rng(3)
    for n in (1, 50, 2000):
        for changed in (0, 1, n // 10, n):
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 64, changed, dtype=np.uint64)]))
            a = np.unique(a)
            places = int(np.bitwise_count((jaccard.sketch_of(a) ^ jaccard.sketch_of(b)).view(np.uint64)).sum())
            assert places <= len(np.setxor1d(a, b)) and len(jaccard.sketch_of(a)) == jaccard.SKETCH // 64
            assert changed or not places
