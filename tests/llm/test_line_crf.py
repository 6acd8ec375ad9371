"""Quality rules by line labels: base figures by brute force, the field against all labellings, held-out documents."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarnflow.llm import line_crf, queries

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if times[w] > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    figures = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return *figures, len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_op11(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op11_quality_lines"](spark, sf_dir).collect()}
    assert len(found) == len(table)
    for i, text in zip(table["doc_id"], table["text"], strict=True):
        assert tuple(found[i])[1:7] == base(text) and not (found[i].base_failed and found[i].kept)
    quality = dict(pd.read_parquet(f"{sf_dir}/labels.parquet")[["doc_id", "quality"]].itertuples(index=False))
    judged = [(found[i].kept, bool(q)) for i, q in quality.items() if not found[i].base_failed]
    assert np.mean([a == b for a, b in judged]) > 0.97


def test_held_out_documents(spark):
    """Good documents that the field was not trained on stay, bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    train = F.col("doc_id") % 2 == 0
    found = line_crf.apply_rules(docs.where("doc_id IS NOT NULL"), labels.where(train), sample_each=150)
    rows = found.join(labels.where(~train), "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert len(rows) > 1000
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.995 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.05


def test_base_figures_of_odd_texts(spark):
    rnd = random.Random(3)
    parts = ["a", "b", "cc", "é", "中", "\n", "\n", " ", "  ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "#", "<>", "|", "\x00", "a b a b a b", "\U0001f600"]
    texts = [None, "", "\n", " \n \n", "one", "a " * 9, "a " * 10, "x y z\n" * 4, "long " * 30_000, "w" * 50_000, "\n" * 5_000 + "end"] + ["".join(rnd.choices(parts, k=rnd.randrange(80))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("kept", "n_words", "lines", "content", "quality", "label")}).repartition(4)
    field = line_crf.Field(np.zeros(line_crf.N_WEIGHTS), np.zeros((2, 2)), np.zeros(2))
    for model in (None, field):
        found = line_crf.label_documents(df, model, with_lines=True).collect()
        assert sorted((tuple(r)[:7] for r in found), key=repr) == sorted(((i, *base(t)) for i, t in rows), key=repr)
        assert all(r.kept != r.base_failed for r in found)
        by_id = {r.doc_id: [x.line for x in r.lines] for r in found if r.doc_id is not None and r.doc_id != 3}
        assert all(by_id[i] == [x for x in (t or "").split("\n") if re.search(WORD, x)] for i, t in rows if i in by_id)
    assert line_crf.label_documents(df.where("doc_id < 0"), None).count() == 0


def test_unlabelled_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 12), (2, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in line_crf.apply_rules(docs, labels).collect()} == {1: False, 2: True}


def test_field_against_all_labellings():
    """Log of the sum, marginals and Viterbi path of short sequences, by trying every labelling."""
    rng = np.random.default_rng(1)
    field = line_crf.Field(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    length = np.array([1, 2, 5, 4])
    scores = rng.normal(size=(4, 5))
    labels, moved, total = line_crf._sums(scores, field, length)
    begin = np.concatenate([[0], np.cumsum(length)])
    best = line_crf.decode(field, np.concatenate([s[:n] for s, n in zip(scores, length, strict=True)]), begin)
    for k, n in enumerate(length):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        value = np.array([field.start[p[0]] + sum(scores[k, t] * y for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        weight = np.exp(value) / np.exp(value).sum()
        assert np.isclose(total[k], np.log(np.exp(value).sum()))
        assert np.allclose(labels[k, :n, 1], weight @ np.array(paths)) and not labels[k, n:].any()
        assert np.allclose(moved[k], [[sum(w * sum((a, b) == m for m in itertools.pairwise(p)) for w, p in zip(weight, paths, strict=True)) for b in (0, 1)] for a in (0, 1)])
        assert tuple(best[begin[k] : begin[k + 1]]) == paths[int(value.argmax())]


def test_training_needs_both_kinds():
    assert line_crf.train_field([b"good line here.\n" * 3], [False]) is None
    field = line_crf.train_field([b"Good words stand here.\nMore good words.", b"BUY!! $$$ ###\nNOW!! %%% &&&"] * 20, [False, True] * 20, steps=40)
    found = line_crf.measure([b"SALE!! $$$ @@\nONLY!! &&& %%%", b"", b"Other fine words here.\nThey go on."])
    assert line_crf.decode(field, field.weights[found.bins].sum(1), found.begin).tolist() == [1, 1, 0, 0]
