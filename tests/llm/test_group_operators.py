"""Operators over groups of rows: joins, components, mixing, and the pipeline."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tarnflow.llm import bpe_tree, embeddings, jaccard, langid, mixing, pii, queries, token_files
from tarnflow.llm.common import apart, materialize, without
from tarnflow.llm.components import connected_components


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == roots_of({n for link in links for n in link}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# N-gram Jaccard join


def shingles(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain_components(rows, words=3, percent=90):
    sets = {i: shingles(t, words) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = roots_of(ids, links)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def near_copies(seed=1):
    """Groups around the threshold, a large group, shared passages, short and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for group in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([20, 60, 150, 400]))]
        if group % 3 == 0:
            base += passage
        for _ in range(30 if group == 0 else rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(copy) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy) if rnd.random() < 0.8 else "  ".join(copy).upper())
    rows += ["a", "a", "A  b", "a b", "a b c", "a b c d", "", None, " \n", "é é é", "x " * 50_000, "x " * 40_000]
    return list(enumerate(rows))


@pytest.mark.parametrize("large", [32, 2])
@pytest.mark.parametrize("seed,words,percent", [(1, 3, 90), (2, 5, 80)])
def test_jaccard_equals_plain(spark, monkeypatch, seed, words, percent, large):
    """Also with nearly all groups taken for large ones, which are compared by their differences from a centre."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "set_id", "tokens", "size", "component_id")})
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, words=words, percent=percent).collect()}
    assert found == plain_components(rows, words, percent)


def two_centres():
    """Two large groups that are akin but not similar, a chain between them, and members far out."""
    rnd = random.Random(7)
    one = [f"w{rnd.randrange(10_000)}" for _ in range(200)]
    two = one[:170] + [f"v{rnd.randrange(10_000)}" for _ in range(30)]
    rows = []
    for base in (one, two):
        for _ in range(60):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 9])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10_000)}"
            rows.append(" ".join(copy))
    chain = list(one)
    for k in range(8):
        chain = chain[: 40 + 20 * k] + [f"c{k}"] + chain[41 + 20 * k :]
        rows.append(" ".join(chain))
    return list(enumerate(rows))


def test_large_groups_equal_plain(spark):
    rows = two_centres()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    plain = {i: root for i, (_, root) in plain_components(rows).items()}
    assert found == plain and 2 < len(set(plain.values())) < len(rows)


def test_jaccard_query_and_odd_tables(spark, sf_dir):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_ngram_jaccard"](spark, sf_dir).collect()}
    assert found == plain_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(odd).collect()), key=repr) == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4)], key=repr)


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = ("Some words, é and " + "long" * 50 + " \t\n x ").encode() * 20
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "SEGMENT", 64)
    assert (jaccard.word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert len(np.unique(jaccard.word_hashes(b" ".join(b"%d" % i for i in range(100_000))))) == 100_000


# Embeddings


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    vectors = [c + rng.normal(size=32) * s for c in centres for s in rng.choice([0.05, 0.15, 0.25, 0.33], 12)]
    vectors += [vectors[0]] * 3
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (1004, [1.0, None] * 16), (1005, [float("inf")] * 32), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e300, 2e300])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("values", "class_id", "cell", "query", "label")})
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    linked = (unit @ unit.T) >= 0.9
    links = sum(linked[k].sum() - 1 for k in range(len(vectors)))
    got = sum(found[k][0] for k in range(len(vectors)))
    assert all(found[k][0] <= linked[k].sum() - 1 for k in range(len(vectors))) and 0.97 * links <= got
    assert all(found[k][0] >= 3 for k in (0, len(vectors) - 1)) and found[len(vectors) - 1][1] == 0
    assert all(found[k] == (0, k, True) for k in range(1000, 1006))
    assert found[1006] == (2, 1006, True) and found[1007] == (2, 1006, False) and found[1008] == (2, 1006, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_anchors_lose_few_pairs(monkeypatch):
    """Blocks compared through anchors against all pairs, at the threshold itself."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * side
    ways = embeddings.directions(64, 5)
    pa_, pb = a @ ways, b @ ways
    apart = (pa_[:, :5] > 0) != (pb[:, :5] > 0)
    met = (~apart | (np.abs(pa_[:, :5]) < embeddings.REACH)).all(1) | (~apart | (np.abs(pb[:, :5]) < embeddings.REACH)).all(1)
    counted = (np.abs(pa_[:, 5:] - pb[:, 5:]) <= embeddings.WINDOW).sum(1) >= embeddings.required_count()
    assert (met & counted).mean() > 0.93


def test_recall_does_not_fall_with_more_anchors(spark, monkeypatch):
    """Pairs just above the threshold against brute force, through all anchors that the largest tables have."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    vectors = np.concatenate([a, 0.901 * a + np.sqrt(1 - 0.901**2) * side])
    links = int(((vectors @ vectors.T) >= 0.9).sum()) - len(vectors)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "CELL", len(vectors) / 2**embeddings.MOST_ANCHORS)
    found = sum(r.n_links for r in embeddings.near_duplicates(df).collect())
    assert 0.985 * links <= found <= links


# Mixing


def filled(sizes, weights=(5, 2, 1)):
    """Targets by clamping and resharing until none is above its cap."""
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    w = [weights[k % 3] for k in range(len(sizes))]
    while open_:
        left = total - sum(out.values())
        share = {k: left * w[k] / sum(w[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not over:
            return [out.get(k, share.get(k)) for k in range(len(sizes))]
        for k in over:
            out[k] = 3.0 * sizes[k]
            open_.remove(k)
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 1000, 5], [1, 2, 3, 4000, 5, 6, 7], [0, 10, 0], [5]])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.water_fill(df).collect()}
    assert [pytest.approx(t) for t in filled(sizes)] == [found[f"s{k}"] for k in range(len(sizes))]


def test_mixing_odd_tables(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d", "x"), (2, None, "y"), (3, "", None), (4, "w " * 30_000, None)] + [(10 + i, "w " * (1 + i % 7), "zé"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "draw", "bucket", "target", "rank", "weight", "cap")})
    found = mixing.plan_repetitions(df).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.plan_repetitions(df.repartition(5)).collect()), key=repr)
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    for source in {r.source for r in found}:
        some = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r.size for r in some)
    assert mixing.plan_repetitions(df.limit(0)).count() == 0


def plain_mix(rows, weights=(5, 2, 1)):
    """Repetitions of ``(id, text, source)`` rows, by one running sum per source."""
    sized = [(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(":".join(["7", *[str(x) for x in (i, t) if x is not None]]).encode()).hexdigest()[:8], 16), i, n, s) for n, (i, t, s) in enumerate(rows)]
    names = sorted({r[4] for r in sized}, key=lambda s: (s is None, s))
    totals = [sum(r[0] for r in sized if r[4] == s) for s in names]
    times = {}
    for name, total, target in zip(names, totals, filled(totals, weights), strict=True):
        whole, at = int(target // total) if total else 0, 0
        for size, _, i, n, _ in sorted((r for r in sized if r[4] == name), key=lambda r: (r[1], r[2], r[0])):
            times[n] = min(3, whole + (2 * at + size < 2 * (target - whole * total)))
            at += size
    return [times[n] for n in range(len(rows))]


def test_mixing_equals_sql(spark, sf_dir):
    found = sorted(tuple(r) for r in queries.QUERIES["op7_mix_sources"](spark, sf_dir).collect())
    wanted = duckdb.sql(queries.SQL["op7_mix_sources"].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in sorted(wanted)]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in sorted(wanted)])


# Pipeline


def more_documents(spark, sf_dir):
    """Documents with null and wordless texts, repeated and missing ids, and columns whose names the stages use themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = (" ".join(f"{w}{k % 37}{chr(97 + k % 23)}" for k in range(90)) for w in ("the", "and"))
    extra = [(10_001, None, "en", "src0", 0), (10_002, "12 34 !!", "en", "src1", 8), (0, one, "en", "src0", 9), (None, two, "en", None, 9), (None, two, "en", None, 9), (10_003, "", "en", "src0", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).union(docs.where("doc_id = 0"))
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(("score", "lang_pred", "found", "base", "candidates", "times", "of", "row", "_row", "_times", "component_id", "size", "c0"))})


def test_stages_against_plain_versions(spark, sf_dir):
    docs = more_documents(spark, sf_dir).cache()
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, sf_dir).cache()
    scores = {(r.doc_id, r.text): r.s for r in langid.identify(docs.select("doc_id", "text", "lang"), keep=("text",), score_col="s").collect()}
    assert spoken.columns == docs.columns
    assert sorted(r.doc_id for r in spoken.collect() if r.doc_id is not None) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and scores[r.doc_id, r.text] >= corpus_pipeline.LEAST_SCORE)
    assert {10_001, 10_002, 10_003}.isdisjoint(r.doc_id for r in spoken.collect())
    kept = stages["ngram_jaccard"](spark, spoken, sf_dir).cache()
    named = list({(r.doc_id, r.text) for r in spoken.collect() if r.doc_id is not None})
    plain = plain_components(list(enumerate(t for _, t in sorted(named))), 5, 80)
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [sorted(named)[k] for k in sorted({root for _, root in plain.values()})]
    assert kept.where("doc_id IS NULL").count() == spoken.where("doc_id IS NULL").count()
    clean = stages["pii"](spark, kept, sf_dir).cache()
    spans = {(r.doc_id, r.text): r.found for r in pii.find_spans(kept.select("doc_id", "text"), keep=("text",)).collect()}
    wanted = []
    for r in kept.collect():
        text = r.text
        for k, s, e in sorted(((f.k, f.s, f.e) for f in spans[r.doc_id, r.text]), key=lambda f: -f[1]):
            text = f"{text[:s]}<{pii.KINDS[k].upper()}>{text[e:]}"
        wanted.append(repr((r.doc_id, text, len(text), r.found)))
    assert clean.columns == docs.columns and sorted(repr((r.doc_id, r.text, r.n_chars, r.found)) for r in clean.collect()) == sorted(wanted)
    mixed = stages["mix_sources"](spark, clean, sf_dir).cache()
    digested = clean.select(corpus_pipeline._content(clean).alias("key"), "text", "source", "doc_id").collect()
    wanted = sorted(repr((r.doc_id, r.text)) for r, n in zip(digested, plain_mix([(r.key, r.text, r.source) for r in digested]), strict=True) for _ in range(n))
    assert mixed.columns == docs.columns and sorted(repr((r.doc_id, r.text)) for r in mixed.collect()) == wanted
    encoding = bpe_tree.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    wanted = sorted((r.doc_id is None, r.doc_id or 0, len(encoding.encode(r.text, disallowed_special=())), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in stages["bpe"](spark, mixed, sf_dir).collect()) == wanted
    for df in (docs, spoken, kept, clean, mixed):
        df.unpersist()


def test_stages_over_no_rows(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, empty, sf_dir)
        assert found.count() == 0 and (name == "bpe" or found.columns == empty.columns)


def test_rows_that_share_an_id(spark, sf_dir):
    """Only copies go, and the row that stays does not depend on the order of rows."""
    rnd = random.Random(9)
    one, two, three = (" ".join(f"w{rnd.randrange(500)}" for _ in range(80)) for _ in range(3))
    rows = [(1, one, "en", "a", 9), (5, one.upper(), "en", "a", 9), (5, two, "en", "a", 9), (7, two, "en", "b", 9), (7, three, "en", "a", 9), (7, three, "en", "a", 9), (8, None, "en", "a", 9), (8, None, "en", "b", 9), (None, one, "en", "a", 9)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    wanted = sorted(map(repr, [rows[0], rows[2], rows[4], rows[6], rows[7], rows[8]]))
    for some in (rows, rows[::-1]):
        found = stage(spark, spark.createDataFrame(some, schema), sf_dir)
        assert found.columns == schema.names
        assert sorted(repr(tuple(r)) for r in found.collect()) == wanted


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test-stage")
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect())) and docs.count() > 100


def test_stages_do_not_shuffle_whole_texts(spark, sf_dir):
    """Where nothing is small enough to be broadcast, only rows whose bit is set are dealt out, and none for the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        kept, mixed = (dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir) for name in ("ngram_jaccard", "mix_sources"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "getbit" in plan and all("getbit" in part for part in plan.split("Exchange hashpartitioning")[1:] if "text#" in part.split("Exchange")[0])
        assert "Exchange hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_rows_apart(spark, monkeypatch, bits):
    monkeypatch.setattr("tarnflow.llm.common.PASS_BITS", bits)
    rows = spark.createDataFrame([(k % 300 or None, k) for k in range(900)], "k long, n long")
    without, within = apart(rows, "k", spark.createDataFrame([(k,) for k in range(0, 300, 2)], "k long"))
    wanted = [(k % 300 or None, k) for k in range(900)]
    assert sorted((r.n, r.k) for r in without.collect()) == [(n, k) for k, n in wanted if k is None or k % 2]
    assert sorted((r.n, r.k) for r in within.collect()) == [(n, k) for k, n in wanted if k is not None and k % 2 == 0]


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_rows_without(spark, monkeypatch, bits):
    """Rows that go are not dealt out to be dropped, unless their bit is that of a row that stays."""
    monkeypatch.setattr("tarnflow.llm.common.PASS_BITS", bits)
    rows = spark.createDataFrame([(k % 300 or None, k) for k in range(900)], "k long, n long")
    some = spark.createDataFrame([(k,) for k in range(0, 300, 2)], "k long")
    kept, spared = without(rows, "k", some)
    assert sorted((r.n, r.k) for r in kept.collect()) == [(k, k % 300 or None) for k in range(900) if not k % 300 or k % 2]
    assert (spared.count() > 0) == (bits == 64)


def test_lists_and_sets_stay_small(spark, monkeypatch):
    """Lists with the same members are one, and whole sets are not dealt out before a pair asks for them."""
    written, plain = {}, jaccard.materialize

    def held(df, label, *more):
        written.setdefault(label, []).append((df._jdf.queryExecution().executedPlan().toString(), out := plain(df, label, *more)))
        if label == "jaccard-lists":
            written["rows"] = [tuple(r) for r in out.select("set_id", "hub").collect()]
        return out

    monkeypatch.setattr(jaccard, "materialize", held)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(4)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.component_id for r in found.collect()] == [0] * 4
    # Two classes of size at most for each of three sets and its hub; the prefix has 40 shared tokens.
    assert 3 <= len(written["rows"]) <= 2 * 3 and len(set(written["rows"])) == 3
    assert "Exchange" not in written["jaccard-sets"][0][0]


def test_wide_sketches_tell_long_sets_apart(spark):
    """Folded to the shorter one's length they bound what sets differ in, and few pairs of long unlike sets pass."""
    rnd = np.random.default_rng(5)
    whole = rnd.integers(0, 1 << 63, 12_000, dtype=np.uint64)
    pairs = [(whole[:3000], whole[3000:6500]), (whole[:4000], whole[100:4200]), (whole[:5], whole[2:9]), (whole, whole[:3000]), (whole[:1], whole[:1])]
    rows = [tuple([int(x) for x in jaccard.wide_sketch_of(s).view(np.int64)] for s in pair) for pair in pairs]
    found = [r[0] for r in spark.createDataFrame(rows, "x array<long>, y array<long>").select(jaccard.places_apart("x", "y")).collect()]
    differ = [len(np.setxor1d(a, b)) for a, b in pairs]
    assert all(f <= d for f, d in zip(found, differ, strict=True)) and found[-1] == 0
    assert 190 * found[0] > 10 * 6500 and 180 * found[0] > 20 * 6500 and 190 * found[1] <= 10 * 8100
    for (a, b), n in zip(pairs, found, strict=True):
        places = min(64 * len(jaccard.wide_sketch_of(s)) for s in (a, b))
        assert n == int(np.bitwise_count((jaccard.sketch_of(a, places) ^ jaccard.sketch_of(b, places)).view(np.uint64)).sum())


def test_mix_of_many_equal_rows(spark, sf_dir):
    """Equal rows on both sides of a source's cut are taken as often as their plans say together."""
    rows = [(1, "a b c d", "en", "x", 7)] * 5 + [(k, "w " * k, "en", ["y", None][k % 2], 2 * k) for k in range(2, 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    found = dict(corpus_pipeline.STAGES)["mix_sources"](spark, docs, sf_dir)
    digested = docs.select(corpus_pipeline._content(docs).alias("key"), "text", "source", "doc_id").collect()
    times = plain_mix([(r.key, r.text, r.source) for r in digested])
    assert len({n for r, n in zip(digested, times, strict=True) if r.doc_id == 1}) == 2
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r, n in zip(digested, times, strict=True) for _ in range(n))


def test_pairs_are_dealt_once(spark):
    keyed = spark.createDataFrame([(1, 1, 9, 0, True), (1, 2, 9, 0, True)], "key long, set_id long, n long, pos long, out boolean")
    labels = spark.createDataFrame([], "node long, root long")
    sketches = spark.createDataFrame([(k, [0] * 16) for k in (1, 2)], "set_id long, sketch array<long>")
    pairs = jaccard.pairs_of(keyed, F.lit(True), labels, sketches, 80)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    assert "hashpartitioning(key#" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(key#\d+L?, root", plan)


def test_ids_are_counted_a_batch_at_a_time(monkeypatch):
    rnd, calls, plain = np.random.default_rng(3), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or plain(*a, **k))
    batches, wanted = [], np.zeros(1 << 17, np.int64)
    for widths in ([2] * 200, [2, 4] * 50, []):
        ids = [rnd.integers(0, 1 << (16 if w == 2 else 17), rnd.integers(0, 9)) for w in widths]
        for some in ids:
            np.add.at(wanted, some, 1)
        batches.append(pa.RecordBatch.from_arrays([pa.array(widths, pa.int32()), pa.array([i.astype(f"<u{w}").tobytes() for i, w in zip(ids, widths, strict=True)], pa.binary())], names=["width", "ids"]))
    found = token_files.tally(iter(batches))
    assert len(calls) == 3 and found.sum() == wanted.sum() and (found == wanted[: len(found)]).all()
