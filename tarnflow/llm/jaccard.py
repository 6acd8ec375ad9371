"""N-gram Jaccard self-join with prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches the threshold must share a token among the
first ``n - ceil(t n) + 1`` of both under *any* global order, so a pair is a candidate only if it
shares prefix tokens under all orders. The first order puts shingles with rare words first, by counts
of words over all documents kept in a table of fixed size; it generates candidates by posting
lists. The others are seeded hashes, tested on these before any set is verified.

Posting lists are keyed by token and size class, so documents of incomparable sizes never
meet. In a list with several classes all are first compared with one hub. Those that
link to it are in one component, whatever their pairs. Where many sets are akin to a hub,
those that do not link to it are not paired with the rest of the list: the majority of
the sets akin to the hub gives a centre, and what each differs from the centre in is
small. Two sets of which one lies further out than the innermost one can reach must
share such differences, and a second prefix filter over these, rare ones first, finds the
few pairs that do. All other sets of a list meet only sets that are not yet in their
component. A large group of near copies thus costs one comparison per member
instead of all its pairs, and no link between components can be lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import discard, map_batches, materialize, table
from tarnflow.llm.components import connected_components

WORDS = 3
#: Similarity in hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Counters of the frequency table. Words that share one are taken for equally frequent,
#: which can only make candidates fewer or more, not the result wrong.
COUNTERS = 1 << 22
CHUNKS = 64
#: Seeds of the token orders; the first breaks ties of frequency.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Bytes of text hashed in one go, and bits of the filter on texts that are read again.
SEGMENT = 1 << 18
FILTER_BITS = 1 << 25
#: Tables that one task adds up, and members from which a group is large. Neither changes the result.
FAN_IN = 64
LARGE = 32
#: Members of a list, one after the other, that all its other members are compared with before any two are paired.
TURNS = 1
#: Places of the sketch that tells how much two sets differ in at least.
SKETCH = 1024
#: Set names that a task remembers, to give each set's tokens once. This does not change the result.
SEEN = 1 << 20
#: Set names that may be broadcast (8 bytes each), to read only these sets; more are joined.
BROADCAST_NAMES = 1 << 19
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = tuple(np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
#: Lower-cases A-Z and makes every separator a blank.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text, by a rolling polynomial over its bytes."""
    folded = text.translate(_FOLD)
    found, at = [], 0
    while at < len(folded):
        end = min(len(folded), at + SEGMENT)
        if end < len(folded):
            cut = folded.rfind(b" ", at, end)
            if cut < 0:  # a word longer than a segment
                cut = folded.find(b" ", end)
            end = cut if cut >= 0 else len(folded)
        data = np.frombuffer(folded, np.uint8, end - at, at)
        inside = np.concatenate([[False], data != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            up, down = _powers(len(data))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
            found.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _PLACE[3]))
        at = end + 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        total = mix(total + hashes[k : len(hashes) - width + 1 + k] * _PLACE[k % 3])
    return total


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    hashes = word_hashes(text)
    return np.unique(_shingles(hashes, words)) if len(hashes) else hashes


def _counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.intp)


def rare_first(text: bytes, counters: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text in the first order: by their rarest word, then by hash."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    shingles, width = _shingles(hashes, words), min(words, len(hashes))
    counts = counters[_counter_of(hashes)]
    rarity = counts[: len(shingles)]
    for k in range(1, width):
        rarity = np.minimum(rarity, counts[k : k + len(shingles)])
    tokens, at = np.unique(shingles, return_index=True)
    return tokens[np.lexsort((tokens, rarity[at]))]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, seed: int, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set under an order, as their ranks in it."""
    ranks = mix(tokens ^ np.uint64(seed))
    size = prefix_length(len(ranks), percent)
    return ranks if size >= len(ranks) else np.partition(ranks, size - 1)[:size]


def count_words(documents: DataFrame, text_col: str) -> np.ndarray:
    """How often words occur, in COUNTERS counters: summed in tasks, then up a tree of chunks.

    One call adds at most FAN_IN tables of a chunk, however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, _counter_of(word_hashes((text.as_py() or "").encode("utf-8"))), 1)
        blobs = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]
        task = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in rows["counts"])
        held = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1] // FAN_IN, "counts": [zlib.compress(held.tobytes(), 1)]})

    schema = "chunk int, part int, counts binary"
    texts = documents.select(documents[text_col].alias("text"))
    partial, tables = map_batches(texts, run, schema), texts.rdd.getNumPartitions()
    while tables > 0:
        partial = partial.groupBy("chunk", "part").applyInPandas(add, schema)
        tables = (tables - 1) // FAN_IN
    counters = np.zeros(COUNTERS, np.uint32)
    for row in partial.collect():
        np.split(counters, CHUNKS)[row["chunk"]][:] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return counters


def size_class(n: Column, percent: int = PERCENT) -> Column:
    """Sizes that can be similar are in the same or in neighbouring classes."""
    return F.floor(F.log(n) / (math.log(100 / percent) * 1.001)).cast("int")


def sketch_of(tokens: np.ndarray, places: int = SKETCH) -> np.ndarray:
    """For each of some places, a power of 2, whether an odd number of tokens falls on it, as 64-bit words.

    Two sets differ in at least as many tokens as their sketches in places. The halves of a
    sketch, one xor the other, are the sketch with half the places.
    """
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.intp) % places, minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch_of(tokens: np.ndarray) -> np.ndarray:
    """:func:`sketch_of` with two places for each token at least, so that it tells long sets apart too."""
    return sketch_of(tokens, max(64, 1 << min(24, (2 * len(tokens) - 1).bit_length())))


def places_apart(a: str, b: str) -> Column:
    """In how many places two sketches differ, the longer one folded to the length of the other."""
    words = F.least(F.size(a), F.size(b))

    def folded(sketch: str, word: Column) -> Column:
        return F.aggregate(F.sequence(word, F.size(sketch) - 1, words), F.lit(0).cast("long"), lambda met, at: met.bitwiseXOR(F.get(sketch, at)))

    return F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda found, word: found + F.bit_count(folded(a, word).bitwiseXOR(folded(b, word))))


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets, equal names."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens ^ _PLACE[0]).sum() + np.uint64(len(tokens)) * _PLACE[1]], np.uint64)).view(np.int64)[0])


def profiles(documents: DataFrame, id_col: str, text_col: str, words: int, percent: int, counters: np.ndarray) -> DataFrame:
    """``doc_id, set_id, n, tokens, sketch``: name and size of each set, its prefix in the first order, and :func:`sketch_of` it.

    Of equal sets that one task meets only one has tokens and sketch.
    """
    narrow = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, counts, tokens, sketches = [], [], [], []
            for text in batch.column("text"):
                found = rare_first((text.as_py() or "").encode("utf-8"), counters, words)
                counts.append(len(found))
                names.append(class_of(found) if len(found) else None)
                new = names[-1] is not None and names[-1] not in seen
                tokens.append(found[: prefix_length(len(found), percent)].view(np.int64) if new else [])
                sketches.append(sketch_of(found) if new else None)
                if new and len(seen) < SEEN:
                    seen.add(names[-1])
            columns = [batch.column("doc_id"), pa.array(names, pa.int64()), pa.array(counts, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (tokens, sketches)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_id", "n", "tokens", "sketch"])

    return map_batches(narrow, run, f"doc_id {kind}, set_id long, n long, tokens array<long>, sketch array<long>")


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the set names that are wanted."""
    slot = F.pmod(F.col("set_id"), F.lit(FILTER_BITS))
    packed = wanted.select(F.floor(slot / 64).alias("word"), F.pmod(slot, F.lit(64)).alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS int))")).alias("bits"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for row in packed.toLocalIterator():
        words[row["word"]] = row["bits"]
    return words.view(np.uint64)


def wanted_sets(documents: DataFrame, wanted: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """``set_id, n, all, second, third, wide`` of the sets named in ``wanted`` at least.

    Texts are read again. A bitmap of fixed size lets most other sets go, and nothing is
    shuffled: :func:`distinct_sets` tells equal sets of several tasks apart where they are
    dealt out for a join, and joins are exact, however full the bitmap is.
    """
    bitmap = _filter_of(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                tokens = shingle_set((text.as_py() or "").encode("utf-8"), words)
                if not len(tokens):
                    continue
                name = class_of(tokens)
                slot = name % FILTER_BITS
                if name in seen or not (int(bitmap[slot >> 6]) >> (slot & 63)) & 1:
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                # Half of a rank is enough for a filter: equal tokens stay equal.
                rows.append((name, len(tokens), tokens.view(np.int64), *[(prefix(tokens, seed, percent) >> np.uint64(32)).astype(np.uint32).view(np.int32) for seed in ORDERS[1:]], wide_sketch_of(tokens)))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["set_id", "n", "all", "second", "third", "wide"])

    found = map_batches(documents.select(documents[text_col].alias("text")), run, "set_id long, n long, all array<long>, second array<int>, third array<int>, wide array<long>")
    return materialize(found, "jaccard-sets")


def distinct_sets(sets: DataFrame, *columns: str) -> DataFrame:
    """``set_id`` and columns that it determines, one row each."""
    return sets.groupBy("set_id").agg(*[F.min(c).alias(c) for c in columns])


def named(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that occur in ``pairs`` (a written table), if their names are few enough to be sent to all tasks; else all."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    return sets.join(F.broadcast(names), "set_id", "left_semi") if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else sets


def filtered(pairs: DataFrame, sets: DataFrame, percent: int | None, made: list[DataFrame]) -> DataFrame:
    """Pairs that pass the filters of size, of the other orders and of wide sketches, with both sets: ``a, b, n_a, n_b, all_a, all_b``.

    Without ``percent`` size and sketches do not matter, and one of the other orders is enough.
    ``made`` gets the tables that the result reads.
    """

    def side(some: DataFrame, name: str, *columns: str) -> DataFrame:
        return distinct_sets(some, *columns).select(F.col("set_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    second, third = F.arrays_overlap("second_a", "second_b"), F.arrays_overlap("third_a", "third_b")
    if percent is None:
        similar = second | third
    else:
        similar = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & second & third
        similar = similar & ((100 + percent) * places_apart("wide_a", "wide_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    tested = ("n", "second", "third") if percent is None else ("n", "second", "third", "wide")
    pairs = materialize(pairs, "jaccard-pairs")
    some = named(sets, pairs)
    near = pairs.join(side(some, "a", *tested), "a").join(side(some, "b", *tested), "b").where(similar).select("a", "b", "n_a", "n_b")
    near = materialize(near, "jaccard-candidates")
    made += [pairs, near]
    some = named(sets, near)
    return near.join(side(some, "a", "all"), "a").join(side(some, "b", "all"), "b")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int, made: list[DataFrame]) -> DataFrame:
    """``a, b`` of the pairs that link, by their exact intersection."""
    counted = filtered(pairs, sets, percent, made).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("all_a", "all_b")).alias("inter"))
    return counted.where(100 * F.col("inter") >= percent * (F.col("n_a") + F.col("n_b") - F.col("inter"))).select("a", "b")


def compare_with_hubs(pairs: DataFrame, sets: DataFrame, percent: int, made: list[DataFrame]) -> DataFrame:
    """``set_id, hub, n, n_hub, link, more, less`` of the sets that are akin to their hub.

    ``more`` are the tokens that the set has beyond the hub's, ``less`` those it lacks. Sets
    with a similarity to the hub below 0.2, or found by none of the other orders, are not akin.
    """
    both = filtered(pairs, sets, None, made).select(
        F.col("a").alias("set_id"), F.col("b").alias("hub"), F.col("n_a").alias("n"), F.col("n_b").alias("n_hub"), F.array_except("all_a", "all_b").alias("more"), F.array_except("all_b", "all_a").alias("less")
    )
    inter, union = F.col("n") - F.size("more"), F.col("n_hub") + F.size("more")
    return both.where(5 * inter >= union).withColumn("link", 100 * inter >= percent * union)


def centred(compared: DataFrame) -> DataFrame:
    """``hub, set_id, n, tokens`` of the members of large hubs: what they differ from their centre in.

    The centre has every token that most members have. Members are the sets akin to the hub
    and the hub. ``tokens`` are the tokens that only one of member and centre has: those in
    which it differs from the hub, but for what most members differ in, and what of that it
    does not differ in.
    """
    sizes = compared.groupBy("hub").agg(F.count("*").alias("members"), F.max(~F.col("link")).alias("open"), F.max("n_hub").alias("n_hub"))
    large = materialize(sizes.where((F.col("members") > LARGE) & F.col("open")).select("hub", "members", "n_hub"), "jaccard-large")
    members = compared.join(large.select("hub", "members"), "hub").select("hub", "set_id", "n", "members", F.concat("more", "less").alias("differs"))
    members = materialize(members, "jaccard-members")
    counts = members.select("hub", "members", F.explode("differs").alias("token")).groupBy("hub", "token").agg(F.count("*").alias("times"), F.max("members").alias("members"))
    # Twice the mean size of a difference at most.
    shared = counts.where(2 * F.col("times") > F.col("members") + 1).groupBy("hub").agg(F.collect_list("token").alias("shared"))
    shared = materialize(shared, "jaccard-shared")
    hubs = large.select("hub", F.col("hub").alias("set_id"), F.col("n_hub").alias("n"), F.array().cast("array<bigint>").alias("differs"))
    both = members.drop("members").unionByName(hubs).join(shared, "hub", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))
    tokens = F.concat(F.array_except("differs", "shared"), F.array_except("shared", "differs"))
    found = materialize(both.select("hub", "set_id", "n", tokens.alias("tokens")), "jaccard-centred")
    discard(large, members, shared)
    return found


def pairs_by_difference(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` that are certain, and ``key, set_id, n, gap, pos, out`` by which others are found.

    Let ``gap`` be the distance of a member from the centre, in tokens. Two members whose gaps
    add up to at most ``(100 - percent) / (100 + percent)`` of their joint size are similar for
    certain, so ``reach = (100 - percent) n - (100 + percent) gap`` tells how much room a
    member leaves, and the one with the largest reach links to all that link to any
    member in this way. The others are ``out``. One of them and any member can be similar only
    if their differences from the centre share at least
    ``(gap + gap' - (100 - percent) / (100 + percent) (n + n')) / 2`` tokens, which is above 0.
    So they share one of their first tokens under any order, early enough to leave room for
    the rest. The order is by frequency in the group; tokens that one member has alone come
    first and need no key.
    """
    less, more = 100 - percent, 100 + percent
    gaps = members.select("hub", "set_id", "n", F.size("tokens").cast("long").alias("gap")).withColumn("reach", less * F.col("n") - more * F.col("gap"))
    inmost = gaps.groupBy("hub").agg(F.max(F.struct("reach", "set_id")).alias("best")).select("hub", F.col("best.reach").alias("most"), F.col("best.set_id").alias("inmost"))
    placed = gaps.join(inmost, "hub").withColumn("out", F.col("reach") + F.col("most") < 0)
    placed = materialize(placed, "jaccard-placed")
    sure = placed.where("not out AND set_id <> inmost").select(F.col("set_id").alias("a"), F.col("inmost").alias("b"))
    # At least so many tokens are common to the member and any that is out (any other, if it is out).
    own, other = F.col("most") + F.col("reach"), F.col("most") - F.col("reach")
    common = F.when(F.col("out"), F.greatest(F.lit(1), F.ceil(-own / (2 * more)))).otherwise(F.floor(other / (2 * more)) + 1)

    tokens = members.select("hub", "set_id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("hub", "token").agg(F.count("*").alias("times")).where("times > 1")
    ranked = tokens.join(counts, ["hub", "token"]).groupBy("hub", "set_id").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("ranked"))
    first = placed.select("hub", "set_id", "n", "gap", "out", common.alias("common")).join(ranked, ["hub", "set_id"])
    alone = F.col("gap") - F.size("ranked")
    first = first.select("hub", "set_id", "n", "gap", "out", "common", alone.alias("alone"), F.posexplode("ranked").alias("nth", "token"))
    first = first.withColumn("pos", F.col("alone") + F.col("nth")).where(F.col("pos") < F.col("gap") - F.col("common") + 1)
    return sure, first.select(F.xxhash64("hub", "token.token").alias("key"), "set_id", "n", "gap", "pos", "out")


def heads(keyed: DataFrame) -> DataFrame:
    """``key, head`` of the keys that more than LARGE sets share, among them some that are out."""
    return keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("set_id").alias("head"), F.max("out").alias("open")).where((F.col("size") > LARGE) & F.col("open")).select("key", "head")


def pairs_of(keyed: DataFrame, near: Column, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` under one key that are not in one component yet, at least one of them out.

    ``near`` is a condition on the rows ``x`` and ``y``; sets whose sketches differ too much are no pair either. Of two sets in different components one at
    least is outside the component that has most sets of the key; only such sets meet the others.
    """
    rows = keyed.join(labels, keyed["set_id"] == labels["node"], "left").withColumn("root", F.coalesce("root", "set_id")).drop("node")
    # Sketches make these rows long: they are dealt once, for both windows and the pairs.
    rows = rows.join(sketches, "set_id").repartition("key")
    same, key = Window.partitionBy("key", "root"), Window.partitionBy("key")
    rows = rows.withColumn("size", F.count("*").over(same)).withColumn("any_out", F.max("out").over(same))
    rows = rows.withColumn("largest", F.max(F.struct("size", "root", "any_out")).over(key))
    rows = rows.withColumn("asks", (F.col("root") != F.col("largest.root")) & (F.col("out") | F.col("largest.any_out")))
    rows = rows.withColumn("any_asks", F.max("asks").over(key)).where("any_asks").drop("largest", "size", "any_out", "any_asks")
    x, y = rows.where("asks").alias("x"), rows.alias("y")
    once = ~F.col("y.asks") | (F.col("x.set_id") < F.col("y.set_id"))
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.out") | F.col("y.out"))
    differ = sum((F.bit_count(F.col("x.sketch")[k].bitwiseXOR(F.col("y.sketch")[k])) for k in range(SKETCH // 64)), F.lit(0))
    near = near & ((100 + percent) * differ <= (100 - percent) * (F.col("x.n") + F.col("y.n")))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & apart & once & near).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))


def star_of(keyed: DataFrame, near: Column, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a, b`` of each set of a key with one of them, another at each ``turn``, if they are not in one component yet.

    A key whose sets are mostly alike falls into few components by this, so that hardly any of its pairs are left.
    """
    rows = keyed.join(labels, keyed["set_id"] == labels["node"], "left").withColumn("root", F.coalesce("root", "set_id")).drop("node")
    head = F.min(F.struct(F.xxhash64("set_id", F.lit(turn)).alias("rank"), "set_id", "root", "n", "pos", "out")).over(Window.partitionBy("key"))
    rows = rows.withColumn("head", head)
    rows = rows.select(F.struct("set_id", "root", "n", "pos", "out").alias("x"), F.col("head").alias("y"))
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.out") | F.col("y.out"))
    return rows.where(apart & near).select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def jaccard_components(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest id reachable by links. Texts with fewer than ``words``
    words have their whole sequence as one shingle. Null and empty texts have the empty set,
    link with nothing and are their own component. Equal texts are one class, so copies
    are never paired; repeated rows each give a row. Other columns are ignored; no
    rows give no rows. Sets are told apart by 64-bit hashes of their shingles.
    """
    counters = count_words(documents, text_col)
    profile = materialize(profiles(documents, id_col, text_col, words, percent, counters), "jaccard-profiles")
    tokens = profile.where("n > 0").select("set_id", "n", F.posexplode("tokens").alias("pos", "token"))
    # Size and place in one number, and size classes only once the tokens are dealt out: this is the largest thing that is.
    dealt = tokens.select("token", "set_id", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("place")).repartition("token")
    # Equal sets that several tasks met are told from others where their tokens lie, not by shuffling whole lists of tokens before.
    dealt = dealt.dropDuplicates(["token", "set_id", "place"])
    size = size_class(F.shiftright("place", 32), percent)
    lists = dealt.select("token", "set_id", "place", F.explode(F.array(size, size - 1)).alias("size"))
    whole = Window.partitionBy("token", "size")
    bounds = {name: f(F.struct("set_id", "place")).over(whole) for name, f in (("first", F.min), ("last", F.max))}
    whose = F.bit_xor(F.xxhash64("set_id")).over(whole)
    shared = lists.withColumns(bounds | {"members": F.count("*").over(whole), "whose": whose}).where("first.set_id < last.set_id AND set_id <> first.set_id")

    def n_of(place: str) -> Column:
        return F.shiftright(place, 32)

    def after(place: str) -> Column:
        """Tokens of a set from the shared one on, in the first order."""
        return n_of(place) - F.col(place).bitwiseAND(F.lit((1 << 32) - 1))

    def can_link(x: str, y: str) -> Column:
        most = (100 + percent) * F.least(after(x), after(y)) >= percent * (n_of(x) + n_of(y))
        return most & (100 * F.least(n_of(x), n_of(y)) >= percent * F.greatest(n_of(x), n_of(y)))

    # Two sets alone in a list that cannot link by the places of the token have nothing to do with each other here.
    shared = shared.where((F.col("members") > 2) | can_link("first.place", "last.place"))
    to_hub = can_link("place", "first.place").alias("near_hub")
    # Lists with the same members are one, with the least place of each member; should others fall together with them, more pairs are looked at.
    shared = shared.select(F.xxhash64("whose", "first.set_id", "members").alias("list"), "set_id", F.col("first.set_id").alias("hub"), n_of("place").alias("n"), (n_of("place") - after("place")).alias("pos"), to_hub, (F.col("members") > 2).alias("several"))
    shared = shared.groupBy("list", "set_id", "hub", "n").agg(F.min("pos").alias("pos"), F.max("near_hub").alias("near_hub"), F.max("several").alias("several"))
    shared = materialize(shared, "jaccard-lists")

    made: list[DataFrame] = []
    sets = wanted_sets(documents, shared.select(F.explode(F.array("set_id", "hub")).alias("set_id")).distinct(), text_col, words, percent)
    to_hub = shared.where("near_hub").select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct()
    compared = materialize(compare_with_hubs(to_hub, sets, percent, made), "jaccard-hubs")
    members = centred(compared)
    sure, keyed = pairs_by_difference(members, percent)
    keyed = materialize(keyed, "jaccard-differences")
    links = materialize(compared.where("link").select(F.col("set_id").alias("a"), F.col("hub").alias("b")).union(sure), "jaccard-links")
    # Many that are far out may be near each other: first all of a key with one of them.
    some = materialize(heads(keyed), "jaccard-heads")
    star = keyed.join(some, "key").where("set_id <> head").select(F.least("set_id", "head").alias("a"), F.greatest("set_id", "head").alias("b")).distinct()
    if not some.isEmpty():
        made.append(links)
        links = materialize(links.union(linked_pairs(star, sets, percent, made)), "jaccard-links")
    labels = connected_components(links)

    less, more = 100 - percent, 100 + percent
    room = 2 * F.least(F.col("x.gap") - F.col("x.pos"), F.col("y.gap") - F.col("y.pos"))
    close = more * (F.col("x.gap") + F.col("y.gap") - room) <= less * (F.col("x.n") + F.col("y.n"))

    # Sets that are neither linked to the hub nor members of its group, with all others of the list.
    done = compared.where("link").select("set_id", "hub").union(members.select("set_id", "hub")).distinct().withColumn("done", F.lit(True))
    others = shared.where("several").join(done, ["set_id", "hub"], "left")
    others = materialize(others.select(F.col("list").alias("key"), "set_id", "n", "pos", F.col("done").isNull().alias("out")), "jaccard-others")
    fits = more * F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= percent * (F.col("x.n") + F.col("y.n"))
    for turn in range(TURNS):
        star = linked_pairs(star_of(others, fits, labels, turn), sets, percent, made)
        made.append(links)
        links = materialize(links.union(star), "jaccard-links")
        discard(labels)
        labels = connected_components(links)
    sketches = distinct_sets(profile.where("sketch IS NOT NULL"), "sketch")
    by_difference = pairs_of(keyed, close, labels, sketches, percent)
    in_list = pairs_of(others, fits, labels, sketches, percent)

    rest = by_difference.union(in_list).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = connected_components(links.union(linked_pairs(rest, sets, percent, made)))
    # All that follows reads roots and profiles only.
    discard(shared, sets, compared, members, keyed, some, links, labels, others, *made)

    names = profile.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    rooted = names.join(roots, names["set_id"] == roots["node"], "left").select("set_id", "first", F.coalesce("root", "set_id").alias("root"))
    rooted = materialize(rooted, "jaccard-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    component = materialize(rooted.join(least, "root").select("set_id", "component_id"), "jaccard-components")
    discard(roots, rooted)
    return profile.join(component, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5(spark, sf_dir):
    """Joins all ``documents``; see :func:`jaccard_components`."""
    return jaccard_components(table(spark, sf_dir, "documents"))
