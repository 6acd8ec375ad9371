"""Near-duplicate embeddings by counting collisions on many one-dimensional projections.

Unit vectors are projected on seeded random directions and sorted on each. Two vectors
collide on a direction if one stands in the run of places that the window around the other
covers; similar vectors collide on most, others on few. The count that a pair must reach
follows from the collision probability at the similarity asked for and the recall wanted.
Pairs that reach it are verified in double precision, so no link is ever wrong.

The projections that are sorted first, the anchors, keep most pairs from being counted at
all: each cuts the line in two, a vector is filed under the sides it lies on, and looks
under all sides that its window reaches. Large cells are cut into blocks that meet pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import discard, map_batches, materialize, table
from tarnflow.llm.components import connected_components

THRESHOLD = 0.9
#: Counted projections, half width of a window (projections of unit vectors have deviation 1), recall of the count.
COUNTED = 24
WINDOW = 0.75
RECALL = 0.99
#: Half width of a single anchor's window (see reach() for more anchors), vectors wanted in a cell, anchors at most.
REACH = 0.6
CELL = 2000
MOST_ANCHORS = 12
#: Vectors of a block; a task compares two blocks at a time.
BLOCK = 2048
TILE = 512
SEED = 4


def collision_probability(cosine: float, window: float) -> float:
    """Probability that unit vectors of this cosine fall within a window on a Gaussian projection."""
    deviation = math.sqrt(2 - 2 * cosine)
    return math.erf(window / (deviation * math.sqrt(2))) if deviation else 1.0


def required_count(cosine: float = THRESHOLD, counted: int = COUNTED, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that pairs of this cosine reach with the recall wanted."""
    p, tail = collision_probability(cosine, window), 0.0
    for count in range(counted, -1, -1):
        tail += math.comb(counted, count) * p**count * (1 - p) ** (counted - count)
        if tail >= recall:
            return count
    return 0


def anchor_loss(width: float, anchors: int, cosine: float) -> float:
    """Share of the pairs of this cosine that anchors with windows of this half width keep from being met."""
    deviation = math.sqrt(max(1e-12, 1 - cosine * cosine))
    at = width + (np.arange(4000) + 0.5) * 0.002
    density = 2 * np.exp(-at * at / 2) / math.sqrt(2 * math.pi) * 0.002
    # On one anchor the two lie apart, and the one (or both) beyond the window.
    one, both = (sum(d * math.erfc((cosine * x + beyond) / (deviation * math.sqrt(2))) / 2 for d, x in zip(density.tolist(), at.tolist(), strict=True)) for beyond in (0.0, width))
    return 1 - 2 * (1 - one) ** anchors + (1 - 2 * one + both) ** anchors


@lru_cache(maxsize=64)
def reach(anchors: int, cosine: float = THRESHOLD) -> float:
    """Half width of the anchors' windows, REACH at least: jointly they lose no more than a single one with REACH does at THRESHOLD."""
    most = anchor_loss(REACH, 1, THRESHOLD)
    low, high = 0.0, 8.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if anchor_loss(middle, anchors, cosine) > most else (low, middle)
    return max(REACH, high)


@lru_cache(maxsize=16)
def directions(dim: int, anchors: int) -> np.ndarray:
    """Seeded directions (dim, anchors + COUNTED); Gaussian, so that the unit vectors' projections have deviation about 1."""
    return np.random.default_rng([SEED, dim]).normal(size=(dim, MOST_ANCHORS + COUNTED))[:, [*range(anchors), *range(MOST_ANCHORS, MOST_ANCHORS + COUNTED)]]


def unit(values: bytes) -> np.ndarray:
    """The unit vector of stored doubles."""
    vector = np.frombuffer(values, np.float64)
    return vector / np.sqrt(vector @ vector)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, values``: components as doubles in binary, null where the vector links with nothing."""
    narrow = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = dict(narrow.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat, ends = vectors.values, vectors.offsets.to_numpy()
            parts = flat.to_numpy(zero_copy_only=False) + 0.0  # null components become NaN, -0 becomes 0
            out = []
            for begin, end, there in zip(ends[:-1].tolist(), ends[1:].tolist(), vectors.is_valid().to_pylist(), strict=True):
                vector = parts[begin:end] if there else parts[:0]
                most = np.abs(vector).max(initial=0.0)  # NaN if a component is
                # Dividing by the largest component keeps squares from overflowing or vanishing.
                out.append((vector / most).tobytes() if 0 < most < math.inf else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "values"])

    return map_batches(narrow, run, f"vec_id {kind}, values binary")


def _file(classes: DataFrame, anchors: int, width: float) -> DataFrame:
    """``cell, query, class_id, copies, values``: a row under the own cell, and one under every cell to look in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows: list[tuple] = []
                for name, copies, stored in zip(part.column("class_id").to_pylist(), part.column("copies").to_pylist(), part.column("values"), strict=True):
                    values = stored.as_py()
                    vector = unit(values)
                    at = vector @ directions(len(vector), anchors)[:, :anchors]
                    own = sum(1 << j for j in range(anchors) if at[j] > 0)
                    cells = [own]
                    for j in range(anchors):
                        if abs(at[j]) < width:
                            cells += [c ^ (1 << j) for c in cells]
                    base = len(vector) << MOST_ANCHORS
                    rows.append((base + own, False, name, copies, values))
                    rows += [(base + c, True, name, copies, values) for c in cells]
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["cell", "query", "class_id", "copies", "values"])

    return map_batches(classes, run, "cell long, query boolean, class_id long, copies long, values binary")


def _roots(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name reachable from each of ``n`` nodes by links a-b."""
    label = names.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            return label


def windows(index: np.ndarray, query: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Collisions on one projection by place in its sorted order.

    Gives the place of every index vector, and for every query the first place and the
    number of places that its window covers.
    """
    order = np.argsort(index, kind="stable")
    place = np.empty(len(order), np.uint16)
    place[order] = np.arange(len(order), dtype=np.uint16)
    first, beyond = np.searchsorted(index[order], query - half, "left"), np.searchsorted(index[order], query + half, "right")
    return place, first.astype(np.uint16), (beyond - first).astype(np.uint16)


def compare(index: pd.DataFrame, query: pd.DataFrame, anchors: int, width: float, threshold: float) -> pd.DataFrame:
    """Links between two blocks of a cell: ``class_id, links, root`` of every vector that has one."""
    need = required_count(threshold)
    x, q = (np.stack([unit(v) for v in side["values"]]) for side in (index, query))
    ways = directions(x.shape[1], anchors)
    px, pq = x @ ways, q @ ways
    runs = [windows(px[:, j], pq[:, j], WINDOW) for j in range(anchors, anchors + COUNTED)]
    names_x, names_q = index["class_id"].to_numpy(), query["class_id"].to_numpy()
    left, right = [], []
    for a in range(0, len(q), TILE):
        for b in range(0, len(x), TILE):
            count = np.zeros((min(TILE, len(q) - a), min(TILE, len(x) - b)), np.uint8)
            for place, first, covered in runs:
                # Unsigned, so places before the first wrap around and lie outside too.
                count += (place[None, b : b + TILE] - first[a : a + TILE, None]) < covered[a : a + TILE, None]
            i, k = np.nonzero(count >= need)
            i, k = i + a, k + b
            cosine = np.einsum("ij,ij->i", q[i], x[k])
            good = (cosine >= threshold) & (names_q[i] != names_x[k])
            left.append(i[good])
            right.append(k[good])
    i, k = np.concatenate(left), np.concatenate(right)
    # The pair is met again from the other side if that one's window reaches here; then only one side counts it.
    apart = (px[k, :anchors] > 0) != (pq[i, :anchors] > 0)
    again = (~apart | (np.abs(px[k, :anchors]) < width)).all(1)
    once = ~again | (names_q[i] < names_x[k])
    i, k = i[once], k[once]
    names = np.concatenate([names_q, names_x])
    unique, where = np.unique(names, return_inverse=True)
    a, b = where[i], where[len(names_q) + k]
    weight = np.zeros((2, len(unique)), np.int64)
    np.add.at(weight[0], a, index["copies"].to_numpy()[k])
    np.add.at(weight[0], b, query["copies"].to_numpy()[i])
    root = _roots(len(unique), a, b, unique)
    some = weight[0] > 0
    return pd.DataFrame({"class_id": unique[some], "links": weight[0][some], "root": root[some]})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    Vectors of one length link when their cosine in double precision is at least
    ``threshold``. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing. Equal vectors are one class with a number of copies,
    each of which links with the others. Repeated rows each give a row and count as copies;
    other columns are ignored; no rows give no rows. ``component_id`` is the smallest id
    reachable by links, ``kept`` whether that is the row's own.

    Pairs are found with the recall of the count, at least RECALL at the threshold itself
    and more above it; anchors take less than 0.001 from it, however many the size calls for.
    """
    stored = materialize(_classes(vectors, id_col, vector_col).withColumn("class_id", F.xxhash64("values")), "embedding-values")
    good = stored.where(F.col("values").isNotNull())
    classes = materialize(good.groupBy("class_id", "values").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")), "embedding-classes")
    anchors = int(min(MOST_ANCHORS, max(0, math.log2(max(1, classes.count()) / CELL))))
    width = reach(anchors, threshold)
    filed = materialize(_file(classes.select("class_id", "copies", "values"), anchors, width), "embedding-cells")

    sizes = filed.groupBy("cell").agg(*[F.ceil(F.sum(F.col("query").cast("int") if is_query else 1 - F.col("query").cast("int")) / BLOCK).cast("int").alias(name) for name, is_query in (("q_blocks", True), ("x_blocks", False))])
    sized = filed.join(sizes.where("x_blocks > 0 AND q_blocks > 0"), "cell")
    own = F.pmod(F.xxhash64("class_id"), F.when(F.col("query"), F.col("q_blocks")).otherwise(F.col("x_blocks"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("x_blocks")).otherwise(F.col("q_blocks")) - 1))
    dealt = sized.withColumn("own", own).withColumn("meets", meets).select(
        "cell", F.when(F.col("query"), F.col("own")).otherwise(F.col("meets")).alias("q"), F.when(F.col("query"), F.col("meets")).otherwise(F.col("own")).alias("x"), "query", "class_id", "copies", "values"
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        index, query = rows[~rows["query"]], rows[rows["query"]]
        if not len(index) or not len(query):
            return pd.DataFrame({"class_id": [], "links": [], "root": []}).astype("int64")
        return compare(index, query, anchors, width, threshold)

    found = materialize(dealt.groupBy("cell", "q", "x").applyInPandas(run, "class_id long, links long, root long"), "embedding-links")
    roots = connected_components(found.where("class_id <> root").select("class_id", "root"), "class_id", "root")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    rooted = classes.select("class_id", "copies", "first").join(links, "class_id", "left").join(roots, F.col("class_id") == F.col("node"), "left")
    rooted = materialize(rooted.select("class_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("root")), "embedding-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    result = materialize(rooted.join(least, "root").select("class_id", "n_links", "component_id"), "embedding-components")
    rows = stored.select("vec_id", F.when(F.col("values").isNotNull(), F.col("class_id")).alias("class_id")).join(result, "class_id", "left")
    component = F.coalesce("component_id", "vec_id")
    discard(filed, found, rooted)
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4(spark, sf_dir):
    """Compares all ``embeddings``; see :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
