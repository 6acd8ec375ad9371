"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample
of labelled windows, labels every byte of every text, and pools the probabilities of
all positions of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tarnflow.llm.common import map_batches, table

UNDETERMINED = "und"
#: Documents of the training sample (split evenly over the languages) and windows of each.
SAMPLE_DOCUMENTS = 3000
#: Languages that a network can tell apart: the most frequent ones, ties by name.
MOST_LANGUAGES = 500
WINDOWS = 3
WINDOW_CHARS = 80
#: Network and training.
HIDDEN = 16
TRAIN_BYTES = 64
TRAIN_STEPS = 700
TRAIN_BATCH = 192
RATE = 0.015
#: Bytes that are run through the network in one piece, and pieces side by side.
SPAN = 256
SIDE = 512
#: Bytes of texts that are labelled together; a longer text goes alone.
TOGETHER = 1 << 20
PAD = 256


@dataclass
class Direction:
    """One gated recurrent layer: input table (3H, 257) and recurrent weights (3H, H)."""

    inputs: np.ndarray
    recurrent: np.ndarray


@dataclass
class Network:
    languages: list[str]
    ways: list[Direction]
    output: np.ndarray  # (L, 2H)
    bias: np.ndarray  # (L, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(way: Direction, data: np.ndarray, order: range) -> tuple[np.ndarray, list]:
    """States (T, H, B) of a layer over bytes (T, B), and what backward needs."""
    h_size = way.recurrent.shape[1]
    h = np.zeros((h_size, data.shape[1]), np.float32)
    states = np.empty((data.shape[0], *h.shape), np.float32)
    tape = []
    for t in order:
        x, a = way.inputs[:, data[t]], way.recurrent @ h
        gates = _sigmoid(x[: 2 * h_size] + a[: 2 * h_size])
        z, r, q = gates[:h_size], gates[h_size:], a[2 * h_size :]
        n = np.tanh(x[2 * h_size :] + r * q)
        tape.append((t, h, z, r, q, n))
        h = n + z * (h - n)
        states[t] = h
    return states, tape


def _backward(way: Direction, data: np.ndarray, tape: list, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights, through time."""
    h_size = way.recurrent.shape[1]
    d_rec = np.zeros_like(way.recurrent)
    d_in = np.empty((data.shape[0], 3 * h_size, data.shape[1]), np.float32)
    carry = np.zeros_like(upstream[0])
    for t, h, z, r, q, n in reversed(tape):
        dh = upstream[t] + carry
        d_n = dh * (1 - z) * (1 - n * n)
        d_z = dh * (h - n) * z * (1 - z)
        d_r = d_n * q * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_n * r])
        d_in[t] = np.concatenate([d_z, d_r, d_n])
        d_rec += d_a @ h.T
        carry = dh * z + way.recurrent.T @ d_a
    flat = data.ravel()
    rows = d_in.transpose(1, 0, 2).reshape(3 * h_size, -1)
    d_table = np.stack([np.bincount(flat, weights=row, minlength=PAD + 1) for row in rows]).astype(np.float32)
    return d_table, d_rec


def train_network(texts: list[bytes], labels: list[int], languages: list[str], hidden: int = HIDDEN, steps: int = TRAIN_STEPS, seed: int = 1) -> Network:
    """Fit the network with Adam; every position of a window carries the label of its document."""
    rng = np.random.default_rng(seed)
    n_lang = len(languages)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    ways = [Direction(draw(3 * hidden, PAD + 1, scale=0.3), draw(3 * hidden, hidden, scale=1 / np.sqrt(hidden))) for _ in range(2)]
    output, bias = draw(n_lang, 2 * hidden, scale=0.3), np.zeros((n_lang, 1), np.float32)
    weights = [ways[0].inputs, ways[0].recurrent, ways[1].inputs, ways[1].recurrent, output, bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    windows = np.full((len(texts), TRAIN_BYTES), PAD, np.int64)
    for k, text in enumerate(texts):
        windows[k, : min(len(text), TRAIN_BYTES)] = np.frombuffer(text[:TRAIN_BYTES], np.uint8)
    truth = np.array(labels)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(windows), min(TRAIN_BATCH, 4 * len(windows)))
        data = np.ascontiguousarray(windows[rows].T)
        real = data != PAD
        up, tape_up = _forward(ways[0], data, range(TRAIN_BYTES))
        down, tape_down = _forward(ways[1], data, range(TRAIN_BYTES - 1, -1, -1))
        states = np.concatenate([up, down], 1)
        logits = output @ states + bias
        logits -= logits.max(1, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(1, keepdims=True)
        delta = share
        delta[:, truth[rows], np.arange(len(rows))] -= 1
        delta *= real[:, None, :] / max(1, int(real.sum()))
        back = output.T @ delta
        grads = [
            *_backward(ways[0], data, tape_up, back[:, :hidden]),
            *_backward(ways[1], data, tape_down, back[:, hidden:]),
            np.einsum("tlb,thb->lh", delta, states, optimize=True),
            delta.sum((0, 2))[:, None],
        ]
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = RATE * min(1.0, step / 20) * (0.1 + 0.9 * (1 - step / steps))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(languages, ways, output, bias)


class Labeler:
    """The trained network, arranged for labelling many pieces side by side."""

    def __init__(self, network: Network) -> None:
        h = self.hidden = network.ways[0].recurrent.shape[1]
        self.network = network
        # Exponentials are all that a step needs: sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 1 - 2 / (1 + exp(2 x)).
        scale = np.full((3 * h, 1), 2, np.float32)
        scale[: 2 * h] = -1
        self.ways = []
        for way in network.ways:
            inputs = way.inputs * scale
            inputs[:h, PAD] = -60.0  # padding keeps the state as it is
            self.ways.append((np.ascontiguousarray(inputs), np.ascontiguousarray(way.recurrent * scale)))

    def states(self, data: np.ndarray) -> np.ndarray:
        """States (T, 2H, B) over bytes (T, B) in both directions."""
        h_size, (steps, side) = self.hidden, data.shape
        out = np.empty((steps, 2 * h_size, side), np.float32)
        x, a, d = (np.empty((n * h_size, side), np.float32) for n in (3, 3, 1))
        gates, n, q = x[: 2 * h_size], x[2 * h_size :], a[2 * h_size :]
        z, r, one, two = gates[:h_size], gates[h_size:], np.float32(1), np.float32(2)
        with np.errstate(over="ignore"):  # exp reaches infinity where a gate is shut
            for way, (inputs, recurrent) in enumerate(self.ways):
                h = np.zeros((h_size, side), np.float32)
                for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                    np.take(inputs, data[t], axis=1, out=x, mode="clip")
                    np.dot(recurrent, h, out=a)
                    gates += a[: 2 * h_size]
                    np.exp(gates, out=gates)
                    gates += one
                    np.divide(one, gates, out=gates)
                    q *= r
                    n += q
                    np.exp(n, out=n)
                    n += one
                    np.divide(two, n, out=n)
                    np.subtract(one, n, out=n)
                    np.subtract(h, n, out=d)
                    d *= z
                    h = out[t, way * h_size : (way + 1) * h_size]
                    np.add(n, d, out=h)
        return out

    def label(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (T, L, B) of every position."""
        logits = np.matmul(self.network.output, self.states(data))
        logits += self.network.bias
        np.exp(logits, out=logits)  # tanh states and bounded weights keep this finite
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, L) over all positions."""
        n_lang = len(self.network.languages)
        sizes = np.array([len(t) for t in texts], np.int64)
        total = np.zeros((len(texts), n_lang))
        pieces = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(texts)), pieces)
        if not len(owner):
            return total
        joined = np.frombuffer(b"".join(texts), np.uint8)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * SPAN
        lengths = np.minimum(SPAN, sizes[owner] - nth * SPAN)
        order = np.argsort(-lengths, kind="stable")  # pieces of like length share a run, so little is padded
        for k in range(0, len(order), SIDE):
            some = order[k : k + SIDE]
            steps = int(lengths[some[0]])
            at = starts[some][None, :] + np.arange(steps)[:, None]
            real = np.arange(steps)[:, None] < lengths[some][None, :]
            data = np.where(real, joined[np.minimum(at, len(joined) - 1)].astype(np.intp), PAD)
            share = self.label(data)
            share *= real[:, None, :]
            np.add.at(total, owner[some], share.sum(0).T)
        return total / np.maximum(1, sizes)[:, None]


def training_sample(documents: DataFrame, id_col: str, text_col: str, label_col: str, sample_documents: int) -> tuple[list[bytes], list[int], list[str]]:
    """Labelled windows of a bounded sample, the same in every run.

    Languages are counted over all rows; each gives about the same number of
    documents, chosen by a hash of the id, and each document windows at hashed places
    of its whole text. Of more than MOST_LANGUAGES labels the most frequent are learned.
    """
    labelled = documents.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    frequent = labelled.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "label").limit(MOST_LANGUAGES)
    counts = {r["label"]: r["times"] for r in frequent.collect()}
    languages = sorted(counts)
    if not languages:
        return [], [], []
    each = -(-sample_documents // len(languages))
    rates = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, each / counts[name])))])
    rank = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11))
    chosen = labelled.where(F.pmod(rank, F.lit(1 << 30)) / F.lit(float(1 << 30)) < rates[F.col(label_col)])
    room = F.greatest(F.lit(1), F.length(text_col) - WINDOW_CHARS + 1)
    windows = [F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), room) + 1).cast("int"), F.lit(WINDOW_CHARS)) for k in range(WINDOWS)]
    drawn = chosen.select(F.xxhash64(rank).alias("rank"), F.col(label_col).alias("label"), F.array(*windows).alias("windows")).distinct()
    # The draw gives the sample size on average; the limit holds it for certain, before anything reaches the driver.
    rows = drawn.orderBy("rank", "label", "windows").limit(2 * sample_documents).collect()
    index = {name: k for k, name in enumerate(languages)}
    pairs = [(w.encode("utf-8"), index[r["label"]]) for r in rows for w in dict.fromkeys(r["windows"]) if w]
    return [t for t, _ in pairs], [k for _, k in pairs], languages


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a run of items into stretches ``(begin, end)`` of at most ``most`` together; a larger item goes alone."""
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def predict(
    documents: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), pred_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``lang_pred`` and ``score`` per row.

    ``score`` is the mean probability of the predicted language over all bytes. Text that
    is null or has no letter is ``und`` with score 0, and so is everything when no
    language was learned. Repeated rows each give a row; other columns are ignored; no rows
    give no rows. Where a kept column has the name of a new one, ``pred_col`` and
    ``score_col`` give the new ones others.
    """
    kept = [c for c in keep if c != id_col]
    sent = [F.col(id_col), *[F.col(c) for c in kept], *([] if text_col in keep or text_col == id_col else [F.col(text_col)])]
    narrow = documents.select(*[c.alias(f"c{k}") for k, c in enumerate(sent)])
    text_at = f"c{([id_col, *kept] + [text_col]).index(text_col)}"
    passed = narrow.schema.fields[: 1 + len(kept)]
    schema = StructType([*passed, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(network) if network else None
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
            for begin, end in slices(sizes, TOGETHER):
                part = batch.slice(begin, end - begin)
                found = [t or "" for t in part.column(text_at).to_pylist()]
                lettered = [any(map(str.isalpha, t)) for t in found]
                pooled = labeler.pool([t.encode("utf-8") if ok else b"" for t, ok in zip(found, lettered, strict=True)]) if labeler else None
                best = pooled.argmax(1) if labeler else None
                names = [network.languages[best[i]] if labeler and ok else UNDETERMINED for i, ok in enumerate(lettered)]
                scores = [float(min(1.0, pooled[i, best[i]])) if labeler and ok else 0.0 for i, ok in enumerate(lettered)]
                columns = [part.column(f.name) for f in passed] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    found = map_batches(narrow, run, schema)
    return found.toDF("doc_id", *kept, pred_col, score_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    keep: tuple[str, ...] = (),
    sample_documents: int = SAMPLE_DOCUMENTS,
    pred_col: str = "lang_pred",
    score_col: str = "score",
) -> DataFrame:
    """Train on labelled documents that are not held out, then predict all; see :func:`predict`.

    At most ``2 * sample_documents`` documents with ``WINDOWS`` windows each reach the driver,
    where the network is trained; it is a few thousand numbers and travels with the tasks.
    """
    texts, labels, languages = training_sample(documents.where(~held_out(id_col)), id_col, text_col, label_col, sample_documents)
    network = train_network(texts, labels, languages) if texts else None
    return predict(documents, network, id_col, text_col, keep, pred_col, score_col)


def op2(spark, sf_dir):
    """Predicts the language of all ``documents``; see :func:`identify`."""
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
