"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words, and only the bag has a label. Every passage is described by what
its bytes and words look like, encoded by a small network, and weighted by gated attention that is
learned from the document labels; the weighted encoding is scored. One poor passage can thus decide
a long document. The model is a few kilobytes, fitted in one task on a bounded sample of labelled rows
(``Fit.documents``, ``Fit.passages``); scoring reads every passage of every document in one map, no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches

PASSAGE = 64
SIGNS = b"!#$%&*|.,;:?-_/<>@="
ENDINGS = 48
FEATURES = len(SIGNS) + 14 + ENDINGS


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of training. At most ``documents`` labelled rows, half of each label, are read, each of them whole."""

    documents: int = 6000
    hidden: int = 24
    attention: int = 12
    rounds: int = 160
    rate: float = 0.02
    decay: float = 1e-4


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value occurs, and which positions hold its first occurrence."""
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    mark = np.zeros(len(key), bool)
    mark[first] = True
    return count[back], mark


def passage_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of some texts, and the number of passages of each text (at least one)."""
    rows = len(off) - 1
    start, end, row = spans.spans(raw, off, spans.NOT_SPACE)
    count = np.bincount(row, minlength=rows)
    bags = np.maximum(-(-count // PASSAGE), 1)
    base = np.cumsum(bags) - bags
    total = int(bags.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(start):
        return out, bags
    inside = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    passage = base[row] + inside // PASSAGE
    per = lambda weights=None: np.bincount(passage, weights=weights, minlength=total)
    words = per()
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    last = np.r_[first[1:], len(passage)] - 1
    which = passage[first]

    def inner(flag):
        """Flagged bytes of each passage, white space between its words included."""
        run = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(flag, out=run[1:])
        value = np.zeros(total)
        value[which] = run[end[last]] - run[start[first]]
        return value

    letter = spans.ALPHANUMERIC[spans.LOWER[raw]]
    upper = (raw >= 65) & (raw <= 90)
    size = (end - start).astype(np.float64)
    letters, bytes_ = inner(letter), per(size)
    for k, sign in enumerate(SIGNS):
        out[:, k] = np.minimum(_share(inner(raw == sign), words), 4)
    k = len(SIGNS)
    hashes = spans.span_hashes(spans.LOWER[raw], start, end)
    place = passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    times, new = _repeats(spans.mix(hashes ^ place))
    peak = np.zeros(total)
    np.maximum.at(peak, passage, times)
    echo = np.r_[False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]
    triple = np.flatnonzero(row[: max(0, len(row) - 2)] == row[2:])
    again, _ = _repeats(spans.mix(spans.run_hashes(hashes, triple, 3) ^ (row[triple].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))) if len(triple) else (np.zeros(0), None)
    known = np.bincount(passage[triple], weights=again > 1, minlength=total)
    loud = size > 1
    ups = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(upper, out=ups[1:])
    loud &= (ups[end] - ups[start]) * 2 >= size
    for value in (
        _share(inner(upper), letters), _share(inner((raw >= 48) & (raw <= 57)), bytes_), _share(letters, bytes_),
        _share(inner(raw >= 128), bytes_), np.minimum(_share(inner(raw == 10), words), 2), np.log1p(_share(bytes_, words)),
        _share(per(new), words), _share(peak, words), _share(per(echo), words), _share(known, words),
        _share(per(loud), words), _share(per(size == 1), words), words / PASSAGE, np.log1p(bags)[np.repeat(np.arange(rows), bags)],
    ):
        out[:, k] = value
        k += 1
    tail = (raw[end - 1].astype(np.int64) * 31 + raw[np.maximum(end - 2, start)]) % ENDINGS
    out[:, k:] = np.bincount(passage * ENDINGS + tail, minlength=total * ENDINGS).reshape(total, ENDINGS) / np.maximum(words, 1)[:, None]
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated-attention multiple-instance network."""

    def __init__(self, fit: Fit, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(7)
        normal = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.weights = {
            "W": normal(len(mean), fit.hidden), "b": np.zeros(fit.hidden, np.float32), "V": normal(fit.hidden, fit.attention),
            "U": normal(fit.hidden, fit.attention), "w": normal(fit.attention), "c": normal(fit.hidden), "d": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, bags: np.ndarray, scaled: bool = False):
        p = self.weights
        if not scaled:
            x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        energy = (t * s) @ p["w"]
        first = np.cumsum(bags) - bags
        weight = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), bags))
        weight = weight / np.repeat(np.add.reduceat(weight, first), bags)
        bag = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return _sigmoid(bag @ p["c"] + p["d"][0]), (x, h, t, s, weight, bag, first)

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x, bags)[0]

    def gradients(self, y: np.ndarray, importance: np.ndarray, bags: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the loss; ``x`` is standardised already."""
        p = self.weights
        score, (x, h, t, s, weight, bag, first) = self.forward(x, bags, True)
        slope = ((score - y) * importance).astype(np.float32)
        d_bag = slope[:, None] * p["c"]
        spread = np.repeat(d_bag, bags, axis=0)
        pull = (spread * h).sum(axis=1)
        d_energy = weight * (pull - np.repeat(np.add.reduceat(weight * pull, first), bags))
        gate = d_energy[:, None] * p["w"]
        d_t, d_s = gate * s * (1 - t * t), gate * t * s * (1 - s)
        d_h = (weight[:, None] * spread + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ d_h, "b": d_h.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s, "w": (t * s).T @ d_energy, "c": bag.T @ slope, "d": slope.sum(keepdims=True)}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, importance: np.ndarray, fit: Fit) -> AttentionModel:
    """Fit by Adam on all bags at once; the same rows in the same order give the same model."""
    deviation = x.std(axis=0)
    model = AttentionModel(fit, x.mean(axis=0), (1 / np.maximum(deviation, 1e-3)).astype(np.float32))
    importance = importance / importance.sum()
    x = ((x - model.mean) * model.scale).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, fit.rounds + 1):
        rate = fit.rate * min(1.0, 2 * (1 - (step - 1) / fit.rounds))
        for k, g in model.gradients(y, importance, bags, x).items():
            g = g + fit.decay * model.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            model.weights[k] = (model.weights[k] - rate * move).astype(np.float32)
    return model


def _bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, off = spans.text_bytes(column)
    for i, j in spans.blocks(off):
        yield i, *passage_features(raw[off[i]: off[j]], off[i: j + 1] - off[i])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, rows = [], []
        for _, x, bags in _bags(batch.column(1)):
            body += [bag.tobytes() for bag in np.split(x, np.cumsum(bags)[:-1])]
            rows += bags.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.int32()), pa.array(body, pa.binary()), batch.column(2)], ["doc", "passages", "features", "label"])


def fit_model(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fit: Fit = Fit()) -> AttentionModel | float:
    """Train on labelled documents; with rows of one label only, its share (or 0.5 without rows) is the model."""
    arrow_batches(docs.sparkSession)
    given = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(F.min(label).cast("int").alias("label"))
    counts = dict(given.groupBy("label").count().collect())
    if len(counts) < 2:
        return 0.5 if not counts else float(next(iter(counts)))
    some = None
    for value in sorted(counts):
        part = given.where(F.col("label") == value).orderBy(F.xxhash64("doc", F.lit(11)), "doc").limit(fit.documents // 2)
        some = part if some is None else some.unionByName(part)
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(some), "doc")
    described = chosen.select("doc", "text", "label").mapInArrow(
        spans.tidy(_describe), f"doc {kind}, passages int, features binary, label int")

    def learn(part):
        part = part.combine_chunks().sort_by([("doc", "ascending"), ("features", "ascending")])
        x = np.frombuffer(b"".join(part.column("features").to_pylist()), np.float32).reshape(-1, FEATURES)
        bags, y = part.column("passages").to_numpy().astype(np.int64), part.column("label").to_numpy().astype(np.float32)
        taken = {v: max(1, int((y == v).sum())) for v in counts}
        importance = np.array([counts[int(v)] / taken[int(v)] for v in y], np.float32)
        model = pickle.dumps(train(x, bags, y, importance, fit))
        del x, part
        spans.release()
        return pa.table({"model": pa.array([model], pa.binary())})

    found = described.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else 0.5


def score(docs: DataFrame, model: AttentionModel | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) of every document row. Null and empty texts are one empty passage."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                value = np.full(batch.num_rows, model)
            else:
                value = np.zeros(batch.num_rows)
                for i, x, bags in _bags(batch.column(1)):
                    value[i: i + len(bags)] = model.score(x, bags)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], ["doc", "score"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(spans.tidy(run), f"doc {kind}, score double")


def accept(docs: DataFrame, model: AttentionModel | float, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for i, x, bags in _bags(batch.column(at)):
                    value[i: i + len(bags)] = model.score(x, bags)
            yield batch.filter(pa.array(value >= threshold))

    return docs.mapInArrow(spans.tidy(run), docs.schema)


def held_out(doc_id: str):
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3; rows without id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
