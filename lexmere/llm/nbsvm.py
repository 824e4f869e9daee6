"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words and pairs of words, and words' and pairs' shapes
(runs of small letters, capitals, digits and each sign) and repetitions, these by how often
they occur (in powers of two of their share). An indicator's value is its class log-count
ratio; a linear model with hinge loss is fitted on the scaled, unit-length rows by dual coordinate descent
(Wang and Manning 2012; Hsieh et al. 2008), and a logistic curve turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm import textscan as ts
from lexmere.llm.textscan import U

BITS = 18
#: Labelled rows that the model is fitted on, at most: those whose doc_id hashes least. And the features that they
#: hold in all, at most: the first rows in that order that stay within it.
SAMPLE, FEATURES = 12_000, 20_000_000

Batches = Iterator[pa.RecordBatch]

_KIND = np.full(256, 1, np.uint8)
_KIND[:128] = np.arange(128)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def _shapes(w: ts.Words) -> np.ndarray:
    """For each word a hash of its characters' kinds, runs of one kind taken once."""
    if not len(w.start):
        return np.zeros(0, U)
    kind = _KIND[w.data]
    new = np.r_[True, kind[1:] != kind[:-1]]
    new[w.start] = True
    total = np.r_[0, np.cumsum(new)]
    values = ts.BYTE[kind[new]]
    sums = np.r_[U(0), np.cumsum(values * ts._power("up", len(values)), dtype=U)]
    a, b = total[w.start], total[w.end]
    return ts.mix((sums[b] - sums[a]) * ts._power("down", len(values) + 1)[a] + (b - a).astype(U))


def features(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): document i's distinct features are ids[bounds[i] : bounds[i + 1]], in 0 .. 2**BITS - 1."""
    w = ts.scan(texts, lower=True)
    raw = ts.scan(texts)
    doc, n = w.doc, len(w.first) - 1
    size = np.diff(w.first)
    pair = (np.arange(len(doc)) + 1 < w.doc_end)
    shape = _shapes(raw)
    after, shape_after = ts.ahead(w.hash, 1), ts.ahead(shape, 1)
    again = np.zeros(len(doc), bool)
    for lag in (1, 2, 3, 4, 5):
        same = w.hash == ts.ahead(w.hash, lag)
        again |= same & (np.arange(len(doc)) + lag < w.doc_end)
    mask = U((1 << BITS) - 1)
    plain = [(doc, ts.mix(w.hash)), (doc[pair], ts.mix(w.hash[pair] * U(3) + after[pair]))]
    rated = [(doc, ts.mix(shape + U(5))), (doc[pair], ts.mix(shape[pair] * U(7) + shape_after[pair])), (doc, ts.mix(np.where(again, U(11), U(13))))]
    owners, ids = [d for d, _ in plain], [h & mask for _, h in plain]
    for d, h in rated:
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, np.int64)
        share = np.diff(np.r_[first, len(d)]) / size[d[first]] if len(d) else np.zeros(0)
        level = np.floor(-2 * np.log2(np.maximum(share, 1e-6))).astype(np.int64)
        owners.append(d[first]), ids.append(ts.mix(h[first] + (level + 17).astype(U) * U(ts.GRAM)) & mask)
    key = np.unique((np.concatenate(owners).astype(np.int64) << BITS) | np.concatenate(ids).astype(np.int64))
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n + 1))


@dataclass(frozen=True)
class Model:
    """weights: hinge weights times log-count ratios; ratios for the rows' lengths; the curve's slope and shift."""

    weights: np.ndarray
    ratios: np.ndarray
    slope: float
    shift: float

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = self.slope * _margins(self.weights, self.ratios, ids, bounds) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _margins(weights: np.ndarray, ratios: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return _sums(weights[ids], bounds) / np.maximum(np.sqrt(_sums(ratios[ids].astype(np.float64) ** 2, bounds)), 1e-9)


def log_count_ratios(ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    owner = np.repeat(labels.astype(bool), np.diff(bounds))
    p, q = (alpha + np.bincount(ids[owner == y], minlength=1 << BITS) for y in (True, False))
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularized, L1-loss linear support vector machine; rows are (features, values)."""
    weights, alpha = np.zeros(1 << BITS), np.zeros(len(rows))
    square = np.array([v @ v for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            if square[i] == 0:
                continue
            slope = signs[i] * (weights[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                weights[at] += (new - alpha[i]) * signs[i] * v
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets (Platt)."""
    up, down = labels.sum(), (1 - labels).sum()
    t = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        g, w = np.array([((p - t) * margins).sum(), (p - t).sum()]), p * (1 - p) + 1e-9
        h = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, cost: float = 1.0) -> Model:
    """With one class only, or no rows, all scores are that class's share (0.5 without rows)."""
    none = np.zeros(1 << BITS, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(none, none, 1.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(ids, bounds, labels)
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        v = ratios[ids[a:b]]
        rows.append((ids[a:b], (v / max(np.sqrt(v @ v), 1e-9)).astype(np.float32)))
    each = np.where(labels == 1, 1.0, labels.sum() / max((1 - labels).sum(), 1)) * cost
    folds = np.arange(len(rows)) % 5 == 0  # margins for the curve come from a model that has not seen the rows
    kept = [r for r, f in zip(rows, folds, strict=True) if not f]
    signs = 2.0 * labels - 1
    part = dual_coordinate_descent(kept, signs[~folds], each[~folds])
    seen = np.array([part[at] @ v for (at, v), f in zip(rows, folds, strict=True) if f])
    slope, shift = _curve(seen, labels[folds])
    weights = dual_coordinate_descent(rows, signs, each)
    return Model((weights * ratios).astype(np.float32), ratios.astype(np.float32), slope, shift)


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def _featured(batches: Batches) -> Batches:
    for batch in batches:
        for part in ts.pieces(batch):
            ids, bounds = features(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), lists], ["place", "label", "ids"])


def _trained(most: int) -> Callable[[Batches], Batches]:
    """One row, the model. The rows arrive in the sample's order."""

    def run(batches: Batches) -> Batches:
        ids, sizes, labels, held = [np.zeros(0, np.int32)], [], [], 0
        for batch in batches:
            for label, own in zip(batch.column("label").to_pylist(), batch.column("ids"), strict=True):
                if held + len(own) <= most:
                    ids.append(own.values.to_numpy())
                    sizes.append(len(own)), labels.append(label)
                    held += len(own)
        m = train(np.concatenate(ids), np.r_[0, np.cumsum(sizes)].astype(np.int64), np.array(labels, np.int64))
        columns = [pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.ratios.tobytes()], pa.binary()), pa.array([m.slope]), pa.array([m.shift])]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "ratios", "slope", "shift"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """Fits on the labelled rows outside fold 1, at most ``sample`` of them: those of the least hashes of doc_id.

    Of these, rows that would bring the features to over ``most`` are passed over. One task of an executor
    fits; the driver gets the weights only.
    labels: doc_id, quality; null doc_ids and qualities are left out, contradicting rows of one doc_id count as good.
    Rows of docs with one doc_id are rows of their own. Without labelled rows all scores are 0.5.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    place = F.xxhash64("doc_id").alias("place")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(place, "label", "text")
    made = rows.mapInArrow(_featured, "place long, label int, ids array<int>")
    taken = made.orderBy("place", "label", F.xxhash64("ids")).limit(sample)  # rows arrive in no fixed order; the fit must not depend on it
    got = taken.mapInArrow(_trained(most), "weights binary, ratios binary, slope double, shift double").head()
    if got is None:
        return train(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    return Model(np.frombuffer(got["weights"], np.float32), np.frombuffer(got["ratios"], np.float32), got["slope"], got["shift"])


def _scored(model: Model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in ts.pieces(batch):
                scores = model.scores(*features(part.column("text")))
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scores)], [*kept, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per input row.

    Null and empty texts have no features and get the curve's value at margin 0. Other columns aren't read.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, floor: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least floor, columns unchanged, whatever their names.

    Null and empty texts get the score of a margin of 0. Rows that are alike stay or go together; an empty table stays empty.
    """
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in ts.pieces(batch):
                yield part.filter(pa.array(model.scores(*features(part.column("text"))) >= floor))

    return docs.mapInArrow(run, docs.schema)
