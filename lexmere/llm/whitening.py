"""Whitening of vectors by an exact covariance: products of small integer slices, put together as big integers.

Entries become integers. A first pass counts and adds them up; a second takes n times each vector less the sums, which is
centred and still whole, splits the numbers into slices so small that float64 matrix products of a block are exact,
and puts the products together as big integers. Tasks hand these on in 32-bit pieces that Spark adds up, a row a
cell of the matrix, so the driver gets one exact matrix, rounds it once and finds its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a slice: products of two have 32, and a float64 holds the sum of 2**21 of them.
SLICE = 16
#: Vectors of a block at most.
BLOCK = 1 << 14
#: Signed 32-bit pieces of a cell: sums of up to 320 bits.
PIECES = 10
#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Numbers beyond are clamped, so that an entry and its sums fit a long.
FAR = float(1 << 61)
#: Share of the greatest eigenvalue, for each dimension, that rounding may leave where there is none.
NOTHING = 2.0**-48


def integers(vectors: pa.ListArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that are whole (of ``dim`` entries, where given, all of them finite numbers), and their integers: a matrix, or with no ``dim`` a flat array."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    whole = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    if dim is not None:
        whole &= lengths == dim
    keep = np.repeat(whole, np.maximum(lengths, 0))
    x = np.clip(np.floor(flat[keep] * SCALE), -FAR, FAR).astype(np.int64) + SHIFT
    return np.flatnonzero(whole), x if dim is None else x.reshape(-1, dim)


def slices(numbers: np.ndarray) -> list[np.ndarray]:
    """float64 matrices a with numbers = sum of a[k] * 2**(SLICE * k), all but the last of 0 to 2**SLICE - 1, the last signed; as few as do."""
    top = max((abs(int(numbers.max())), abs(int(numbers.min()))), default=0) if numbers.size else 0
    out = []
    for _ in range(top.bit_length() // SLICE):
        out.append((numbers & ((1 << SLICE) - 1)).astype(np.float64))
        numbers = numbers >> SLICE
    return [*out, numbers.astype(np.float64)]


def gram(numbers: np.ndarray) -> np.ndarray:
    """numbers' * numbers as Python integers."""
    out = np.zeros((numbers.shape[1],) * 2, object)
    for at in range(0, len(numbers), BLOCK):
        parts = slices(numbers[at : at + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object)  # exact: under 2**53
                out += (product if i == j else product + product.T) << (SLICE * (i + j))
    return out


def to_pieces(numbers: list[int]) -> list[list[int]]:
    """Signed numbers as PIECES lists of 32-bit pieces, the last signed, which may be added up one by one."""
    out = []
    for k in range(PIECES):
        last = k == PIECES - 1
        out.append([(v >> (32 * k)) if last else (v >> (32 * k)) & 0xFFFFFFFF for v in numbers])
    return out


def from_pieces(pieces: list[int]) -> int:
    return sum(int(p) << (32 * k) for k, p in enumerate(pieces))


_PIECES = ", ".join(f"p{k} long" for k in range(PIECES))


@dataclass(frozen=True)
class Whitener:
    """n vectors, the sums of their integers, unit eigenvectors (rows) by falling eigenvalue, of the covariance, whose trace is ``trace``."""

    n: int
    sums: list[int]
    reach: int
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums, self.reach)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """One row a vector, one column a component; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return ((centred / self.n).astype(np.float64) @ self.vectors.T) * scale


def centred(x: np.ndarray, n: int, sums: list[int], reach: int) -> np.ndarray:
    """n * x - sums; 64-bit where no entry is farther than ``reach`` from its mean and n times that fits, else Python integers."""
    if n * (reach + 1) < 1 << 62:
        middle = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.int64)
        return (x - middle) * n - rest
    return x.astype(object) * n - np.array(sums, object)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each length of vector and each place in it: count, sum, most and least."""
    for batch in batches:
        vectors = batch.column(0)
        lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            whole, x = integers(vectors, dim)
            if not len(whole):
                continue
            low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
            pieces = to_pieces([a + (b << 32) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            data = {"dim": [dim] * dim, "at": list(range(dim)), "rows": [len(whole)] * dim, "most": x.max(axis=0).tolist(), "least": x.min(axis=0).tolist()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in (data | {f"p{k}": p for k, p in enumerate(pieces)}).items()})


def _multiplied(dim: int, n: int, sums: list[int], reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's products: a row for each cell on or under the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = integers(batch.column(0), dim)
            if len(x):
                part = gram(centred(x, n, sums, reach))
                total = part if total is None else total + part
        if total is not None:
            pieces = to_pieces(total[np.tril_indices(dim)].tolist())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in ({"cell": list(range(len(pieces[0])))} | {f"p{k}": p for k, p in enumerate(pieces)}).items()})

    return run


def fit(rows: DataFrame, vector_col: str, components: int = 32) -> Whitener | None:
    """The first ``components`` components of all whole vectors of the most common length (of equally common ones the greatest); None without a vector.

    Two passes over the vectors; the driver gets the sums of each place and one matrix of the vectors' length squared.
    """
    vectors = rows.select(F.col(vector_col).alias("v"))
    first = vectors.mapInArrow(_summed, f"dim long, at long, rows long, most long, least long, {_PIECES}")
    first = first.groupBy("dim", "at").agg(F.sum("rows").alias("rows"), F.max("most").alias("most"), F.min("least").alias("least"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(PIECES)))
    top = first.filter("at = 0").select("dim", "rows").orderBy(F.desc("rows"), F.desc("dim")).head()
    if top is None:
        return None
    dim, n = top["dim"], top["rows"]
    cells = sorted(first.filter(F.col("dim") == dim).collect(), key=lambda r: r["at"])
    sums = [from_pieces([r[f"p{k}"] for k in range(PIECES)]) for r in cells]
    reach = max(max(abs(r["most"] - s // n), abs(r["least"] - s // n)) for r, s in zip(cells, sums, strict=True)) + 1
    second = vectors.mapInArrow(_multiplied(dim, n, sums, reach), f"cell long, {_PIECES}")
    added = second.groupBy("cell").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(PIECES)))
    exact = {r["cell"]: from_pieces([r[f"p{k}"] for k in range(PIECES)]) for r in added.collect()}
    matrix = np.zeros((dim, dim))
    for cell, (i, j) in enumerate(zip(*np.tril_indices(dim), strict=True)):
        matrix[i, j] = matrix[j, i] = exact[cell] / n**3  # of integers: rounded once
    trace = sum(exact[i * (i + 3) // 2] for i in range(dim)) / n**3
    values, columns = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    values, found = values[order], columns[:, order].T.copy()
    found *= np.where(np.take_along_axis(found, np.abs(found).argmax(axis=1)[:, None], 1) < 0, -1, 1)  # the largest entry is positive
    values[values <= max(0.0, float(values[0])) * dim * NOTHING] = 0.0
    return Whitener(n, sums, reach, found, values, trace)


def _moments(model: Whitener) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's count, means and centred products of the whitened vectors, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            _, x = integers(batch.column(0), len(model.sums))
            if len(x):
                w = model.whiten(model.centred(x))[:, model.values > 0]
                mean = w.mean(axis=0)
                state = _merged(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"n": pa.array([state[0]], pa.int64()), "mean": pa.array([state[1].tolist()], pa.list_(pa.float64())), "products": pa.array([state[2].ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _merged(a: tuple[int, np.ndarray, np.ndarray] | None, b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    if a is None:
        return b
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        for n, mean, products in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            state = _merged(state, (n, np.array(mean), np.array(products).reshape(len(mean), -1)))
    if state is not None:
        yield pa.RecordBatch.from_pydict({"n": pa.array([state[0]], pa.int64()), "mean": pa.array([state[1].tolist()], pa.list_(pa.float64())), "products": pa.array([state[2].ravel().tolist()], pa.list_(pa.float64()))})


def identity_error(rows: DataFrame, vector_col: str, model: Whitener) -> float:
    """The greatest absolute entry of the covariance of the whitened vectors, centred before multiplying, less the identity; components without variance left out."""
    if not (model.values > 0).any():
        return 0.0
    schema = "n long, mean array<double>, products array<double>"
    tasks = rows.select(F.col(vector_col).alias("v")).mapInArrow(_moments(model), schema)
    state = None
    # one row a task: folded in a few tasks, then here
    for r in tasks.repartition(8).mapInArrow(_folded, schema).collect():
        state = _merged(state, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1)))
    return float(np.abs(state[2] / state[0] - np.eye(len(state[1]))).max())


def _rows_of(model: Whitener, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(width)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                whole, x = integers(part.column(1), len(model.sums))
                if not len(whole):
                    continue
                c = model.centred(x)
                small = c.dtype != object and x.shape[1] * (model.n * (model.reach + 1)) ** 2 < 1 << 63
                squares = (c * c).sum(axis=1).tolist() if small else [sum(v * v for v in row) for row in c.astype(object).tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in squares], pa.int64())
                whitened = model.whiten(c).ravel()
                rows = np.repeat(np.arange(len(whole)), width)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(whole)).take(pa.array(rows)),
                    "component": pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(whole))),
                    "n": pa.array(np.full(len(rows), model.n, np.int64)),
                    "deviation": deviation.take(pa.array(rows)),
                    "whitened": pa.array(whitened, mask=np.isnan(whitened)),
                    "explained": pa.array(np.tile(explained, len(whole))),
                    "identity_error": pa.array(np.full(len(rows), error)),
                })

    return run


def whiten(rows: DataFrame, id_col: str, vector_col: str, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each whole vector and component.

    Left out are vectors that are null or empty, hold a null or a number that is not finite, or have not the most common length. Repeated
    rows count and come out each time; null ids pass through; an empty table gives no rows; other columns aren't read. A component without variance (fewer or
    dependent vectors, equal ones) has whitened null and explained 0 and is left out of identity_error. deviation is null where it exceeds a long.
    """
    schema = f"vec_id {dict(rows.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, vector_col, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select(F.col(id_col), F.col(vector_col)).mapInArrow(_rows_of(model, identity_error(rows, vector_col, model)), schema)
