"""Approximate vector search over a stored index: cells, product-quantization codes, exact re-ranking.

A coarse k-means, trained on a bounded sample, deals all vectors to cells; what is left of a vector after its cell's
center is cut into parts, each written as one byte, the number of its nearest codeword. The index is a
Parquet table in folders by cell. A search reads the codes of the nearest cells, takes the best candidates by
their codes and ranks these by their whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmere.functions import vectors
from lexmere.operators.search import compile_filters

#: Rows that centers and codewords are trained on, at most: those of the least hashes of their ids.
SAMPLE = 40_000
#: Dimensions of a part, codewords of a part.
PART, WORDS = 4, 256
#: Queries that go through the index together, and candidates of all of them, at most: what is broadcast.
BLOCK, CANDIDATES = 2_048, 400_000
#: Rows of the sample whose true neighbours tell how many cells must be probed.
TRIALS, NEIGHBOURS = 256, 10


class Quantizer(NamedTuple):
    """centers: one row a cell; words: for each part a table of codewords."""

    centers: np.ndarray
    words: list[np.ndarray]
    metric: str

    def shaped(self, x: np.ndarray) -> np.ndarray:
        """float32 rows; for cosine of unit length, zeros as they are."""
        x = x.astype(np.float32)
        if self.metric == "cosine":
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        return x

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centers)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centers[cell]
        return np.stack([nearest(p, w) for p, w in zip(parts(rest), self.words, strict=True)], 1).astype(np.uint8)

    def restored(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.centers[cell] + np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], 1)


def parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, range(PART, x.shape[1], PART), axis=1)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each row the number of its nearest center; ties to the first."""
    out = np.empty(len(x), np.int64)
    half = (centers * centers).sum(axis=1) / 2
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (x[at : at + 8192] @ centers.T - half).argmax(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from k distinct rows; a center without rows moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        many = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers, np.float64)
        np.add.at(sums, own, x)
        centers = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centers).astype(np.float32)
        empty = np.flatnonzero(many == 0)
        if len(empty):
            far = np.argsort(-((x - centers[own]) ** 2).sum(axis=1))[: len(empty)]
            centers[empty[: len(far)]] = x[far]
    return centers


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors without nulls, all of one length, as rows."""
    flat = pc.cast(column.flatten(), pa.float32()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def probes_for(x: np.ndarray, centers: np.ndarray, recall: float) -> int:
    """The least number of nearest cells that hold so large a share of the sample's own nearest neighbours."""
    rng = np.random.default_rng(11)
    asked = x[rng.permutation(len(x))[:TRIALS]]
    half, own = (x * x).sum(axis=1) / 2, nearest(x, centers)
    ranks = np.argsort(np.argsort(-(asked @ centers.T - (centers * centers).sum(axis=1) / 2), axis=1, kind="stable"), axis=1)
    needed = []
    for q, rank in zip(asked, ranks, strict=True):
        best = np.argsort(half - x @ q, kind="stable")[:NEIGHBOURS]
        needed.append(rank[own[best]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def _trained(cells: int, metric: str, recall: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(b.column(0)) for b in batches if len(b)]
        if not held:
            return
        x = Quantizer(np.zeros((0, 0)), [], metric).shaped(np.concatenate(held))
        centers = kmeans(x, cells)
        rest = x - centers[nearest(x, centers)]
        words = [kmeans(np.ascontiguousarray(p), WORDS) for p in parts(rest)]
        flat = [pa.array([a.astype("<f4").ravel().tolist()], pa.list_(pa.float32())) for a in (centers, np.concatenate([w.ravel() for w in words]))]
        sizes = pa.array([[len(w) for w in words]], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), *flat, sizes, pa.array([probes_for(x, centers, recall)], pa.int32())], ["dimensions", "centers", "words", "sizes", "probes"])

    return run


def _placed(model: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds cell and code; the vector is the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Quantizer = model.value
        for batch in batches:
            x = own.shaped(_matrix(batch.column(0))) if len(batch) else np.zeros((0, own.centers.shape[1]), np.float32)
            cell = own.cells(x)
            codes = own.codes(x, cell)
            columns = [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "code", "cell"])

    return run


def _candidates(model: Any, asked: Any, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query, id, cell, near of the best rows of each batch for each query that probes their cells, by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Quantizer = model.value
        queries, probes = asked.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for c in np.unique(cell).tolist():
                rows, ask = np.flatnonzero(cell == c), np.array(probes.get(c, ()), np.int64)
                if not len(ask):
                    continue
                x = own.restored(codes[rows], cell[rows])
                near = x @ queries[ask].T
                if own.metric == "l2":
                    near -= (x * x).sum(axis=1, keepdims=True) / 2
                for j, q in enumerate(ask.tolist()):
                    best = np.argpartition(-near[:, j], min(keep, len(rows)) - 1)[:keep]
                    found.setdefault(q, []).append((rows[best], near[best, j]))
            for q, pieces in found.items():
                at, near = (np.concatenate(p) for p in zip(*pieces, strict=True))
                best = np.argsort(-near, kind="stable")[:keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q, np.int32)), batch.column(0).take(pa.array(at[best])), batch.column(2).take(pa.array(at[best])), pa.array(near[best].astype(np.float64))], ["query", "id", "cell", "near"])

    return run


def _scored(asked: Any, k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        own = Quantizer(np.zeros((0, 0)), [], metric)
        q = own.shaped(queries)
        for batch in batches:
            if not len(batch):
                continue
            x = own.shaped(_matrix(batch.column(1)))
            near = x @ q.T - ((x * x).sum(axis=1, keepdims=True) / 2 if metric == "l2" else 0)
            best = np.argpartition(-near, min(k, len(x)) - 1, axis=0)[:k].T
            place = pa.array(best.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), best.shape[1])), batch.column(0).take(place), batch.column(1).take(place)], ["query", "id", "vector"])

    return run


def exact_topk(table: DataFrame, queries: Sequence[Sequence[float]], k: int, id_col: str, vector_col: str, metric: str = "cosine") -> DataFrame:
    """query, id, score, rank as VectorIndex.search() has them, by all rows: queries in blocks, each compared in matrix products with a few rows more than k kept a batch."""
    spark, out = table.sparkSession, None
    rows = table.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    for at in range(0, len(queries), BLOCK):
        block = [list(map(float, q)) for q in queries[at : at + BLOCK]]
        near = rows.mapInArrow(_scored(spark.sparkContext.broadcast(np.array(block)), k + 10, metric), f"query int, id {dict(rows.dtypes)['id']}, vector array<float>")
        part = _ranked(near, spark.createDataFrame(list(enumerate(block)), "query int, asked array<double>"), k, metric).select((F.col("query") + at).alias("query"), F.col("id").alias(id_col), "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(rows: DataFrame, asked: DataFrame, k: int, metric: str) -> DataFrame:
    """query, id, score, rank from query, id, vector: the k best of each query by their whole vectors; ``asked`` has at most BLOCK rows."""
    measure = vectors.cosine(F.col("vector"), F.col("asked")) if metric == "cosine" else vectors.l2(F.col("vector"), F.col("asked"))
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    scored = rows.join(F.broadcast(asked), "query").select("query", "id", F.round(measure, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "id"))).filter(F.col("rank") <= k)


class VectorIndex:
    """The index under ``path``. Vectors have one length; rows with null vectors are not in it; ids are unique, and not null."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/model").head()
        self.id_col, self.metric, self.schema, self.probes = about["id_col"], about["metric"], about["schema"], about["probes"]
        dim, words, at = about["dimensions"], [], 0
        flat = np.array(about["words"], np.float32)
        for size, width in zip(about["sizes"], [len(p) for p in np.split(np.arange(dim), range(PART, dim, PART))], strict=True):
            words.append(flat[at : at + size * width].reshape(size, width))
            at += size * width
        self.quantizer = Quantizer(np.array(about["centers"], np.float32).reshape(-1, dim), words, self.metric)
        self.shared = spark.sparkContext.broadcast(self.quantizer)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/cells")

    @classmethod
    def build(cls, table: DataFrame, path: str, id_col: str, vector_col: str, metric: str = "cosine", cells: int | None = None, carry: Sequence[str] = (), sample: int = SAMPLE, recall: float = 0.97) -> VectorIndex | None:
        """Trains on at most ``sample`` rows in one task and stores all rows; None if no row has a vector. ``carry``: columns for filters.

        Searches probe as many cells as hold a share of ``recall`` of the neighbours of rows of the sample.
        """
        spark = table.sparkSession
        rows = table.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
        n = rows.count()
        if not n:
            return None
        cells = cells or max(1, min(4096, round(math.sqrt(n))))
        kinds = dict(table.dtypes)
        some = rows.select(F.col(vector_col).cast("array<float>").alias("v"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(sample).select("v")
        model = some.coalesce(1).mapInArrow(_trained(cells, metric, recall), "dimensions int, centers array<float>, words array<float>, sizes array<int>, probes int")
        schema = ", ".join(["vector array<float>", f"id {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in carry), "code binary", "cell int"])
        model.select("*", F.lit(id_col).alias("id_col"), F.lit(metric).alias("metric"), F.lit(schema).alias("schema"), F.array(*map(F.lit, carry)).cast("array<string>").alias("carry")).write.parquet(f"{path}/model")
        own = cls(spark, path)
        own.append(table, vector_col, carry)
        return own

    def append(self, table: DataFrame, vector_col: str, carry: Sequence[str] = ()) -> None:
        """Stores more rows under the same centers; big cells are split over files by size."""
        rows = table.filter(F.col(vector_col).isNotNull() & F.col(self.id_col).isNotNull())
        rows = rows.select(vectors.checked(F.col(vector_col).cast("array<float>"), self.quantizer.centers.shape[1]).alias("vector"), F.col(self.id_col).alias("id"), *carry)
        placed = rows.mapInArrow(_placed(self.shared), self.schema).hint("rebalance", "cell").sortWithinPartitions("cell", "id")
        placed.write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")

    def delete(self, ids: DataFrame) -> None:
        """Rows with these ids are not found from now on, until they are appended to a new index."""
        ids.select(F.col(self.id_col).alias("id")).write.mode("append").parquet(f"{self.path}/gone")

    def _live(self, rows: DataFrame) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gone")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return rows
        return rows.join(self.spark.read.parquet(f"{self.path}/gone").distinct(), "id", "left_anti")

    def probed(self, cells: Sequence[int], filters: Mapping[str, Any] | None = None) -> DataFrame:
        return self.rows.filter(F.col("cell").isin(*cells)).filter(compile_filters(filters))

    def search(self, queries: Sequence[Sequence[float]], k: int, probes: int | None = None, among: int | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """query (its place), id, score, rank of the k best rows of each query: cosine similarity, or distance for l2; ties by id.

        probes: cells that are read for each query, by default as many as the build found needed; among: candidates whose
        whole vectors are compared. Queries go through the index in blocks of at most BLOCK queries and CANDIDATES candidates.
        """
        if not len(queries):
            return self.spark.createDataFrame([], f"query int, {self.id_col} {dict(self.rows.dtypes)['id']}, score double, rank int")
        centers = self.quantizer.centers
        probes = min(len(centers), probes or self.probes)
        among = among or max(100, 12 * k)
        out, size = None, max(1, min(BLOCK, CANDIDATES // among))
        for at in range(0, len(queries), size):
            block = self._block([list(map(float, q)) for q in queries[at : at + size]], at, k, probes, among, filters)
            out = block if out is None else out.unionByName(block)
        return out

    def _block(self, queries: list[list[float]], first: int, k: int, probes: int, among: int, filters: Mapping[str, Any] | None) -> DataFrame:
        centers = self.quantizer.centers
        q = self.quantizer.shaped(np.array(queries))
        nearness = q @ centers.T - (centers * centers).sum(axis=1) / 2
        chosen = np.argsort(-nearness, axis=1, kind="stable")[:, :probes]
        asking: dict[int, list[int]] = {}
        for i, row in enumerate(chosen.tolist()):
            for c in row:
                asking.setdefault(c, []).append(i)
        asked = self.spark.sparkContext.broadcast((q, asking))
        kind = dict(self.rows.dtypes)["id"]
        near = self._live(self.probed(sorted(asking), filters).select("id", "code", "cell")).mapInArrow(_candidates(self.shared, asked, among), f"query int, id {kind}, cell int, near double")
        w = Window.partitionBy("query").orderBy(F.desc("near"), "id")
        best = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= among).select("query", "id", "cell")
        whole = self.probed(sorted(asking), filters).select("cell", "id", "vector").join(F.broadcast(best), ["cell", "id"])  # at most CANDIDATES rows
        ranked = _ranked(whole, self.spark.createDataFrame(list(enumerate(queries)), "query int, asked array<double>"), k, self.metric)
        return ranked.select((F.col("query") + first).alias("query"), F.col("id").alias(self.id_col), "score", "rank")
