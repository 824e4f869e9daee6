"""Token ids of a corpus as rANS frames in files, and back.

A store is a folder of two Parquet tables, so that any file system Spark knows can hold it:
``table`` (id, count: the shared frequencies, of all ids of all documents) and ``frames``
(shard, first, n_ids, frame: see ``rans``). Shards ascend by doc_id; ``first`` counts the ids of the
shard before the frame. Frames hold whole documents and are decoded independently.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from lexmere.llm import rans
from lexmere.llm import textscan as ts
from lexmere.llm.shared import shared_dir, stage
from lexmere.llm.tokens import encoded

#: Ids from which a frame is closed.
FRAME = 1 << 18

Batches = Iterator[pa.RecordBatch]


def _width(path: str) -> str:
    """The narrowest integers that hold every id of a tokenizer."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _tokenized(path: str, end_id: int, width: str) -> Callable[[Batches], Batches]:
    step = np.dtype(width).itemsize

    def run(batches: Batches) -> Batches:
        for part, ids, bounds in encoded(batches, path, end_id):
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((bounds * step).astype(np.int64).tobytes()), pa.py_buffer(ids.astype(width).tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), raw.cast(pa.binary())], ["doc_id", "ids"])

    return run


def _counted(width: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(ts.buffers(batch.column("ids"))[0].view(width), minlength=len(total))
            got[: len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return run


def _framed(symbols: np.ndarray, counts: np.ndarray, width: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        table, shard, first = rans.Table(symbols, counts), TaskContext.get().partitionId(), 0
        names, parts, held = [], [], 0

        def frame() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64)
            raw = rans.encode_frame(pa.concat_arrays(names), lengths, np.concatenate(parts), table)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())], ["shard", "first", "n_ids", "frame"])

        for batch in batches:
            for i, raw in enumerate(batch.column("ids")):
                names.append(batch.column("doc_id").slice(i, 1))
                parts.append(np.frombuffer(raw.as_buffer(), width))
                held += len(parts[-1])
                if held >= FRAME:
                    yield frame()
                    names, parts, first, held = [], [], first + held, 0
        if parts:
            yield frame()

    return run


def _decoded(symbols: np.ndarray, counts: np.ndarray, with_ids: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        table = rans.Table(symbols, counts)
        for batch in batches:
            for shard, first, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "frame")), strict=True):
                f = rans.Frame(raw)
                docs = list(f.documents(table))
                ends = np.cumsum(f.lengths)
                columns = {
                    "doc_id": f.doc_ids, "shard": pa.array([shard] * len(docs), pa.int32()), "at": pa.array(first + ends - f.lengths, pa.int64()),
                    "n_tokens": pa.array(f.lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(d, "<u4").tobytes()) for d in docs], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([d.tolist() for d in docs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _table(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The shared frequencies; one row for each id of the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()
    return rows["id"].to_numpy(np.uint32), rows["n"].to_numpy(np.int64)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encodes every whole text of docs (doc_id, text), end_id after each, and returns the store's folder.

    Null texts are empty. Rows are stored in ascending order of doc_id, null first; equal doc_ids
    in order of their ids' checksum, then their ids, so that many rows of one doc_id spread over files. Empty table: a store without frames. Other columns aren't read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    kind, width = dict(docs.dtypes)["doc_id"], _width(tokenizer)
    made = docs.select("doc_id", "text").mapInArrow(_tokenized(tokenizer, end_id, width), f"doc_id {kind}, ids binary")
    raw = f"{path}/unordered"
    made.write.option("compression", "zstd").parquet(raw)
    made = spark.read.schema(made.schema).parquet(raw)
    counts = made.select("ids").mapInArrow(_counted(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/table")
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("ids").asc()]
    ordered = made.repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    frames = ordered.mapInArrow(_framed(*_table(spark, path), width), "shard int, first long, n_ids long, frame binary")
    frames.write.option("compression", "uncompressed").parquet(f"{path}/frames")
    folder = spark._jvm.org.apache.hadoop.fs.Path(raw)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return path


def read_store(spark: SparkSession, path: str, doc_id: str = "bigint", with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    frames = spark.read.schema("shard int, first long, n_ids long, frame binary").parquet(f"{path}/frames")
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = stage(totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    schema = f"doc_id {doc_id}, shard int, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = frames.select("shard", "first", "frame").mapInArrow(_decoded(*_table(spark, path), with_ids), schema)
    return docs.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
