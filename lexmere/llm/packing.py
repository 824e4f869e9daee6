"""Best-fit packing, planned on the histogram of lengths.

Tokenized documents are cut into pieces of at most ``capacity`` tokens. Only the number of
pieces of each length reaches the driver, at most ``capacity`` numbers. Best-fit decreasing runs
over these counts: sequences with equal room are one group, and a length's pieces fill the
group with the least sufficient room, many sequences at a time. The plan is a list of
runs, "the next pieces of this length go q to a sequence, from sequence s and offset o on";
pieces find their run by their rank within their length.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmere.llm.shared import stage
from lexmere.llm.tokens import encoded

CAPACITY = 2048
#: Rows that one group should hold when ranks are counted.
RANK_GROUP = 4096

Batches = Iterator[pa.RecordBatch]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, sequence, per sequence, offset), by length and rank, and the number of sequences."""
    runs, opened = [], 0
    rooms: list[int] = []  # ascending; groups[r] holds (first sequence, how many) of room r
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, many))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("a piece is longer than a sequence, or empty")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                many = math.ceil(left / (capacity // length))
                put(capacity, opened, many)
                opened += many
                continue
            room = rooms[at]
            first, many = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = many - full
            if left and rest:
                runs.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            put(room, first + full, rest)
    table = np.array(runs, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], opened


def _cut(path: str, end_id: int, capacity: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for part, ids, bounds in encoded(batches, path, end_id):
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for k, s in enumerate(range(a, b, capacity)):
                    e = min(s + capacity, b)
                    rows.append(i), pieces.append(k), starts.append(s - a), lengths.append(e - s), sums.append(zlib.crc32(ids[s:e].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _placed(runs: np.ndarray, stride: int) -> Callable[[Batches], Batches]:
    keys = runs[:, 0] * stride + runs[:, 1]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            own = runs[np.searchsorted(keys, length * stride + rank, "right") - 1]
            nth = rank - own[:, 1]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, rank_group: int = RANK_GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Every whole text of docs (doc_id, text; null is empty) with end_id after it; only longer ones
    are cut. Rows with equal doc_ids are packed each by itself; ties within a length are broken by
    doc_id, piece and checksum. Empty table: no rows. Other columns aren't read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    pieces = stage(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    total = sum(counts.values())
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, math.ceil(total / rank_group))))
    dealt = pieces.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    if not len(runs):
        runs = np.zeros((1, 5), np.int64)
    return out.mapInArrow(_placed(runs, max(total, 1)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
