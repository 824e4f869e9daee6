"""Static range asymmetric numeral system (rANS) for token ids, in numpy.

One frequency table for all files. A block of ids is dealt over interleaved lanes, id i to lane
i % lanes; every lane is a coder with a 64-bit state and 32-bit renormalization, and all lanes step
together. Blocks start from fresh states and can be decoded by themselves: a frame's checkpoints
say where each block's words and states lie, how many ids it has and their crc32.

Frame: ``MAGIC``, counts (documents, ids, blocks, bytes of doc_ids) as little-endian u64, doc_ids as
an Arrow stream, document lengths i64, checkpoints (ids u4, lanes u4, words u4, crc32 u4 per
block), states u64, words u32, and a crc32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MAGIC = b"LXRANS01"
BITS = 20
LOW = U(1 << 31)
BLOCK = 1 << 17
LANES = 1024
_CHECK = np.dtype([("ids", "<u4"), ("lanes", "<u4"), ("words", "<u4"), ("crc", "<u4")])


class Table:
    """Frequencies of symbols, scaled to sum 2**BITS, each at least 1."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray) -> None:
        if len(symbols) > 1 << (BITS - 1):
            raise ValueError("too many symbols for the table's precision")
        order = np.argsort(symbols)
        self.symbols, counts = np.asarray(symbols, np.uint32)[order], np.asarray(counts, np.float64)[order]
        total = 1 << BITS
        freq = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (total - len(counts)))).astype(np.int64)
        if len(freq):
            freq[np.argmax(freq)] += total - freq.sum()
        self.freq = freq.astype(U)
        self.low = (np.cumsum(freq) - freq).astype(U)
        self.index = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, np.uint32)
        self.index[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """Index of the symbol that owns each of the 2**BITS slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) of one block."""
    lanes = max(1, min(LANES, len(ids) // 64))
    at = table.index[ids]
    freq, low = table.freq[at], table.low[at]
    limit = freq << U(63 - BITS)
    state, words = np.full(lanes, LOW), []
    for a in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        b = min(a + lanes, len(ids))
        x, f = state[: b - a], freq[a:b]
        over = x >= limit[a:b]
        if over.any():
            words.append((x[over] & U(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(over, x >> U(32), x)
        q = x // f
        state[: b - a] = (q << U(BITS)) + (x - q * f) + low[a:b]
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_block(n: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    lanes, state, at = len(states), states.copy(), 0
    out = np.empty(n, np.uint32)
    words = words.astype(U)
    mask = U((1 << BITS) - 1)
    slots = table.slots
    for a in range(0, n, lanes):
        b = min(a + lanes, n)
        x = state[: b - a]
        slot = x & mask
        s = slots[slot]
        out[a:b] = s
        x = table.freq[s] * (x >> U(BITS)) + slot - table.low[s]
        under = np.flatnonzero(x < LOW)
        if len(under):
            x[under] = (x[under] << U(32)) | words[at : at + len(under)]
            at += len(under)
        state[: b - a] = x
    return table.symbols[out]


def encode_frame(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", doc_ids.type)])) as out:
        out.write_batch(pa.record_batch([doc_ids], ["doc_id"]))
    names = sink.getvalue().to_pybytes()
    checks, states, words = [], [], []
    for a in range(0, len(ids), BLOCK):
        block = np.ascontiguousarray(ids[a : a + BLOCK], "<u4")
        x, w = encode_block(block, table)
        checks.append((len(block), len(x), len(w), zlib.crc32(block.tobytes())))
        states.append(x), words.append(w)
    body = b"".join([
        MAGIC, struct.pack("<4Q", len(lengths), len(ids), len(checks), len(names)), names, lengths.astype("<i8").tobytes(),
        np.array(checks, _CHECK).tobytes(), *(x.astype("<u8").tobytes() for x in states), *(w.astype("<u4").tobytes() for w in words),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class Frame:
    """A frame read back; blocks are decoded one by one, in any order."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged frame")
        docs, self.n_ids, blocks, size = struct.unpack_from("<4Q", raw, 8)
        at = 40
        self.doc_ids = pa.ipc.open_stream(raw[at : at + size]).read_all().column("doc_id").combine_chunks()
        at += size
        self.lengths = np.frombuffer(raw, "<i8", docs, at)
        at += 8 * docs
        self.checks = np.frombuffer(raw, _CHECK, blocks, at)
        at += _CHECK.itemsize * blocks
        self.states = np.frombuffer(raw, "<u8", int(self.checks["lanes"].sum()), at)
        at += 8 * len(self.states)
        self.words = np.frombuffer(raw, "<u4", int(self.checks["words"].sum()), at)

    def block(self, i: int, table: Table) -> np.ndarray:
        lane, word = int(self.checks["lanes"][:i].sum()), int(self.checks["words"][:i].sum())
        c = self.checks[i]
        ids = decode_block(int(c["ids"]), self.states[lane : lane + int(c["lanes"])], self.words[word : word + int(c["words"])], table)
        if zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) != int(c["crc"]):
            raise ValueError(f"block {i} does not match its checksum")
        return ids

    def documents(self, table: Table) -> Iterator[np.ndarray]:
        ids = np.concatenate([self.block(i, table) for i in range(len(self.checks))]) if len(self.checks) else np.zeros(0, np.uint32)
        return iter(np.split(ids, np.cumsum(self.lengths)[:-1])) if len(self.lengths) else iter(())
