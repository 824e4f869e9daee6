"""Words, word hashes and k-gram hashes of whole Arrow batches of texts, with numpy.

Texts are scanned as one run of bytes: a table tells separators, words are hashed eight bytes at a
time by a mixing function that no pattern of letters undoes, words of over 64 bytes by BLAKE2b, and k-gram
hashes are put together by doubling. UTF-8 keeps multi-byte letters above 0x7F, so ASCII separators are safe on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
FULL = U(2**64 - 1)
P = 0x9E3779B97F4A7C15
GRAM = 0xD6E8FEB86659FD93
#: Bytes of text that are scanned at once; a longer text is scanned alone.
PIECE = 1 << 21

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(P))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = P if kind == "up" else pow(P, -1, 2**64)
        run = np.full(max(n, PIECE), step, U)
        run[0] = 1
        _powers[kind] = np.cumprod(run, dtype=U)
    return _powers[kind][:n]


#: Words of more bytes are hashed one by one.
LONG = 64
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word, by its bytes; words of at most eight bytes and the same length never share them."""
    size = end - start
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(size.astype(U) * U(P))
    which, at = np.arange(len(start)), 0
    while len(which):
        lane = eight[start[which] + at] & _FIRST[np.minimum(size[which] - at, 8)]
        out[which] = mix((out[which] * U(GRAM)) ^ lane)
        at += 8
        which = which[(size[which] > at) & (size[which] <= LONG)]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """start, end: byte places in data; first[i]: index of document i's first word; hash: by content."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def doc_end(self) -> np.ndarray:
        """For each word, the index after its document's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by single spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = pc.fill_null(texts.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(texts: pa.Array | pa.ChunkedArray, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, off = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[edges + 1]
    stop[edges - 1] |= inside[edges]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(data, start, end, np.searchsorted(start, off), word_hashes(data, start, end))


def pieces(table: pa.Table | pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.Table | pa.RecordBatch]:
    """Slices of whole rows with at most limit bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False) if len(table) else np.zeros(0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(table):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield table.slice(at, to - at)
        at = to


def ahead(a: np.ndarray, k: int, fill: np.uint64 = U(0)) -> np.ndarray:
    out = np.full_like(a, fill)
    if k < len(a):
        out[: len(a) - k] = a[k:]
    return out


def _behind(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(a)
    if k < len(a):
        out[k:] = a[: len(a) - k]
    return out


def grams(hashes: np.ndarray, k: int, base: int = GRAM) -> np.ndarray:
    """At each word the hash of the k words from there on; past the end of a document they run into the next."""
    parts, size, cur = None, 1, hashes
    done = 0
    while True:
        if k & size:
            parts = cur if parts is None else parts * U(pow(base, size, 2**64)) + ahead(cur, done)
            done += size
        size *= 2
        if size > k:
            return mix(parts + U(k))
        cur = cur * U(pow(base, size // 2, 2**64)) + ahead(cur, size // 2)


def slide(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum of a[i : i + width] for each i, or maximum of a[i - width + 1 : i + 1]."""
    reach, step = 1, None
    while reach < width:
        step = min(reach, width - reach)
        a = np.minimum(a, ahead(a, step, FULL)) if least else np.maximum(a, _behind(a, step))
        reach += step
    return a


def isin_sorted(a: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of a is in the ascending array known."""
    if not len(known):
        return np.zeros(len(a), bool)
    at = np.searchsorted(known, a)
    at[at == len(known)] = 0
    return known[at] == a
