"""Token ids of whole batches of texts with the tokenizers library, each distinct word once.

A text is cut at ASCII white space where the tokenizer's own rules always cut, so a text's ids are
the ids of its segments in order. Distinct segments of a batch are found by hash with numpy;
only new ones go through the library, many in a call. Texts with white
space beyond ASCII, where the cut could matter, or with the string of an added token (such as
<|endoftext|>, one id) go through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lexmere.llm import textscan as ts
from lexmere.llm.textscan import U

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Python worker has one core

#: UTF-8 forms of white space beyond ASCII.
WIDE_SPACE = re.compile(rb"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Segments whose ids a worker remembers.
REMEMBERED = 2_000_000


class Encoder:
    """Encodes batches of texts for one tokenizer file; lives as long as its Python worker."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        # In lower case: a normalizer may lower texts before added tokens are looked for.
        self.added = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # A byte-level tokenizer without a normalizer keeps white space and joins a single space to the word after it.
        self.keeps_space = self.tokenizer.normalizer is None
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, U)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _apart(self, data: np.ndarray) -> list[int]:
        """Byte places of what sends a text through the library whole."""
        places = [m.start() for m in WIDE_SPACE.finditer(data)]
        low = ts.LOWER[data].tobytes()
        for token in self.added:
            at = low.find(token)
            while at >= 0:
                places.append(at)
                at = low.find(token, at + 1)
        return places

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end (byte places) and hash of the segments of all texts in order."""
        w = ts.scan(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())))
        if not self.keeps_space:
            return w.start, w.end, w.hash
        begins = np.zeros(len(data) + 1, bool)
        begins[off[:-1]] = True
        led = (w.start > 0) & ~begins[w.start]
        led[led] = data[w.start[led] - 1] == 0x20
        # What is left between words: white space runs without the space that a word takes.
        gap_start = np.r_[0, w.end]
        gap_end = np.r_[w.start - led, len(data)]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        at = np.searchsorted(gap_start, cuts, "right") - 1  # gaps never span documents
        inner = (cuts > gap_start[at]) & (cuts < gap_end[at])
        gap_start, gap_end = np.r_[gap_start, cuts[inner]], np.r_[gap_end, np.full(inner.sum(), -1)]
        order = np.argsort(gap_start, kind="stable")
        gap_start, gap_end = gap_start[order], gap_end[order]
        split = np.flatnonzero(gap_end < 0)
        for i in split:  # a gap cut by document ends: each part ends where the next begins
            j = i - 1
            gap_end[i], gap_end[j] = gap_end[j], gap_start[i]
        # A run before a word that takes no space of it ends in a segment of one character.
        bare = np.zeros(len(data) + 2, bool)
        bare[w.start[~led]] = True
        last = np.flatnonzero((gap_end - gap_start > 1) & bare[gap_end])
        gap_start, gap_end = np.r_[gap_start, gap_end[last] - 1], np.r_[gap_end, gap_end[last]]
        gap_end[last] -= 1
        some = gap_end > gap_start
        gap_start, gap_end = gap_start[some], gap_end[some]
        start, end = np.r_[w.start - led, gap_start], np.r_[w.end, gap_end]
        gap_hash = np.array([int.from_bytes(data[a:b].tobytes()[-7:], "little") + (b - a) * 0x100000001B3 for a, b in zip(gap_start.tolist(), gap_end.tolist(), strict=True)], object).astype(U) if len(gap_start) else np.zeros(0, U)
        same = gap_end - gap_start > 7
        for i in np.flatnonzero(same):
            gap_hash[i] = hash(data[gap_start[i] : gap_end[i]].tobytes()) & (2**64 - 1)
        hashes = np.r_[ts.mix(w.hash + led.astype(U)), ts.mix(gap_hash ^ U(0x2545F4914F6CDD1D))]
        order = np.argsort(start, kind="stable")
        return start[order], end[order], hashes[order]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, distinct: np.ndarray, at: np.ndarray) -> None:
        """Encodes the distinct segments that are new; at: where each stands."""
        fresh = ~ts.isin_sorted(distinct, self.known)
        new, at = distinct[fresh], at[fresh]
        if not len(new):
            return
        segments = [data[a:b].tobytes().decode("utf-8") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        got = [x.ids for x in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        size = np.array([len(x) for x in got], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([y for x in got for y in x], np.uint32)])
        where = np.searchsorted(self.known, new)
        self.known = np.insert(self.known, where, new)
        self.first, self.size = np.insert(self.first, where, first), np.insert(self.size, where, size)

    def encode(self, texts: pa.Array | pa.ChunkedArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i's ids, end_id last, are ids[bounds[i] : bounds[i + 1]]. Null is an empty text."""
        data, off = ts.buffers(texts)
        if len(self.known) > REMEMBERED:
            self._forget()
        odd = np.unique(np.searchsorted(off, self._apart(data), "right") - 1) if len(data) else []
        start, end, hashes = self._segments(data, off)
        distinct, where, own = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(data, start, end, distinct, where)
        at = np.searchsorted(self.known, distinct)[own]
        size = self.size[at]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[at] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        cut = np.r_[0, total][np.searchsorted(start, off)]
        n = len(off) - 1
        out = np.insert(ids, cut[1:], np.uint32(end_id))
        bounds = cut + np.arange(n + 1)
        if len(odd):
            parts = [out[bounds[i] : bounds[i + 1]] for i in range(n)]
            for i in odd:
                parts[i] = np.append(self.whole(data[off[i] : off[i + 1]].tobytes().decode("utf-8")), np.uint32(end_id))
            bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
            out = np.concatenate(parts)
        return out.astype("<u4", copy=False), bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their ids and bounds."""
    own = encoder(path)
    for batch in batches:
        for part in ts.pieces(batch):
            yield part, *own.encode(part.column("text"), end_id)
