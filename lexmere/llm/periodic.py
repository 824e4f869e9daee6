"""Periodic run detection: stretches of words that repeat with a period.

A document's words get small numbers, whose bits make planes: one big integer for each bit, with one bit
for each word. For a lag q the planes are XORed with themselves shifted by q and the results ORed: a zero
says that a word equals the one q words on. ANDing the complement with shifted copies of itself, in doublings, leaves the starts of
stretches that are long enough; each is a run of period q unless a smaller period has the same run.

Large lags need long stretches, so most are ruled out on every d-th word alone, d about a sixteenth of the lag:
a run of period q has 2q words that equal the ones q on, and at least 31 of them are looked at. The work of a text of n words without
runs is thus about n log n, not n squared.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmere.llm import textscan as ts

#: Words that are looked at, in a stretch of the least length, before a lag is followed up: twice as many for each q.
SAMPLED = 16
#: Planes that rule lags out before all are taken.
SIEVE = 4

#: From a doc_id and a number of words the places of the words to take in their stead; None: the text as it is.
Edit = Callable[[int | None, int], np.ndarray | None]


class Run(NamedTuple):
    start: int
    length: int
    period: int


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of all doc_ids, by their checksum, the tail of the text becomes a repetition; a null doc_id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _planes(ids: np.ndarray) -> list[int]:
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(max(1, int(ids.max()).bit_length()))]


def _thinned(ids: np.ndarray, step: int) -> list[list[int]]:
    """For each of the first planes and each remainder r the bits of the words r, r + step, ..."""
    rows = -(-len(ids) // step)
    padded = np.zeros(rows * step, ids.dtype)
    padded[: len(ids)] = ids
    columns = padded.reshape(rows, step).T
    out = []
    for k in range(min(SIEVE, max(1, int(ids.max()).bit_length()))):
        packed = np.packbits((columns >> k) & 1, axis=1, bitorder="little")
        out.append([int.from_bytes(row.tobytes(), "little") for row in packed])
    return out


def _long_zeros(mismatch: int, bits: int, least: int) -> int:
    """The bits at which at least ``least`` zeros start among the first ``bits``."""
    if bits < least:
        return 0
    zeros = ~mismatch & ((1 << bits) - 1)
    done = 1
    while done < least and zeros:
        step = min(done, least - done)
        zeros &= zeros >> step
        done += step
    return zeros


def _stretches(mismatch: int, bits: int, least: int) -> Iterator[tuple[int, int]]:
    """Start and end of the maximal stretches of at least ``least`` zeros."""
    raw = np.frombuffer(mismatch.to_bytes(-(-bits // 8), "little"), np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[1, np.unpackbits(raw, bitorder="little")[:bits], 1]))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    yield from zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """All maximal runs of at least ``least`` words and ``times`` (2 or more) periods, each with its smallest period, by start and period. ids: word numbers from 0."""
    n = len(ids)
    found: list[Run] = []
    spans: set[tuple[int, int]] = set()
    if n < max(least, times):
        return found
    planes = _planes(ids)
    step, thinned, live = 0, [], []
    for q in range(1, n // times + 1):
        bits, need = n - q, max(least, times * q) - q
        # a run of a smaller period that divides this one matches at this lag too, all along and nowhere else
        live = [r for r in live if r.length >= times * q]
        known = [(r.start, r.start + r.length - q) for r in live if q % r.period == 0]
        if q >= 2 * SAMPLED:
            wanted = 1 << ((q // SAMPLED).bit_length() - 1)
            if wanted != step:
                step, thinned = wanted, _thinned(ids, wanted)
            some, far = need // step - 1, q // step
            few = -(-bits // step)
            mismatch = 0
            for a, b in known:
                mismatch |= ((1 << (b // step - -(-a // step))) - 1) << -(-a // step) if b // step > -(-a // step) else 0
            left = 1
            for plane in thinned:
                mismatch |= plane[0] ^ (plane[q % step] >> far)
                if not (left := _long_zeros(mismatch, few, some)):
                    break
            if not left:
                continue
        mismatch, top = 0, (1 << bits) - 1
        for a, b in known:
            mismatch |= ((1 << (b - a)) - 1) << a
        for plane in planes:
            mismatch |= (plane ^ (plane >> q)) & top
            if not _long_zeros(mismatch, bits, need):
                break
        else:
            for a, b in _stretches(mismatch, bits, need):
                if (a, b + q) not in spans:
                    spans.add((a, b + q))
                    run = Run(a, b + q - a, q)
                    found.append(run)
                    if run.length >= times * 2 * q:
                        live.append(run)
    return sorted(found)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Places of the words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period; of equal ones that of the least start, then period."""
    return min(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)


def _found(least: int, times: int, edit: Edit | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.pieces(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    words = (text.as_py() or "").encode().split()  # at ASCII white space, which is the words' definition
                    numbers: dict[bytes, int] = {}
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    at = edit(doc_id, len(words)) if edit else None
                    if at is not None:
                        ids, words = ids[at], [words[i] for i in at.tolist()]
                    runs = runs_of(ids, least, times)
                    best = strongest(runs)
                    kept = b" ".join(words[i] for i in kept_words(len(words), runs).tolist()) if runs else b" ".join(words)
                    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
                    top = (None,) * 4 if best is None else (*best, 1000 * best.length // best.period)
                    rows.append((len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words)))
                columns = [pa.array(c, pa.string() if j in (5, 6) else pa.int64()) for j, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"])

    return run


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words: one row per input row.

    A run is a maximal stretch of words with smallest period q and at least max(least, times * q) words. start to exponent_milli are of the
    strongest run, null where there is none; collapsed_sha256 is of the words that no run holds after its first period. Null and blank texts have
    no words and no runs; null doc_ids pass through and are never edited; repeated rows get equal results; an empty table gives an empty one; texts of
    any length are taken whole; columns but doc_id and text aren't read.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    kind = dict(docs.dtypes)["doc_id"]
    out = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"
    return docs.select("doc_id", "text").mapInArrow(_found(least, times, edit), f"doc_id {kind}, {out}")
