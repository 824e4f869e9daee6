"""HyperMinHash sketches of word-shingle sets.

The top bits of a shingle's 64-bit hash name one of 256 registers. A register keeps the least
of the remaining 56 bits as six bits of leading-zero count and ten bits of mantissa. Empty
registers take the value of another register, the first non-empty one in a fixed random
order of their own (optimal densification), so that two sketches agree in a register with
about the sets' Jaccard similarity whatever their sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexmere.llm import textscan as ts
from lexmere.llm.textscan import U

BITS = 8
REGISTERS = 1 << BITS
MANTISSA = 10
REST = 64 - BITS
ROWS = 8
#: Registers of each band: runs of eight, and every 32nd from each of the first 32 on. Two bands share one register at most.
BANDS = np.concatenate([np.arange(REGISTERS).reshape(-1, ROWS), np.arange(REGISTERS).reshape(ROWS, -1).T])

_order = np.argsort(ts.mix(np.arange(REGISTERS * REGISTERS, dtype=U) + U(1)).reshape(REGISTERS, REGISTERS), axis=1)
#: RANK[j, b]: place of register b in the order of register j.
RANK = np.empty((REGISTERS, REGISTERS), np.int16)
np.put_along_axis(RANK, _order, np.arange(REGISTERS, dtype=np.int16)[None, :].repeat(REGISTERS, 0), axis=1)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): document i's set is hashes[bounds[i] : bounds[i + 1]], ascending.

    A-Z are lower-cased; words are runs of other characters than ASCII white space. Fewer words
    than size make one shingle, no words none.
    """
    w = ts.scan(texts, lower=True)
    at = np.arange(len(w.hash))
    doc = w.doc
    full = at + size <= w.doc_end
    hashes, owner = ts.grams(w.hash, size)[full], doc[full]
    counts = np.diff(w.first)
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            hashes, owner = np.r_[hashes, ts.grams(w.hash, n)[w.first[few]]], np.r_[owner, few]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def set_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: equal sets, equal bits."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(ts.mix(hashes ^ U(salt)), out=sums[1:])
        out.append(ts.mix(sums[bounds[1:]] - sums[bounds[:-1]] + (bounds[1:] - bounds[:-1]).astype(U)))
    return out[0], out[1]


def _packed(rest: np.ndarray) -> np.ndarray:
    """Leading zeros of 56 bits (at most 46, so that a mantissa is left) and the bits after the first one."""
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    big = length > 52  # the float may have been rounded up to the next power of two
    length[big] -= (rest[big] >> (length[big] - 1).astype(U)) == 0
    length = np.maximum(length, MANTISSA + 1)
    return (((REST - length) << MANTISSA) | ((rest >> (length - 1 - MANTISSA).astype(U)).astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of REGISTERS 16-bit registers for each set; zeros for an empty set."""
    n = len(bounds) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    filled = np.zeros((n, REGISTERS), bool)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    spread = ts.mix(hashes ^ U(0xA0761D6478BD642F))
    register = (spread >> U(REST)).astype(np.int64)
    rest = spread & U((1 << REST) - 1)
    cell = owner * REGISTERS + register
    order = np.lexsort((rest, cell))
    first = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0]) if len(order) else order
    least = order[first]
    out.ravel()[cell[least]] = _packed(rest[least])
    filled.ravel()[cell[least]] = True
    for i in np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1)):
        full, empty = np.flatnonzero(filled[i]), np.flatnonzero(~filled[i])
        out[i, empty] = out[i, full[RANK[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """One row of band keys for each sketch; the band is part of its key."""
    keys = np.repeat(np.arange(1, len(BANDS) + 1, dtype=U)[None, :], len(registers), axis=0)
    for at in BANDS.T:
        keys = ts.mix(keys * U(ts.GRAM) + registers[:, at].astype(U))
    return keys


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of sketches, less the share of registers that agree by chance.

    Two independent minima agree if their leading-zero counts and mantissas do; for sets of like
    size that is 0.1699 * 2 ** (BITS - MANTISSA + 1) registers of all (Yu and Weber, HyperMinHash).
    """
    chance = 0.169919487159739 * 2.0 ** (BITS - MANTISSA + 1) / REGISTERS
    share = (a == b).mean(axis=1)
    return np.clip((share - chance) / (1 - chance), 0, 1)
