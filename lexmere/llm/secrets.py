"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmere.llm import textscan as ts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of fewer signs would be dropped
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``signs`` with a digit and a letter; a window of a width is a secret if its entropy is at
    least that which all but a share of strings drawn at random from ``signs`` have; widths: pairs of width and share."""

    kind: str
    signs: str
    widths: tuple[tuple[int, float], ...] = ((20, 0.1), (32, 0.02))

    @property
    def least(self) -> int:
        return min(w for w, _ in self.widths)

    def bits(self) -> list[tuple[int, float]]:
        return [(w, threshold(len(self.signs), w, share)) for w, share in self.widths]


@lru_cache
def threshold(signs: int, width: int, share: float, draws: int = 4_000) -> float:
    """The entropy that a share of random strings stays below: of ``draws`` drawn with a fixed seed."""
    drawn = np.random.default_rng(signs * 1_000 + width).integers(0, signs, (draws, width))
    counts = (drawn[:, :, None] == np.arange(signs)).sum(axis=1)
    p = counts / width
    return float(np.quantile(-(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=1), share))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From wide to narrow: fewer signs need less entropy; what a wider class holds, a narrower one does not find again.
CLASSES = (
    CharClass("base64_entropy", _UPPER + _LOWER + _DIGITS + "+/_=-"),
    CharClass("alnum_entropy", _UPPER + _LOWER + _DIGITS),
    CharClass("lower_entropy", _LOWER + _DIGITS),
    CharClass("base32_entropy", _UPPER + "234567"),
    CharClass("hex_entropy", _DIGITS + "ABCDEF"),
)
#: Parts of candidates, between separators, that are names and not secrets: words in any case with few numbers among them, numbers, capitals, single letters.
ALLOWED = (
    r"(?:[A-Z][a-z]++|[a-z]{2,}+)++(?:\d{1,8}+(?:[A-Z][a-z]++|[a-z]{2,}+)++){0,2}\d{0,8}",
    r"[A-Z]{1,12}\d{0,8}",
    r"[A-Za-z]?\d{1,18}[A-Za-z]?",
    r"[a-z]{1,3}\d{0,8}",
)
SEPARATORS = "/_=+-"
#: What no window may meet: alphabets and placeholders, UUIDs, dates.
PLACEHOLDER = re.compile(
    "0123456789|abcdefghijklm|example|placeholder|changeme|xxxx|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", re.I
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))


def _table(signs: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(signs.encode())] = True
    return t


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, in code points, end exclusive."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _between(run: str) -> Iterator[tuple[int, str]]:
    """Start and text of the parts of a candidate outside placeholders."""
    at = 0
    for m in PLACEHOLDER.finditer(run):
        yield at, run[at : m.start()]
        at = m.end()
    yield at, run[at:]


def entropy_spans(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal unions of the windows of a string with at least ``bits`` of Shannon entropy.

    Counts change by one sign in and one sign out; the entropy is log2(w) - sum(c log2 c) / w.
    """
    term = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, sign in enumerate(run):
        c = counts.get(sign, 0)
        total += term[c + 1] - term[c]
        counts[sign] = c + 1
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            a, b = i - window + 1, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> None:
        self.classes = [(c, re.compile(f"[{re.escape(c.signs)}]{{{c.least},}}"), c.bits()) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed))
        self.parts = re.compile(f"[^{re.escape(SEPARATORS)}]+")

    def core(self, run: str) -> tuple[int, int]:
        """From the first part of a candidate that is no name to the last; empty if all are."""
        odd = [m.span() for m in self.parts.finditer(run) if not self.allowed.fullmatch(m[0])]
        return (odd[0][0], odd[-1][1]) if odd else (0, 0)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of high entropy that no base span and no span of an earlier class holds."""
        held, found = [(a, b) for _, a, b in base], []
        for c, runs, widths in self.classes:
            held.sort()
            starts, reach = [a for a, _ in held], list(accumulate((b for _, b in held), max))  # the farthest end of the spans that start by then
            own = []
            for m in runs.finditer(text):
                begin, stop = self.core(m[0])
                run = m[0][begin:stop]
                if len(run) < c.least or not (any(x.isdigit() for x in run) and any(x.isalpha() for x in run)):
                    continue
                begin += m.start()
                spans = sorted((x + at, y + at) for at, part in _between(run) for width, bits in widths for x, y in entropy_spans(part, width, bits))
                for a, b in _joined(spans):
                    before = bisect_right(starts, begin + a)
                    if not before or reach[before - 1] < begin + b:
                        own.append((begin + a, begin + b))
            found += [(c.kind, a, b) for a, b in own]
            held += own
        return found

    def triggered(self, texts: pa.Array) -> np.ndarray:
        """Documents that can hold any span: those with a keyword, AKIA, or a long run of some class."""
        data, off = ts.buffers(texts)
        low = ts.LOWER[data].tobytes()
        at = [m.start() for k in KEYWORDS for m in re.finditer(re.escape(k), low)]
        at += [m.start() for m in re.finditer(b"AKIA", data.tobytes())]
        for signs, least in [("0123456789abcdef", 16), *((c.signs, c.least) for c, _, _ in self.classes)]:
            inside = np.zeros(len(data) + 2, bool)
            inside[1:-1] = _table(signs)[data]
            begin, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
            edges = off[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            begin[edges] = inside[edges + 1]
            stop[edges - 1] |= inside[edges]
            starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            at += starts[ends - starts >= least].tolist()
        hit = np.zeros(len(off) - 1, bool)
        if at:
            hit[np.searchsorted(off, np.unique(at), "right") - 1] = True
        return hit


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scanned(classes: tuple[CharClass, ...], allowed: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    none = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for batch in batches:
            for part in ts.pieces(batch):
                hit, rows = scanner.triggered(part.column("text")), []
                for i, suspect in enumerate(hit.tolist()):
                    if not suspect:
                        rows.append(none)
                        continue
                    text = part.column("text")[i].as_py() or ""
                    base = base_spans(text)
                    kinds = [k for k, _, _ in base]
                    rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + scanner.added(text, base))))
                names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
                columns = [pa.array(c, pa.int64() if j < 3 else pa.string()) for j, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return run


def scan_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per input row.

    spans lists kind:start:end (code points, end exclusive) by start, then kind: all base matches,
    whole matches that is, and the entropy spans that no other span holds. Null and empty texts:
    none. An empty table gives no rows; null doc_ids pass through; repeated rows get equal results; texts are taken whole,
    however long; columns but doc_id and text aren't read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scanned(classes, allowed), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
