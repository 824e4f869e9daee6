"""Recurring passages, found with repeated-phrase automata.

Documents are dealt into shards of about SHARD_ROWS rows or SHARD_BYTES bytes by a hash of doc_id and text. Then:

1. Each shard hashes the 8-word phrases of its documents and keeps, for each window of
   ``window`` words, the phrase with the least hash: equal windows keep equal phrases, so a
   window whose phrase stands at one place only cannot recur. The kept hashes go to owners by
   hash; owners tell each shard which of its phrases recur.
2. Each shard hashes the windows around recurring phrases (96 bits) and sends them to owners,
   which confirm those that start at two places or more.
3. Each shard compiles an Aho-Corasick automaton of the phrases of its confirmed windows,
   streams all its documents through it, and around each occurrence marks the words that
   confirmed windows cover.

An owner gets at most one entry (two, for "more than once") per hash and shard, however
often a shard repeats a passage, and hashes are even, so no task depends on how frequent a
passage is. A shard's entries for one owner are one row, so there are never more rows than entries,
which are in proportion to the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm import textscan as ts
from lexmere.llm.shared import row_key
from lexmere.llm.textscan import U

WINDOW = 35
PHRASE = 8
SHARD_ROWS, SHARD_BYTES = 2048, 4 << 20

_BLOBS = "owner int, shard int, keys binary, checks binary, places binary, phrases string"
_BACK = "shard int, keys binary, places binary, phrases string"


def _shape(words: ts.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hash at each word, whether a window starts there, and that window's least phrase hash."""
    at = np.arange(len(words.hash))
    h = ts.grams(words.hash, phrase)
    whole = at + window <= words.doc_end
    least = ts.slide(h, window - phrase + 1, True)
    least[~whole] = 0
    return h, whole, least


def _keys(words: ts.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return ts.grams(words.hash, window), ts.grams(words.hash, window, ts.P).astype(np.uint32)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_BLOB_SCHEMA = pa.schema([("owner", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("places", pa.binary()), ("phrases", pa.string())])
_BACK_SCHEMA = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("places", pa.binary()), ("phrases", pa.string())])


def _parts(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(owner[part[0]]), part


def _offer(owners: int, window: int, phrase: int):
    def run(docs: pa.Table) -> pa.Table:
        shard = docs.column("shard")[0].as_py()
        got = []
        for piece in ts.pieces(docs):
            w = ts.scan(piece.column("text"))
            h, _, least = _shape(w, window, phrase)
            got.append(h[(ts.slide(least, window - phrase + 1, False) == h) & (h > 0)])
        u, n = np.unique(np.concatenate(got), return_counts=True)
        keys = np.repeat(u, np.minimum(n, 2))
        return _table([(o, shard, keys[p].tobytes(), None, None, None) for o, p in _parts((keys % U(owners)).astype(np.int32))], _BLOB_SCHEMA)

    return run


def _recurring(blobs: pa.Table) -> pa.Table:
    """What an owner tells the shards: which of their keys stand at two places or more."""
    rows, columns = [], {c: blobs.column(c).to_pylist() for c in ("shard", "keys", "checks", "places", "phrases")}
    use = [i for i, k in enumerate(columns["keys"]) if k is not None]
    rows += [(columns["shard"][i], None, None, columns["phrases"][i]) for i, p in enumerate(columns["phrases"]) if p is not None]
    keys = [np.frombuffer(columns["keys"][i], U) for i in use]
    if keys:
        key = np.concatenate(keys)
        check = [np.frombuffer(columns["checks"][i], np.uint32) for i in use if columns["checks"][i] is not None]
        check = np.concatenate(check) if check else np.zeros(len(key), np.uint32)
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = 0
        for i, own in zip(use, keys, strict=True):
            hit = twice[at : at + len(own)]
            at += len(own)
            if hit.any():
                places = columns["places"][i]
                rows.append((columns["shard"][i], own[hit].tobytes(), None if places is None else np.frombuffer(places, np.int32)[hit].tobytes(), None))
    return _table(rows, _BACK_SCHEMA)


def _told(back: pa.Table) -> np.ndarray:
    blobs = [np.frombuffer(b, U) for b in back.column("keys").to_pylist() if b is not None]
    return np.unique(np.concatenate(blobs)) if blobs else np.zeros(0, U)


def _confirm(owners: int, window: int, phrase: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        known = _told(back)
        if not len(docs) or not len(known):
            return _table([], _BLOB_SCHEMA)
        shard = docs.column("shard")[0].as_py()
        keys, checks, places, phrases = [], [], [], [b""] * len(known)
        for piece in ts.pieces(docs):
            w = ts.scan(piece.column("text"))
            h, whole, least = _shape(w, window, phrase)
            at = np.flatnonzero(whole & ts.isin_sorted(least, known))
            if not len(at):
                continue
            key, check = _keys(w, window)
            place = np.searchsorted(known, least[at]).astype(np.int32)
            keys.append(key[at]), checks.append(check[at]), places.append(place)
            new = np.unique(place[[not phrases[p] for p in place]])
            spots = np.flatnonzero(ts.isin_sorted(h, known[new]))
            for p, s in zip(*np.unique(np.searchsorted(known, h[spots]), return_index=True), strict=True):
                if not phrases[p]:
                    phrases[p] = w.text(spots[s], spots[s] + phrase)
        if not keys:
            return _table([], _BLOB_SCHEMA)
        key, check, place = np.concatenate(keys), np.concatenate(checks), np.concatenate(places)
        order = np.lexsort((check, key))
        key, check, place = key[order], check[order], place[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(key)])
        keep = np.repeat(first, np.minimum(n, 2))
        key, check, place = key[keep], check[keep], place[keep]
        rows = [(o, shard, key[p].tobytes(), check[p].tobytes(), place[p].tobytes(), None) for o, p in _parts((key % U(owners)).astype(np.int32))]
        rows.append((shard % owners, shard, None, None, None, b"\n".join(phrases).decode("utf-8", "replace")))
        return _table(rows, _BLOB_SCHEMA)

    return run


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds phrases of whole words in a text whose words are joined by single spaces, one at either end too."""
    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(f" {p} ", len(p) + 1)
    found.make_automaton()
    return found


def _occurrences(machine: ahocorasick.Automaton, words: list[bytes]) -> np.ndarray:
    """The word positions at which phrases of the automaton begin."""
    text = f" {b' '.join(words).decode('utf-8', 'replace')} "
    begins = [end - n for end, n in machine.iter(text)]
    if not begins:
        return np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20)
    return np.unique(np.searchsorted(gaps, begins))


def _mark(window: int, phrase: int, carry: list[str], schema: pa.Schema):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return _table([], schema)
        known = _told(back)
        machine = None
        if len(known):
            phrases = next(p for p in back.column("phrases").to_pylist() if p is not None).split("\n")
            used = np.unique(np.concatenate([np.frombuffer(b, np.int32) for b in back.column("places").to_pylist() if b is not None]))
            machine = automaton([phrases[i] for i in used if phrases[i]])
        out = []
        for piece in ts.pieces(docs):
            texts = [(t or "").encode().split() for t in piece.column("text").to_pylist()]
            hit, near = [], []
            if machine is not None:
                for i, t in enumerate(texts):
                    if len(t) >= window and len(found := _occurrences(machine, t)):
                        hit.append(i)
                        reach = np.zeros(len(t) + 1, np.int32)
                        np.add.at(reach, np.maximum(found - (window - phrase), 0), 1)
                        np.add.at(reach, found + 1, -1)
                        near.append(np.cumsum(reach[:-1]) > 0)
            covered: dict[int, np.ndarray] = {}
            if hit:
                w = ts.scan(piece.column("text").take(pa.array(hit)))
                key, _ = _keys(w, window)
                starts = np.concatenate(near) & (np.arange(len(key)) + window <= w.doc_end) & ts.isin_sorted(key, known)
                edge = np.zeros(len(key) + 1, np.int32)
                at = np.flatnonzero(starts)
                edge[at] += 1
                np.add.at(edge, at + window, -1)
                inside = np.cumsum(edge[:-1]) > 0
                covered = {i: inside[a:b] for i, a, b in zip(hit, w.first[:-1], w.first[1:], strict=True)}
            for i, (row, t) in enumerate(zip(piece.select(carry).to_pylist(), texts, strict=True)):
                gone = covered.get(i)
                kept = t if gone is None or not gone.any() else [x for x, g in zip(t, gone.tolist(), strict=True) if not g]
                out.append((*row.values(), b" ".join(kept).decode("utf-8", "replace"), len(t), len(t) - len(kept)))
        return _table(out, schema)

    return run


def remove_recurring(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed: each text without the words that recurring windows cover.

    Words are runs of other characters than ASCII white space, unchanged; a window recurs if
    its words also start at any other place of any document, its own included. All windows are
    judged on the input. kept_text has the kept words joined by single spaces. Null and
    empty texts: no words, empty kept_text. Fewer words than a window: all kept. Rows that are
    alike are different places. One row per input row; columns but doc_id and text aren't read.
    """
    if window < phrase:
        raise ValueError("a window must hold a phrase")
    held = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).head()
    shards = max(1, math.ceil(held["n"] / shard_rows), math.ceil(held["b"] / SHARD_BYTES))
    dealt = docs.select("doc_id", "text").withColumn("shard", F.pmod(row_key(F.col("doc_id"), F.col("text")), F.lit(shards)).cast("int"))
    by = dealt.groupBy("shard")
    offered = by.applyInArrow(_offer(shards, window, phrase), _BLOBS)
    recurring = offered.groupBy("owner").applyInArrow(_recurring, _BACK)
    windows = by.cogroup(recurring.groupBy("shard")).applyInArrow(_confirm(shards, window, phrase), _BLOBS)
    confirmed = windows.groupBy("owner").applyInArrow(_recurring, _BACK)
    kind = dict(docs.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
    return by.cogroup(confirmed.groupBy("shard")).applyInArrow(_mark(window, phrase, ["doc_id"], schema), f"doc_id {kind}, kept_text string, n_words long, n_removed long")

