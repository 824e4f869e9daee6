"""URL filters by cascades of Bloom filters over the corpus's own keys.

Each url has keys: its whole host, and for every shape of rule (labels of the host, characters of the
path) the host's last labels with the path's first characters. The distinct keys of all urls are the
universe. A cascade for a list holds its keys in a first Bloom filter, the other keys of the universe
that pass it in a second, the listed keys that pass that in a third, until none passes wrongly; so on the
universe it answers exactly, in a few bits a key, and urls are judged without joins.

Keys are told apart by 128 bits of SHA-256. They are dealt to shards by their first bits, a cascade is
built for each shard in one task, and all shards go out as broadcasts of bounded size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm.shared import BROADCAST_BYTES, drop, lower_ascii, stage
from lexmere.llm.textscan import U, mix

#: Keys of a shard at most, in the mean: what one task holds while it builds a cascade.
SHARD_KEYS = 500_000
#: More levels than any universe needs: each level halves at least what passes wrongly.
LEVELS = 200
LISTS = ("allow", "block")


class Level(NamedTuple):
    bits: int
    hashes: int
    words: np.ndarray


def _places(keys: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The places of keys (two 64-bit lanes each) in a level's filter, one hash function after another; each level has functions of its own."""
    seed = mix(np.array([2 * level + 1, 2 * level + 2], U))
    a, b = mix(keys[:, 0] ^ seed[0]) + keys[:, 1], mix(keys[:, 1] ^ seed[1]) | U(1)
    for i in range(hashes):
        yield mix(a + U(i) * b) % U(bits)


def passes(level: Level, number: int, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _places(keys, number, level.bits, level.hashes):
        out &= (level.words[at >> U(6)] >> (at & U(63))) & U(1) == 1
    return out


def build(keys: np.ndarray, listed: np.ndarray) -> list[Level]:
    """The cascade that tells the listed keys from all others of ``keys``; none listed: no levels."""
    levels, inside, outside = [], keys[listed], keys[~listed]
    while len(inside):
        if len(levels) == LEVELS:
            raise RuntimeError("two keys have the same 128 bits")
        # the first filter lets through about as many others as there are listed keys, later ones a half
        rate = min(0.5, len(inside) / (math.sqrt(2) * max(1, len(outside)))) if not levels else 0.5
        bits = 64 * math.ceil(max(64, -len(inside) * math.log(rate) / math.log(2) ** 2) / 64)
        hashes = max(1, round(-math.log2(rate)))
        held = np.zeros(bits, bool)
        for at in _places(inside, len(levels), bits, hashes):
            held[at] = True
        level = Level(bits, hashes, np.packbits(held, bitorder="little").view(U))
        inside, outside = outside[passes(level, len(levels), outside)], inside
        levels.append(level)
    return levels


def holds(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the first level that a key fails decides, or the last one where it passes all."""
    out = np.full(len(keys), len(levels) % 2 == 1)
    rest = np.arange(len(keys))
    for n, level in enumerate(levels):
        ok = passes(level, n, keys[rest])
        out[rest[~ok]] = n % 2 == 1
        rest = rest[ok]
    return out


def dump(levels: list[Level]) -> bytes:
    head = np.array([len(levels), *(x for v in levels for x in (v.bits, v.hashes))], "<i8")
    return b"".join([head.tobytes(), *(v.words.astype("<u8").tobytes() for v in levels)])


def load(raw: bytes) -> list[Level]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist(), 8 + 16 * n, []
    for bits, hashes in sizes:
        out.append(Level(bits, hashes, np.frombuffer(raw, "<u8", bits // 64, at)))
        at += bits // 8
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 32)


def _host_key(host: Column) -> Column:
    """No rule's key has a question mark."""
    return F.concat(F.lit("?"), host)


def _rule_key(host: Column, path: Column, labels: int, chars: int) -> Column:
    """The key of one shape; null where the host or the path is too short for it."""
    fits = (_labels(host) >= labels) & (F.length(path) >= chars)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def _built(table: pa.Table) -> pa.Table:
    keys = np.frombuffer(b"".join(table["digest"].to_pylist()), ">u8").astype(U).reshape(-1, 2)
    raw = [dump(build(keys, table[name].to_numpy() > 0)) for name in LISTS]
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), **{n: pa.array([r], pa.binary()) for n, r in zip(LISTS, raw, strict=True)}})


def _probed(volume: dict[int, tuple[bytes, bytes]], shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets the marks of the keys that are in this volume's shards: 1 allow, 2 block, 0 neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascades = {s: [load(raw) for raw in pair] for s, pair in volume.value.items()}
        for batch in batches:
            digests, marks = batch.column("digests"), batch.column("marks")
            flat, mark = digests.flatten(), marks.flatten().to_numpy(zero_copy_only=False).copy()
            there = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
            keys = np.frombuffer(b"".join(flat.drop_null().to_pylist()), ">u8").astype(U).reshape(-1, 2)
            shard = (keys[:, 0] % U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for s, part in zip(*_groups(shard[order], order), strict=True):
                if s in cascades:
                    for bit, levels in zip((1, 2), cascades[s], strict=True):
                        mark[there[part[holds(levels, keys[part])]]] |= bit
            ends = np.arange(len(marks) + 1, dtype=np.int32) * (len(mark) // max(1, len(marks)))
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(mark, pa.int32()))
            yield pa.RecordBatch.from_arrays([values if n == "marks" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return run


def _groups(sorted_values: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return sorted_values[np.r_[0, cuts]].tolist() if len(order) else [], np.split(order, cuts) if len(order) else []


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, volume_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: one row per input row.

    rules has host, path and verdict (allow or block); a rule fits its host and all subdomains where the path
    starts with its path, the longest that fits decides (of equally long ones that with the longer host; one that is
    listed both ways blocks). Elsewhere hosts of ``listed`` (column host) are blocked, all others allowed. listed in
    the result says so for each row.

    Null urls and urls without ``://`` have an empty host and path, which no rule fits. Empty tables give no
    rows; null page_ids and repeated rows get the result of their url; urls of any length are whole; columns but page_id and url aren't read.
    The number of rule shapes is that of the distinct pairs (labels of the host, characters of the path) in ``rules``.
    """
    rules = rules.filter("not host rlike '[/?#]' and path rlike '^(/[^?#]*)?$'")  # others can't fit
    shapes = sorted((r["labels"], r["chars"]) for r in rules.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars")).distinct().collect())

    def keys_of(host: Column, path: Column) -> list[Column]:
        return [_host_key(host), *(_rule_key(host, path, *shape) for shape in shapes)]

    keys = keys_of(host_of(F.col("url")), path_of(F.col("url")))
    zero = F.lit(0)
    corpus = pages.select(F.explode(F.array(*keys)).alias("key")).filter("key is not null")
    corpus = corpus.select(_digest(F.col("key")).alias("hex"), F.lit(1).alias("met"), zero.alias("allow"), zero.alias("block"))
    named = rules.select(_digest(F.concat("host", "path")).alias("hex"), zero.alias("met"), *((F.col("verdict") == n).cast("int").alias(n) for n in LISTS))
    hosts = listed.select(_digest(_host_key(F.col("host"))).alias("hex"), zero.alias("met"), zero.alias("allow"), F.lit(1).alias("block"))
    every = corpus.unionByName(named).unionByName(hosts).groupBy("hex").agg(*(F.max(c).alias(c) for c in ("met", *LISTS))).filter("met = 1").drop("met")
    universe = stage(every, "url-keys")
    shards = max(1, math.ceil(universe.count() / shard_keys))
    # the first eight bytes modulo the number of shards, as the probes take it
    halves = [F.conv(F.substring("hex", at, 8), 16, 10).cast("decimal(20,0)") for at in (1, 9)]
    shard = ((halves[0] * F.lit(1 << 32) + halves[1]) % F.lit(shards)).cast("long")
    dealt = universe.select(F.unhex("hex").alias("digest"), *LISTS, shard.alias("shard"))
    cascades = stage(dealt.groupBy("shard").applyInArrow(_built, "shard long, allow binary, block binary"), "url-cascades")
    drop(universe)

    size = functools.reduce(add, (F.length(n) for n in LISTS))
    sizes = {r["shard"]: r["bytes"] for r in cascades.select("shard", size.alias("bytes")).collect()}
    volumes: list[list[int]] = [[]]
    for s, n in sorted(sizes.items()):
        if volumes[-1] and sum(sizes[x] for x in volumes[-1]) + n > volume_bytes:
            volumes.append([])
        volumes[-1].append(s)
    out = pages.select("page_id", "url").select("*", F.array(*[F.unhex(_digest(k)) for k in keys]).alias("digests"), F.array(*[zero] * len(keys)).alias("marks"))
    schema, spark = f"page_id {dict(pages.dtypes)['page_id']}, url string, digests array<binary>, marks array<int>", pages.sparkSession
    for n, volume in enumerate(volumes):
        held = {r["shard"]: (bytes(r["allow"]), bytes(r["block"])) for r in cascades.filter(F.col("shard").isin(volume)).collect()}
        if n:
            out = stage(out, "url-marks")  # so that a worker holds one volume at a time
        out = out.mapInArrow(_probed(spark.sparkContext.broadcast(held), shards), schema)
    drop(cascades)

    host, path = F.col("host"), F.col("path")
    out = out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "marks")
    fits = []
    for i, (shape, key) in enumerate(zip(shapes, keys_of(host, path)[1:], strict=True), 1):
        mark = F.get("marks", F.lit(i))
        fits.append(F.when(mark > 0, F.struct(F.length(key).alias("n"), F.length(F.substring_index(host, ".", -shape[0])).alias("h"), key.alias("rule"), mark.alias("mark"))))
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,h:int,rule:string,mark:int>")
    out = out.select("page_id", "host", "path", (F.get("marks", F.lit(0)) > 0).alias("listed"), best.alias("best"))
    verdict = F.when(F.coalesce(F.col("best.mark") >= 2, F.col("best.mark").isNull() & F.col("listed")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")


def hosts_with(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """The distinct hosts of the urls with one of ``words`` between their dots and hyphens: a list of hosts for judge()."""
    host = host_of(F.col("url"))
    return pages.select(host.alias("host")).filter(F.arrays_overlap(F.split("host", r"[.-]"), F.array(*map(F.lit, words)))).distinct()
