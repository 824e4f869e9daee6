"""Near-duplicate documents: HyperMinHash candidates, exact links, connected components.

Documents with equal shingle sets form one class and are handled once. Classes meet in the
buckets of 64 bands of eight registers each, two arrangements of the 256 registers (a pair of
similarity 0.8 shares 11 buckets on average and misses all with probability 8e-6). Sets so small that only an
equal set can reach the threshold are in no band.

A bucket's classes are first held against one leader: the class that meets the most others over all its
buckets, so the text that a group of copies was made from leads rather than one of the copies.
What a leader leads is its star. Within a star, estimates that are corrected for collisions pick the members whose whole sets are
compared with the leader's. Buckets that are then in one component are done. Of the others,
the members outside a star's largest component meet the whole star, estimate first and sets after, in blocks of bounded size
within tasks: no pair is written down that is not a link, and a class links to another component
once for each block at most. That work grows with the product of these two numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm import hyperminhash as hmh
from lexmere.llm import textscan as ts
from lexmere.llm.shared import WORD, drop, row_key, small, stage

#: Members of one star, or classes of one block, that are compared in one group, and how many shingles they hold, about.
GROUP, SHINGLES = 256, 1 << 22

Batches = Iterator[pa.RecordBatch]


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hmh.REGISTERS)


def _sketched(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in ts.pieces(batch):
                hashes, bounds = hmh.shingle_sets(part.column("text"), size)
                a, b = hmh.set_hashes(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(np.diff(bounds), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _binary(hmh.sketches(hashes, bounds))],
                    ["doc_id", "key", "n", "s1", "s2", "regs"],
                )

    return run


def _banded(batches: Batches) -> Batches:
    for batch in batches:
        if len(batch):
            keys = hmh.bands(_registers(batch.column("regs")))
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.ravel().view(np.int64))], ["node", "band"])


def _sets(size: int) -> Callable[[Batches], Batches]:
    """Texts to their sets and sketches; drops texts whose set is not the class's."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in ts.pieces(batch):
                hashes, bounds = hmh.shingle_sets(part.column("text"), size)
                own = hmh.set_hashes(hashes, bounds)[0].view(np.int64)
                raw = [hashes[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                rows = pa.RecordBatch.from_arrays([part.column("node"), _binary(hmh.sketches(hashes, bounds)), pa.array(raw, pa.binary())], ["node", "regs", "set"])
                yield rows.filter(pa.array(own == part.column("s1").to_numpy(zero_copy_only=False)))

    return run


def _links(own: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, percent: int) -> np.ndarray:
    """The places of the sets that are linked with own: those with a near estimate are compared whole."""
    t = percent / 100
    sizes = np.array([len(s) for s in sets])
    small, large = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
    # Six deviations of 256 draws; shingles that share a register can cost a small set one more.
    slack = 6 * np.sqrt(t * (1 - t) / hmh.REGISTERS)
    at = np.flatnonzero(100 * small >= percent * large)
    at = at[hmh.estimate(regs[None, :], sketches[at]) >= t - slack - 1 / small[at]]
    if not len(at):
        return at
    both = np.add.reduceat(ts.isin_sorted(np.concatenate([sets[i] for i in at]), own), np.r_[0, np.cumsum(sizes[at])[:-1]])
    return at[100 * both >= percent * (sizes[at] + len(own) - both)]


def _led(percent: int) -> Callable[[pa.Table], pa.Table]:
    """A star's links between its leader and members."""

    def run(group: pa.Table) -> pa.Table:
        leads = group.column("leads").to_numpy(zero_copy_only=False)
        found, lead = np.zeros(0, np.int64), np.flatnonzero(leads)
        if len(lead):
            sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
            sketches, rest = _registers(group.column("regs")), np.flatnonzero(~leads)
            found = group.column("node").to_numpy()[rest[_links(sets[lead[0]], sketches[lead[0]], [sets[i] for i in rest], sketches[rest], percent)]]
        return pa.table({"a": pa.array(np.repeat(group.column("lead").to_numpy()[:1], len(found)), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def _crossed(percent: int) -> Callable[[pa.Table], pa.Table]:
    """The components (a, b) that a block's minor classes join: for each such class one link to each other component."""

    def run(group: pa.Table) -> pa.Table:
        minor, comp = (group.column(c).to_numpy(zero_copy_only=False) for c in ("minor", "comp"))
        sets, sketches = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()], _registers(group.column("regs"))
        rest, found = np.flatnonzero(~minor), set()
        for i in np.flatnonzero(minor):
            others = rest[comp[rest] != comp[i]]
            hit = others[_links(sets[i], sketches[i], [sets[j] for j in others], sketches[others], percent)] if len(others) else others
            found.update((min(comp[i], c), max(comp[i], c)) for c in np.unique(comp[hit]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _buckets(classes: DataFrame, percent: int) -> DataFrame:
    """band, lead, node: the classes of every bucket of two or more, the leader too."""
    able = classes.filter(100 * F.col("n") >= percent * (F.col("n") + 1))
    bands = stage(able.select("node", "regs").mapInArrow(_banded, "node long, band long"), "bands")
    # Tables that are joined are written first: both sides are then plain shuffles, of which a hot key's partition can be split.
    counts = stage(bands.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    shared = stage(bands.join(counts, "band"), "shared")
    drop(bands, counts)
    meets = shared.groupBy("node").agg(F.sum(F.col("m") - 1).alias("meets"))
    first = F.max(F.struct("meets", (-F.col("node")).alias("last")))
    leaders = stage(shared.join(meets, "node").groupBy("band").agg((-first["last"]).alias("lead")), "leaders")
    led = stage(shared.select("band", "node").join(leaders, "band"), "led")
    drop(shared, leaders)
    return led


def _whole(led: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """node, regs, set of the classes that share a bucket."""
    keys = stage(led.select("node").distinct().join(classes.select("node", "key", "s1"), "node"), "wanted")
    rows = texts.join(small(keys, F.lit(48)), "key").select("node", "s1", "text").mapInArrow(_sets(size), "node long, regs binary, set binary")
    sets = stage(rows.groupBy("node").agg(F.first("regs").alias("regs"), F.first("set").alias("set")), "sets")  # a row that is repeated has one key
    drop(keys)
    return sets


def _parts(classes: str, shingles: str) -> F.Column:
    return F.ceil(F.greatest(F.col(classes) / GROUP, F.col(shingles) / SHINGLES)).cast("int")


def _part(parts: str) -> F.Column:
    return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")


def _each(parts: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _to_leaders(led: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of stars' members with their leaders. Large stars are dealt into groups, each with the leader's set."""
    pairs = stage(led.select("lead", "node").distinct().filter("lead != node").join(sizes, "node"), "pairs")
    stars = stage(pairs.groupBy("lead").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).select("lead", _parts("members", "shingles").alias("parts")), "stars")
    members = pairs.join(stars, "lead").select("lead", _part("parts").alias("part"), "node", F.lit(False).alias("leads"))
    leads = stars.select("lead", _each("parts").alias("part"), F.col("lead").alias("node"), F.lit(True).alias("leads"))
    rows = members.unionByName(leads).join(sets, "node")
    links = stage(rows.groupBy("lead", "part").applyInArrow(_led(percent), "a long, b long"), "links")
    drop(pairs, stars)
    return links


def _across(led: DataFrame, comps: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between the components of each star, by number; None if no bucket of three or more has several."""
    placed = stage(led.join(comps, "node", "left").select("band", "lead", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    several = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"))
    several = stage(several.filter("m > 2 and low != high").select("band"), "several")
    mixed = stage(placed.join(several, "band", "left_semi").select("lead", "node", "comp").distinct().join(sizes, "node"), "mixed")
    drop(placed, several)
    if mixed.isEmpty():
        drop(mixed)
        return None
    each = mixed.groupBy("lead", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("held"))
    stars = each.groupBy("lead").agg(F.max(F.struct("m", "held", "comp")).alias("top"), F.sum("m").alias("every"), F.sum("held").alias("all_held")).select(
        "lead", F.col("top.comp").alias("main"), "every", "all_held", (F.col("every") - F.col("top.m")).alias("rest"), (F.col("all_held") - F.col("top.held")).alias("rest_held"))
    stars = stage(stars.filter("rest > 0").select("lead", "main", _parts("every", "all_held").alias("parts"), _parts("rest", "rest_held").alias("minors")), "stars")
    all_ = mixed.join(stars, "lead")
    every = all_.select("lead", "node", "comp", F.lit(False).alias("minor"), _part("parts").alias("x"), _each("minors").alias("y"))
    minor = all_.filter("comp != main").select("lead", "node", "comp", F.lit(True).alias("minor"), _each("parts").alias("x"), _part("minors").alias("y"))
    rows = every.unionByName(minor).join(sets, "node")
    links = stage(rows.groupBy("lead", "x", "y").applyInArrow(_crossed(percent), "a long, b long"), "links")
    drop(mixed, stars)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, comp (one node of its component) for every node of links (a, b).

    Each round, a node joins the least of its neighbours and itself in an order of the round's own, and
    links between joined nodes become one: few links are left after a few rounds, whatever the shape.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.xxhash64(F.lit(len(maps)), F.col(c))  # noqa: B023, E731
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), "b")).alias("to"))
        joined = stage(least.select(F.col("a").alias("node"), F.when(F.col("to.h") < order("a"), F.col("to.b")).otherwise(F.col("a")).alias("comp")), "joined")
        maps.append(joined)
        side = lambda c: joined.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))  # noqa: B023, E731
        moved = edges.join(side("a"), "a").join(side("b"), "b").select(F.least("a_comp", "b_comp").alias("a"), F.greatest("a_comp", "b_comp").alias("b"))
        was, edges = edges, stage(moved.filter("a != b").distinct(), "edges")
        drop(was)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    drop(edges)
    ends = maps.pop()
    while maps:
        joined = maps.pop()
        further = ends.select(F.col("node").alias("comp"), F.col("comp").alias("end"))
        was, ends = ends, stage(joined.join(further, "comp", "left").select("node", F.coalesce("end", "comp").alias("comp")), "ends")
        drop(was, joined)
    return ends


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, carry_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * intersection >= percent * union.

    If asked, also key (the row_key) and comp, a number of the component that is never null where there are shingles.

    Sets are of distinct shingles of ``size`` words, A-Z lower-cased; fewer words make one
    shingle. Null, empty and blank texts have none and are linked with nothing. component_id is the
    least doc_id reachable over links, the own one included; kept is doc_id = component_id (null
    doc_ids count as equal and as larger than all others). Rows with one doc_id are documents
    of their own; equal rows share a class. One row per input row, none of an empty table; texts are taken whole, however
    long; other columns aren't read.
    """
    texts = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = stage(texts.mapInArrow(_sketched(size), f"doc_id {kind}, key long, n long, s1 long, s2 long, regs binary"), "sketches")
    classes = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.first("regs").alias("regs"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    led = _buckets(classes, percent)
    sizes = classes.select("node", "n")
    sets = _whole(led, classes, texts, size)
    links = _to_leaders(led, sizes, sets, percent)
    comps = components(links)
    across, further, own = _across(led, comps, sizes, sets, percent), None, comps
    if across is not None:  # a component's number is one of its nodes, a class without links has its own
        further = components(across)
        ends = further.select(F.col("node").alias("comp"), F.col("comp").alias("end"))
        comps = comps.join(ends, "comp", "left").select("node", F.coalesce("end", "comp").alias("comp")).unionByName(further).distinct()
    drop(led, sets, links, across)

    joined = stage(comps.join(classes.select("node", "least"), "node"), "linked")
    drop(own, further)
    least = stage(joined.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    linked = stage(joined.select("node", "comp").join(least, "comp"), "components")
    drop(joined, least)
    named = classes.join(linked, "node", "left").select(
        "s1", "s2", F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("comp", "node").alias("comp"))
    more = ["comp"] * carry_key
    named = stage(named.select("s1", "s2", "component_id", *more), "named")
    drop(classes, linked)
    more = ["key"] * carry_key + more
    out = rows.join(named, ["s1", "s2"], "left").select("doc_id", "n", "component_id", *more)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more)
    out.reads = (rows, named)  # staged tables that the result still reads
    return out


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component of near duplicates: the one with the least doc_id, nulls last.

    Where that doc_id stands in several rows of the component, the row whose row_key is least stays.
    Documents without words are linked with nothing and all stay. An empty table stays empty; columns
    are unchanged, whatever their names.
    """
    found = near_duplicates(docs, size, percent, carry_key=True)
    first = found.filter("n_shingles > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"))
    first = stage(first.select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__first")), "first")
    drop(*found.reads)
    worded = F.coalesce("text", F.lit("")).rlike(WORD)
    keyed = docs.filter(worded).withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    one = keyed.join(first, (F.col("__key") == F.col("__first")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    one = one.dropDuplicates(["doc_id", "__key"])  # rows equal in doc_id and text are one document
    return one.drop("__key").unionByName(docs.filter(~worded))
