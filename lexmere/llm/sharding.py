"""Sharding by a hierarchical weighted hash tree.

Every document descends region, rack and shard. On each level each child draws
``-ln(u) / weight`` with u from a hash of the document and the child's name, and the
smallest draw wins, so a child gets rows in proportion to its weight. A draw depends on
nothing but the document, the child and its weight: raising one weight moves rows only
into that subtree, lowering it only out of it. A new shard opens a region of its own, so
no old subtree changes weight and rows move into the new shard only (law ``key``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one window group should hold when slots are counted.
SLOT_GROUP = 4096
BITS = 52


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = 40, per_region: int = 8, per_rack: int = 4) -> list[Leaf]:
    """The tree of a shard count: the first ``base`` shards fill regions and racks evenly,
    each later one is a region of its own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    regions = math.ceil(base / per_region)
    return [
        Leaf(s // per_region, s % per_region // per_rack, s) if s < base else Leaf(regions + s - base, 0, s)
        for s in range(shards)
    ]


def _draw(key: Column, label: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), label)), 1, BITS // 4)
    unit = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))
    return -F.ln(unit) / weight


def _children(groups: dict[int, dict[int, float]]) -> Column:
    return F.create_map(*[
        x
        for parent, kids in sorted(groups.items())
        for x in (F.lit(parent), F.array(*[F.struct(F.lit(k).alias("node"), F.lit(w).alias("weight")) for k, w in sorted(kids.items())]))
    ])


def _pick(key: Column, level: str, kids: Column) -> Column:
    drawn = F.transform(kids, lambda c: F.struct(_draw(key, F.concat(F.lit(level), c["node"].cast("string")), c["weight"]).alias("draw"), c["node"].alias("node")))
    return F.array_min(drawn)["node"]


def assign(docs: DataFrame, leaves: list[Leaf], key: str, prefix: str = "") -> DataFrame:
    """Adds {prefix}region, {prefix}rack and {prefix}shard, drawn for column ``key`` (null counts as the word null)."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for x in leaves:
        if x.weight <= 0:
            continue
        rack = x.region * 10_000 + x.rack
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        racks.setdefault(x.region, {})[rack] = racks.get(x.region, {}).get(rack, 0.0) + x.weight
        shards.setdefault(rack, {})[x.shard] = x.weight
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    out = docs.withColumn(f"{prefix}region", _pick(name, "r", F.array(*[F.struct(F.lit(k).alias("node"), F.lit(w).alias("weight")) for k, w in sorted(regions.items())])))
    out = out.withColumn(f"{prefix}rack", _pick(name, "k", F.element_at(_children(racks), F.col(f"{prefix}region"))))
    return out.withColumn(f"{prefix}shard", _pick(name, "s", F.element_at(_children(shards), F.col(f"{prefix}rack"))))


def shard_documents(docs: DataFrame, shards: int = 40, slot_group: int = SLOT_GROUP) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    Null or empty text: size 16, checksum 0. Null doc_id: all such rows share one shard.
    Repeated doc_ids: the same shard, slots of their own. Empty table: no rows. Columns
    other than doc_id and text are not read. Slots run from 0 without gaps in each shard;
    they are counted in groups of about ``slot_group`` rows (a hash of doc_id, checksum and size within the
    shard), so no task holds a whole shard, nor all rows of one doc_id.
    """
    groups = max(1, math.ceil(docs.count() / shards / slot_group))
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(groups)).cast("int")
    tree = topology(shards)
    ids = assign(sized, tree, "doc_id").withColumn("bucket", bucket)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ids.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    placed = assign(assign(sized, tree, "doc_id"), topology(shards + 1), "doc_id", "grown_").withColumn("bucket", bucket)
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("at")).cast("long").alias("slot"), F.col("grown_shard"),
            "region", F.pmod(F.col("rack"), F.lit(10_000)).alias("rack"),
        )
    )
