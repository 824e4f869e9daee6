"""Approximate aggregates as small stored summaries that merge: distinct counts, quantiles, frequent items, membership.

A summary has one row for each group (a source and a day, say) with binary sketches; merging rows gives the sketch
of all their rows, so a report over any days reads summaries alone. All of it runs in the JVM.

Bounds: distinct counts are within DISTINCT_ERROR of the truth with 95 % probability (HyperLogLog of 2**12
registers); a quantile's rank is within RANK_ERROR (KLL of 400); a frequent item's count is exact while a group has at most
``tracked`` items, and else approximate, where items that are no more frequent than the error aren't listed at all: ``top``
counts the groups of more items. Membership never denies what was put in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISTINCT_BITS, DISTINCT_ERROR = 12, 0.04
RANKS, RANK_ERROR = 400, 0.01
COVERED = 0.8  # of the tracked items: an estimate within it is over twelve standard errors from a group of more than tracked


class Spec(NamedTuple):
    """Columns of each kind of sketch; frequent items are of ``tracked`` candidates."""

    distinct: Sequence[str] = ()
    quantile: Sequence[str] = ()
    frequent: Sequence[str] = ()
    tracked: int = 4_096


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def summarize(rows: DataFrame, by: Sequence[str], spec: Spec) -> DataFrame:
    """by, n, and the columns distinct_<c>, quantile_<c>, frequent_<c>. Nulls count in n and as a frequent item alone; one shuffle of partial sketches."""
    parts = [F.count("*").alias("n")]
    parts += [F.hll_sketch_agg(c, DISTINCT_BITS).alias(f"distinct_{c}") for c in spec.distinct]
    parts += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(RANKS)).alias(f"quantile_{c}") for c in spec.quantile]
    parts += [F.expr(f"approx_top_k_accumulate({_quoted(c)}, {spec.tracked})").alias(f"frequent_{c}") for c in spec.frequent]
    return rows.groupBy(*by).agg(*parts)


def merge(summaries: DataFrame, by: Sequence[str], spec: Spec) -> DataFrame:
    """The summaries of coarser groups, from those of finer ones."""
    parts = [F.sum("n").alias("n")]
    parts += [F.expr(f"hll_union_agg({_quoted(f'distinct_{c}')})").alias(f"distinct_{c}") for c in spec.distinct]
    parts += [F.kll_merge_agg_double(f"quantile_{c}").alias(f"quantile_{c}") for c in spec.quantile]
    parts += [F.expr(f"approx_top_k_combine({_quoted(f'frequent_{c}')}, {spec.tracked})").alias(f"frequent_{c}") for c in spec.frequent]
    return summaries.groupBy(*by).agg(*parts)


def distinct(column: str) -> Column:
    return F.hll_sketch_estimate(f"distinct_{column}")


def quantile(column: str, share: float) -> Column:
    """The value below which about ``share`` of the rows lie; null without values."""
    sketch = F.col(f"quantile_{column}")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def rank(column: str, value: Column | float) -> Column:
    """About which share of the rows is at most a value."""
    return F.kll_sketch_get_rank_double(F.col(f"quantile_{column}"), value if isinstance(value, Column) else F.lit(float(value)))


def frequent(column: str, k: int) -> Column:
    """The k items met most often as an array of (item, count), most often first."""
    return F.expr(f"approx_top_k_estimate({_quoted(f'frequent_{column}')}, {k})")


def top(summaries: DataFrame, rows: DataFrame, by: Sequence[str], column: str, k: int, tracked: int = Spec().tracked) -> DataFrame:
    """by, column, count: the k items met most often in each group, and those that tie with the k-th. Exact; null is an item too.

    ``summaries`` have the distinct and frequent sketches of the column, over all of ``rows``. They answer for the groups whose items
    they all hold: the listed counts add up to n, and the estimated number of items is within COVERED. The items of the
    other groups are counted from rows; each of those has about 0.8 * tracked rows at least, so their keys are few enough to broadcast.
    """
    listed = F.aggregate("__items", F.lit(0).cast("long"), lambda total, f: total + f["count"])
    held = summaries.select(*by, "n", (distinct(column) + 1).alias("__distinct"), frequent(column, tracked).alias("__items"))
    held = held.withColumn("__whole", (listed == F.col("n")) & (F.col("__distinct") <= COVERED * tracked))
    known = held.filter("__whole").select(*by, F.inline("__items")).select(*by, F.col("item").alias(column), "count")
    rest = held.filter("not __whole").select(*[F.col(c).alias(f"__{c}") for c in by])
    within = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    counted = rows.join(F.broadcast(rest), within, "left_semi").groupBy(*by, column).agg(F.count("*").alias("count"))
    place = F.rank().over(Window.partitionBy(*by).orderBy(F.desc("count")))
    return known.unionByName(counted).withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


class Store:
    """Summaries of each day in a folder of its own, under a path; a day is written whole and may be written again."""

    def __init__(self, path: str, by: Sequence[str], spec: Spec) -> None:
        self.path, self.by, self.spec = path, list(by), spec
        self.schema = None  # of what was written here; no file says it where rows was empty

    def write(self, rows: DataFrame, time_col: str) -> None:
        """Summarizes rows by the group columns and day; days that rows has replace what was there."""
        made = summarize(rows.withColumn("day", F.to_date(time_col)), [*self.by, "day"], self.spec)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        self.schema = made.schema

    def read(self, spark, first: str | None = None, last: str | None = None, by: Sequence[str] | None = None) -> DataFrame:
        """One merged summary for each group of ``by`` over the days from first to last; other days' folders aren't read."""
        rows = (spark.read if self.schema is None else spark.read.schema(self.schema)).parquet(self.path)
        if first is not None:
            rows = rows.filter(F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            rows = rows.filter(F.col("day") <= F.lit(last).cast("date"))
        return merge(rows, self.by if by is None else list(by), self.spec)


# Membership: a Bloom filter as bitmaps, a row for each 32,768 bits that hold any.


def _bits(value: Column, bits: int, hashes: int) -> Column:
    """Places from 1, as Spark's bitmap functions count them."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(bits)) + 1 for i in range(hashes)])


def _room(expected: int, error: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-expected * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / expected * math.log(2)))


def membership(rows: DataFrame, column: str, expected: int, error: float = 0.01) -> DataFrame:
    """bucket, bitmap: the filter of a column's values; ``expected`` values give about ``error`` wrong answers. Nulls are left out."""
    at = rows.filter(F.col(column).isNotNull()).select(F.explode(_bits(F.col(column), *_room(expected, error))).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def merged_membership(parts: DataFrame) -> DataFrame:
    """The filter of all that several filters of the same size hold."""
    return parts.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def maybe_members(rows: DataFrame, column: str, bitmaps: DataFrame, expected: int, error: float = 0.01) -> DataFrame:
    """The rows whose value may be in the filter: all that are, and about ``error`` of the others.

    Each distinct value is asked once; its bits join the bitmaps by bucket.
    """
    keys = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("__v")).distinct()
    bits, hashes = _room(expected, error)
    asked = keys.select("__v", F.explode(F.array_distinct(_bits(F.col("__v"), bits, hashes))).alias("at")).select("__v", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("pos"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("pos") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("pos") % 8).cast("int")) == 1, F.lit(False))
    known = asked.join(bitmaps, "bucket", "left").groupBy("__v").agg(F.bool_and(hit).alias("__in")).filter("__in").drop("__in")
    return rows.join(known, F.col(column) == F.col("__v"), "left_semi")
