"""As-of joins: to each row the latest row of another table at or before its time.

No range join: both sides go into one table, are dealt by key and a bucket of time, and the last right row is carried
along in order. A bucket in which nothing came yet takes what the buckets before it ended with; these ends
are one row for each key and bucket. So a key with very many rows is many buckets, not one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _seconds(time: Column, kind: str) -> Column:
    """A time as a number, in order: seconds, or a number as it is."""
    if kind == "timestamp":
        return F.unix_micros(time) / 1_000_000
    if kind == "timestamp_ntz":  # by its own clock, not by the session's zone
        return F.unix_date(F.to_date(time)) * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60 + F.date_part(F.lit("SECOND"), time).cast("double")
    return F.unix_date(time) * 86_400 if kind == "date" else time


def _bucket(time: Column, kind: str, width: float) -> Column:
    return F.floor(_seconds(time, kind) / F.lit(width)).cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, width: float, take: Sequence[str] | None = None,
    strict: bool = False, tolerance: float | None = None, how: str = "left", prefix: str = "right_", ties: Sequence[str] = (),
) -> DataFrame:
    """left's columns, and prefix + each of ``take`` (right's columns): from the right row of the same ``by`` with the greatest time at or before left's.

    strict: before, not at. tolerance (seconds, or the time's own unit for numbers): older rows don't count. how: left keeps rows without a match, with
    nulls; inner drops them. Of right rows at one time the one with the greatest ``ties`` counts. Rows whose key or time is null match nothing.
    width: of a bucket, in the same unit as tolerance; about as much as holds 100,000 rows of the most frequent key is good. Rows are shuffled once.
    """
    take = list(take if take is not None else [c for c in right.columns if c not in by])
    kind = dict(left.dtypes)[left_time]
    keys = [f"__k{i}" for i in range(len(by))]
    at = {"l": F.col(left_time), "r": F.col(right_time).cast(kind)}
    usable = lambda df, t: df.filter(F.col(t).isNotNull()).dropna(subset=list(by)) if by else df.filter(F.col(t).isNotNull())
    own = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    value = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(take)])
    order = F.struct(at["r"].alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(ties)])
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)

    r = usable(right, right_time).select(*own, at["r"].alias("__t"), order.alias("__o"), value.alias("__r"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l = usable(left, left_time).select(*own, at["l"].alias("__t"), none(r, "__o").alias("__o"), none(r, "__r").alias("__r"), F.lit(1).alias("__side"), row.alias("__l"))
    r = r.withColumn("__side", F.lit(0)).withColumn("__l", none(l, "__l"))
    both = l.unionByName(r).withColumn("__b", _bucket(F.col("__t"), kind, width))

    # of one time, right rows come first, or with strict left rows
    w = Window.partitionBy(*keys, "__b").orderBy("__t", F.desc("__side") if strict else F.asc("__side"), F.asc_nulls_first("__o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1").select(*keys, "__b", "__t", "__l", "__m")
    ends = both.groupBy(*keys, "__b").agg(F.max_by("__r", "__o").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__b", F.last("__end", ignorenulls=True).over(before).alias("__c")).filter("__c is not null")
    joined = within.join(carried, [*keys, "__b"], "left").withColumn("__m", F.coalesce("__m", "__c"))
    if tolerance is not None:
        age = _seconds(F.col("__t"), kind) - _seconds(F.col("__m.t").cast(kind), kind)
        joined = joined.withColumn("__m", F.when(age <= tolerance, F.col("__m")))
    out = joined.select("__l.*", *[F.col(f"__m.v{i}").alias(prefix + c) for i, c in enumerate(take)], F.col("__m").isNotNull().alias("__hit"))
    if how == "inner":
        return out.filter("__hit").drop("__hit")
    lost = left.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (left_time, *by))))
    rest = lost.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(prefix + c) for c in take])
    return out.drop("__hit").unionByName(rest)
