"""Keyed merges, deletes, statistics, tags, metadata, pagination."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyed_merge(base: DataFrame, delta: DataFrame, keys: Sequence[str], mode: str = "update", order: Column | None = None) -> DataFrame:
    """base with delta's rows by key, null keys equal: update (delta wins), ignore (base wins), coalesce (delta's nulls keep base's values).

    Of several delta rows with one key the one with the greatest ``order`` counts (else the one with the greatest values, column by column; maps compare as text).
    Exactly one shuffle, on the keys.
    """
    if mode not in ("update", "ignore", "coalesce"):
        raise ValueError(f"unknown mode: {mode}")
    columns = base.columns
    rest = [c for c in columns if c not in keys]
    if order is None:
        kinds = dict(base.dtypes)
        order = F.struct(*[F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in rest]) if rest else F.lit(0)
    d = delta.select(*columns).withColumn("__order", order)
    w = Window.partitionBy(*keys).orderBy(F.col("__order").desc())
    latest = d.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__order")
    sides = base.select(*columns).withColumn("__side", F.lit(0)).unionByName(latest.withColumn("__side", F.lit(1)))
    first = Window.partitionBy(*keys).orderBy(F.col("__side").asc() if mode == "ignore" else F.col("__side").desc())
    if mode == "coalesce":
        whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sides = sides.select(*keys, "__side", *[F.first(c, ignorenulls=True).over(whole).alias(c) for c in rest])
    return sides.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*columns)


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join on columns in which nulls are equal."""
    keys = right.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    return left.join(keys, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on)), how)


def delete_where(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """table without the rows whose ``on`` columns are in keys."""
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def missing_parents(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Rows of child whose (not null) reference has no parent."""
    known = parent.select(F.col(parent_column).alias("__ref")).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__ref"), "left_anti")


def for_tenant(table: DataFrame, tenant: str) -> DataFrame:
    return table.filter(F.col("tenant_id") == F.lit(tenant))


def page(table: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return table.orderBy(*order).offset(offset).limit(limit)


def document_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over documents left-joined to chunks; counts by type and averages are of joined rows."""
    c = chunks.select(F.col("doc_id").alias("__doc"), F.col("source_type").alias("__type"), F.length("text").alias("__chars"))
    joined = documents.join(c, F.col("doc_id") == F.col("__doc"), "left")
    return joined.agg(
        F.count_distinct("doc_id").alias("documents"), F.count("__doc").alias("chunks"),
        *[F.count_if(F.col("__type") == t).alias(f"{t}_chunks") for t in ("code", "markdown", "text")],
        F.round(F.avg("__chars"), 2).alias("avg_chars"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
    )


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tags_of(document_tags: DataFrame, tags: DataFrame, doc_id: Any) -> DataFrame:
    return document_tags.filter(F.col("doc_id") == F.lit(doc_id)).join(tags, ["tag_id", "tenant_id"]).select("name", "color", "description").orderBy("name")


def tag_id_of(tenant: Column, name: Column) -> Column:
    """The version-5 UUID of tenant/name in the namespace of object identifiers, without hyphens."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), F.concat(tenant, F.lit("/"), name).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def metadata_of(metadata: DataFrame, key: str | None = None, doc_id: Any = None) -> DataFrame:
    """Entries by key and document; without a document the global ones (null doc_id)."""
    scope = F.col("doc_id").eqNullSafe(F.lit(doc_id).cast("string"))
    return metadata.filter(scope if key is None else scope & (F.col("key") == key)).select("key", "value", "doc_id").orderBy("key")


def describe(tables: dict[str, DataFrame]) -> dict[str, list[dict[str, str]]]:
    return {n: [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields] for n, df in tables.items()}
