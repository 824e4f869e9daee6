"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm.shared import row_key, stage

WINDOW = 3


def lines_of(text: Column) -> Column:
    """A text's lines, split at \\n; none for null."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _kept(lines: Column, starts: Column, size: int) -> Column:
    """The lines outside all windows that begin at starts (ascending, from 0)."""
    k = F.size(starts)
    gaps = F.transform(
        F.sequence(F.lit(0), k),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(starts, i - 1) + size).alias("a"),
            F.when(i == k, F.size(lines)).otherwise(F.get(starts, i)).alias("b"),
        ),
    )
    kept = F.filter(gaps, lambda g: g["b"] > g["a"])
    return F.flatten(F.transform(kept, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def dedup_lines(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drops every line inside a later occurrence of a window of ``size`` consecutive lines.

    A window is equal lines in equal order; the occurrence that comes first by (doc_id, line)
    stays, all others go, in the same document too. Windows without a word don't count. Returns
    the columns of docs with the text cut, and n_lines and n_removed (replacing columns
    of such names). Rows equal in doc_id and text are one document and are cut alike; rows with
    the same doc_id and other texts count in order of a hash of the text, null doc_ids come first.
    Null text: stays null, 0 lines. Empty text: one empty line. Fewer lines than a window: untouched.
    """
    base = docs.drop("n_lines", "n_removed").withColumn("__key", row_key(F.col(doc_id), F.col(text)))
    lined = docs.select(F.col(doc_id).alias("id"), row_key(F.col(doc_id), F.col(text)).alias("__key"), lines_of(F.col(text)).alias("l"))
    joined = lambda i: F.concat_ws("\n", *[F.get(F.col("l"), i + j) for j in range(size)])
    windows = (
        lined.filter(F.size("l") >= size)
        .select("id", "__key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("l") - size), joined)).alias("at", "w"))
        .filter(F.col("w").rlike(r"[^\x20\x09-\x0D]"))
        .select("id", "__key", "at", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(size), "w").alias("h2"))
    )
    first = F.min(F.struct("id", "__key", "at"))
    # Written first: the join below is then of two plain shuffles, and the partition of a window that very many texts share can be split.
    repeated = stage(windows.groupBy("h1", "h2").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first"), "repeated")
    later = (
        windows.join(repeated, ["h1", "h2"]).filter(F.struct("id", "__key", "at") > F.col("first"))
        .groupBy("__key").agg(F.array_sort(F.collect_set("at")).alias("__starts"))
    )
    out = base.join(later, "__key", "left").withColumn("__lines", lines_of(F.col(text)))
    out = out.withColumn("__rest", F.when(F.col("__starts").isNull(), F.col("__lines")).otherwise(_kept(F.col("__lines"), F.col("__starts"), size)))
    return out.select(
        *[F.when(F.col("__starts").isNull(), F.col(c)).otherwise(F.array_join("__rest", "\n")).alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__rest")).cast("long").alias("n_removed"),
    )
