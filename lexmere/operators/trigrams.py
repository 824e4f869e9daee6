"""Substring search over names without reading them all: an inverted index of three-letter pieces.

Every name stands under each of its distinct pieces, lower-cased, and once under the empty piece. A search looks up how often the pieces of its
text occur, reads the postings of the rarest alone, and keeps the names that hold the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.operators.search import TextIndex

SIZE = 3


def pieces(name: Column) -> Column:
    """The distinct pieces of a text; none of a shorter one."""
    low = F.lower(name)
    last = F.length(low) - SIZE + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(low, i, SIZE))))


class NameIndex:
    """The index under ``path`` of rows with a column ``name``; all columns are kept. Null names are not in it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").head()
        self.buckets, self.schema = about["buckets"], about["schema"]

    @classmethod
    def build(cls, names: DataFrame, path: str, buckets: int = 64) -> NameIndex:
        """One pass over the names; buckets of frequent pieces are split over files by size."""
        rows = names.filter("name is not null").select("*", F.explode(F.array_union(F.array(F.lit("")), pieces(F.col("name")))).alias("piece"))
        schema = ", ".join([*(f"`{c}` {t}" for c, t in names.dtypes), "piece string", "bucket int"])
        placed = rows.withColumn("bucket", TextIndex.bucket(F.col("piece"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "piece", "name")
        placed.write.partitionBy("bucket").parquet(f"{path}/postings")
        made = names.sparkSession.read.schema(schema).parquet(f"{path}/postings")
        made.groupBy("bucket", "piece").agg(F.count("*").alias("n")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/counts")
        names.sparkSession.createDataFrame([(buckets, schema)], "buckets int, schema string").write.parquet(f"{path}/about")
        return cls(names.sparkSession, path)

    def candidates(self, text: str) -> tuple[str, int]:
        """The piece to read for a text, and how many names stand under it: the rarest of its pieces; for a text of fewer than three letters the empty one."""
        asked = self.spark.createDataFrame([(text,)], "t string").select(F.explode(pieces(F.col("t"))).alias("piece")).select("piece", TextIndex.bucket(F.col("piece"), self.buckets).alias("bucket")).collect()
        if not asked:
            return "", -1
        counts = self.spark.read.schema("piece string, n long, bucket int").parquet(f"{self.path}/counts")
        met = {r["piece"]: r["n"] for r in counts.filter(F.col("bucket").isin(*{r["bucket"] for r in asked}) & F.col("piece").isin(*[r["piece"] for r in asked])).collect()}
        return min(((r["piece"], met.get(r["piece"], 0)) for r in asked), key=lambda p: (p[1], p[0]))

    def search(self, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        """The rows whose name holds the text in any case, by name, then node; at most 100: those of graph.search_entities()."""
        piece, _ = self.candidates(text)
        bucket = self.spark.createDataFrame([(piece,)], "p string").select(TextIndex.bucket(F.col("p"), self.buckets)).head()[0]
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/postings").filter((F.col("bucket") == bucket) & (F.col("piece") == piece)).drop("piece", "bucket")
        hit = F.lower("name").contains(text.lower())
        return rows.filter(hit if kind is None else hit & (F.col("type") == kind)).orderBy("name", "node").limit(min(limit, 100))
