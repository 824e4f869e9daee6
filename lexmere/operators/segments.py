"""A full-text index that grows with a knowledge base: postings in segments, one for each commit, folders by term bucket.

Which rows of which segment count is kept outside, in a table of entries (id, segment, dl) that is versioned with the
texts; so deletes and replaced texts touch entries only, and an old version's search still finds what it had.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.operators.search import TextIndex, _best, _score, token_index
from lexmere.sources.staging import staged

#: Segments after which they are put together.
MOST_SEGMENTS = 16


class SegmentIndex:
    def __init__(self, spark: SparkSession, path: str, id_col: str, id_type: str = "string", buckets: int = 16) -> None:
        self.spark, self.path, self.id_col, self.buckets = spark, path.rstrip("/"), id_col, buckets
        self.schema = f"term string, {id_col} {id_type}, tf int, dl int, segment string, bucket int"

    def _write(self, postings: DataFrame) -> str:
        segment = uuid.uuid4().hex[:16]
        rows = postings.withColumn("bucket", TextIndex.bucket(F.col("term"), self.buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/segment={segment}")
        return segment

    def add(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """Indexes rows (id, text) as a new segment; the entries to keep: id, segment, dl, and sha, a hash of the text. Rows without a token are entries of length 0."""
        postings = staged(token_index(rows, self.id_col, text_col), "postings")
        segment = self._write(postings)
        dl = postings.groupBy(self.id_col).agg(F.first("dl").alias("dl"))
        held = rows.select(self.id_col, F.xxhash64(text_col).alias("sha")).join(dl, self.id_col, "left")
        return held.select(self.id_col, F.lit(segment).alias("segment"), F.coalesce("dl", F.lit(0)).alias("dl"), "sha")

    def _postings(self, pattern: str) -> DataFrame:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segment=*/{pattern}")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        paths = [f.getPath().toString() for f in found or []]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths)

    def merge(self, entries: DataFrame) -> DataFrame:
        """All live postings as one segment; the entries that name it."""
        live = self._postings("bucket=*").join(entries.select(self.id_col, "segment"), [self.id_col, "segment"], "left_semi")
        segment = self._write(live.select("term", self.id_col, "tf", "dl"))
        return entries.withColumn("segment", F.lit(segment))

    def search(self, entries: DataFrame, terms: list[str], k: int | None, every: bool = False) -> DataFrame:
        """id, score of entries that hold any (or every one) of the terms, as search.bm25() over their texts has them: no text is read."""
        wanted = sorted(set(terms))
        if not wanted:
            return entries.select(self.id_col, F.lit(0.0).alias("score")).limit(0)
        places = {r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(TextIndex.bucket(F.col("t"), self.buckets)).collect()}
        postings = reduce(DataFrame.unionByName, (self._postings(f"bucket={p}") for p in sorted(places)))
        met = postings.filter(F.col("term").isin(*wanted)).join(entries.select(self.id_col, "segment"), [self.id_col, "segment"], "left_semi")
        corpus = entries.filter("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        counts = met.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus))
        scored = met.join(F.broadcast(counts), "term").select(self.id_col, _score(F.col("tf"), F.col("dl"), F.col("df")).alias("part"))
        out = scored.groupBy(self.id_col).agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("met"))
        return _best(out.filter(F.col("met") == len(wanted) if every else F.lit(True)).select(self.id_col, "score"), k, self.id_col)
