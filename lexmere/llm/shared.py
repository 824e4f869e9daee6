"""What the operators have in common: input tables, the shared folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of most contracts: runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: A side of a join of at most so many bytes in memory is broadcast, a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session gets a temporary folder; a cluster has no such fallback.
    """
    if (named := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="lexmere-")
    return f"file://{_local[sc.applicationId]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more; others, such as columns of one, are passed over."""
    for df in tables:
        if (at := getattr(df, "staged_at", None)) is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: Column) -> DataFrame:
    """df, to be broadcast if its rows, of so many bytes each, have BROADCAST_BYTES at most in all."""
    return F.broadcast(df) if (df.agg(F.sum(width)).head()[0] or 0) <= BROADCAST_BYTES else df


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells documents apart: rows with the same doc_id and the same text are one document, repeated."""
    return F.xxhash64(doc_id, text, doc_id.isNull(), text.isNull())
