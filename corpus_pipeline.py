"""A training-data pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame; all but the last return the columns of documents. Rows are judged one by one: null or repeated
doc_ids tell nothing apart that its text does not, extra columns of any name come through as they are,
and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm import decontam, linededup, nbsvm, neardup, packing
from lexmere.llm.catalog import tokenizer
from lexmere.llm.shared import drop, row_key, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go. It is fitted as in op9, on labels outside the held-out fold.

    Null and empty texts have the score of a margin of 0.
    """
    return nbsvm.keep_good(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines inside later occurrences of three-line windows go; documents stay, with n_chars counted anew where lines went. Null texts stay null."""
    names = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}  # the operator's counts have these names
    out = linededup.dedup_lines(docs.withColumnsRenamed(names))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id: shingles of five words, similarity of 0.8 or more.

    Null and blank texts are in no group and stay.
    """
    return neardup.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those with 13-word windows of benchmark items on at least a twentieth of their words.

    Null and empty texts stay. A document is known by its doc_id and its text.
    """
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"), carry_key=True)
    bad = stage(decontam.judge(found).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("key").alias("__bad")).distinct(), "contaminated")
    drop(*found.reads)
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(bad, (F.col("__key") == F.col("__bad")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens. Null texts are empty: one piece, the end id."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: A trained classifier and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's result written and read again, and deleted once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
