"""The queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm import decontam, linededup, linequality, nbsvm, neardup, packing, periodic, phrases, secrets, sharding, tokenstore, urlfilter, whitening
from lexmere.llm.shared import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenstore.write_store(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2)
    return tokenstore.read_store(spark, store)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.remove_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linequality.measure(table(spark, sf_dir, "documents"))
    return out.select(*[c for c in out.columns if c != "clean_text"], F.sha2("clean_text", 256).alias("clean_sha256"))


#: The rules of the contract.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Words that make a host a listed one.
URL_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(pages, rules, urlfilter.hosts_with(pages, URL_WORDS))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), edit=periodic.repeated_tail)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_sharding, op2_rans_tokens, op3_near_dedup, op4_repeated_phrases, op5_line_dedup,
        op6_best_fit_packing, op7_decontamination, op8_secret_scan, op9_quality_classifier, op10_quality_rules,
        op11_url_filter, op12_periodic_runs, op13_whitening,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from lexmere.llm import oracles

    return oracles.SQL
