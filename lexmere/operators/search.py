"""Vector, full-text and hybrid search, context expansion, re-ranking."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmere.functions import vectors
from lexmere.functions.text import tokens
from lexmere.sources.staging import staged

K1, B = 1.2, 0.75
RRF_K = 60
NOISE = ("heading", "toc", "inventory")


def compile_filters(filters: Mapping[str, Any] | None) -> Column:
    """Conjunction of equalities; a list means any of its values. Values stay typed, nothing is spliced into SQL."""
    def one(name: str, value: Any) -> Column:
        return F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value)

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in (filters or {}).items()), F.lit(True))


def vector_topk(table: DataFrame, query: Column | list[float], k: int, id_col: str, vector_col: str, metric: str = "cosine", filters: Mapping[str, Any] | None = None) -> DataFrame:
    """id, score of the k nearest rows; ties by id. metric cosine: similarity, high is near; l2: distance, low is near.

    Filters go below the scoring. One pass and a per-partition top-k; nothing is shuffled but k rows a partition.
    """
    q = vectors.literal(query) if isinstance(query, list) else query
    measure = {"cosine": vectors.cosine, "l2": vectors.l2}[metric](F.col(vector_col), q)
    scored = table.filter(compile_filters(filters)).select(F.col(id_col), F.round(measure, 6).alias("score"))
    order = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    return scored.orderBy(order, F.col(id_col)).limit(k)


def similar_to(table: DataFrame, row_id: Any, k: int, id_col: str, vector_col: str, exclude_self: bool = True) -> DataFrame:
    """The k rows nearest to a stored row; the row's vector joins as a single broadcast row."""
    own = table.filter(F.col(id_col) == F.lit(row_id)).select(F.col(vector_col).alias("__query")).limit(1)
    rest = table.filter(F.col(id_col) != F.lit(row_id)) if exclude_self else table
    scored = rest.crossJoin(F.broadcast(own)).select(id_col, F.round(vectors.cosine(F.col(vector_col), F.col("__query")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), id_col).limit(k)


def _counted(docs: DataFrame, wanted: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, dl (tokens) and tf0, tf1, ... of texts with tokens, written to the shared folder: each text is read and cut once."""
    count_of = lambda ts, t: F.size(F.filter(ts, lambda w: w == F.lit(t)))
    row = F.transform(F.array(tokens(F.col(text_col))), lambda ts: F.struct(F.size(ts).alias("dl"), *[count_of(ts, t).alias(f"tf{i}") for i, t in enumerate(wanted)]))
    # A generator's columns are not taken apart: a filter on them does not cut the text again.
    return staged(docs.select(id_col, F.inline(row)).filter("dl > 0"), "term-counts")


def bm25(docs: DataFrame, terms: list[str], k: int | None, id_col: str, text_col: str = "text", every: bool = False) -> DataFrame:
    """id, score of documents that hold any of the terms (with ``every`` all of them), best first.

    Terms are counted inside each row, for query terms only; no token is shuffled, and the corpus statistics
    are one small aggregate of the counts. For searches again and again see TextIndex.
    """
    wanted = sorted(set(terms))
    if not wanted:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    counted = _counted(docs, wanted, id_col, text_col)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    scores = [F.when(F.col(f"tf{i}") > 0, _score(F.col(f"tf{i}"), F.col("dl"), F.col(f"df{i}"))).otherwise(0.0) for i in range(len(wanted))]
    hit = reduce(lambda a, b: a & b if every else a | b, (F.col(f"tf{i}") > 0 for i in range(len(wanted))))
    out = counted.filter(hit).crossJoin(F.broadcast(stats)).select(id_col, F.round(reduce(lambda a, b: a + b, scores), 6).alias("score"))
    return _best(out, k, id_col)


def _score(tf: Column, dl: Column, df: Column) -> Column:
    """One term's share of the BM25 score; n and avgdl are columns."""
    return F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _best(scored: DataFrame, k: int | None, id_col: str) -> DataFrame:
    ordered = scored.orderBy(F.col("score").desc(), id_col)
    return ordered if k is None else ordered.limit(k)


def token_index(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """term, id, tf, dl: the postings of an inverted index, terms counted within each row, so nothing is shuffled."""
    rows = docs.select(id_col, F.inline(F.transform(F.array(tokens(F.col(text_col))), lambda ts: F.struct(F.size(ts).alias("dl"), F.array_sort(ts).alias("ts")))))
    starts = lambda ts: F.filter(F.sequence(F.lit(0), F.size(ts)), lambda i: (i == F.size(ts)) | F.coalesce(F.get(ts, i) != F.get(ts, i - 1), F.lit(True)))
    counts = F.transform(F.array(starts(F.col("ts"))), lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda a, i: F.struct(F.get("ts", a).alias("term"), (F.get(s, i + 1) - a).alias("tf"))))
    return rows.filter("dl > 0").select(id_col, "dl", F.inline(counts[0])).select("term", id_col, "tf", "dl")


class TextIndex:
    """A stored inverted index: postings in files by a hash of the term, each sorted by term, and the corpus statistics.

    A search reads the bucket folders of its terms, and of these the row groups that can hold them; no text.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str) -> None:
        self.id_col = id_col
        self.corpus = spark.read.parquet(f"{path}/corpus")
        about = self.corpus.head()
        self.buckets = about["buckets"]
        self.postings = spark.read.schema(about["schema"]).parquet(f"{path}/postings")

    @staticmethod
    def bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str, text_col: str = "text", buckets: int = 64) -> TextIndex:
        """Writes the index of docs under path. Buckets of frequent terms are split over files by size, not kept in one task."""
        postings = token_index(docs, id_col, text_col).withColumn("bucket", cls.bucket(F.col("term"), buckets))
        spread = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", id_col)
        spread.write.partitionBy("bucket").parquet(f"{path}/postings")
        schema = f"term string, {id_col} {dict(docs.dtypes)[id_col]}, tf int, dl int, bucket int"
        made = docs.sparkSession.read.schema(schema).parquet(f"{path}/postings")
        per_doc = made.agg(F.sum("tf").alias("tokens"), F.sum(F.col("tf") / F.col("dl")).alias("n"))  # each document's shares add up to one
        n = F.coalesce(F.round("n").cast("long"), F.lit(0))
        per_doc.select(n.alias("n"), F.try_divide("tokens", n).alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(schema).alias("schema")).write.parquet(f"{path}/corpus")
        return cls(docs.sparkSession, path, id_col)

    def search(self, terms: list[str], k: int | None, every: bool = False) -> DataFrame:
        """id, score of documents that hold any (or every one) of the terms, best first, as bm25() has them."""
        wanted = sorted(set(terms))
        spark = self.postings.sparkSession
        places = sorted({r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(self.bucket(F.col("t"), self.buckets)).collect()})
        met = self.postings.filter(F.col("bucket").isin(*places) & F.col("term").isin(*wanted)).select("term", self.id_col, "tf", "dl")
        counts = met.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.corpus))
        scored = met.join(F.broadcast(counts), "term").select(self.id_col, _score(F.col("tf"), F.col("dl"), F.col("df")).alias("part"))  # a row for each query term
        out = scored.groupBy(self.id_col).agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("met"))
        return _best(out.filter(F.col("met") == len(wanted) if every else F.lit(True)).select(self.id_col, "score"), k, self.id_col)


def conjunctive(docs: DataFrame, terms: list[str], k: int | None, id_col: str, text_col: str = "text") -> DataFrame:
    """Documents that hold all terms, by BM25."""
    return bm25(docs, terms, k, id_col, text_col, every=True)


def rrf(lists: list[DataFrame], id_col: str, k: int, rrf_k: int = RRF_K, floor: float | None = None, excluded: tuple[str, ...] = (), type_col: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, score[, type]): sum of 1 / (rrf_k + rank), rank from 1.

    Ranks are of the whole lists; then rows below ``floor`` (first list only) and of ``excluded`` types
    go. If nothing is left, the first ``k`` rows that pass the type test come back in list order, with score 0.
    Lists are short (top-k each), so ranking them in one task is bounded.
    """
    ranked = []
    for n, rows in enumerate(lists):
        w = Window.orderBy(F.col("score").desc(), F.col(id_col))
        passes = F.lit(True) if type_col is None else ~F.coalesce(F.col(type_col).isin(*excluded), F.lit(False))
        above = F.lit(True) if floor is None or n else F.col("score") >= floor
        ranked.append(rows.withColumn("rank", F.row_number().over(w)).select(id_col, F.lit(n).alias("list"), "rank", passes.alias("typed"), above.alias("above")))
    rows = reduce(DataFrame.unionByName, ranked).filter("typed")
    fused = rows.filter("above").groupBy(id_col).agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    best = fused.select(id_col, F.round("score", 6).alias("score"), "first").orderBy(F.col("score").desc(), "first", id_col).limit(k)
    plain = rows.groupBy(id_col).agg(F.min(F.struct("list", "rank")).alias("first")).orderBy("first", id_col).limit(k).select(id_col, F.lit(0.0).alias("score"), "first")
    some = best.agg((F.count("*") > 0).alias("some"))
    fallback = plain.crossJoin(F.broadcast(some)).filter("not some").drop("some")
    return best.unionByName(fallback).select(id_col, "score")


def hybrid(
    table: DataFrame, query_vector: Column | list[float], terms: list[str], k: int, id_col: str, vector_col: str, text_col: str = "text", depth: int = 20,
    filters: Mapping[str, Any] | None = None, floor: float | None = None, index: TextIndex | None = None,
) -> DataFrame:
    """Vector and full-text lists of ``depth`` rows each, fused; filters hold for both. Rows without a vector can be found by their words.

    With an index of the table's texts the words are looked up there, and no text is read.
    """
    rows = table.filter(compile_filters(filters))
    near = vector_topk(rows.filter(F.col(vector_col).isNotNull()), query_vector, depth, id_col, vector_col)
    if index is None:
        words = bm25(rows, terms, depth, id_col, text_col)
    elif not filters:
        words = index.search(terms, depth)
    else:
        words = _best(index.search(terms, None).join(rows.select(id_col), id_col, "left_semi"), depth, id_col)
    return rrf([near, words], id_col, k, floor=floor)


def context(chunks: DataFrame, hits: DataFrame, before: int, after: int, doc_col: str, index_col: str) -> DataFrame:
    """Rows of hits (doc, index) with each chunk of the same document from ``before`` before to ``after`` after it, itself included."""
    h = hits.select(F.col(doc_col).alias("__doc"), F.col(index_col).alias("hit_index"))
    c = F.col(index_col)
    return chunks.join(h, (F.col(doc_col) == F.col("__doc")) & c.between(F.col("hit_index") - before, F.col("hit_index") + after)).drop("__doc")


def nearest_context(chunks: DataFrame, hits: DataFrame, n: int, doc_col: str, index_col: str) -> DataFrame:
    """The n chunks nearest to each hit within n places, the hit itself left out; ties go to the earlier chunk."""
    near = context(chunks, hits, n, n, doc_col, index_col).filter(F.col(index_col) != F.col("hit_index")).withColumn("distance", F.abs(F.col(index_col) - F.col("hit_index")))
    w = Window.partitionBy(doc_col, "hit_index").orderBy("distance", index_col)
    return near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def context_strings(results: DataFrame, source_col: str = "source", text_col: str = "text", order_col: str = "rank") -> DataFrame:
    """One row: the results as numbered source blocks, in order."""
    w = Window.orderBy(order_col)
    block = F.format_string("---\nSource [%d]: %s\n%s", F.row_number().over(w), F.col(source_col), F.col(text_col))
    blocks = results.select(F.col(order_col).alias("o"), block.alias("b"))
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "b"))), lambda x: x["b"]), "\n\n").alias("context"))


def parse_order(answer: str, n: int) -> list[int]:
    """1-based order from a model's answer: a JSON list in it, else n integers, else the identity."""
    if found := re.search(r"\[[\d\s,]*\]", answer):
        try:
            if order := [i for i in json.loads(found[0]) if 1 <= i <= n]:
                return order
        except ValueError:
            pass
    parts = answer.split()
    if len(parts) == n and all(p.isdigit() for p in parts):
        return [int(p) for p in parts]
    return list(range(1, n + 1))


def rerank(results: list[dict], query: str, k: int, ask: Callable[[str], str] | None = None, among: int = 5) -> list[dict]:
    """The first k; with ``ask`` (a model), its order of the first ``among`` results, missing ones after, and no others. Errors keep the order."""
    if ask is None:
        return results[:k]
    head = results[:among]
    prompt = f"Query: {query}\nRank these passages, best first, as a JSON list of numbers.\n" + "\n".join(f"{i}. {r.get('text', '')[:200]}" for i, r in enumerate(head, 1))
    try:
        order = list(dict.fromkeys(parse_order(ask(prompt), len(head))))
    except Exception:  # noqa: BLE001  whatever the model's client raises, search goes on
        return results[:k]
    order += [i for i in range(1, len(head) + 1) if i not in order]
    return [head[i - 1] for i in order if i <= len(head)][:k]


def ivf_assign(table: DataFrame, centers: list[list[float]], vector_col: str) -> DataFrame:
    """Adds cell, the number of the nearest center, for a coarse index that probes few cells."""
    distances = F.array(*[F.struct(vectors.l2(F.col(vector_col), vectors.literal(c)).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centers)])
    return table.withColumn("cell", F.array_min(distances)["cell"])
