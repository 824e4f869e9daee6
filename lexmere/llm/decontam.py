"""Benchmark decontamination over a distributed positional inverted index.

Texts are cut into terms once and the terms are written. From these, count how often the corpus holds each
term of the test items; store the positions (postings) of the terms that are rarest in some
test window; shift each posting by its term's place in the item and intersect the shifted
lists, which leaves (document, item, alignment) candidates, and compare words there. The same postings tell where
all of an item's rare terms stand close together in any order: a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm.shared import drop, lower_ascii, row_key, small, stage, words

#: Runs of letters and digits, all characters beyond ASCII included, after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Rarest terms of each window whose lists are intersected.
RAREST = 3
#: A proximity match has all indexed terms of an item within the item's length and so many words more.
SLOP = 8


def terms(text: Column) -> Column:
    return words(lower_ascii(text), TERM)


def _wide(term: str) -> Column:
    return F.octet_length(term) + 48


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, item (its words): items with at least one word; equal items of one id count once.

    item_key is never null, so joins on it keep items whose item_id is.
    """
    items = benchmark.select("item_id", terms(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    return items.select(F.xxhash64("item_id", "item", F.col("item_id").isNull()).alias("item_key"), "item_id", "item")


def corpus_terms(docs: DataFrame) -> DataFrame:
    """doc_id, key, w: each document's words in order."""
    return docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), terms(F.col("text")).alias("w"))


def frequencies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n: how often the corpus (rows of corpus_terms) holds each wanted term (0 if never)."""
    found = rows.select(F.explode("w").alias("term")).join(small(wanted, _wide("term")), "term").groupBy("term").agg(F.count("*").alias("n"))
    return wanted.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """item_key, item_id, item, term, offset, need: the places of each window's rarest terms.

    need: for each window of the item, the offsets that must all be met for it to occur.
    """
    placed = items.select("item_key", "item_id", "item", F.posexplode("item").alias("offset", "term")).join(counts, "term")
    ranked = placed.groupBy("item_key", "item_id", "item").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by"))
    span = F.least(F.size("item"), F.lit(window))
    need = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size("item") - span),
        lambda s: F.array_sort(F.transform(F.slice(F.filter("by", lambda x: (x["offset"] >= s) & (x["offset"] < s + span)), 1, rarest), lambda x: x["offset"])),
    ))
    chosen = ranked.select("item_key", "item_id", "item", "by", need.alias("need"))
    chosen = chosen.withColumn("offsets", F.array_distinct(F.flatten("need")))
    return chosen.select("item_key", "item_id", "item", "need", F.explode(F.filter("by", lambda x: F.array_contains("offsets", x["offset"]))).alias("x")).select(
        "item_key", "item_id", "item", "need", F.col("x.term").alias("term"), F.col("x.offset").alias("offset"))


def postings(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, key, pos: the positional index of the wanted terms."""
    return rows.select("key", F.posexplode("w").alias("pos", "term")).join(small(wanted, _wide("term")), "term").select("term", "key", "pos")


def alignments(index: DataFrame, places: DataFrame) -> DataFrame:
    """key, item_key, aligns: where an item may start in a document, judged by one window's rarest terms."""
    shifted = index.join(places.select("term", "item_key", "offset"), "term").select("key", "item_key", (F.col("pos") - F.col("offset")).alias("align"), "offset")
    met = shifted.groupBy("key", "item_key", "align").agg(F.collect_set("offset").alias("met"))
    need = places.select("item_key", "need").distinct()
    met = met.join(need, "item_key").filter(F.exists("need", lambda w: F.size(F.array_except(w, F.col("met"))) == 0))
    return met.groupBy("key", "item_key").agg(F.collect_set("align").alias("aligns"))


def proximity(index: DataFrame, places: DataFrame, slop: int = SLOP) -> tuple[DataFrame, list[DataFrame]]:
    """The staged tables that are read, and key, item_key: documents that hold all indexed terms of an item within its length plus ``slop`` words, in any order.

    Pairs that lack a term go first, by a count. Then each pair's postings are folded in order: the last place of each
    term is kept, and the least of these tells whether all stand close together.
    """
    own = places.groupBy("item_key").agg(F.array_sort(F.collect_set("term")).alias("ts"), (F.first(F.size("item")) + slop).alias("reach"))
    numbered = stage(own.select("item_key", "reach", F.size("ts").alias("k"), F.posexplode("ts").alias("t", "term")), "item-terms")
    found = index.join(numbered, "term").select("key", "item_key", "reach", "k", "pos", "t")
    every = found.groupBy("key", "item_key").agg(F.count_distinct("t").alias("kinds"), F.first("k").alias("k")).filter("kinds = k").select("key", "item_key")
    holders = stage(every, "holders")
    lists = found.join(holders, ["key", "item_key"]).groupBy("key", "item_key", "reach", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("at"))
    none = F.struct(F.transform(F.sequence(F.lit(1), F.col("k")), lambda _: F.lit(-(1 << 30))).alias("last"), F.lit(False).alias("close"))

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, j: F.when(j == x["t"], x["pos"]).otherwise(v))
        return F.when(s["close"], s).otherwise(F.struct(last.alias("last"), (F.array_min(last) > x["pos"] - F.col("reach")).alias("close")))

    return lists.filter(F.aggregate("at", none, step, lambda s: s["close"])).select("key", "item_key"), [numbered, holders]


def _hits(doc: Column, aligned: Column, window: int) -> Column:
    """(item_id, start, length) of every window that stands in doc at one of the alignments."""
    def of(a: Column) -> Column:
        span = F.least(F.size(a["item"]), F.lit(window))
        windows = F.sequence(F.lit(0), F.size(a["item"]) - span)
        equal = lambda at: F.transform(a["item"], lambda w, j: F.coalesce(F.get(doc, at + j) == w, F.lit(False)))
        starts = lambda at: F.transform(F.array(equal(at)), lambda e: F.filter(windows, lambda s: ~F.array_contains(F.slice(e, s + 1, span), False)))[0]
        return F.flatten(F.transform(a["aligns"], lambda at: F.transform(starts(at), lambda s: F.struct(a["item_id"].alias("item_id"), (at + s).alias("start"), span.alias("length")))))

    return F.flatten(F.transform(aligned, of))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry_key: bool = False) -> DataFrame:
    """doc_id, n_words, hits (item_id, start, length), near (item_id) and, if asked, key (the row_key), one row per input row.

    hits are exact phrases, windows of items; near lists the items of proximity matches.
    Null or empty text: no words. Items without words are left out; null item_ids take part.
    Rows equal in doc_id and text are one document and get equal results. An empty table of documents gives no rows, one of items no hits;
    texts are taken whole, however long. Other columns aren't read.
    """
    items = stage(items_of(benchmark.select("item_id", "text")), "items")
    rows = terms = stage(corpus_terms(docs.select("doc_id", "text")), "terms")
    counts = stage(frequencies(rows, items.select(F.explode("item").alias("term")).distinct()), "term-counts")
    places = stage(anchors(items, counts, window), "anchors")
    index = stage(postings(rows, places.select("term").distinct()), "postings")
    few = small(items, F.aggregate("item", F.lit(64), lambda s, w: s + _wide(w)))
    exact = alignments(index, places).join(few, "item_key").select("key", F.struct("item_id", "item", "aligns").alias("a"), F.lit(None).cast(items.select(F.struct("item_id")).schema[0].dataType).alias("x"))
    close, held_by = proximity(index, places)
    near = close.join(few, "item_key").select("key", F.lit(None).cast(exact.schema["a"].dataType).alias("a"), F.struct("item_id").alias("x"))
    cands = stage(exact.unionByName(near).groupBy("key").agg(F.collect_list("a").alias("aligned"), F.collect_list("x").alias("near")), "candidates")
    drop(items, counts, places, index, *held_by)
    held = F.aggregate("aligned", F.lit(128), lambda s, a: s + 64 + 16 * F.size(a["item"]) + 8 * F.size(a["aligns"]))
    rows = rows.join(small(cands, held + 16 * F.size("near")), "key", "left")
    hits = F.when(F.col("aligned").isNotNull(), _hits(F.col("w"), F.col("aligned"), window))
    out = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), hits.alias("hits"), "near", *["key"] * carry_key)
    out.reads = (terms, cands)  # staged tables that the result still reads
    return out


def judge(found: DataFrame) -> DataFrame:
    """find()'s rows with n_hit, n_items, items_sha256, contaminated (by exact phrases alone) and n_near, the items of proximity matches."""
    spans = F.array_sort(F.array_distinct(F.transform(F.coalesce("hits", F.array().cast("array<struct<item_id:bigint,start:int,length:int>>")), lambda h: F.struct(h["start"], h["length"]))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, h: F.struct(F.greatest(s["end"], h["start"] + h["length"]).alias("end"), (s["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(s["end"], h["start"]))).alias("n")),
        lambda s: s["n"],
    )
    named = lambda c: F.array_distinct(F.transform(c, lambda h: F.coalesce(h["item_id"].cast("string"), F.lit("null"))))
    ids = F.array_sort(named("hits"))
    key = [c for c in found.columns if c == "key"]
    rows = found.select(*key, "doc_id", "n_words", covered.cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"), F.coalesce(F.size(named("near")), F.lit(0)).cast("long").alias("n_near"))
    return rows.select(
        *key, "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near",
    )
