import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexmere.functions import vectors
from lexmere.operators import search
from lexmere.plans import catalog


def _list(spark, rows):
    return spark.createDataFrame(rows, "id string, score double, type string")


def test_rrf_of_one_list_keeps_order(spark):
    out = search.rrf([_list(spark, [("a", 0.9, "x"), ("b", 0.8, "x")])], "id", 10).collect()
    assert [r["id"] for r in out] == ["a", "b"]


def test_rrf_prefers_what_both_lists_have(spark):
    out = search.rrf([_list(spark, [("a", 0.9, "x"), ("b", 0.8, "x")]), _list(spark, [("b", 0.9, "x"), ("c", 0.8, "x")])], "id", 10).collect()
    assert out[0]["id"] == "b" and [r["id"] for r in out[1:]] == ["a", "c"]


def test_rrf_floor_types_and_fallback(spark):
    near = _list(spark, [("a", 0.85, "content"), ("t", 0.84, "toc"), ("z", 0.1, "content")])
    assert [r["id"] for r in search.rrf([near], "id", 10, floor=0.3, excluded=search.NOISE, type_col="type").collect()] == ["a"]
    low = _list(spark, [("a", 0.1, "content"), ("t", 0.2, "toc")])
    assert [(r["id"], r["score"]) for r in search.rrf([low], "id", 10, floor=0.3, excluded=search.NOISE, type_col="type").collect()] == [("a", 0.0)]


def test_registered_fusions_and_diff_take_all_documents(spark, tmp_path):
    d = str(tmp_path)
    rows = [(i, "the oner" if i >= 600 else "x", "en") for i in [*range(20), *range(600, 612)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [1.0, i / 9], i % 4) for i in range(8)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    words = [r["id"] for r in catalog._lists(spark, d)[1].collect()]
    assert words == list(range(600, 612))
    assert [r["id"] for r in catalog.rrf_fusion(spark, d).collect()] == [0, 600, 1, 601, 2, 602, 3, 603, 4, 604]
    assert [r["id"] for r in catalog.rrf_floor_exclusion(spark, d).collect()] == [600, 601, 2, 602, 3, 603, 604, 605, 6, 606]
    plan = catalog.version_diff(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "% 10" not in plan and sorted(r["doc_id"] for r in catalog.version_diff(spark, d).collect()) == [0, 600]


def test_filters_are_typed(spark):
    df = spark.createDataFrame([("a' or 1=1", 1), ("b", 2)], "s string, n int")
    assert df.filter(search.compile_filters({"s": "a' or 1=1"})).count() == 1
    assert df.filter(search.compile_filters({"n": [1, 2], "s": "b"})).count() == 1 and df.filter(search.compile_filters({})).count() == 2


def test_stored_index_ranks_as_a_scan_does(spark, tmp_path):
    words = [["cat", "dog"], ["cat"] * 3 + ["bird"], ["dog"] * 2, ["Über", "cat"], []]
    docs = spark.createDataFrame([(i, " ".join(w) if w else None) for i, w in enumerate(words * 3)], "doc_id long, text string")
    index = search.TextIndex.build(docs, f"file://{tmp_path}/index", "doc_id", buckets=4)
    rows = lambda df: [(r["doc_id"], r["score"]) for r in df.collect()]
    for terms in (["cat"], ["cat", "dog"], ["über", "nothing"], ["nothing"]):
        assert rows(index.search(terms, 20)) == rows(search.bm25(docs, terms, 20, "doc_id"))
        assert rows(index.search(terms, 20, every=True)) == rows(search.conjunctive(docs, terms, 20, "doc_id"))
    own = docs.withColumn("v", F.array(F.lit(1.0), F.col("doc_id").cast("double")))
    ask = lambda **more: rows(search.hybrid(own, [1.0, 0.0], ["cat"], 5, "doc_id", "v", **more))
    assert ask() == ask(index=index)
    empty = search.TextIndex.build(docs.limit(0), f"file://{tmp_path}/empty", "doc_id")
    assert empty.search(["cat"], 5).count() == 0


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "cat cat dog")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.bm25(docs, ["cat"], 5, "doc_id").collect()] == [3]
    assert search.bm25(docs, [], 5, "doc_id").count() == 0 and search.bm25(docs.limit(0), ["cat"], 5, "doc_id").count() == 0
    assert search.conjunctive(docs, ["cat", "bird"], 5, "doc_id").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    assert [(r["id"], r["score"]) for r in search.vector_topk(df, [1.0, 0.0], 3, "id", "v").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]
    assert not vectors.degraded(df, "v").head()[0] and vectors.degraded(df.filter("id = 3"), "v").head()[0] and not vectors.degraded(df.limit(0), "v").head()[0]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        df.select(vectors.checked(df["v"], 3)).collect()
    assert {r["cell"] for r in search.ivf_assign(df, [[1.0, 0.0], [0.0, 1.0]], "v").filter("id < 3").collect()} == {0, 1}


def test_seeded_embedder_is_deterministic(spark):
    e = vectors.SeededEmbedder(32)
    assert e.vector("a") == e.vector("a") != e.vector("b") and len(e.vector("a")) == 32
    df = spark.createDataFrame([("a",), ("a",), (None,)], "text string").withColumn("k", vectors.F.monotonically_increasing_id())
    out = vectors.embed_texts(df, e, "k").collect()
    assert len(out) == 3 and max(abs(x - y) for x, y in zip(sorted(out)[0]["vector"], e.vector("a"), strict=True)) < 1e-6
    h = vectors.HashingEmbedder(16)
    same = spark.createDataFrame([("cat dog",), ("dog  cat",)], "t string").select(h.column(vectors.F.col("t")).alias("v")).distinct()
    assert same.count() == 1


def test_parse_order():
    assert search.parse_order("[3, 1, 2]", 3) == [3, 1, 2] == search.parse_order("3 1 2", 3)
    assert search.parse_order("garbage", 3) == [1, 2, 3] == search.parse_order("[]", 3)


@given(st.text(max_size=30), st.integers(0, 6))
def test_parse_order_never_leaves_the_range(answer, n):
    assert all(1 <= i <= n for i in search.parse_order(answer, n)) or n == 0


def test_rerank():
    rows = [{"text": str(i)} for i in range(20)]
    assert search.rerank(rows, "q", 5) == rows[:5]
    assert [r["text"] for r in search.rerank(rows, "q", 3, lambda _: "[2, 1]")] == ["1", "0", "2"]
    assert search.rerank(rows, "q", 5, lambda _: 1 / 0) == rows[:5]


def test_context(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(6)] + [("e", 0)], "doc string, i int")
    hits = spark.createDataFrame([("d", 2)], "doc string, i int")
    assert sorted(r["i"] for r in search.context(chunks, hits, 1, 2, "doc", "i").collect()) == [1, 2, 3, 4]
    assert sorted(r["i"] for r in search.nearest_context(chunks, hits, 2, "doc", "i").collect()) == [1, 3]
