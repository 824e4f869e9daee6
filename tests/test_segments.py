"""The knowledge base's own full-text index: the same as a scan, through every kind of write."""

import json

from pyspark.sql import functions as F

from lexmere.api import KnowledgeBase
from lexmere.config import load_config
from lexmere.functions import vectors
from lexmere.operators import search
from lexmere.operators.segments import SegmentIndex
from lexmere.streaming import events as ev


def test_segments_rank_as_a_scan(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    index = SegmentIndex(spark, f"file://{tmp_path}/ix", "id")
    parts = [index.add(docs.filter(F.expr(f"id % 3 = {i}"))) for i in range(3)]
    entries = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("id % 5 != 0")  # some went since
    left = docs.filter("id % 5 != 0")
    for every in (False, True):
        want = [tuple(r) for r in search.bm25(left, ["the", "of", "tion"], 15, "id", every=every).collect()]
        assert [tuple(r) for r in index.search(entries, ["the", "of", "tion"], 15, every).collect()] == want
        assert [tuple(r) for r in index.search(index.merge(entries), ["the", "of", "tion"], 15, every).collect()] == want
    assert index.search(entries, ["nowhere"], 5).count() == 0 and index.search(entries, [], 5).count() == 0
    files = [f for f in index.search(entries, ["the"], 5).inputFiles() if "/ix/" in f]
    assert files and len({f.split("/bucket=")[1].split("/")[0] for f in files}) == 1  # one bucket of each segment


def test_the_index_follows_every_write(spark, tmp_path):
    cfg = load_config(env={})
    cfg["search"]["floor"] = 2.0  # vectors don't count: what is found is found by words
    cfg["embedding"]["dimensions"] = 32
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", config=cfg)
    hits = lambda q, **named: [h["text"] for h in kb.search(q, 5, **named)]
    kb.ingest_text("alpha beta", "one")
    kb.ingest_text("beta gamma", "two")
    first = kb.list_versions()[0]["version"]
    assert hits("alpha") == ["alpha beta"] and sorted(hits("beta")) == ["alpha beta", "beta gamma"]
    kb.ingest_text("delta alone", "one")  # the source again
    doc = next(d["doc_id"] for d in kb.list_documents() if d["source"] == "two")
    assert hits("delta") == ["delta alone"] and "alpha beta" not in hits("beta") and "alpha beta" in hits("alpha", version=first)
    assert kb.sql_execute("update chunks set text = 'epsilon' where text = 'delta alone'") == {"affected_rows": 1}
    assert hits("epsilon") == ["epsilon"]
    log = f"file://{tmp_path}/log"
    ev.append(spark, log, [("e", "d9", "default", "ChunksAdded", 1, json.dumps({"doc_id": "d9", "chunks": ["zeta one", "zeta two"]}), __import__("datetime").datetime(2024, 1, 1))])
    ev.start_projection(spark, log, kb.store, f"file://{tmp_path}/check").awaitTermination(120)
    assert sorted(hits("zeta")) == ["zeta one", "zeta two"] and hits("zeta", filters={"chunk_index": 1}) == ["zeta two"]
    kb.delete_document(doc)
    assert "beta gamma" not in hits("gamma")
    versions = len(kb.list_versions())
    hits("zeta")
    assert len(kb.list_versions()) == versions  # nothing to bring up


def test_many_segments_become_one(spark, tmp_path, monkeypatch):
    from lexmere import api

    monkeypatch.setattr(api, "MOST_SEGMENTS", 2)
    cfg = load_config(env={})
    cfg["embedding"]["dimensions"] = 8
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", config=cfg)
    for i in range(3):
        kb.ingest_text(f"common word{i}", f"s{i}")
    before = [(h["text"], h["score"]) for h in kb.search("common word1", 3)]
    kb.optimize_index()
    assert kb._table("indexed_chunks").select("segment").distinct().count() == 1
    assert [(h["text"], h["score"]) for h in kb.search("common word1", 3)] == before


def test_default_vectors_mean_something(spark):
    e = vectors.HashingEmbedder(256)
    near = lambda a, b: sum(x * y for x, y in zip(e.vector(a), e.vector(b), strict=True))
    base = "the parser reads tokens of a file"
    assert near(base, "a parser that read the token files") > 0.5 > near(base, "grilled fish with lemon and salt") and abs(near(base, base) - 1) < 1e-9
    assert e.vector("") == [0.0] * 256
    column = spark.createDataFrame([(base,), (None,)], "t string").select(e.column(F.col("t"))).collect()
    assert max(abs(x - y) for x, y in zip(column[0][0], e.vector(base), strict=True)) < 1e-6 and not any(column[1][0])
