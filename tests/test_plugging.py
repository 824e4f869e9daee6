"""What plugs in: chunkers by type, extractors by name, recorded extractions with a fallback, a chunk's own name."""

import hashlib
import json

import pytest

from lexmere.api import KnowledgeBase
from lexmere.config import load_config
from lexmere.operators import chunking, extraction


def test_chunkers_plug_in(spark):
    docs = spark.createDataFrame([("a", "s", "csv", None, "x,y\n1,2", "t"), ("b", "s", "text", None, "plain", "t")], "doc_id string, source string, source_type string, language string, text string, tenant_id string")
    rows = lambda text, language, size: [chunking.Piece(line, "row", i, i) for i, line in enumerate(text.split("\n"))]
    got = [(r["doc_id"], r["chunk_type"], r["text"]) for r in chunking.chunk_documents(docs, chunkers={"csv": rows}).orderBy("doc_id", "chunk_index").collect()]
    assert got == [("a", "row", "x,y"), ("a", "row", "1,2"), ("b", "paragraph_group", "plain")]
    chunking.register("csv", rows)
    try:
        assert chunking.chunk_documents(docs).count() == 3
    finally:
        chunking._CHUNKERS.clear()


def test_extractors_by_name(spark):
    docs = spark.createDataFrame([("a", "code", "class Foo:\n  def bar(x)"), ("b", "text", "# Some Head\nthe end"), ("c", None, None)], "doc_id string, source_type string, text string")
    got = {(r["doc_id"], r["name"], r["kind"]) for r in extraction.extractor("patterns")(docs).collect()}
    assert {("a", "Foo", "CLASS"), ("a", "bar", "FUNCTION"), ("b", "Some Head", "CONCEPT")} <= got
    assert extraction.extractor("patterns")(docs).columns == extraction.extractor("regex")(docs).columns
    with pytest.raises(ValueError):
        extraction.extractor("nope")


def test_ingest_takes_recorded_extractions_first(spark, tmp_path):
    text = "Ada met the UserService in London."
    rows = [{"extraction_class": "Person", "extraction_text": "Ada", "char_interval": {"start_pos": 0, "end_pos": 3}, "confidence": 0.8}, {"extraction_class": "Concept", "extraction_text": "London", "char_interval": {"start_pos": 27, "end_pos": 33}, "confidence": 0.6}]
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / f"{hashlib.sha256(text.encode()).hexdigest()}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cfg = load_config(env={})
    cfg["embedding"]["dimensions"] = 8
    cfg["extraction"]["recorded"] = f"file://{tmp_path}/rec"
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", config=cfg)
    kb.ingest_text(text, "one")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.py").write_text("def run_job():\n    return AuthManager()\n")
    kb.ingest_file(str(tmp_path / "in" / "b.py"))
    got = {r["name"]: (r["extractor_id"], r["confidence"], r["start_char"]) for r in kb.store.table("entities").collect()}
    assert got["Ada"] == ("recorded", 0.8, 0) and got["London"] == ("recorded", 0.6, 27) and "UserService" not in got
    assert got["run_job"] == ("chunker", None, None) and got["AuthManager"] == ("regex", None, None)
    edges = {(r["relation_type"], r["confidence"]) for r in kb.store.table("relations").collect()}
    assert ("MENTIONS", 0.7) in edges or any(abs((c or 0) - 0.7) < 1e-9 for _, c in edges)
