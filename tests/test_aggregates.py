"""Events of every write: versions, conflicts, and the tables again from the log."""

import datetime as dt

import pytest

from lexmere.api import KnowledgeBase
from lexmere.config import load_config
from lexmere.sources.snapshots import ConflictError, Store
from lexmere.streaming import aggregates, events

NOW = dt.datetime(2024, 1, 1)


def test_versions_go_on_and_conflicts_are_told(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    doc = aggregates.Document(store, "t", "d")
    with pytest.raises(ValueError):
        doc.add_chunks(["x"], NOW)
    assert doc.ingest("src", "one two", NOW) == 1
    stale = aggregates.Document(store, "t", "d")
    assert doc.add_chunks(["one", "two"], NOW + dt.timedelta(1)) == 2
    with pytest.raises(ConflictError):
        stale.delete(NOW)
    assert aggregates.catch_up(store) == 2 and aggregates.catch_up(store) == 0
    assert [r["text"] for r in store.table("chunks").orderBy("chunk_index").collect()] == ["one", "two"]
    assert doc.delete(NOW + dt.timedelta(2)) == 3 and not aggregates.Document(store, "t", "d").alive
    with pytest.raises(ValueError):
        doc.delete(NOW)
    assert aggregates.catch_up(store) == 1 and store.table("documents").count() == store.table("chunks").count() == 0
    assert events.checkpoint_of(store, "documents", "t")["events"] == 3


def test_the_log_gives_the_tables_again(spark, tmp_path):
    cfg = load_config(env={})
    cfg["embedding"]["dimensions"] = 8
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", config=cfg)
    kb.ingest_text("# Head\nThe UserService calls the AuthManager.\n" + "words " * 40 + "\n## More\nThe end.", "a")
    kb.ingest_text("plain text about an algorithm", "b")
    kb.ingest_text("plain text, another time", "b")
    kb.ingest_text("gone soon", "c")
    kb.delete_document(next(d["doc_id"] for d in kb.list_documents() if d["source"] == "c"))
    a, b = kb.add_entity("A", "Person"), kb.add_entity("B", "Org")
    kb.add_relation(a, b, "PART_OF")
    assert kb.add_entity("A", "Person") == a
    look = lambda: {
        "documents": sorted(tuple(r) for r in kb.store.table("documents").select("doc_id", "source", "text").collect()),
        "chunks": sorted(tuple(r) for r in kb.store.table("chunks").select("chunk_id", "chunk_index", "text").collect()),
        "entities": sorted(tuple(r) for r in kb.store.table("entities").select("entity_id", "name", "entity_type").collect()),
        "relations": sorted(tuple(r) for r in kb.store.table("relations").select("relation_id", "relation_type").collect()),
    }
    before = look()
    log = kb.store.table("events").collect()
    by = {}
    for r in log:
        by.setdefault(r["aggregate_id"], []).append(r["version"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and len({r["event_id"] for r in log}) == len(log)
    aggregates.replay(kb.store)
    assert look() == before and len(before["relations"]) >= 1 and len(before["documents"]) == 2
    assert [h["text"] for h in kb.search("algorithm another", 1)] == ["plain text, another time"]
