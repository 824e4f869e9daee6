import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexmere import schemas
from lexmere.api import KnowledgeBase
from lexmere.config import Ontology, load_config, load_ontology
from lexmere.functions.text import file_type, language, raw_text_type
from lexmere.functions.vectors import SeededEmbedder
from lexmere.operators import extraction, relational, sql
from lexmere.sources import files
from lexmere.sources.snapshots import ConflictError, Store
from lexmere.streaming import events as ev
from lexmere.streaming.retry import retrying

NOW = dt.datetime(2024, 1, 1)


def test_merge_modes(spark):
    base = spark.createDataFrame([(1, None, "a", "x"), (2, "k", "b", "y")], "id int, k string, v string, w string")
    delta = spark.createDataFrame([(1, None, "A", None), (3, None, "C", "z")], "id int, k string, v string, w string")
    assert sorted((r["id"], r["v"]) for r in relational.keyed_merge(base, delta, ["id", "k"]).collect()) == [(1, "A"), (2, "b"), (3, "C")]
    assert sorted((r["id"], r["v"]) for r in relational.keyed_merge(base, delta, ["id", "k"], "ignore").collect()) == [(1, "a"), (2, "b"), (3, "C")]
    assert {(r["id"], r["v"], r["w"]) for r in relational.keyed_merge(base, delta, ["id", "k"], "coalesce").collect()} == {(1, "A", "x"), (2, "b", "y"), (3, "C", "z")}
    latest = relational.keyed_merge(base.select("id", F.lit(0).alias("n")), spark.createDataFrame([(1, 9), (1, 10)], "id int, n int"), ["id"])
    assert {r["id"]: r["n"] for r in latest.collect()} == {1: 10, 2: 0}
    twice = relational.keyed_merge(relational.keyed_merge(base, delta, ["id", "k"]), delta, ["id", "k"])
    assert twice.exceptAll(relational.keyed_merge(base, delta, ["id", "k"])).count() == 0


def test_sql_guard(spark):
    t = {"t": spark.createDataFrame([(i,) for i in range(7)], "i int")}
    ok = sql.sql_query(spark, "select i, 'DROP TABLE x' as s from t where i > 1 -- DELETE", t, limit=3)
    assert len(ok["rows"]) == 3 and ok["row_count"] == 5
    assert sql.sql_query(spark, "with a as (select 1 as x) select * from a union all select i from t", t)["row_count"] == 8
    assert sql.sql_query(spark, "select i from t where exists (select 1 from t as u where u.i = t.i) and i in (select max(i) from t)", t)["rows"] == [{"i": 6}]
    for bad in ("drop table t", "insert into t values (1)", "select 1; drop table t", "create table u as select 1", "/**/delete from t", "set spark.x=1", "nonsense"):
        assert "error" in sql.sql_query(spark, bad, t)


def test_sql_reads_nothing_but_its_tables(spark, tmp_path):
    t = {"t": spark.createDataFrame([(1,)], "i int")}
    spark.range(3).write.parquet(f"{tmp_path}/secret")
    spark.range(3).createOrReplaceTempView("other")
    for bad in (
        f"select * from parquet.`{tmp_path}/secret`", "select * from other", "select * from t where i in (select id from other)", "select (select max(id) from other) as m from t",
        f"with a as (select * from parquet.`{tmp_path}/secret`) select * from a", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select i from t where java_method('java.lang.System', 'nanoTime') > 0",
        "with a as (select try_reflect('java.lang.System', 'getProperty', 'user.home') as x) select * from a", "select * from read_files('/etc')",
    ):
        assert "error" in sql.sql_query(spark, bad, t), bad
    assert sql.sql_query(spark, "select id from range(3) where id not in (select i from t)", t)["row_count"] == 2


def test_snapshots(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    tag = lambda n: spark.createDataFrame([(n, "t", n, None, None)], schemas.TAGS)
    assert s.table("tags").count() == 0 and s.versions() == []
    assert s.upsert({"tags": tag("a")}, "one") == 1
    s.tag("first")
    assert s.upsert({"tags": tag("b")}, "two") == 2
    assert s.table("tags").count() == 2 and s.table("tags", "first").count() == 1 and s.table("tags", 1).count() == 1
    s.create_branch("dev", "first")
    dev = s.on_branch("dev")
    dev.upsert({"tags": tag("c")}, "three")
    assert {r["name"] for r in dev.table("tags").collect()} == {"a", "c"} and s.table("tags").count() == 2
    s.restore(1)
    assert s.table("tags").count() == 1 and [v["version"] for v in s.versions()] == [4, 3, 2, 1] and s.versions()[-1]["tags"] == ["first"]
    with pytest.raises(KeyError):
        s.table("tags", "nope")
    assert s.size() > 0


def test_store_survives_writers_that_stop_or_race(spark, tmp_path):
    tag = lambda n: spark.createDataFrame([(n, "t", n, None, None)], schemas.TAGS)
    s, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    s.upsert({"tags": tag("a")}, "one")
    stale = s._read()
    other.upsert({"tags": tag("b")}, "two")
    s._read = lambda: json.loads(json.dumps(stale))  # it looked before the other one was done
    with pytest.raises(ConflictError):
        s.upsert({"tags": tag("z")}, "too late")
    (tmp_path / "s/manifests/new-torn").write_text("{")  # a writer that stopped before its rename
    again = Store(spark, f"file://{tmp_path}/s")
    assert {r["name"] for r in again.table("tags").collect()} == {"a", "b"} and len(again.versions()) == 2


def test_layers_read_as_whole_tables(spark, tmp_path, monkeypatch):
    from lexmere.sources import snapshots

    monkeypatch.setattr(snapshots, "MOST_LAYERS", 4)
    s = Store(spark, f"file://{tmp_path}/s")
    row = lambda k, v, doc=None, tenant="t": (k, v, doc, tenant)
    put = lambda *rows, mode="update": s.upsert({"metadata": spark.createDataFrame(list(rows), schemas.METADATA)}, "put", mode)
    got = lambda version=None: sorted((r["key"], r["value"], r["doc_id"] or "") for r in s.table("metadata", version).collect())
    put(row("a", "1"), row("b", "1", "d"))
    put(row("a", "2"), row("c", "1", "d"))  # null doc_ids are one key
    put(row("a", "3"), row("d", "1"), mode="ignore")
    assert got() == [("a", "2", ""), ("b", "1", "d"), ("c", "1", "d"), ("d", "1", "")] and len(s._version(s._read(), None)["tables"]["metadata"]) == 3
    s.change({"metadata": snapshots.Change(gone=spark.createDataFrame([("d",)], "doc_id string"))}, "cut")
    put(row("b", "9", "d"), mode="coalesce")
    assert got() == [("a", "2", ""), ("b", "9", "d"), ("d", "1", "")] and len(s._version(s._read(), None)["tables"]["metadata"]) == 1
    put(row("b", None, "d"), row("d", "4"), mode="coalesce")
    assert got() == [("a", "2", ""), ("b", "9", "d"), ("d", "4", "")] and got(1) == [("a", "1", ""), ("b", "1", "d")]


def test_knowledge_base(spark, tmp_path):
    cfg = load_config(env={})
    cfg["search"]["floor"] = -1.0
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", config=cfg, embedder=SeededEmbedder(8))
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# User Guide\nThe UserService talks to AuthManager.\n" + "More words. " * 20 + "\n## Setup\nInstall it first.")
    (src / "b.py").write_text("def run_job():\n    return 1\n")
    (src / "c.bin").write_bytes(b"\xff\xfe")
    (src / "d.txt").write_bytes(b"bad \xff utf8")
    got = kb.ingest_directory(str(src))
    assert got["documents"] == 2 and len(got["errors"]) == 1 and not got["embedding_degraded"]
    before = kb.list_versions()[0]["version"]
    assert kb.ingest_text("plain text about an algorithm", "note")["chunks"] == 1
    assert kb.list_versions()[0]["version"] > before
    hit = kb.search("AuthManager", 3)[0]
    assert "AuthManager" in hit["text"] and kb.get_chunk(hit["chunk_id"])["chunk_type"] == "section"
    assert kb.search_context("AuthManager", 1)[0]["context"] and len(kb.search_similar(hit["chunk_id"], 2)) == 2
    assert kb.retrieve_context("AuthManager").startswith("---\nSource [1]:") and "JSON" in kb.retrieve_context("x", filters="{")
    doc = next(d for d in kb.list_documents() if d["source"].endswith("a.md"))
    (src / "a.md").write_text("# Changed\nall new")
    kb.ingest_file(str(src / "a.md"))
    assert kb.get_document(doc["doc_id"])["text"] == "# Changed\nall new" and len(kb.list_documents()) == 3
    assert [e["name"] for e in kb.search_graph("authm")] == ["AuthManager"]
    a, b = kb.add_entity("A", "Person"), kb.add_entity("B", "Org")
    assert kb.add_entity("A", "Person") == a
    kb.add_relation(a, b, "PART_OF", 0)
    with pytest.raises(ValueError, match="unknown"):
        kb.add_relation(a, "nope", "PART_OF")
    assert kb.bfs(a, 3)[1]["name"] == "B" and kb.shortest_path(a, b) == [a, b] and kb.get_entity_relations(b)[0]["src_name"] == "A" and kb.neighbours(a)[0]["direction"] == "outgoing"
    kb.tag_document(doc["doc_id"], "x"), kb.add_tag("y"), kb.tag_document(doc["doc_id"], "y")
    kb.untag_document(doc["doc_id"], "x")
    assert kb.get_document_tags(doc["doc_id"]) == ["y"] and kb.list_tags() == ["x", "y"]
    kb.set_metadata("k", "global"), kb.set_metadata("k", "own", doc["doc_id"]), kb.set_metadata("k", "newer")
    assert kb.get_metadata("k") == {"k": "newer"} and kb.get_metadata(doc_id=doc["doc_id"]) == {"k": "own"}
    assert kb.sql_query("select count(*) as n from documents")["rows"] == [{"n": 3}] and "error" in kb.sql_query("drop table documents")
    assert kb.delete_rows("tags", {"name": "x"}) == {"affected_rows": 1} and "error" in kb.delete_rows("nope", {"name": "x"})
    assert "error" in kb.merge_rows("metadata", [("k", "v", None, "other")]) and kb.merge_rows("metadata", [("z", "v", None, "default")]) == {"affected_rows": 1}
    assert kb.query_document_stats()["documents"] == 3 and kb.sync_database()["documents_synced"] == 3 and kb.get_stats()["entities"] >= 3
    kb.create_tag("keep")
    assert kb.delete_document(doc["doc_id"]) and not kb.delete_document(doc["doc_id"])
    assert kb._table("chunks").filter(F.col("doc_id") == doc["doc_id"]).count() == 0 and kb.checkout_version("keep")["documents"].count() == 3
    kb.create_branch("old", "keep"), kb.switch_branch("old")
    assert len(kb.list_documents()) == 3 and "old" in kb.list_branches()
    assert kb.resource("stats://") and kb.resource(f"doc://{doc['doc_id']}").startswith("doc_id") and kb.resource("graph://zzz") == "nothing found" and kb.resource("chunk://no") == "no such chunk" and kb.resource("versions://")
    other = KnowledgeBase(spark, f"file://{tmp_path}/kb", tenant="other", config=cfg, embedder=SeededEmbedder(8))
    assert other.list_documents() == [] and other.search("AuthManager") == []


def test_backend_cache_and_failing_models(spark, tmp_path):
    from lexmere.backend import RetrievalBackend, StoreBackend
    from lexmere.functions.vectors import CallableEmbedder

    asked = tmp_path / "asked"

    def model(text):
        with asked.open("a") as f:
            f.write(text + "\n")
        if "bad" in text:
            raise OSError
        return [1.0, float(len(text))]

    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", embedder=CallableEmbedder(model, 2, "m"))
    backend = StoreBackend(kb)
    assert isinstance(backend, RetrievalBackend) and backend.health()
    backend.initialize()
    backend.ingest("s", [{"text": "aaaa", "metadata": {"page": 1}}, {"text": "aaaa"}, {"text": "bad"}, {"text": "b"}])
    assert sorted(asked.read_text().split()) == ["aaaa", "b", "bad"]
    assert [(r["source_id"], r["text"]) for r in backend.retrieve("aaaa", 2)] == [("s", "aaaa")] * 2 and backend.retrieve("x", 9, {"chunk_index": 0})[0]["metadata"] == {"page": "1"}
    backend.ingest("s", [{"text": "b"}, {"text": "bad"}])
    assert sorted(asked.read_text().split()) == ["aaaa", "aaaa", "b", "bad", "bad", "x"] and len(backend.retrieve("b", 9)) == 2  # the queries, and the failed text once more
    backend.delete_source("s")
    assert backend.retrieve("b", 9) == []
    assert kb.add_entity("A", "Person", always_new=True) != kb.add_entity("A", "Person", always_new=True)
    assert kb.sql_query("select count(*) as n from entities where name = :who", args={"who": "A"})["rows"] == [{"n": 2}]


def test_sql_functions(spark):
    from lexmere.functions.tables import register
    from lexmere.operators import graph

    register(spark, 4)
    rows = spark.sql("select d.i, c.chunk_index, c.heading_path from (select 1 as i, '# A\n' || repeat('t ', 80) || '\n## B\nx' as t union all select 2, null) d, lateral chunk_markdown(d.t) c order by 2").collect()
    assert [(r["i"], r["heading_path"]) for r in rows] == [(1, ["A"]), (1, ["A", "B"])]
    assert spark.sql("select entity_name from chunk_code('def f():\n    pass\n', 'python')").head()[0] == "f" and spark.sql("select count(*) from chunk_text('a b')").head()[0] == 1
    assert len(spark.sql("select seeded_embed('a') as v").head()["v"]) == 4
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "Y"), ("c", "d", "X")], "src string, dst string, kind string")
    seen = graph.bfs_paths(edges, "a", 2)
    assert [r["kind"] for r in graph.relations_among(edges, seen, ("Y",)).collect()] == ["Y"] and graph.relations_among(edges, seen).count() == 2


def test_events(spark, tmp_path):
    log, store = f"file://{tmp_path}/log", Store(spark, f"file://{tmp_path}/store")
    e = lambda i, kind, body, at=0: (f"e{i}", "d1", "t", kind, i, json.dumps(body) if body is not None else "{", NOW + dt.timedelta(seconds=at))
    ev.append(spark, log, [e(1, "DocumentIngested", {"doc_id": "d1", "text": "x"}), e(2, "ChunksAdded", {"doc_id": "d1", "chunks": ["a", "b"]}), e(3, "Weird", {"doc_id": "d1"}), e(4, "EntityCreated", {"name": "N", "entity_type": "Person"})])
    ev.start_projection(spark, log, store, f"{tmp_path}/cp").awaitTermination(120)
    assert store.table("documents").count() == 1 and [r["text"] for r in store.table("chunks").orderBy("chunk_index").collect()] == ["a", "b"]
    assert store.table("entities").count() == 1
    dead = ev.DeadLetters(store)
    assert [r["event_id"] for r in dead.unresolved().collect()] == ["e3"]
    batch = spark.read.schema(schemas.EVENTS).parquet(log)
    ev.project_batch(store, batch)  # the same batch once more changes nothing
    assert store.table("chunks").count() == 2 and dead.unresolved().head()["retry_count"] == 1
    ev.project_batch(store, spark.createDataFrame([e(9, "ChunksAdded", {"doc_id": "d1", "chunks": ["only"]}, 1)], schemas.EVENTS))
    assert [r["text"] for r in store.table("chunks").collect()] == ["only"]
    ev.append(spark, log, [e(5, "DocumentDeleted", {"doc_id": "d1"}, 9)])
    ev.start_projection(spark, log, store, f"{tmp_path}/cp").awaitTermination(120)
    assert store.table("documents").count() == 0 and store.table("chunks").count() == 0
    again = spark.createDataFrame([("documents", "t", "e3", "Weird", "no", NOW)], "projection_name string, tenant_id string, event_id string, event_type string, error_message string, created_at timestamp")
    dead.record(again), dead.record(again)
    row = dead.unresolved().head()
    assert row["retry_count"] == 3 and row["permanent"]
    dead.resolve("e3", "another projection")
    assert dead.unresolved().count() == 1
    dead.resolve("e3", tenant="t")
    assert dead.unresolved().count() == 0
    ev.replay(spark, log, store)
    assert store.table("entities").count() == 1 and store.table("documents").count() == 0


def test_idempotency(spark, tmp_path):
    keys = ev.Idempotency(Store(spark, f"file://{tmp_path}/i"), "t")
    assert keys.check("k", NOW) is None
    keys.record("k", "c", "{}", "done", NOW)
    assert keys.check("k", NOW)["result"] == "done" and keys.check("k", NOW + dt.timedelta(hours=25)) is None


def test_retry():
    seen = []

    @retrying(3, 5, sleep=seen.append)
    def flaky():
        if len(seen) < 2:
            raise OSError
        return "ok"

    assert flaky() == "ok" and seen == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        retrying(2, 5, sleep=lambda _: None)(lambda: 1 / 0)()


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("search:\n  top_k: 3\n")
    got = load_config(str(p), env={"LEXMERE_SEARCH__RRF_K": "7"})
    assert got["search"]["top_k"] == 3 and got["search"]["rrf_k"] == 7 and got["search"]["floor"] == 0.3
    assert load_config(env={"LEXMERE_CONFIG": str(p)})["search"]["top_k"] == 3
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none"), env={})
    o = tmp_path / "o.yaml"
    o.write_text("entity_types: [A]\nrelation_types: [B]\n")
    assert load_ontology(str(o)) == Ontology(("A",), ("B",))
    for bad in (((), ("B",)), (("A", "A"), ("B",)), (("A",), ("A",))):
        with pytest.raises(ValueError):
            Ontology(*bad)


def test_detection(spark):
    rows = [("a.py", ""), ("b.MD", ""), ("run", "#!/usr/bin/env Python3\n"), ("x.txt", "# hi"), (".bashrc", ""), (None, None)]
    df = spark.createDataFrame(rows, "p string, t string")
    out = df.select(file_type(F.col("p"), F.col("t")), language(F.col("p"), F.col("t")), raw_text_type(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("code", "python", "text"), ("markdown", None, "text"), ("code", "python", "markdown"), ("text", None, "markdown"), ("text", None, "text"), ("text", None, "text")]


def test_partition_and_recorded(spark, tmp_path):
    assert files.partition("<h1>T</h1><p>a <b>b</b></p><script>x</script><li>i", "html") == [("T", "Title", 0), ("a b", "NarrativeText", None), ("i", "ListItem", None)]
    assert files.partition("# T\ntext\n- item\n\nmore", "markdown") == [("T", "Title", 0), ("text", "NarrativeText", None), ("item", "ListItem", None), ("more", "NarrativeText", None)]
    chunk = "Ann works at Acme"
    import hashlib

    sha = hashlib.sha256(chunk.encode()).hexdigest()
    rows = [{"extraction_class": "Person", "extraction_text": "Ann", "char_interval": {"start_pos": 0, "end_pos": 3}, "confidence": 0.8}, {"extraction_class": "Org", "extraction_text": "Acme", "char_interval": {"start_pos": 13, "end_pos": 17}, "confidence": None}, {"extraction_class": "Org", "extraction_text": "?", "char_interval": {"start_pos": 5, "end_pos": 99}}]
    (tmp_path / f"{sha}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    chunks = spark.createDataFrame([("c1", chunk)], "chunk_id string, text string")
    found = extraction.recorded(chunks, files.recorded_extractions(spark, str(tmp_path)))
    assert {(r["name"], chunk[r["start_char"] : r["end_char"]]) for r in found.collect()} == {("Ann", "Ann"), ("Acme", "Acme")}
    pair = extraction.cooccurrences(found).head()
    assert (pair["source"], pair["target"], pair["confidence"]) == ("Ann", "Acme", 0.8)
    with pytest.raises(Exception, match="outside the ontology"):
        extraction.recorded(chunks, files.recorded_extractions(spark, str(tmp_path)), Ontology(("Org",), ("R",))).collect()


def test_extraction(spark):
    rows = [("m", "markdown", "# Big Title {#x}\nUserService and UserService"), ("c", "code", "class FooBar: def my_func"), ("t", "text", "An API for AuthManager"), ("n", "text", None)]
    docs = spark.createDataFrame(rows, "doc_id string, source_type string, text string")
    got = {(r["doc_id"], r["name"], r["kind"]) for r in extraction.entities(docs).collect()}
    assert {("m", "Big Title", "CONCEPT"), ("m", "UserService", "CONCEPT"), ("c", "FooBar", "CLASS"), ("c", "my_func", "FUNCTION"), ("t", "AuthManager", "CONCEPT"), ("t", "Api", "CONCEPT")} <= got
    assert not any(d == "n" for d, _, _ in got) and ("c", "class", "FUNCTION") not in got
    old = {(r["name"], r["kind"]) for r in extraction.entities_by_pattern(docs.filter("doc_id = 'c'"), ("class", "function")).collect()}
    assert ("FooBar", "CLASS") in old
    kinds = extraction.with_ontology(spark.createDataFrame([("x", "person"), ("y", "CLASS")], "name string, kind string")).collect()
    assert [r["entity_type"] for r in kinds] == ["Person", "Concept"]
    both = extraction.with_fallback(docs.filter("doc_id = 'm'"), docs)
    assert both.count() == 4
    with pytest.raises(ValueError):
        extraction.extractor("nope")
