"""One facade over a store: ingest, search, graph, SQL, tags, metadata, versions."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere import schemas
from lexmere.config import DEFAULT_ONTOLOGY, Ontology, load_config
from lexmere.functions.text import tokens
from lexmere.functions.vectors import Embedder, HashingEmbedder, checked, degraded, embed_texts
from lexmere.operators import chunking, extraction, graph, relational, search, sql
from lexmere.operators.segments import MOST_SEGMENTS, SegmentIndex
from lexmere.sources import files
from lexmere.sources.snapshots import Change, ConflictError, Store
from lexmere.sources.staging import staged
from lexmere.streaming import aggregates


class KnowledgeBase:
    """Calls return small results as Python values; everything before that stays a DataFrame."""

    def __init__(self, spark: SparkSession, path: str, tenant: str = "default", config: dict[str, Any] | None = None, embedder: Embedder | None = None, ontology: Ontology = DEFAULT_ONTOLOGY, ask: Callable[[str], str] | None = None) -> None:
        self.spark, self.tenant, self.ontology, self.ask = spark, tenant, ontology, ask
        self.config = config or load_config()
        self.store = Store(spark, path)
        self.embedder = embedder or HashingEmbedder(self.config["embedding"]["dimensions"])
        self.index = SegmentIndex(spark, f"{path.rstrip('/')}/text-index/{hashlib.sha256(tenant.encode()).hexdigest()[:16]}", "chunk_id")

    def _table(self, name: str, version: int | str | None = None) -> DataFrame:
        return relational.for_tenant(self.store.table(name, version), self.tenant)

    # Ingest

    def _ingest(self, docs: DataFrame, operation: str) -> dict[str, Any]:
        """Documents with chunks, vectors and entities in one commit; a source read again replaces its chunks."""
        s = self.config["chunking"]
        docs = staged(docs.dropDuplicates(["doc_id"]), "ingest")
        good = docs.filter("error is null")
        chunks = staged(chunking.chunk_documents(good, s["max_size"]), "chunks")
        vectors, cache = self._embedded(chunks)
        found = staged(self._found(chunks), "found")
        of = chunks.select("chunk_id", "doc_id", "tenant_id")
        entity = found.join(of, "chunk_id").select(
            F.sha2(F.concat_ws("\u001f", "tenant_id", "name", "entity_type"), 256).alias("entity_id"), "tenant_id", "name", "entity_type", F.col("doc_id").alias("source_document_id"), "chunk_id",
            "start_char", "end_char", "confidence", F.col("extractor").alias("extractor_id"), F.create_map(F.lit("pattern"), F.col("pattern")).alias("metadata"))
        entity = staged(entity, "entities")
        pairs = extraction.cooccurrences(found, self.ontology)
        ids = entity.select("chunk_id", F.col("name"), "entity_id").distinct()
        rel = pairs.join(ids.select("chunk_id", F.col("name").alias("source"), F.col("entity_id").alias("source_entity_id")), ["chunk_id", "source"]).join(ids.select("chunk_id", F.col("name").alias("target"), F.col("entity_id").alias("target_entity_id")), ["chunk_id", "target"])
        rel = rel.select(
            F.sha2(F.concat_ws("\u001f", F.lit(self.tenant), "source_entity_id", "target_entity_id", "relation_type"), 256).alias("relation_id"), F.lit(self.tenant).alias("tenant_id"), "source_entity_id", "target_entity_id", "relation_type",
            F.lit(1.0).alias("weight"), "confidence", "chunk_id")
        many = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
        rows = good.join(many, "doc_id", "left").select(
            "doc_id", "source", "source_type", "language", "title", "text", "file_size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(None).cast("map<string,string>").alias("metadata"), "tenant_id", F.current_timestamp().alias("created_at"))
        own = good.select("tenant_id", "doc_id")
        lists = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("x")).select("doc_id", F.col("x.text").alias("chunks"))
        old_vectors = self.store.table("chunks").join(own, ["tenant_id", "doc_id"], "left_semi").select("tenant_id", "chunk_id")
        new_entities, new_relations = self.store.merge("entities", entity, "ignore"), self.store.merge("relations", rel, "ignore")
        events = self._emitted(
            aggregates.facts(good, "doc_id", "DocumentIngested", ["doc_id", "source", "source_type", "title", "text"]), aggregates.facts(lists, "doc_id", "ChunksAdded", ["doc_id", "chunks"], 2),
            aggregates.facts(new_entities.rows, "entity_id", "EntityCreated", ["name", "entity_type"]), aggregates.facts(new_relations.rows, "relation_id", "RelationCreated", ["source_entity_id", "target_entity_id", "relation_type"]))
        self.store.change({
            "events": events, "documents": self.store.merge("documents", rows), "chunks": Change(chunks, own), "chunk_vectors": Change(vectors, old_vectors), "embedding_cache": cache, "indexed_chunks": Change(self._entries(chunks), old_vectors),
            "entities": new_entities, "relations": new_relations,
        }, operation)
        errors = [{"source": r["source"], "error": r["error"]} for r in docs.filter("error is not null").select("source", "error").toLocalIterator()]
        return {"documents": good.count(), "chunks": chunks.count(), "entities": entity.select("entity_id").distinct().count(), "errors": errors, "embedding_degraded": bool(degraded(vectors).head()[0])}

    def _found(self, chunks: DataFrame) -> DataFrame:
        """chunk_id, pos, name, entity_type, pattern, extractor, start_char, end_char, confidence of the chunks' entities, each name once a chunk.

        Recorded extractions (config extraction.recorded: where their files lie) come first; chunks without any go through the backend. A code chunk's own
        name is an entity as well.
        """
        about = self.config["extraction"]
        blank = {"start_char": "int", "end_char": "int", "confidence": "double"}
        none = [F.lit(None).cast(t).alias(c) for c, t in blank.items()]
        own = extraction.with_ontology(extraction.extractor(about["backend"])(chunks, "chunk_id"), self.ontology)
        own = own.select("chunk_id", "pos", "name", "entity_type", "pattern", F.lit(about["backend"]).alias("extractor"), *none)
        if about.get("recorded"):
            first = extraction.recorded(chunks, files.recorded_extractions(self.spark, about["recorded"]), self.ontology)
            first = first.select("chunk_id", F.col("pos").cast("int").alias("pos"), "name", "entity_type", F.lit("recorded").alias("pattern"), F.lit("recorded").alias("extractor"), *blank)
            own = extraction.with_fallback(first, own, "chunk_id")
        named = chunks.filter("entity_name is not null").select("chunk_id", F.lit(-1).alias("pos"), F.col("entity_name").alias("name"), F.upper("chunk_type").alias("kind"))
        named = extraction.with_ontology(named, self.ontology).select("chunk_id", "pos", "name", "entity_type", F.lit("entity_name").alias("pattern"), F.lit("chunker").alias("extractor"), *none)
        return named.unionByName(own).groupBy("chunk_id", "name").agg(F.min_by(F.struct("pos", "entity_type", "pattern", "extractor", *blank), "pos").alias("x")).select("chunk_id", "name", "x.*")

    def _emitted(self, *facts: DataFrame) -> Change:
        made = facts[0]
        for f in facts[1:]:
            made = made.unionByName(f)
        return aggregates.emitted(self.store, self.tenant, made)

    def _embedded(self, chunks: DataFrame) -> tuple[DataFrame, Change]:
        """The chunks' vectors, checked for their dimension, and what is new of them for the cache; a text is embedded once, now or earlier."""
        model = self.embedder.model
        known = self._table("embedding_cache").filter(F.col("embedding_model") == model).select("sha", "vector")
        made = staged(embed_texts(chunks, self.embedder, "chunk_id", cache=known).withColumn("vector", checked(F.col("vector"), self.embedder.dimensions)), "embedded")
        vectors = made.select("chunk_id", F.lit(self.tenant).alias("tenant_id"), "vector", F.lit(model).alias("embedding_model"), F.current_timestamp().alias("embedded_at"))
        fresh = chunks.select("chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).join(made, "chunk_id").filter(F.exists("vector", lambda x: x != 0))  # failures are tried again
        rows = fresh.select("sha", F.lit(model).alias("embedding_model"), F.lit(self.tenant).alias("tenant_id"), "vector")
        return vectors, self.store.merge("embedding_cache", rows, "ignore")

    def replace_chunks(self, doc_id: str, given: DataFrame) -> None:
        """Puts ready chunks (doc_id, chunk_index, text, metadata) in place of a document's."""
        own = self.spark.createDataFrame([(self.tenant, doc_id)], "tenant_id string, doc_id string")
        old = relational.null_safe(self.store.table("chunks"), own, ["tenant_id", "doc_id"], "left_semi").select("tenant_id", "chunk_id")
        have = given.select(chunking.chunk_id_of(F.lit(self.tenant), F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "text", F.lit("text").alias("source_type"), F.lit("given").alias("chunk_type"), "metadata", F.lit(self.tenant).alias("tenant_id"), F.current_timestamp().alias("created_at"))
        blank = self.spark.createDataFrame([], schemas.TABLES["chunks"])
        chunks = staged(blank.unionByName(have, allowMissingColumns=True), "chunks")
        vectors, cache = self._embedded(chunks)
        lists = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("x")).select("doc_id", F.col("x.text").alias("chunks"))
        events = self._emitted(aggregates.facts(lists, "doc_id", "ChunksAdded", ["doc_id", "chunks"]))
        self.store.change({"events": events, "chunks": Change(chunks, own), "chunk_vectors": Change(vectors, old), "embedding_cache": cache, "indexed_chunks": Change(self._entries(chunks), old)}, f"chunks of {doc_id}")

    def _entries(self, chunks: DataFrame) -> DataFrame:
        return self.index.add(chunks.select("chunk_id", "text")).withColumn("tenant_id", F.lit(self.tenant))

    def refresh_index(self) -> None:
        """Brings the full-text index up to the chunks, whoever wrote them, in one commit; nothing to do is nothing written."""
        if self.store.stamp("chunks") == self.store.stamp("indexed_chunks"):
            return
        have, want = self._table("indexed_chunks"), self._table("chunks").select("chunk_id", "tenant_id", "text", F.xxhash64("text").alias("sha"))
        missing = staged(relational.null_safe(want, have, ["chunk_id", "sha"], "left_anti"), "unindexed")
        dead = relational.null_safe(have, want, ["chunk_id", "sha"], "left_anti").select("tenant_id", "chunk_id")
        self.store.change({"chunks": Change(gone=dead.limit(0)), "indexed_chunks": Change(self._entries(missing), dead.unionByName(missing.select("tenant_id", "chunk_id")))}, "index")

    def optimize_index(self) -> None:
        """Puts the index's segments together when there are many; older versions keep theirs."""
        entries = self._table("indexed_chunks")
        if entries.select("segment").distinct().count() > MOST_SEGMENTS:
            made = staged(self.index.merge(staged(entries, "entries")), "entries")
            self.store.change({"chunks": Change(gone=made.select("tenant_id", "chunk_id").limit(0)), "indexed_chunks": Change(made, made.select("tenant_id", "chunk_id"))}, "optimize index")

    def ingest_file(self, path: str, strict: bool = False) -> dict[str, Any]:
        return self._ingest(files.read_files(self.spark, path, self.tenant, extensions=None, strict=strict), f"ingest {path}")

    def ingest_text(self, text: str, source: str = "raw_text", source_type: str | None = None) -> dict[str, Any]:
        return self._ingest(files.raw_texts(self.spark, [(source, text)], self.tenant, source_type), f"ingest {source}")

    def ingest_directory(self, path: str, recursive: bool = True, all_files: bool = False) -> dict[str, Any]:
        return self._ingest(files.read_files(self.spark, path, self.tenant, recursive, None if all_files else files.EXTENSIONS, strict=True), f"ingest {path}")

    def list_documents(self, limit: int = 100, offset: int = 0) -> list[dict]:
        rows = relational.page(self._table("documents").drop("text"), [F.desc("created_at"), "doc_id"], offset, min(limit, 1000))
        return [r.asDict() for r in rows.collect()]

    def delete_document(self, doc_id: str) -> bool:
        """Removes a document with its chunks, vectors, tags and metadata; entities stay without their source. False if there is none."""
        own = (F.col("doc_id") == doc_id) & (F.col("tenant_id") == self.tenant)
        t = lambda n: self.store.table(n).filter(own)
        gone = t("documents").select("tenant_id", "doc_id")
        if gone.isEmpty():
            return False
        changes = {n: Change(gone=gone) for n in ("documents", "chunks", "document_tags", "metadata")}
        changes["chunk_vectors"] = changes["indexed_chunks"] = Change(gone=t("chunks").select("tenant_id", "chunk_id"))
        left = self._table("entities").filter(F.col("source_document_id") == doc_id).withColumn("source_document_id", F.lit(None).cast("string"))
        changes["events"] = self._emitted(aggregates.facts(gone, "doc_id", "DocumentDeleted", ["doc_id"]))
        self.store.change(changes | {"entities": self.store.merge("entities", left)}, f"delete {doc_id}")
        return True

    # Search

    def _searchable(self, version: int | str | None = None) -> DataFrame:
        return self._table("chunks", version).join(self._table("chunk_vectors", version).select("chunk_id", "vector"), "chunk_id", "left")

    def search(self, query: str, k: int = 10, filters: dict[str, Any] | None = None, version: int | str | None = None) -> list[dict]:
        """Hybrid search; k is at most 50; noise types are left out. Words are looked up in the index; of the chunks only the hits are read."""
        s, k = self.config["search"], max(1, min(k, 50))
        depth = max(20, 2 * k)
        if version is None:
            self.refresh_index()
        entries, vectors = self._table("indexed_chunks", version), self._table("chunk_vectors", version).select("chunk_id", "vector")
        if filters:
            own = self._table("chunks", version).filter(search.compile_filters(filters)).select("chunk_id")
            entries, vectors = (x.join(own, "chunk_id", "left_semi") for x in (entries, vectors))
        words = self.spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q"))).head()[0]
        near = search.vector_topk(vectors, self.embedder.vector(query), depth, "chunk_id", "vector")
        text = self.index.search(entries, words, depth)
        lists = [[tuple(r) for r in df.collect()] for df in (near, text)]
        ids = sorted({i for rows in lists for i, _ in rows})
        found = {r["chunk_id"]: r.asDict(recursive=True) for r in self._table("chunks", version).filter(F.col("chunk_id").isin(*ids)).drop("created_at").collect()}
        typed = [self.spark.createDataFrame([(i, float(v), found[i]["chunk_type"]) for i, v in rows if i in found], "chunk_id string, score double, chunk_type string") for rows in lists]
        fused = search.rrf(typed, "chunk_id", k, s["rrf_k"], s["floor"], tuple(s["excluded_types"]), "chunk_type").orderBy(F.desc("score"), "chunk_id").collect()
        return search.rerank([found[r["chunk_id"]] | {"score": round(r["score"], 4)} for r in fused], query, k, self.ask)

    def search_context(self, query: str, k: int = 5, before: int = 1, after: int = 1) -> list[dict]:
        """Hits (at most 20) with their neighbours (at most 5 each way) in order."""
        hits = self.search(query, min(k, 20))
        before, after = (max(0, min(x, 5)) for x in (before, after))
        if not hits:
            return []
        at = self.spark.createDataFrame([(h["doc_id"], h["chunk_index"]) for h in hits], "doc_id string, chunk_index int")
        near = search.context(self._table("chunks").select("doc_id", "chunk_index", "text"), at, before, after, "doc_id", "chunk_index").collect()
        for h in hits:
            h["context"] = [r["text"] for r in sorted((r for r in near if (r["doc_id"], r["hit_index"]) == (h["doc_id"], h["chunk_index"])), key=lambda r: r["chunk_index"])]
        return hits

    def retrieve(self, query: str, top_k: int, filters: dict[str, Any] | None = None) -> list[dict]:
        """The chunks whose vectors are nearest to the query's: chunk_id, doc_id, text, score, metadata."""
        rows = self._searchable().filter(search.compile_filters(filters)).filter("vector is not null")
        best = search.vector_topk(rows, self.embedder.vector(query), top_k, "chunk_id", "vector")
        full = best.join(self._table("chunks").select("chunk_id", "doc_id", "text", "metadata"), "chunk_id").orderBy(F.desc("score"), "chunk_id")
        return [r.asDict(recursive=True) for r in full.collect()]

    def search_similar(self, chunk_id: str, k: int = 10, exclude_self: bool = True) -> list[dict]:
        rows = self._table("chunk_vectors").select("chunk_id", "vector")
        best = search.similar_to(rows, chunk_id, min(k, 20), "chunk_id", "vector", exclude_self)
        return [r.asDict() for r in best.join(self._table("chunks").select("chunk_id", "doc_id", "text"), "chunk_id").orderBy(F.desc("score"), "chunk_id").collect()]

    def retrieve_context(self, query: str, k: int = 5, filters: str | None = None) -> str:
        try:
            wanted = json.loads(filters) if filters else None
        except ValueError:
            return "filters must be JSON"
        return "\n\n".join(f"---\nSource [{i}]: {h['file_path']}\n{h['text']}" for i, h in enumerate(self.search(query, k, wanted), 1))

    def get_chunk(self, chunk_id: str) -> dict | None:
        row = self._table("chunks").filter(F.col("chunk_id") == chunk_id).head()
        return row.asDict(recursive=True) if row else None

    def get_document(self, doc_id: str) -> dict | None:
        row = self._table("documents").filter(F.col("doc_id") == doc_id).head()
        return row.asDict(recursive=True) if row else None

    # Graph

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        nodes = self._table("entities").select(F.col("entity_id").alias("node"), "name", F.col("entity_type").alias("type"))
        edges = self._table("relations").select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.col("relation_type").alias("kind"), "weight")
        return nodes, edges

    def add_entity(self, name: str, entity_type: str, always_new: bool = False) -> str:
        """The id of the entity, which may have been there; with always_new another entity of the same name and type."""
        if always_new:
            key = uuid.uuid4().hex
            row = self.spark.createDataFrame([(key, self.tenant, name, entity_type, None, None, None, None, None, "manual", None)], schemas.ENTITIES)
            self.store.change({"entities": Change(row), "events": self._emitted(aggregates.facts(row, "entity_id", "EntityCreated", ["name", "entity_type"]))}, f"entity {name}")
            return key
        key = self.spark.range(1).select(F.sha2(F.concat_ws("\u001f", F.lit(self.tenant), F.lit(name), F.lit(entity_type)), 256)).head()[0]
        row = self.spark.createDataFrame([(key, self.tenant, name, entity_type, None, None, None, None, None, "manual", None)], schemas.ENTITIES)
        self._create("entities", row, "entity_id", "EntityCreated", ["name", "entity_type"])
        return key

    def add_relation(self, source: str, target: str, relation_type: str, weight: float = 1.0) -> str:
        """Both ends must exist; a weight of 0 means 1."""
        key = self.spark.range(1).select(F.sha2(F.concat_ws("\u001f", F.lit(self.tenant), F.lit(source), F.lit(target), F.lit(relation_type)), 256)).head()[0]
        row = self.spark.createDataFrame([(key, self.tenant, source, target, relation_type, float(weight or 1.0), None, None)], schemas.RELATIONS)
        for end in ("source_entity_id", "target_entity_id"):
            if not relational.missing_parents(row, self._table("entities"), end, "entity_id").isEmpty():
                raise ValueError(f"{end} is unknown")
        self._create("relations", row, "relation_id", "RelationCreated", ["source_entity_id", "target_entity_id", "relation_type"])
        return key

    def _create(self, table: str, row: DataFrame, key: str, event: str, payload: list[str]) -> None:
        """Adds a row with its event, in one commit; a row that is there stays, without one."""
        new = self.store.merge(table, row, "ignore")
        if not new.rows.isEmpty():
            self.store.change({table: new, "events": self._emitted(aggregates.facts(new.rows, key, event, payload))}, f"add to {table}")

    def search_graph(self, text: str, entity_type: str | None = None, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in graph.search_entities(self._graph()[0], text, entity_type, limit).collect()]

    def neighbours(self, entity_id: str) -> list[dict]:
        nodes, edges = self._graph()
        return [r.asDict() for r in graph.neighbours(edges, nodes, entity_id).collect()]

    def bfs(self, entity_id: str, depth: int = 2) -> list[dict]:
        nodes, edges = self._graph()
        return [r.asDict() for r in graph.bfs_min_depth(edges, entity_id, graph.clamp_depth(depth)).join(nodes, "node").orderBy("depth", "name").collect()]

    def shortest_path(self, source: str, target: str, max_depth: int = 10) -> list[str] | None:
        return graph.shortest_path(self._graph()[1], source, target, max_depth)

    def get_entity_relations(self, entity_id: str) -> list[dict]:
        nodes, edges = self._graph()
        return [r.asDict() for r in graph.relations_of(edges, nodes, entity_id).collect()]

    # SQL

    def _views(self) -> dict[str, DataFrame]:
        return {n: self._table(n) for n in schemas.TABLES}

    def sql_query(self, query: str, limit: int = 100, args: dict[str, Any] | list[Any] | None = None) -> dict[str, Any]:
        return sql.sql_query(self.spark, query, self._views(), limit, args=args)

    def sql_execute(self, statement: str, args: dict[str, Any] | list[Any] | None = None) -> dict[str, Any]:
        """Runs one INSERT, UPDATE, DELETE or MERGE on the tenant's rows, in one commit: affected_rows, or the error.

        UPDATE and DELETE need a WHERE; a key that is taken is an error; args are values for :name or ? markers.
        """
        defaults = {
            "tags": {"tag_id": relational.tag_id_of(F.col("tenant_id"), F.col("name"))}, "chunks": {"chunk_id": chunking.chunk_id_of(F.col("tenant_id"), F.col("doc_id"), F.col("chunk_index"))},
            "entities": {"entity_id": F.sha2(F.concat_ws("\u001f", "tenant_id", "name", "entity_type"), 256)},
            "relations": {"relation_id": F.sha2(F.concat_ws("\u001f", "tenant_id", "source_entity_id", "target_entity_id", "relation_type"), 256)},
            "documents": {"doc_id": F.lit(None)},
        }
        try:
            writer = sql.Writer(self.spark, self._views(), {t: schemas.KEYS[t] for t in schemas.WRITABLE}, {"tenant_id": self.tenant}, defaults, {"metadata": ["doc_id"]})
            write, n = writer.compile(statement, args)
            if n:
                self.store.change({write.table: Change(write.rows, write.gone)}, statement)
            return {"affected_rows": n}
        except ConflictError:
            raise
        except Exception as e:  # noqa: BLE001  callers get errors as data
            return {"error": (str(e).strip() or type(e).__name__).splitlines()[0]}

    def merge_rows(self, table: str, rows: list[tuple], mode: str = "update") -> dict[str, Any]:
        """Merges rows by the table's natural key."""
        if table not in schemas.TABLES:
            return {"error": f"no such table: {table}"}
        given = self.spark.createDataFrame(rows, schemas.TABLES[table])
        if not given.filter(~F.col("tenant_id").eqNullSafe(F.lit(self.tenant))).isEmpty():
            return {"error": "rows of another tenant"}
        self.store.upsert({table: given}, f"merge into {table}", mode)
        return {"affected_rows": len(rows)}

    def delete_rows(self, table: str, values: dict[str, Any]) -> dict[str, Any]:
        """Deletes the rows with these values."""
        if table not in schemas.TABLES or not values:
            return {"error": f"no such table: {table}" if values else "nothing named"}
        gone = self._table(table).filter(search.compile_filters(values))
        n = gone.count()
        self.store.change({table: Change(gone=gone.select(*schemas.KEYS[table]))}, f"delete from {table}")
        return {"affected_rows": n}

    def sql_tables(self) -> dict[str, list[dict[str, str]]]:
        return relational.describe(self._views())

    # Tags and metadata

    def add_tag(self, name: str, color: str = "", description: str = "") -> None:
        row = self.spark.createDataFrame([(uuid.uuid5(uuid.NAMESPACE_OID, f"{self.tenant}/{name}").hex, self.tenant, name, color, description)], schemas.TAGS)
        self.store.upsert({"tags": row}, f"tag {name}")

    def tag_document(self, doc_id: str, name: str) -> None:
        tag_id = uuid.uuid5(uuid.NAMESPACE_OID, f"{self.tenant}/{name}").hex
        tag = self.spark.createDataFrame([(tag_id, self.tenant, name, "", "")], schemas.TAGS)
        link = self.spark.createDataFrame([(doc_id, tag_id, self.tenant)], schemas.DOCUMENT_TAGS)
        self.store.upsert({"tags": tag, "document_tags": link}, f"tag {doc_id}", "ignore")

    def untag_document(self, doc_id: str, name: str) -> None:
        ids = self._table("tags").filter(F.col("name") == name).select("tenant_id", F.lit(doc_id).alias("doc_id"), "tag_id")
        self.store.change({"document_tags": Change(gone=ids)}, f"untag {doc_id}")

    def get_document_tags(self, doc_id: str) -> list[str]:
        return [r["name"] for r in relational.tags_of(self._table("document_tags"), self._table("tags"), doc_id).collect()]

    def list_tags(self) -> list[str]:
        return [r["name"] for r in self._table("tags").orderBy("name").collect()]

    def set_metadata(self, key: str, value: str, doc_id: str | None = None) -> None:
        self.store.upsert({"metadata": self.spark.createDataFrame([(key, value, doc_id, self.tenant)], schemas.METADATA)}, f"metadata {key}")

    def get_metadata(self, key: str | None = None, doc_id: str | None = None) -> dict[str, str]:
        return {r["key"]: r["value"] for r in relational.metadata_of(self._table("metadata"), key, doc_id).collect()}

    # Statistics and versions

    def sync_database(self) -> dict[str, int]:
        """Nothing is mirrored: SQL reads the same tables. Kept for callers; returns what SQL sees."""
        return {"documents_synced": self._table("documents").count(), "chunks_synced": self._table("chunks").count()}

    def query_document_stats(self) -> dict[str, Any]:
        return relational.document_stats(self._table("documents"), self._table("chunks")).head().asDict()

    def get_stats(self) -> dict[str, Any]:
        return {r["name"]: r["rows"] for r in relational.counts(self._views()).collect()} | {"bytes": self.store.size(), "versions": len(self.store.versions())}

    def list_versions(self) -> list[dict]:
        return self.store.versions()

    def create_tag(self, name: str, version: int | None = None) -> None:
        self.store.tag(name, version)

    def checkout_version(self, version: int | str) -> dict[str, DataFrame]:
        """The tables as they were; the head doesn't move."""
        return {n: self._table(n, version) for n in schemas.TABLES}

    def restore_version(self, version: int | str) -> int:
        return self.store.restore(version)

    def create_branch(self, name: str, version: int | str | None = None) -> None:
        self.store.create_branch(name, version)

    def list_branches(self) -> dict[str, int]:
        return self.store.branches()

    def switch_branch(self, name: str) -> None:
        self.store = self.store.on_branch(name)

    # Formatted resources

    def resource(self, uri: str) -> str:
        """search://<query>, chunk://<id>, doc://<id>, graph://<text>, stats:// and versions:// as text."""
        kind, _, rest = uri.partition("://")
        if kind == "search":
            return self.retrieve_context(rest)
        if kind in ("chunk", "doc"):
            row = self.get_chunk(rest) if kind == "chunk" else self.get_document(rest)
            return f"no such {kind}" if row is None else "\n".join(f"{k}: {v}" for k, v in row.items() if v is not None)
        if kind == "graph":
            return "\n".join(f"{r['name']} ({r['type']}) {r['node']}" for r in self.search_graph(rest)) or "nothing found"
        if kind == "stats":
            return "\n".join(f"{k}: {v}" for k, v in self.get_stats().items())
        if kind == "versions":
            return "\n".join(f"{v['version']} {v['at']} {v['operation']} {','.join(v['tags'])}".rstrip() for v in self.list_versions())
        raise ValueError(f"unknown resource: {uri}")
