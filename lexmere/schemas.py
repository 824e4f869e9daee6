"""Schemas of the stored tables."""

from __future__ import annotations

DOCUMENTS = "doc_id string, source string, source_type string, language string, title string, text string, file_size long, chunk_count int, metadata map<string,string>, tenant_id string, created_at timestamp"
CHUNKS = (
    "chunk_id string, doc_id string, chunk_index int, text string, source_type string, chunk_type string, entity_name string, "
    "heading_path array<string>, scope_chain array<string>, parent_chunk_id string, sibling_order int, sibling_count int, "
    "file_path string, start_line int, end_line int, start_char int, end_char int, metadata map<string,string>, tenant_id string, created_at timestamp"
)
VECTORS = "chunk_id string, tenant_id string, vector array<float>, embedding_model string, embedded_at timestamp"
CACHE = "sha string, embedding_model string, tenant_id string, vector array<float>"
ENTITIES = "entity_id string, tenant_id string, name string, entity_type string, source_document_id string, chunk_id string, start_char int, end_char int, confidence double, extractor_id string, metadata map<string,string>"
RELATIONS = "relation_id string, tenant_id string, source_entity_id string, target_entity_id string, relation_type string, weight double, confidence double, chunk_id string"
TAGS = "tag_id string, tenant_id string, name string, color string, description string"
DOCUMENT_TAGS = "doc_id string, tag_id string, tenant_id string"
METADATA = "key string, value string, doc_id string, tenant_id string"
EVENTS = "event_id string, aggregate_id string, tenant_id string, event_type string, version long, payload string, created_at timestamp"
DLQ = "projection_name string, tenant_id string, event_id string, event_type string, error_message string, retry_count int, resolved boolean, created_at timestamp"
IDEMPOTENCY = "idempotency_key string, tenant_id string, command_type string, command_payload string, result string, created_at timestamp, expires_at timestamp"
INDEXED = "chunk_id string, tenant_id string, segment string, dl int, sha long"
CHECKPOINTS = "projection_name string, tenant_id string, stream string, batch_id long, last_event_id string, last_event_at timestamp, events long, updated_at timestamp"

TABLES = {
    "documents": DOCUMENTS, "chunks": CHUNKS, "chunk_vectors": VECTORS, "embedding_cache": CACHE, "entities": ENTITIES, "relations": RELATIONS, "tags": TAGS,
    "document_tags": DOCUMENT_TAGS, "metadata": METADATA, "events": EVENTS, "projection_dlq": DLQ, "idempotency_keys": IDEMPOTENCY, "projection_checkpoints": CHECKPOINTS, "indexed_chunks": INDEXED,
}
#: Natural keys, by which upserts and insert-ignores tell rows apart.
KEYS = {
    "documents": ("tenant_id", "source"), "chunks": ("tenant_id", "doc_id", "chunk_index"), "chunk_vectors": ("tenant_id", "chunk_id"),
    "embedding_cache": ("tenant_id", "embedding_model", "sha"),
    "entities": ("tenant_id", "name", "entity_type"), "relations": ("tenant_id", "source_entity_id", "target_entity_id", "relation_type"),
    "tags": ("tenant_id", "name"), "document_tags": ("tenant_id", "doc_id", "tag_id"), "metadata": ("tenant_id", "key", "doc_id"),
    "events": ("tenant_id", "event_id"), "projection_dlq": ("projection_name", "tenant_id", "event_id"), "idempotency_keys": ("tenant_id", "idempotency_key"),
    "projection_checkpoints": ("projection_name", "tenant_id", "stream"), "indexed_chunks": ("tenant_id", "chunk_id"),
}
#: Tables that SQL statements may write.
WRITABLE = ("documents", "chunks", "entities", "relations", "tags", "document_tags", "metadata")
