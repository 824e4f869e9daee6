"""The seam for retrieval backends, and the one over a knowledge base."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import functions as F

from lexmere.api import KnowledgeBase
from lexmere.operators import relational


@runtime_checkable
class RetrievalBackend(Protocol):
    """What a search layer asks of a store of chunk vectors."""

    def initialize(self) -> None: ...

    def ingest(self, source_id: str, chunks: list[dict[str, Any]]) -> None: ...

    def retrieve(self, query: str, top_k: int, filters: dict[str, Any] | None = None) -> list[dict[str, Any]]: ...

    def delete_source(self, source_id: str) -> None: ...

    def health(self) -> bool: ...


class StoreBackend:
    """RetrievalBackend over a KnowledgeBase: a source is a document, its chunks come ready cut."""

    def __init__(self, base: KnowledgeBase) -> None:
        self.base = base

    def initialize(self) -> None:
        """Nothing to prepare: the store is made where it is opened."""

    def ingest(self, source_id: str, chunks: list[dict[str, Any]]) -> None:
        """Replaces the source's chunks by these ({"text": ..., "metadata": ...}); none removes them."""
        rows = [(source_id, i, c.get("text") or "", {k: str(v) for k, v in (c.get("metadata") or {}).items()}) for i, c in enumerate(chunks)]
        given = self.base.spark.createDataFrame(rows, "doc_id string, chunk_index int, text string, metadata map<string,string>")
        self.base.replace_chunks(source_id, given)

    def retrieve(self, query: str, top_k: int, filters: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        """node_id, source_id, text, score, metadata of the nearest chunks; filters are equalities on chunk columns."""
        return [{"node_id": r["chunk_id"], "source_id": r["doc_id"], "text": r["text"], "score": r["score"], "metadata": r["metadata"] or {}} for r in self.base.retrieve(query, top_k, filters)]

    def delete_source(self, source_id: str) -> None:
        self.ingest(source_id, [])

    def health(self) -> bool:
        """Whether the store can be read."""
        try:
            relational.for_tenant(self.base.store.table("chunks"), self.base.tenant).select(F.lit(1)).head()
        except Exception:  # noqa: BLE001  whatever is wrong, it is not well
            return False
        return True
