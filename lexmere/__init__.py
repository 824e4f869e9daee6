"""A document knowledge base on Spark: ingest, chunk, embed, search, graph, versions, events."""
