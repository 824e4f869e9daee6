"""Functions for SQL: chunkers as table functions, vectors as scalar ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmere.functions.vectors import SeededEmbedder
from lexmere.operators import chunking

_ROW = "chunk_index int, text string, chunk_type string, entity_name string, heading_path array<string>, start_line int, end_line int"


def _rows(pieces: list[chunking.Piece]) -> Iterator[tuple]:
    for i, p in enumerate(pieces):
        yield i, p.text, p.chunk_type, p.entity_name, list(p.heading_path), p.start_line, p.end_line


class ChunkMarkdown:
    def eval(self, text: str, max_size: int = chunking.MAX_SIZE) -> Iterator[tuple]:
        yield from _rows(chunking.markdown(text or "", max_size))


class ChunkText:
    def eval(self, text: str, max_size: int = chunking.MAX_SIZE) -> Iterator[tuple]:
        yield from _rows(chunking.paragraphs(text or "", max_size))


class ChunkCode:
    def eval(self, text: str, language: str, max_size: int = chunking.MAX_SIZE) -> Iterator[tuple]:
        yield from _rows(chunking.code(text or "", language, max_size))


def _embedding(dimensions: int) -> Callable:
    vector = SeededEmbedder(dimensions).vector

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(vector)

    return embed


def register(spark: SparkSession, dimensions: int = 768) -> None:
    """chunk_markdown(text[, size]), chunk_text(text[, size]), chunk_code(text, language[, size]) and seeded_embed(text) for the session's SQL.

    Null and blank texts have no chunks. Used as: select d.doc_id, c.* from docs d, lateral chunk_markdown(d.text) c.
    """
    for name, handler in (("chunk_markdown", ChunkMarkdown), ("chunk_text", ChunkText), ("chunk_code", ChunkCode)):
        spark.udtf.register(name, F.udtf(handler, returnType=_ROW))
    spark.udf.register("seeded_embed", _embedding(dimensions))
