"""Vector expressions and embedders."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def checked(v: Column, dimensions: int) -> Column:
    """The vector; another dimension is an error."""
    return F.when(F.size(v) == dimensions, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size(v).cast("string"))))


def degraded(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """One row: whether there are vectors and all are all zeros."""
    zero = F.forall(column, lambda x: x == 0)
    return vectors.agg((F.count("*") > 0).alias("some"), F.bool_and(zero).alias("zeros")).select((F.col("some") & F.coalesce("zeros", F.lit(False))).alias("degraded"))


class Embedder(Protocol):
    model: str
    dimensions: int

    def column(self, text: Column) -> Column: ...

    def vector(self, text: str) -> list[float]: ...


class SeededEmbedder:
    """Vectors from a random generator seeded with the text's sha256: stands in for a model, equal texts get equal vectors."""

    def __init__(self, dimensions: int = 768) -> None:
        self.dimensions = dimensions
        self.model = f"seeded-{dimensions}"

    def vector(self, text: str) -> list[float]:
        draw = random.Random(int.from_bytes(hashlib.sha256((text or "").encode()).digest(), "big")).uniform
        return [draw(-1.0, 1.0) for _ in range(self.dimensions)]

    def column(self, text: Column) -> Column:
        vector = self.vector

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(vector)

        return embed(text)


class CallableEmbedder:
    """Vectors of a Python function, such as a model server's client; a text on which it fails, or gives another length, gets the zero vector."""

    def __init__(self, embed: Callable[[str], list[float]], dimensions: int, model: str) -> None:
        self.embed, self.dimensions, self.model = embed, dimensions, model

    def vector(self, text: str) -> list[float]:
        try:
            got = [float(x) for x in self.embed(text or "")]
        except Exception:  # noqa: BLE001  whatever the model's client raises, the text stays searchable by its words
            got = []
        return got if len(got) == self.dimensions else [0.0] * self.dimensions

    def column(self, text: Column) -> Column:
        vector = self.vector

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(vector)

        return embed(text)


def hashed(text: str | None, dimensions: int) -> list[float]:
    """Of unit length: lower-cased words and their pieces of three signs, each with a sign at a hashed place, words twice as heavy, repeats by the root of their number; zeros without words."""
    counts: dict[str, float] = {}
    for word in re.findall(r"\w+", (text or "").lower()):
        for sign, weight in [(word, 2.0), *((f"#{p}", 1.0) for p in map("".join, zip(f"<{word}>", word + ">", word[1:] + ">", strict=False)))]:
            counts[sign] = counts.get(sign, 0.0) + weight
    out = np.zeros(dimensions)
    for sign, weight in counts.items():
        h = zlib.crc32(sign.encode())
        out[h % dimensions] += math.sqrt(weight) * (1 if h >> 31 else -1)
    size = float(np.linalg.norm(out))
    return (out / size if size else out).tolist()


class HashingEmbedder:
    """Vectors of hashed words and their pieces: texts with words, or forms of words, in common are near. Needs no model; the default."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions
        self.model = f"hashing-{dimensions}"

    def vector(self, text: str) -> list[float]:
        return hashed(text, self.dimensions)

    def column(self, text: Column) -> Column:
        dimensions = self.dimensions

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda t: hashed(t, dimensions))

        return embed(text)


def embed_texts(texts: DataFrame, embedder: Embedder, key: str, text: str = "text", cache: DataFrame | None = None) -> DataFrame:
    """(key, vector): each distinct text is embedded once; ``cache`` (sha, vector) holds vectors made before."""
    keyed = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("sha", F.sha2("__text", 256))
    distinct = keyed.groupBy("sha").agg(F.first("__text").alias("__text"))
    if cache is not None:
        made = distinct.join(cache.select("sha"), "sha", "left_anti").select("sha", embedder.column(F.col("__text")).alias("vector")).unionByName(cache.select("sha", "vector"))
    else:
        made = distinct.select("sha", embedder.column(F.col("__text")).alias("vector"))
    return keyed.select(key, "sha").join(made, "sha").select(key, "vector")
