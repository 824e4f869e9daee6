"""Entities and relations: pattern extraction, recorded extractions, co-occurrence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmere.config import DEFAULT_ONTOLOGY, Ontology
from lexmere.functions.text import camel_case

#: Identifiers that are not functions.
KEYWORDS = ("def", "class", "import", "from", "return", "if", "else")
#: Words that stand for concepts.
CONCEPTS = (
    "concept", "definition", "principle", "pattern", "architecture", "design", "algorithm", "data structure",
    "framework", "library", "module", "component", "service", "api", "protocol", "standard",
)
#: Names that are no entities.
STOP_NAMES = ("the", "this", "that", "and", "for", "with")
#: The kinds of the older extractor and their patterns.
PATTERNS = {
    "class": (r"(?:class|struct|interface)\s+(\w+)", r"(?:type|trait)\s+(\w+)", r"(?:defmodule|defstruct)\s+(\w+)"),
    "function": (r"(?:def|fn|func|fun|function)\s+(\w+)\s*\(", r"(?:sub)\s+(\w+)", r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\("),
    "concept": (r"(?:#+|##+)\s*(.+)$", r"(?:^|\n)([A-Z][a-z]+(?:[A-Z][a-z]+)+)"),
}
MOST_PAIRS = 10


def _listed(names: Column, kind: str, pattern: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"), F.lit(None).cast("int").alias("level")))


def _headings(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    row = lambda x: F.struct(
        F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.+?)(?:\s*\{.*\})?$", 1)).alias("name"), F.lit("CONCEPT").alias("kind"), F.lit("heading").alias("pattern"),
        F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).alias("level"),
    )
    return F.filter(F.transform(lines, row), lambda x: x["name"] != "")


def _keywords(text: Column) -> Column:
    """Concepts that stand in a text as whole words, in the order of CONCEPTS. One cut into words finds all of one word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    phrases = [c for c in CONCEPTS if " " in c]
    alone = lambda c: low.contains(c) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){c}(?![\p{{L}}\p{{N}}_])")
    words = F.concat(F.split(low, r"[^\p{L}\p{N}_]+"), *[F.when(alone(c), F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for c in phrases])
    return F.transform(F.array_intersect(F.array(*[F.lit(c) for c in CONCEPTS]), words), F.initcap)


def _first_of_each(found: Column) -> Column:
    """Of structs with a name, the first of each name, with its place as pos, in order. A sort by name within the row."""
    named = F.transform(found, lambda x, i: F.struct(x["name"].alias("name"), i.alias("pos"), x.alias("x")))
    new = lambda s: F.filter(s, lambda x, i: F.coalesce(x["name"] != F.get(s, i - 1)["name"], F.lit(True)))
    firsts = F.transform(F.array(F.array_sort(named)), new)  # the outer transform binds the sorted array once
    return F.array_sort(F.transform(firsts[0], lambda x: F.struct(x["pos"].alias("pos"), x["x"].alias("x"))))


def entity_lists(docs: DataFrame, id_col: str = "doc_id", type_col: str = "source_type", text_col: str = "text") -> DataFrame:
    """id, found: for each text an array of (pos, x: name, kind, pattern, level), the first occurrence of each name in order.

    markdown: headings, then CamelCase words. code: CamelCase words as classes, then snake_case words as
    functions. text: CamelCase words, then concept keywords. All within the row: nothing is shuffled, rows with
    one id are texts of their own, null texts have an empty array.
    """
    text = F.col(text_col)
    snake = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(r"^[a-z][a-z0-9_]*$") & (F.length(w) > 2) & ~w.isin(*KEYWORDS))
    found = (
        F.when(F.col(type_col) == "markdown", F.concat(_headings(text), _listed(camel_case(text), "CONCEPT", "CamelCase")))
        .when(F.col(type_col) == "code", F.concat(_listed(camel_case(text), "CLASS", "CamelCase"), _listed(snake, "FUNCTION", "snake_case")))
        .otherwise(F.concat(_listed(camel_case(text), "CONCEPT", "CamelCase"), _listed(_keywords(text), "CONCEPT", "keyword")))
    )
    return docs.select(id_col, _first_of_each(found).alias("found"))


def entities(docs: DataFrame, id_col: str = "doc_id", type_col: str = "source_type", text_col: str = "text") -> DataFrame:
    """id, pos, name, kind, pattern, level: a row for each entry of entity_lists."""
    return entity_lists(docs, id_col, type_col, text_col).select(id_col, F.inline("found")).select(id_col, "pos", "x.*")


def entities_by_pattern(docs: DataFrame, kinds: tuple[str, ...], known: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, name, kind: the older extractor's names of two letters or more, first of each, stop names and known names left out."""
    def names(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text_col), F.lit("(?m)" + pattern), F.lit(1))
        return F.transform(found, lambda n: F.struct(F.trim(n).alias("name"), F.lit(kind.upper()).alias("kind")))

    parts = F.concat(*[names(k, p) for k in kinds for p in PATTERNS[k]])
    ok = lambda x: (F.length(x["name"]) >= 2) & ~F.lower(x["name"]).isin(*STOP_NAMES) & (~x["name"].isin(*known) if known else F.lit(True))
    return docs.select(id_col, F.inline(_first_of_each(F.filter(parts, ok)))).select(id_col, "pos", "x.*")


def with_ontology(rows: DataFrame, ontology: Ontology = DEFAULT_ONTOLOGY) -> DataFrame:
    """Adds entity_type: the kind if the ontology has it, else Concept, else its first type."""
    other = "Concept" if "Concept" in ontology.entity_types else ontology.entity_types[0]
    own = {t.upper(): t for t in ontology.entity_types}
    table = F.create_map(*[F.lit(x) for p in own.items() for x in p])
    return rows.withColumn("entity_type", F.coalesce(F.try_element_at(table, F.upper("kind")), F.lit(other)))


def recorded(chunks: DataFrame, extractions: DataFrame, ontology: Ontology = DEFAULT_ONTOLOGY) -> DataFrame:
    """chunk_id, pos, name, entity_type, start_char, end_char, confidence of recorded extractions (sha, class, text, start, end, confidence, pos).

    They belong to chunks by the sha256 of the text. Null or impossible places are left out; a type
    outside the ontology is an error.
    """
    keyed = chunks.select("chunk_id", "text", F.sha2("text", 256).alias("sha"))
    met = keyed.join(extractions.withColumnRenamed("text", "name"), "sha").filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    met = met.filter((F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.col("start") < F.col("end")))
    kind = F.when(F.col("class").isin(*ontology.entity_types), F.col("class")).otherwise(F.raise_error(F.concat(F.lit("type outside the ontology: "), F.coalesce("class", F.lit("null")))))
    return met.select("chunk_id", "pos", "name", kind.alias("entity_type"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), "confidence")


def _paired(group: Column, few: Column, ontology: Ontology, most: int) -> list[Column]:
    """group, source, target, relation_type, confidence of the first ``most`` pairs of an array of (name, confidence)."""
    kind = next((t for t in ("MENTIONS", "RELATED_TO") if t in ontology.relation_types), ontology.relation_types[0])
    pairs = F.flatten(F.transform(few, lambda a, i: F.transform(F.slice(few, i + 2, F.lit(most)), lambda b: F.struct(
        a["name"].alias("source"), b["name"].alias("target"), F.lit(kind).alias("relation_type"),
        F.coalesce((a["confidence"] + b["confidence"]) / 2, a["confidence"], b["confidence"]).alias("confidence")))))
    return [group, F.inline(F.slice(pairs, 1, most))]


def cooccurrences(found: DataFrame, ontology: Ontology = DEFAULT_ONTOLOGY, group: str = "chunk_id", most: int = MOST_PAIRS) -> DataFrame:
    """group, source, target, relation_type, confidence: the first ``most`` pairs of a chunk's entities in order.

    Pairs (i, j) in order of i, then j, are all within the first most + 1 entities, so no more are paired.
    confidence is the mean, or the one that is known. For entities as rows, which are put together by chunk; entities that are still in
    their text's array need no shuffle, see cooccurrences_within.
    """
    w = Window.partitionBy(group).orderBy("pos", "name")
    few = found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most + 1)
    lists = few.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "confidence"))).alias("__few"))
    return lists.select(*_paired(F.col(group), F.col("__few"), ontology, most))


def cooccurrences_within(lists: DataFrame, ontology: Ontology = DEFAULT_ONTOLOGY, group: str = "doc_id", most: int = MOST_PAIRS, confidence: float | None = None) -> DataFrame:
    """The pairs of cooccurrences() for rows of entity_lists(), within the row."""
    few = F.transform(F.slice("found", 1, most + 1), lambda e: F.struct(e["x"]["name"].alias("name"), F.lit(confidence).cast("double").alias("confidence")))
    return lists.select(group, few.alias("__few")).select(*_paired(F.col(group), F.col("__few"), ontology, most))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "doc_id") -> DataFrame:
    """primary's rows, and fallback's for documents of which primary has none."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def patterned(docs: DataFrame, id_col: str = "doc_id", type_col: str = "source_type", text_col: str = "text") -> DataFrame:
    """The older extractor with the kinds of each source type: classes and functions of code, concepts of other texts; columns as entities() has them."""
    code = F.coalesce(F.col(type_col) == "code", F.lit(False))
    parts = entities_by_pattern(docs.filter(code), ("class", "function"), (), id_col, text_col).unionByName(entities_by_pattern(docs.filter(~code), ("concept",), (), id_col, text_col))
    return parts.select(id_col, "pos", "name", "kind", F.lit("older").alias("pattern"), F.lit(None).cast("int").alias("level"))


_BACKENDS: dict[str, Callable[..., DataFrame]] = {"regex": entities, "patterns": patterned}


def register(name: str, extract: Callable[..., DataFrame]) -> None:
    _BACKENDS[name] = extract


def extractor(name: str = "regex") -> Callable[..., DataFrame]:
    if name not in _BACKENDS:
        raise ValueError(f"unknown extractor: {name}")
    return _BACKENDS[name]
