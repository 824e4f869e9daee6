"""Files, folders, raw texts, element partitions and recorded extractions as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.functions.text import LANGUAGES, MARKDOWN, file_type, language, raw_text_type

#: Extensions that folder ingestion takes.
EXTENSIONS = (*LANGUAGES, *MARKDOWN, ".txt", ".html", ".htm")


def read_files(spark: SparkSession, path: str, tenant: str = "default", recursive: bool = True, extensions: tuple[str, ...] | None = EXTENSIONS, strict: bool = False) -> DataFrame:
    """doc_id, source, source_type, language, title, text, file_size, tenant_id, error: one row per file under path.

    Bad UTF-8 is replaced; with ``strict`` it fills ``error`` and leaves text null, and the other files go on.
    extensions None takes all files. A path without files is an error, as Spark raises it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if extensions is not None:
        raw = raw.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = raw.select(
        F.regexp_replace("path", "^file:", "").alias("source"), F.col("length").alias("file_size"),
        (F.when(valid, text) if strict else text).alias("text"), (F.when(~valid, F.lit("not UTF-8")) if strict else F.lit(None).cast("string")).alias("error"),
    )
    return documents(rows, tenant)


def documents(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows (source, text, file_size, error) as documents; doc_id follows from tenant and source, so a source read again keeps it."""
    return rows.select(
        F.sha2(F.concat_ws("\u001f", F.lit(tenant), "source"), 256).alias("doc_id"), "source", file_type(F.col("source"), F.col("text")).alias("source_type"),
        language(F.col("source"), F.col("text")).alias("language"), F.regexp_extract("source", r"[^/]*$", 0).alias("title"), "text", "file_size", F.lit(tenant).alias("tenant_id"), "error",
    )


def raw_texts(spark: SparkSession, texts: list[tuple[str, str]], tenant: str = "default", source_type: str | None = None) -> DataFrame:
    """Documents of (source, text) pairs; the type is as given or told by the first characters."""
    rows = spark.createDataFrame(texts, "source string, text string").withColumn("file_size", F.length("text").cast("long")).withColumn("error", F.lit(None).cast("string"))
    own = F.lit(source_type) if source_type else raw_text_type(F.col("text"))
    return documents(rows, tenant).withColumn("source_type", own)


class _Elements(HTMLParser):
    KINDS = {"p": "NarrativeText", "li": "ListItem", "blockquote": "Quote", "td": "UncategorizedText", "th": "UncategorizedText", "pre": "UncategorizedText", "header": "Header", "footer": "Footer", "title": "Title"}
    HIDDEN = ("script", "style", "noscript", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, int | None]] = []
        self.kind: tuple[str, int | None] = ("UncategorizedText", None)
        self.text: list[str] = []
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((text, *self.kind))
        self.text, self.kind = [], ("UncategorizedText", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        if re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.kind = ("Title", int(tag[1]) - 1)
        elif tag in self.KINDS:
            self.flush()
            self.kind = (self.KINDS[tag], 0 if tag == "title" else None)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if re.fullmatch(r"h[1-6]|div|section|article|tr|ul|ol|table", tag) or tag in self.KINDS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def partition(text: str, kind: str) -> list[tuple[str, str, int | None]]:
    """(text, element type, title depth) of an html, markdown or plain text."""
    if kind == "html":
        parser = _Elements()
        parser.feed(text)
        parser.close()
        parser.flush()
        return parser.found
    out: list[tuple[str, str, int | None]] = []
    for block in re.split(r"\n\s*\n", text):
        lines = block.strip("\n").split("\n")
        run: list[str] = []
        for line in lines:
            m = re.match(r"(#{1,6})\s+(.+)$", line) if kind == "markdown" else None
            item = re.match(r"\s*[-*+]\s+(.+)$", line) if kind == "markdown" else None
            if m or item:
                if "".join(run).strip():
                    out.append(("\n".join(run).strip(), "NarrativeText", None))
                run = []
                out.append((m[2].strip(), "Title", len(m[1]) - 1) if m else (item[1].strip(), "ListItem", None))
            else:
                run.append(line)
        if "".join(run).strip():
            out.append(("\n".join(run).strip(), "NarrativeText", None))
    return out


def elements(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, pos, text, element_type, depth: the elements of each text in order; null texts have none."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, pos, t, k, d) for i, text in zip(batch["doc_id"], batch["text"], strict=True) for pos, (t, k, d) in enumerate(partition(text or "", kind))]
            frame = pd.DataFrame(rows, columns=["doc_id", "pos", "text", "element_type", "depth"])
            frame["depth"] = frame["depth"].astype("Int32")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, pos int, text string, element_type string, depth int")


def html_elements(docs: DataFrame) -> DataFrame:
    return elements(docs, "html")


def text_element(docs: DataFrame) -> DataFrame:
    """Raw text as one element each."""
    return docs.select("doc_id", F.lit(0).alias("pos"), "text", F.lit("NarrativeText").alias("element_type"), F.lit(None).cast("int").alias("depth"))


def recorded_extractions(spark: SparkSession, path: str) -> DataFrame:
    """sha, pos, class, text, start, end, confidence of JSON-lines files named by the sha256 of a chunk's text."""
    raw = spark.read.schema("extraction_class string, extraction_text string, char_interval struct<start_pos:int,end_pos:int>, confidence double").json(path)
    rows = raw.withColumn("sha", F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]{64})[^/]*$", 1)).withColumn("at", F.monotonically_increasing_id())
    return rows.select("sha", F.col("at").alias("pos"), F.col("extraction_class").alias("class"), F.col("extraction_text").alias("text"), F.col("char_interval.start_pos").alias("start"), F.col("char_interval.end_pos").alias("end"), "confidence")
