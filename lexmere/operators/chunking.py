"""Chunkers: a document's text to ordered chunks with provenance.

Chunking is a fold over one document, so each chunker is a plain function of a text, and
``chunk_documents`` runs it over Arrow batches, one document at a time, without a shuffle.
``lines`` and ``sentences`` are expressions and need no Python.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.operators.codelex import code_only

MAX_SIZE = 2000
SMALL = 100
#: Words whose full stop does not end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "approx", "dept", "est", "govt",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "inc", "ltd", "corp", "co",
)
#: Starts of lines at which code may be cut.
BOUNDARIES = ("def ", "async def ", "class ", "func ", "fn ", "public ", "private ", "protected ")
#: Element types to source types; others are text.
ELEMENT_TYPES = {
    "Title": "markdown", "Header": "markdown", "Footer": "markdown", "List": "markdown", "ListItem": "markdown",
    "NarrativeText": "text", "UncategorizedText": "text", "Quote": "text",
}


@dataclass(frozen=True)
class Piece:
    text: str
    chunk_type: str
    start_line: int = 0
    end_line: int = 0
    heading_path: tuple[str, ...] = ()
    entity_name: str | None = None
    scope_chain: tuple[str, ...] = ()
    start_char: int | None = None
    end_char: int | None = None
    source_type: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def packed(parts: Iterable[str], max_size: int) -> Iterator[list[str]]:
    """Runs of parts of at most max_size characters, joiners aside; a longer part is a run of its own."""
    run: list[str] = []
    for part in parts:
        if run and sum(map(len, run)) + len(part) > max_size:
            yield run
            run = []
        run.append(part)
    if run:
        yield run


def merged(pieces: list[Piece], max_size: int, same: Callable[[Piece], object], joiner: str = "\n\n") -> list[Piece]:
    """Joins a piece to a small one before it where ``same`` agrees and both fit; the first entity name stays."""
    out: list[Piece] = []
    for p in pieces:
        last = out[-1] if out else None
        if last and len(last.text) < SMALL and same(last) == same(p) and len(last.text) + len(p.text) <= max_size:
            out[-1] = replace(last, text=last.text + joiner + p.text, end_line=p.end_line, entity_name=last.entity_name or p.entity_name)
        else:
            out.append(p)
    return out


def _front_matter(text: str) -> tuple[str, dict[str, str], int]:
    found = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", text, re.S)
    if not found:
        return text, {}, 0
    pairs = (line.split(":", 1) for line in found[1].split("\n") if ":" in line)
    return text[found.end():], {f"frontmatter.{k.strip()}": v.strip().strip("'\"") for k, v in pairs}, text[: found.end()].count("\n")


def markdown(text: str, max_size: int = MAX_SIZE) -> list[Piece]:
    """One chunk per heading with the path of headings above it; text before the first heading is left out.

    Without headings the whole text is one chunk. Larger sections are cut at blank lines; small
    neighbours under one path are joined.
    """
    body, meta, skipped = _front_matter(text)
    if not body.strip():
        return []
    lines = body.split("\n")
    heads = [(i, len(m[1]), m[2].strip()) for i, line in enumerate(lines) if (m := re.match(r"(#{1,6})\s+(.+)$", line))]
    if not heads:
        return [Piece(body, "document", skipped, skipped + len(lines) - 1, metadata=meta)]
    out, path = [], []
    for (at, level, title), until in zip(heads, [h[0] for h in heads[1:]] + [len(lines)], strict=True):
        path = [p for p in path if p[0] < level] + [(level, title)]
        section = Piece("\n".join(lines[at:until]), "section", skipped + at + 1, skipped + until - 1, tuple(t for _, t in path), metadata=meta)
        if len(section.text) <= max_size:
            out.append(section)
        else:
            out += [replace(section, text="\n\n".join(run), chunk_type="section_fragment") for run in packed(re.split(r"\n\n+", section.text), max_size)]
    return merged(out, max_size, lambda p: p.heading_path)


def paragraphs(text: str, max_size: int = MAX_SIZE) -> list[Piece]:
    if not text.strip():
        return []
    out, line = [], 0
    for run in packed(re.split(r"\n\n+", text.strip()), max_size):
        body = "\n\n".join(run)
        out.append(Piece(body, "paragraph_group", line, line + body.count("\n")))
        line += sum(p.count("\n") + 1 for p in run)
    return out


def split_sentences(text: str) -> list[str]:
    """Cut after a word that ends in a full stop, question or exclamation mark, abbreviations aside; line by line if there is one sentence at most and over three lines."""
    out, run = [], []
    for word in text.replace("\n", " ").split(" "):
        run.append(word)
        if word.endswith((".", "?", "!")) and word.rstrip(".?!").lower() not in ABBREVIATIONS:
            out.append(" ".join(run).strip())
            run = []
    out.append(" ".join(run).strip())
    out = [s for s in out if s]
    rows = [line.strip() for line in text.split("\n") if line.strip()]
    return rows if len(out) <= 1 and len(rows) > 3 else out


def gaps(vectors: list[list[float]], window: int = 3) -> list[float]:
    """1 - cosine of the means of the windows at i and at i + window, for each i that has a second window, cut short at the end."""
    import numpy as np

    v = np.asarray(vectors, float)
    out = []
    for i in range(len(v) - window):
        a, b = v[i : i + window].mean(axis=0), v[i + window : i + 2 * window].mean(axis=0)
        size = float(np.linalg.norm(a) * np.linalg.norm(b))
        out.append(1 - (float(a @ b) / size if size else 0.0))
    return out


def semantic(text: str, embed: Callable[[list[str]], list[list[float]]], max_size: int = MAX_SIZE, window: int = 3, threshold: float = 0.3, least: int = 200) -> list[Piece]:
    """Sentences grouped until the size is full or the meaning turns; paragraphs if there is one sentence or the embedder fails.

    Gap i is looked up before sentence i.
    """
    sentences = split_sentences(text)
    if len(sentences) <= 1:
        return paragraphs(text, max_size)
    try:
        turns = gaps(embed(sentences), window)
    except Exception:  # noqa: BLE001  an embedder may raise anything
        return paragraphs(text, max_size)
    groups: list[list[str]] = [[]]
    for i, s in enumerate(sentences):
        size = sum(map(len, groups[-1]))
        if groups[-1] and (size + len(s) > max_size or (i < len(turns) and turns[i] > threshold and size > least)):
            groups.append([])
        groups[-1].append(s)
    out, line = [], 0
    for g in groups:
        body = " ".join(g)
        out.append(Piece(body, "semantic", line, line + body.count("\n")))
        line += body.count("\n") + 1
    return out


def _at_boundaries(text: str) -> list[tuple[int, str]]:
    """(first line, text) of the runs that begin at boundary lines, blank ones left out."""
    lines = text.split("\n")
    firsts = [0, *(i for i, line in enumerate(lines) if i and line.strip().startswith(BOUNDARIES))]
    runs = ((a, "\n".join(lines[a:b])) for a, b in zip(firsts, [*firsts[1:], len(lines)], strict=True))
    return [(a, t) for a, t in runs if t.strip()]


def by_lines(text: str, least: int = 200) -> list[Piece]:
    """Code without a known grammar: a boundary line ends a chunk once more than ``least`` characters are gathered."""
    out, run, first = [], [], 0
    for i, line in enumerate(text.split("\n")):
        run.append(line)
        if line.strip().startswith(BOUNDARIES) and sum(len(x) + 1 for x in run) > least:
            out.append(Piece("\n".join(run), "code_block", first, i))
            run, first = [], i + 1
    if "".join(run).strip():
        out.append(Piece("\n".join(run), "code_block", first, first + len(run) - 1))
    return out


_DEFINITIONS = {
    "javascript": (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(function\*?|class)\s+(\w+)", r"import\b"),
    "typescript": (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum|type)\s+(\w+)", r"import\b"),
    "rust": (r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+)?(fn|struct|enum|trait|impl|mod)\s+(?:<[^>]*>\s*)?(\w+)", r"use\b"),
    "go": (r"(func|type)\s+(?:\([^)]*\)\s*)?(\w+)", r"import\b"),
    "java": (r"(?:(?:public|private|protected|abstract|final|static)\s+)*(class|interface|enum|record)\s+(\w+)", r"import\b"),
}
_TYPES = {"function": "function", "function*": "function", "fn": "function", "func": "function", "def": "function"}


def _python_entities(text: str) -> tuple[list[tuple[str, str, int, int]], list[int]]:
    tree = ast.parse(text)
    found = [
        (n.name, "class" if isinstance(n, ast.ClassDef) else "function", min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1, n.end_lineno - 1)
        for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
    ]
    return found, [i for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)) for i in range(n.lineno - 1, n.end_lineno)]


def _braced_entities(text: str, language: str) -> tuple[list[tuple[str, str, int, int]], list[int]]:
    """The topmost definitions, each from the line that it begins to its closing brace, or its own line without one. Braces in literals and comments don't count."""
    define, load = (re.compile(r"\s*" + p) for p in _DEFINITIONS[language])
    lines, found, imports, at = code_only(text, language).split("\n"), [], [], 0
    while at < len(lines):
        if load.match(lines[at]) and not found:
            imports.append(at)
            while "(" in lines[at] and ")" not in lines[imports[-1]] and imports[-1] + 1 < len(lines):
                imports.append(imports[-1] + 1)
            at = imports[-1]
        elif m := define.match(lines[at]):
            depth, end, opened = 0, at, False
            for end in range(at, len(lines)):
                depth += lines[end].count("{") - lines[end].count("}")
                opened |= "{" in lines[end]
                if (opened and depth <= 0) or (not opened and lines[end].rstrip().endswith(";")):
                    break
            kind = "method" if language == "go" and re.match(r"\s*func\s*\(", lines[at]) else _TYPES.get(m[1], m[1])
            found.append((m[2], kind, at, end))
            at = end
        at += 1
    return found, imports


def code(text: str, language: str | None, max_size: int = MAX_SIZE) -> list[Piece]:
    """Imports first, then one chunk per top-level definition; other languages and broken code by lines."""
    if not text.strip():
        return []
    try:
        found, imports = _python_entities(text) if language == "python" else _braced_entities(text, language) if language in _DEFINITIONS else ([], [])
    except (SyntaxError, ValueError):
        found, imports = [], []
    if not found:
        return by_lines(text)
    lines, out = text.split("\n"), []
    if imports:
        loaded = "\n".join(lines[i] for i in imports)
        out.append(Piece(loaded, "imports", 0, loaded.count("\n")))
    for name, kind, a, b in found:
        body = "\n".join(lines[a : b + 1])
        if len(body) <= max_size:
            out.append(Piece(body, kind, a, b, entity_name=name, scope_chain=(name,)))
        else:
            out += [Piece(t, kind, a + i, a + i + t.count("\n"), entity_name=name, scope_chain=(name,)) for i, t in _at_boundaries(body)]
    return merged(out, max_size, lambda p: p.chunk_type)


def elements(original: str, parts: Iterable[tuple[str, str, str | None, int | None]]) -> list[Piece]:
    """Elements (text, type, parent id, title depth) to chunks with their places in the original text.

    Each is looked for after the one before it, as it is and then stripped; not found, it is put right there.
    """
    out, cursor, path = [], 0, ()
    for text, kind, parent, depth in parts:
        if not text:
            continue
        start = original.find(text, cursor)
        if start < 0 and text.strip() and (start := original.find(text.strip(), cursor)) >= 0:
            text = text.strip()
        start = max(start, cursor) if start >= 0 else cursor
        cursor = start + len(text)
        if kind == "Title":
            path = (*path[: depth or 0], text)
        out.append(Piece(
            text, "element", original.count("\n", 0, start) + 1, original.count("\n", 0, cursor) + 1, path, start_char=start, end_char=cursor,
            source_type=ELEMENT_TYPES.get(kind, "text"), metadata={"element_type": kind, "parent_id": parent or ""},
        ))
    return out


def resolved(pieces: list[Piece]) -> list[tuple[int | None, int, int]]:
    """(parent's index, 1-based order among siblings, siblings) of each chunk.

    The parent is the nearest chunk before whose heading path is a strict prefix; without one, for
    code, the nearest whose lines contain it; else there is none.
    """
    order = sorted(range(len(pieces)), key=lambda i: (pieces[i].start_line, i))
    last_path: dict[tuple[str, ...], int] = {}
    open_: list[int] = []
    parent: dict[int, int | None] = {}
    for i in order:
        p = pieces[i]
        above = [last_path[p.heading_path[:k]] for k in range(len(p.heading_path)) if p.heading_path[:k] in last_path]
        found = max(above, default=None, key=order.index) if above else None
        open_ = [j for j in open_ if pieces[j].end_line >= p.start_line]
        if found is None and not p.heading_path:
            inside = [j for j in open_ if pieces[j].start_line <= p.start_line and pieces[j].end_line >= p.end_line and pieces[j].chunk_type != "imports"]
            found = inside[-1] if inside else None
        parent[i] = found
        if p.heading_path:
            last_path[p.heading_path] = i
        open_.append(i)
    groups: dict[int | None, list[int]] = {}
    for i in order:
        groups.setdefault(parent[i], []).append(i)
    return [(parent[i], groups[parent[i]].index(i) + 1, len(groups[parent[i]])) for i in range(len(pieces))]


def chunk_id(tenant: str | None, doc_id: str | None, index: int) -> str:
    """Of a document's chunk; chunk_id_of says the same of columns."""
    return hashlib.sha256(f"{tenant or ''}\x1f{doc_id or ''}\x1f{index}".encode()).hexdigest()[:32]


def chunk_id_of(tenant: Column, doc_id: Column, index: Column) -> Column:
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (tenant, doc_id, index)]
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32)


def rows_of(doc: dict, pieces: list[Piece]) -> list[dict]:
    places = resolved(pieces)
    ids = [chunk_id(doc["tenant_id"], doc["doc_id"], i) for i in range(len(pieces))]
    return [
        {
            "chunk_id": ids[i], "doc_id": doc["doc_id"], "chunk_index": i, "text": p.text, "source_type": p.source_type or doc["source_type"], "chunk_type": p.chunk_type,
            "entity_name": p.entity_name, "heading_path": list(p.heading_path), "scope_chain": list(p.scope_chain), "parent_chunk_id": None if up is None else ids[up],
            "sibling_order": order, "sibling_count": many, "file_path": doc["source"], "start_line": p.start_line, "end_line": p.end_line,
            "start_char": p.start_char, "end_char": p.end_char, "metadata": p.metadata, "tenant_id": doc["tenant_id"],
        }
        for i, (p, (up, order, many)) in enumerate(zip(pieces, places, strict=True))
    ]


_OUT = (
    "chunk_id string, doc_id string, chunk_index int, text string, source_type string, chunk_type string, entity_name string, heading_path array<string>, "
    "scope_chain array<string>, parent_chunk_id string, sibling_order int, sibling_count int, file_path string, start_line int, end_line int, start_char int, "
    "end_char int, metadata map<string,string>, tenant_id string"
)


#: Chunkers by source type, besides the library's own: from a text, its language and the greatest size to pieces.
Chunker = Callable[[str, str | None, int], list[Piece]]
_CHUNKERS: dict[str, Chunker] = {}


def register(source_type: str, chunker: Chunker) -> None:
    """Documents of a source type go through this chunker from now on."""
    _CHUNKERS[source_type] = chunker


def chunk_documents(docs: DataFrame, max_size: int = MAX_SIZE, embed: Callable[[list[str]], list[list[float]]] | None = None, chunkers: dict[str, Chunker] | None = None) -> DataFrame:
    """Chunks of documents (doc_id, source, source_type, language, text, tenant_id) by their type; null texts have none. chunkers: for some types, in place of registered ones and the library's own."""
    own = _CHUNKERS | (chunkers or {})
    names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", _OUT).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc in batch.to_dict("records"):
                text = doc["text"] or ""
                if doc["source_type"] in own:
                    pieces = own[doc["source_type"]](text, doc["language"], max_size)
                elif doc["source_type"] == "markdown":
                    pieces = markdown(text, max_size)
                elif doc["source_type"] == "code":
                    pieces = code(text, doc["language"], max_size)
                else:
                    pieces = semantic(text, embed, max_size) if embed else paragraphs(text, max_size)
                if pieces:
                    frame = pd.DataFrame(rows_of(doc, pieces), columns=names)
                    for c in ("start_char", "end_char"):
                        frame[c] = frame[c].astype("Int32")
                    yield frame

    made = docs.select("doc_id", "source", "source_type", "language", "text", "tenant_id").mapInPandas(run, _OUT)
    return made.withColumn("created_at", F.current_timestamp())


def lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, pos (from 0), line, char_count of every line."""
    return docs.select(id_col, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("char_count", F.length("line"))


def sentences(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, sentence_id (from 0), sentence: as split_sentences does, without its case for texts of lines.

    The words of each row are cut after its end marks, in the JVM and without a shuffle; rows with one id
    are texts of their own. Null and blank texts have no sentences; blank ones count in sentence_id.
    """
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ", -1)
    ends = lambda w: F.substring(w, -1, 1).isin(".", "?", "!") & ~F.lower(F.rtrim(w, F.lit(".?!"))).isin(*ABBREVIATIONS)
    last = lambda ws: F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: ends(F.get(ws, i)))
    marked = docs.select(id_col, F.inline(F.transform(F.array(words), lambda ws: F.struct(ws.alias("ws"), last(ws).alias("m")))))
    first, after = lambda k: F.coalesce(F.get("m", k - 1) + 1, F.lit(0)), lambda k: F.coalesce(F.get("m", k) + 1, F.size("ws"))
    cut = F.transform(F.sequence(F.lit(0), F.size("m")), lambda k: F.trim(F.array_join(F.slice("ws", first(k) + 1, after(k) - first(k)), " ")))
    rows = marked.select(id_col, F.posexplode(cut).alias("sentence_id", "sentence"))
    return rows.select(id_col, F.col("sentence_id").cast("long"), "sentence").filter("sentence != ''")


def pack_lines(docs: DataFrame, max_size: int, id_col: str = "doc_id", pattern: str = "\n") -> DataFrame:
    """id, group_id, parts, chars: greedy packing of a text's parts, as ``packed`` does, by a fold within the row. Null texts have no groups."""
    closed = lambda s: F.struct(s["n"].cast("long").alias("parts"), s["size"].cast("long").alias("chars"))
    state = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.array().cast("array<struct<parts:bigint,chars:bigint>>").alias("out"))

    def step(s: Column, part: Column) -> Column:
        full = (s["n"] > 0) & (s["size"] + F.length(part) > max_size)
        return F.struct(
            F.when(full, F.length(part)).otherwise(s["size"] + F.length(part)).alias("size"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(full, F.concat(s["out"], F.array(closed(s)))).otherwise(s["out"]).alias("out"),
        )

    groups = F.aggregate(F.split("text", pattern, -1), state, step, lambda s: F.concat(s["out"], F.array(closed(s))))
    return docs.select(id_col, F.posexplode(groups).alias("group_id", "x")).select(id_col, "group_id", "x.parts", "x.chars")


def heading_parents(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, parent_index: the nearest chunk before whose heading path is a strict prefix.

    Each chunk names its prefixes, so the join is on equal (document, prefix).
    """
    joined = lambda p: F.array_join(p, "\u001f")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("heading_path") - 1), lambda k: joined(F.slice("heading_path", F.lit(1), k)))
    own = chunks.select("doc_id", "chunk_index", F.explode_outer(F.when(F.size("heading_path") > 1, prefixes)).alias("prefix"))
    up = chunks.select("doc_id", joined(F.col("heading_path")).alias("prefix"), F.col("chunk_index").alias("up")).filter(F.size("heading_path") > 0)
    met = own.join(up, ["doc_id", "prefix"], "left").groupBy("doc_id", "chunk_index").agg(F.max(F.when(F.col("up") < F.col("chunk_index"), F.col("up"))).alias("parent_index"))
    return met
