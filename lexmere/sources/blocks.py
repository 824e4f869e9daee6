"""Blocks of Markdown, mail and plain text with their exact places: text[start:end] is the block.

One pass over the lines. What is no block is white space, so nothing of a text is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+\S")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S")
_QUOTE = re.compile(r" {0,3}>")
_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t]*$")
#: Names of mail header lines that make a text a mail if it begins with one.
MAIL_HEADERS = ("from", "to", "cc", "subject", "date", "reply-to", "message-id")
_HEADER = re.compile(r"([A-Za-z][A-Za-z-]*):[ \t]")


class Block(NamedTuple):
    kind: str
    start: int
    end: int
    first_line: int
    last_line: int
    depth: int | None
    parent: int | None


def _lines(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def _mail_head(lines: list[tuple[int, str]]) -> int:
    """How many lines are a mail's headers: up to the first blank line, if the first is a known header."""
    m = _HEADER.match(lines[0][1])
    if not m or m[1].lower() not in MAIL_HEADERS:
        return 0
    n = 0
    while n < len(lines) and lines[n][1].strip() and (_HEADER.match(lines[n][1]) or (n and lines[n][1][0] in " \t")):
        n += 1
    return n


def blocks(text: str) -> list[Block]:
    """Title, ListItem, Table, Quote, CodeSnippet, Header, Footer (a mail's signature) and NarrativeText, in order; parent: the place of the Title above."""
    lines, out = _lines(text), []
    titles: list[tuple[int, int]] = []  # depth and place of the titles that are open
    blank = lambda i: i >= len(lines) or not lines[i][1].strip()

    def put(kind: str, a: int, b: int, depth: int | None = None) -> None:
        start = lines[a][0] + len(lines[a][1]) - len(lines[a][1].lstrip()) if kind != "CodeSnippet" else lines[a][0]
        end = lines[b][0] + len(lines[b][1].rstrip())
        if kind == "Title":
            while titles and titles[-1][0] >= depth:
                titles.pop()
        out.append(Block(kind, start, end, a, b, depth, titles[-1][1] if titles else None))
        if kind == "Title":
            titles.append((depth, len(out) - 1))

    def plain(i: int) -> bool:
        """Whether a line goes on with the paragraph before it."""
        s = lines[i][1]
        return not (blank(i) or _FENCE.match(s) or _HEADING.match(s) or _ITEM.match(s) or _QUOTE.match(s) or ("|" in s and i + 1 < len(lines) and _RULE.match(lines[i + 1][1])))

    def underlined(i: int) -> re.Match | None:
        """Whether the next line makes this one a title."""
        return _UNDERLINE.match(lines[i + 1][1]) if i + 1 < len(lines) and not (head and lines[i + 1][1].rstrip() == "--") else None

    head = _mail_head(lines)
    for i in range(head):
        if not (i and lines[i][1][0] in " \t"):
            last = i
            while last + 1 < head and lines[last + 1][1][0] in " \t":
                last += 1
            put("Header", i, last)
    at = head
    while at < len(lines):
        s = lines[at][1]
        end = at
        if blank(at):
            pass
        elif head and s.rstrip() == "--":
            end = max(i for i in range(at, len(lines)) if not blank(i))
            put("Footer", at, end)
        elif m := _FENCE.match(s):
            close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            end = next((i for i in range(at + 1, len(lines)) if close.match(lines[i][1])), len(lines) - 1)
            put("CodeSnippet", at, end)
        elif m := _HEADING.match(s):
            put("Title", at, at, len(m[1]) - 1)
        elif _QUOTE.match(s):
            while end + 1 < len(lines) and _QUOTE.match(lines[end + 1][1]):
                end += 1
            put("Quote", at, end)
        elif "|" in s and at + 1 < len(lines) and _RULE.match(lines[at + 1][1]):
            end = at + 1
            while not blank(end + 1) and "|" in lines[end + 1][1]:
                end += 1
            put("Table", at, end)
        elif _ITEM.match(s):
            while not blank(end + 1) and lines[end + 1][1][0] in " \t" and plain(end + 1):
                end += 1
            put("ListItem", at, end)
        elif m := underlined(at):
            end = at + 1
            put("Title", at, end, 0 if m[1][0] == "=" else 1)
        else:
            while end + 1 < len(lines) and plain(end + 1) and not underlined(end + 1) and not (head and lines[end + 1][1].rstrip() == "--"):
                end += 1
            put("NarrativeText", at, end)
        at = end + 1
    return out


def block_elements(docs: DataFrame) -> DataFrame:
    """doc_id, pos, element_type, text, start_char, end_char, start_line, end_line (from 0), depth, parent_pos: the blocks of each text in order; null and blank texts have none."""
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "pos", "element_type", "text", "start_char", "end_char", "start_line", "end_line", "depth", "parent_pos"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows = [(doc_id, n, b.kind, text[b.start : b.end], b.start, b.end, b.first_line, b.last_line, b.depth, b.parent) for n, b in enumerate(blocks(text or ""))]
                if rows:
                    frame = pd.DataFrame(rows, columns=names)
                    for c in ("depth", "parent_pos"):
                        frame[c] = frame[c].astype("Int32")
                    yield frame

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, pos int, element_type string, text string, start_char int, end_char int, start_line int, end_line int, depth int, parent_pos int")
