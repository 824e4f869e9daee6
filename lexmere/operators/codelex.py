"""Where code is code: strings, characters, templates, regular expressions and comments of five brace languages blanked out.

One pass over the text: an opening sign says which rule finds the end. What is blanked keeps its length and its
line ends, so places in the result are places in the text.
"""

from __future__ import annotations

import re

_LINE = re.compile(r"[^\n]*")
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}?", re.S) for q in "\"'"}
_LONG_QUOTED = re.compile(r'"(?:\\.|[^"\\])*"?', re.S)
_TEXT_BLOCK = re.compile(r'"""(?:\\.|[^\\])*?(?:"""|\Z)', re.S)
_RUST_CHAR = re.compile(r"b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}\n]*\}|.)|[^\\'\n])'")
_RUST_RAW = re.compile(r'\b(?:b|c)?r(#*)"')
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Before a slash that begins a regular expression and is no division.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield))\s*\Z")
_OPENERS = {
    "javascript": re.compile(r"""//|/\*|["'`/]"""), "typescript": re.compile(r"""//|/\*|["'`/]"""), "java": re.compile(r"""//|/\*|["']"""),
    "go": re.compile(r"""//|/\*|["'`]"""), "rust": re.compile(r"""//|/\*|\b[bc]?r#*"|["']"""),
}
LANGUAGES = tuple(_OPENERS)


def _nested_comment(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """The end of a template literal, templates and braces inside its ${...} included. open_: depths of the braces of each ${ that is open."""
    open_: list[int | None] = [None]  # None: in a template; a number: in code
    at += 1
    signs, code = re.compile(r"\\.|`|\$\{", re.S), re.compile(r"""//|/\*|["'`{}]""")
    while open_:
        m = (signs if open_[-1] is None else code).search(text, at)
        if m is None:
            return len(text)
        sign, at = m[0], m.end()
        if open_[-1] is None:
            if sign == "`":
                open_.pop()
            elif sign == "${":
                open_.append(0)
        elif sign == "`":
            open_.append(None)
        elif sign == "{":
            open_[-1] += 1
        elif sign == "}":
            if open_[-1] == 0:
                open_.pop()
            else:
                open_[-1] -= 1
        else:
            at = _end(text, m.start(), sign, "javascript")
    return at


def _end(text: str, at: int, sign: str, language: str) -> int:
    """The end of what ``sign`` opens at a place; the place itself where it opens nothing."""
    if sign == "//":
        return _LINE.match(text, at).end()
    if sign == "/*":
        if language == "rust":
            return _nested_comment(text, at)
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    if sign == '"':
        if language == "java" and text.startswith('"""', at):
            return _TEXT_BLOCK.match(text, at).end()
        return (_LONG_QUOTED if language == "rust" else _QUOTED['"']).match(text, at).end()
    if sign == "'":
        if language == "rust":  # else it is a lifetime
            m = _RUST_CHAR.match(text, at)
            return m.end() if m else at
        return _QUOTED["'"].match(text, at).end()
    if sign == "`":
        if language == "go":
            end = text.find("`", at + 1)
            return len(text) if end < 0 else end + 1
        return _template_end(text, at)
    if sign == "/":
        m = _REGEX.match(text, at) if _BEFORE_REGEX.search(text, max(0, at - 40), at) else None
        return m.end() if m else at
    hashes = _RUST_RAW.match(text, at)[1]
    end = text.find('"' + hashes, at + len(sign))
    return len(text) if end < 0 else end + 1 + len(hashes)


def code_only(text: str, language: str) -> str:
    """The text with spaces in place of the characters of literals and comments; line ends stay."""
    out, done, at = [], 0, 0
    openers = _OPENERS[language]
    while m := openers.search(text, at):
        at = _end(text, m.start(), m[0], language)
        if at == m.start():
            at += len(m[0])
            continue
        out += [text[done : m.start()], re.sub(r"[^\n]", " ", text[m.start() : at])]
        done = at
    return "".join([*out, text[done:]])
