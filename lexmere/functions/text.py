"""Text expressions: tokens, file and language detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name extension to language.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".go": "go", ".java": "java",
    ".cpp": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".lua": "lua", ".hs": "haskell", ".ex": "elixir", ".exs": "elixir", ".clj": "clojure", ".cljs": "clojure", ".sql": "sql",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".fish": "bash", ".ps1": "powershell", ".r": "r", ".m": "matlab", ".zig": "zig",
}
#: Extensions of markdown files.
MARKDOWN = (".md", ".mdx", ".rst")
#: Word in a first line that begins with #! to language; the first that is found counts.
SHEBANGS = {
    "python": "python", "node": "javascript", "deno": "javascript", "bash": "bash", "sh": "bash", "zsh": "bash", "ruby": "ruby", "perl": "perl",
    "php": "php", "lua": "lua", "go": "go", "rust": "rust",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def camel_case(text: Column) -> Column:
    """CamelCase words of more than two letters, in order, repeats included; word limits are of any script."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda w: (w >= "A") & (w < "[") & w.rlike(r"^[A-Z][a-z]+([A-Z][a-z]+)*$") & (F.length(w) > 2))  # the cheap test first


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty if the file name has none or only a leading dot."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/]*$", 0)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def _shebang(text: Column) -> Column:
    first = F.lower(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1))
    found = F.lit(None).cast("string")
    for word, language in reversed(SHEBANGS.items()):
        found = F.when(first.contains(word), F.lit(language)).otherwise(found)
    return F.when(first.startswith("#!"), found)


def language(path: Column, text: Column) -> Column:
    """By extension, then by shebang; null if neither tells."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), _shebang(text))


def file_type(path: Column, text: Column) -> Column:
    """code, markdown or text."""
    ext = extension(path)
    return F.when(ext.isin(*LANGUAGES), "code").when(ext.isin(*MARKDOWN), "markdown").when(_shebang(text).isNotNull(), "code").otherwise("text")


def raw_text_type(text: Column) -> Column:
    """Of text without a file: a leading # means markdown (#! too, as # is tested first), else text."""
    return F.when(F.coalesce(text, F.lit("")).startswith("#"), "markdown").otherwise("text")
