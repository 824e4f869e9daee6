"""Quality rules, line first: lines that fail go, then documents that lost too much text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm.shared import SPACE, WORD, words

SYMBOLS = r"[#*$%&|<>]"
#: A line's last sign, white space and closing quotes and brackets aside.
ENDS = (".", "?", "!", ":", ";", ",", "…", "。", "！", "？")
BLANKS, CLOSERS = " \t\n\x0b\x0c\r", "\"'”»)]"
#: Marks after a word that prose does not use.
MARKED = r"[#*$%&<>]{2,}|[!?]{2,}"
#: Whole lines of menus, other signs after them aside.
MENUS = (
    "home", "menu", "login", "log in", "sign up", "next", "previous", "back to top", "contact us", "about us",
    "startseite", "anmelden", "impressum", "weiter", "accueil", "connexion", "suivant", "inicio", "iniciar sesión", "siguiente",
)
#: Phrases of lines that are no prose of their own.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "enable javascript", "lorem ipsum", "subscribe to our", "click here", "©",
    "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "politique de confidentialité", "todos los derechos reservados", "política de privacidad",
)
#: A document goes if less than this share of its words' characters is left.
LEAST_LEFT = 0.5
#: A line's share of marked words from which it fails.
MOST_MARKED = 0.4


def good_line(line: Column, low: Column) -> Column:
    """Whether a line stays; low is the line in lower case. Tests for plain parts come before patterns, which few lines need."""
    n = F.regexp_count(line, F.lit(WORD))
    ended = F.substring(F.rtrim(F.rtrim(line, F.lit(BLANKS)), F.lit(CLOSERS)), -1, 1).isin(*ENDS) | (n >= 12)
    twins = reduce(lambda a, b: a | b, (line.contains(x) for x in "#*$%&<>!?"))
    marked = twins & (F.regexp_count(line, F.lit(MARKED)) >= F.lit(MOST_MARKED) * n)
    bars = line.contains("|") & line.rlike(r"(\|[^|]*){3,}") | line.contains("»") & line.rlike("(»[^»]*){2,}") | line.contains(" > ") & line.rlike("( > [^>]*){2,}")
    menu = reduce(lambda a, b: a | b, (low.startswith(x) for x in MENUS)) & low.rlike(rf"^({'|'.join(MENUS)})\W*$")
    boiler = reduce(lambda a, b: a | b, (low.contains(x) for x in BOILERPLATE))
    return (n > 0) & ended & ~marked & ~bars & ~menu & ~boiler


def _repeats(hashes: Column, size: int) -> Column:
    """Words inside windows found twice or more: sorts (hash, position), keeps those next to an equal one."""
    inside = lambda pos: F.aggregate(
        pos, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, p: F.struct((p + size).alias("end"), (s["n"] + F.least(F.lit(size), p + size - s["end"])).alias("n")),
        lambda s: s["n"],
    )
    twice = lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    found = F.transform(F.array(pairs), twice)  # the outer transform binds the sorted array once
    return F.transform(found, lambda f: inside(F.array_sort(F.transform(f, lambda x: x["p"]))))[0]


def measure(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_good_lines, clean_text.

    clean_text is the text without its failed lines. Null and empty texts: all counts 0,
    base_failed, not kept. One row per input row; repeated rows get equal results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.select("doc_id", "t", words(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("l"), F.split(F.lower("t"), "\n", -1).alias("low"))
    rows = rows.select("doc_id", "t", "l", "low", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    at = lambda i, j: F.get(F.col("wh"), i + j)
    windows = F.when(F.col("n") > window, F.transform(F.sequence(F.lit(0), F.col("n") - window), lambda i: F.xxhash64(*[at(i, j) for j in range(window)])))
    rows = rows.select("doc_id", "t", "l", "low", "n", windows.alias("h"))
    rows = rows.select(
        "doc_id", "t", "n", "h", F.size("l").alias("n_lines"),
        F.filter("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("worded"), F.filter("l", lambda x, i: good_line(x, F.get("low", i))).alias("good"),
    )
    repeats = F.when(F.col("h").isNull(), F.lit(0)).when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_repeats(F.col("h"), window))
    rows = rows.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.col("n_lines").cast("long"), F.size("good").cast("long").alias("n_good_lines"), F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.length("clean_text") - F.regexp_count("clean_text", F.lit(SPACE))
    kept = ~failed & (left >= F.lit(LEAST_LEFT) * F.col("word_chars"))
    named = lambda *names: [F.col(n) for n in names]
    out = F.struct(*named("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"), *named("n_lines", "n_good_lines", "clean_text"))
    return rows.select("doc_id", F.inline(F.array(out)))  # a filter on a generator's columns is not worked into what they are made of
