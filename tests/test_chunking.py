import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmere.operators import chunking as c


def test_markdown_paths_and_lines():
    out = c.markdown("lost\n# A\nx\n## B\n" + "y " * 80 + "\n### C\nz\n## D\nw")
    assert [p.heading_path for p in out] == [("A",), ("A", "B"), ("A", "B", "C"), ("A", "D")]
    assert out[0].text == "# A\nx" and out[0].start_line == 2


def test_markdown_without_headings_is_one_document():
    out = c.markdown("just\n\nparagraphs")
    assert len(out) == 1 and out[0].chunk_type == "document"
    assert c.markdown("") == [] and c.markdown(" \n ") == []


def test_front_matter_becomes_metadata():
    out = c.markdown("---\ntitle: Hello\n---\n# T\nbody")
    assert out[0].metadata == {"frontmatter.title": "Hello"} and out[0].start_line == 4


def test_large_section_is_cut_and_small_ones_joined():
    out = c.markdown("# H\n\n" + "\n\n".join("p" * 90 for _ in range(8)), 200)
    assert len(out) > 1 and all(p.chunk_type == "section_fragment" and p.heading_path == ("H",) for p in out)
    assert len(c.merged([c.Piece("a", "x", heading_path=("H",)), c.Piece("b", "x", heading_path=("H",))], 100, lambda p: p.heading_path)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=30), max_size=20), st.integers(1, 60))
def test_packing_keeps_all_parts_in_order(parts, size):
    runs = list(c.packed(parts, size))
    assert [p for r in runs for p in r] == parts
    assert all(len(r) == 1 or sum(map(len, r)) <= size for r in runs)


def test_paragraphs():
    text = "\n\n".join("w" * 60 for _ in range(6))
    out = c.paragraphs(text, 130)
    assert len(out) == 3 and "\n\n".join(p.text for p in out) == text
    assert c.paragraphs("  \n ") == [] and len(c.paragraphs("x" * 500, 10)) == 1


def test_sentences_keep_abbreviations():
    assert c.split_sentences("Dr. Who came. Did he? Yes!") == ["Dr. Who came.", "Did he?", "Yes!"]
    assert c.split_sentences("a\nb\nc\nd") == ["a", "b", "c", "d"]


def test_semantic_turns_and_fallback():
    embed = lambda xs: [[1.0, 0.0] if "cat" in x else [0.0, 1.0] for x in xs]
    text = " ".join(["The cat sat on the mat and purred loudly."] * 8 + ["A stock fell in the market today again."] * 8)
    out = c.semantic(text, embed)
    assert len(out) >= 2 and " ".join(p.text for p in out) == text

    def broken(_):
        raise RuntimeError

    assert c.semantic(text, broken)[0].chunk_type == "paragraph_group"
    turn = c.gaps([[1, 0]] * 3 + [[0, 1]] * 3)
    assert turn[0] == 1.0 and turn[2] < turn[1] < 1.0


def test_python_code():
    src = "import os\nfrom a import b\n\n\nclass K:\n" + "    x = 1\n" * 30 + "\n\ndef f():\n" + "    y = 2\n" * 30
    out = c.code(src, "python")
    assert [p.chunk_type for p in out] == ["imports", "class", "function"]
    assert out[1].entity_name == "K" and out[1].text.startswith("class K:")
    assert c.code("def broken(:\n  pass", "python")[0].chunk_type == "code_block"
    big = c.code("class K:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(40)), "python", 300)
    assert len(big) > 1 and all(p.entity_name == "K" and p.chunk_type == "class" for p in big)
    two = c.merged([c.Piece("a", "x"), c.Piece("b", "x", entity_name="B"), c.Piece("c", "x", entity_name="C")], 100, lambda p: p.chunk_type)
    assert [(p.text, p.entity_name) for p in two] == [("a\n\nb\n\nc", "B")]


def test_braced_code():
    js = "import x from 'y'\nfunction foo() {\n" + "  a();\n" * 30 + "}\nexport class Bar {\n" + "  b;\n" * 40 + "}\n"
    assert [(p.chunk_type, p.entity_name) for p in c.code(js, "javascript")] == [("imports", None), ("function", "foo"), ("class", "Bar")]
    assert c.code("x = 1\n" * 3, "lua")[0].chunk_type == "code_block"


def test_elements_keep_their_places():
    text = "Title\n\nSome text here.\n  padded  \nend"
    out = c.elements(text, [("Title", "Title", None, 0), ("Some text here.", "NarrativeText", None, None), ("  padded", "ListItem", "p", None), ("", "Title", None, 0)])
    assert all(text[p.start_char : p.end_char] == p.text for p in out)
    assert out[1].heading_path == ("Title",) and out[1].start_line == 3


def test_hierarchy():
    paths = c.resolved([c.Piece("", "s", 0, 1, ("A",)), c.Piece("", "s", 2, 3, ("A", "B")), c.Piece("", "s", 4, 5, ("A", "B")), c.Piece("", "s", 6, 7, ("Z",))])
    assert paths == [(None, 1, 2), (0, 1, 2), (0, 2, 2), (None, 2, 2)]
    code = c.resolved([c.Piece("", "class", 0, 10), c.Piece("", "function", 2, 5)])
    assert code == [(None, 1, 1), (0, 1, 1)]
    assert c.resolved([c.Piece("", "x")]) == [(None, 1, 1)]


def test_chunk_documents(spark):
    rows = [("d1", "a.md", "markdown", None, "# A\n" + "t " * 80 + "\n## B\nx", "t"), ("d2", "b.txt", "text", None, None, "t"), ("d3", "c.py", "code", "python", "def f():\n    pass\n", "t")]
    docs = spark.createDataFrame(rows, "doc_id string, source string, source_type string, language string, text string, tenant_id string")
    out = {(r["doc_id"], r["chunk_index"]): r for r in c.chunk_documents(docs).collect()}
    assert set(out) == {("d1", 0), ("d1", 1), ("d3", 0)}
    assert out["d1", 1]["parent_chunk_id"] == out["d1", 0]["chunk_id"] and out["d3", 0]["entity_name"] == "f"


def test_sentences_in_the_jvm_match(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Dr.", "a", "b.", "c?", "etc.", "D!"]) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in c.sentences(docs).orderBy("doc_id", "sentence_id").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    assert [got[i] for i in range(20)] == [c.split_sentences(t) for t in texts]
    twice = spark.createDataFrame([(1, "One a. Two b."), (1, "Three c. Four d."), (2, None), (3, " ")], "doc_id long, text string")
    assert sorted(r["sentence"] for r in c.sentences(twice).collect()) == ["Four d.", "One a.", "Three c.", "Two b."]


def test_packing_in_the_jvm_matches(spark):
    rng = random.Random(4)
    texts = ["\n".join("x" * rng.randrange(60) for _ in range(rng.randrange(1, 40))) for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["group_id"]): (r["parts"], r["chars"]) for r in c.pack_lines(docs, 100).collect()}
    assert got == {(i, g): (len(run), sum(map(len, run))) for i, t in enumerate(texts) for g, run in enumerate(c.packed(t.split("\n"), 100))}


def test_work_within_rows_is_not_shuffled(spark):
    from lexmere.operators import extraction

    docs = spark.createDataFrame([(1, "Cat api. Dog CatDog data structure", "text"), (1, "# Head\nCatDog", "markdown"), (2, None, "text")], "doc_id long, text string, source_type string")
    lists = extraction.entity_lists(docs)
    for df in (c.sentences(docs), c.pack_lines(docs, 10), extraction.entities(docs), extraction.cooccurrences_within(lists)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pos"], r["name"]) for r in extraction.entities(docs).collect()) == [(0, "Cat"), (0, "Head"), (1, "Dog"), (2, "CatDog"), (2, "CatDog"), (3, "Data Structure"), (4, "Api")]
    pairs = [(r["source"], r["target"]) for r in extraction.cooccurrences_within(lists, most=2).collect()]
    assert sorted(pairs) == [("Cat", "CatDog"), ("Cat", "Dog"), ("Head", "CatDog")]


def test_chunk_ids_tell_documents_of_one_source_apart(spark):
    docs = spark.createDataFrame([(f"d{i}", "same.txt", "text", None, "some words here", "t") for i in range(5)], "doc_id string, source string, source_type string, language string, text string, tenant_id string")
    ids = c.chunk_documents(docs).select("chunk_id", c.chunk_id_of(F.col("tenant_id"), F.col("doc_id"), F.col("chunk_index")).alias("again")).collect()
    assert len({r["chunk_id"] for r in ids}) == 5 and all(r["chunk_id"] == r["again"] for r in ids)
