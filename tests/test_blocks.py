"""Blocks and their places."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmere.sources.blocks import block_elements, blocks

TEXT = """# One

A paragraph
of two lines.
- first
  goes on
2) second
> quoted
> more

Under
-----
| a | b |
|---|---|
| 1 | 2 |
```py
# not a title

```
## Deep
end
"""


def test_kinds_and_places():
    got = [(b.kind, TEXT[b.start : b.end], b.depth, b.parent) for b in blocks(TEXT)]
    assert got == [
        ("Title", "# One", 0, None), ("NarrativeText", "A paragraph\nof two lines.", None, 0), ("ListItem", "- first\n  goes on", None, 0), ("ListItem", "2) second", None, 0), ("Quote", "> quoted\n> more", None, 0),
        ("Title", "Under\n-----", 1, 0), ("Table", "| a | b |\n|---|---|\n| 1 | 2 |", None, 5), ("CodeSnippet", "```py\n# not a title\n\n```", None, 5), ("Title", "## Deep", 1, 0), ("NarrativeText", "end", None, 8),
    ]


def test_mail():
    mail = "From: a@b\nSubject: long\n  goes on\nX-Own: y\n\nHello.\n\n> as you said\n\nBye\n-- \nname\nplace"
    assert [(b.kind, mail[b.start : b.end]) for b in blocks(mail)] == [
        ("Header", "From: a@b"), ("Header", "Subject: long\n  goes on"), ("Header", "X-Own: y"), ("NarrativeText", "Hello."), ("Quote", "> as you said"), ("NarrativeText", "Bye"), ("Footer", "-- \nname\nplace")]
    assert [b.kind for b in blocks("Note: no mail\nat all")] == ["NarrativeText"] and blocks(" \n\t\n") == []


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab#-=>|`~:1.) \n\té"), max_size=60))
def test_nothing_but_white_space_is_left_out(text):
    got = blocks(text)
    at = 0
    for b in got:
        assert not text[at : b.start].strip() and at <= b.start < b.end and text[b.start : b.end].strip()
        assert text.count("\n", 0, b.start) >= b.first_line and b.parent is None or got[b.parent].kind == "Title"
        at = b.end
    assert not text[at:].strip()


def test_rows(spark):
    rows = block_elements(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1} and all(TEXT[r["start_char"] : r["end_char"]] == r["text"] for r in rows) and len(rows) == 10
