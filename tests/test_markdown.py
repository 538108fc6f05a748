import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.operators import markdown as md


def kinds(text):
    return [b["type"] for b in md.blocks_of(text)]


def only(text, *names):
    (block,) = md.blocks_of(text)
    return tuple(block[n] for n in names)


def test_tables():
    table = "| Person | Items | Work |\n| --- | --- | --- |\n| Ada | 4 | page; map |\n| Bob | 3 | audio |"
    assert only(table, "type", "headers", "rows") == ("table", ["Person", "Items", "Work"], [["Ada", "4", "page; map"], ["Bob", "3", "audio"]])
    assert kinds("Run `a | b` to pipe.") == ["paragraph"] and kinds("| a | b |\nno divider") == ["paragraph"]
    assert [(b["type"], b["headers"], b["rows"]) for b in md.blocks_of("| a |\n--\n| b |\n--\n| c |")] == [("table", ["a"], [["b"]]), ("paragraph", None, None)]
    assert kinds("before\n| a |\n|--|\nafter") == ["paragraph", "table", "paragraph"]


def test_other_blocks():
    assert only("## Who works", "type", "level", "text") == ("heading", 2, "Who works") and kinds("#### four") == ["paragraph"]
    assert only("- one\n* two\n+ three", "type", "ordered", "items") == ("list", False, ["one", "two", "three"])
    assert only("1. first\n2) second", "type", "ordered", "items") == ("list", True, ["first", "second"])
    assert kinds("- a\n1. b\n- c") == ["list"] * 3
    assert kinds("---\n***\n___\n--") == ["rule", "rule", "rule", "paragraph"]
    assert only("> a\n>b\n>", "type", "text") == ("quote", "a\nb")
    assert kinds("One.\n\nTwo.\nstill two") == ["paragraph", "paragraph"] and kinds("") == kinds(None) == kinds(" \n\t\n") == []


def test_fences():
    text = "Here:\n\n```python\n# no heading\n- no list\n```\n\nAfter."
    assert kinds(text) == ["paragraph", "code", "paragraph"] and "# no heading" in md.blocks_of(text)[1]["code"]
    head = "**`lib/rag.ts:84`** — [open on GitHub](https://a.io/x#L84)\n\n```typescript\nconst x = 1;\n```"
    assert only(head, "type", "path", "line", "url", "language", "code") == ("code", "lib/rag.ts", 84, "https://a.io/x#L84", "typescript", "const x = 1;\n")
    assert only("**`a.py`** x\n```\ny```", "path", "line", "url", "language") == ("a.py", None, None, "text")
    assert kinds("```py\nnever closed") == ["paragraph"]


def test_spans():
    found = [(s["type"], s["text"], s["href"]) for s in md.spans_of("**Bold** and *soft* and `code` and [x](https://a.io) and @brain, __b__ _i_")]
    assert [f for f in found if f[0] != "text"] == [
        ("bold", "Bold", None), ("italic", "soft", None), ("code", "code", None), ("link", "x", "https://a.io"), ("mention", "@brain", None), ("bold", "b", None), ("italic", "i", None),
    ]
    assert [s["type"] for s in md.spans_of("Pass `**kwargs` through.")] == ["text", "code", "text"]
    assert [s["type"] for s in md.spans_of("Write to ada@example.com today")] == ["text"] and md.spans_of(None) == []
    assert [s["type"] for s in md.spans_of("@ada hi")] == ["mention", "text"]


LINES = st.sampled_from(["", "# h", "- a", "1. b", "> q", "---", "| a | b |", "|--|--|", "--", "plain *x*", "  - c", "```", "```py", "text | with | pipes", "a\tb"])


@settings(max_examples=300, deadline=None)
@given(st.lists(LINES, max_size=14))
def test_blocks_hold_all_text(lines):
    """Every letter of a text is in some block, in order, and nothing else is."""
    text = "\n".join(lines)
    shown = []
    for b in md.blocks_of(text):
        shown += [b["text"] or "", *(b["items"] or []), *(b["headers"] or []), *(c for r in b["rows"] or [] for c in r), (b["language"] if b["language"] != "text" else "") if b["type"] == "code" else "", b["code"] or ""]
    letters = lambda t: re.sub(r"[^a-z]", "", t)
    assert letters("".join(shown)) == letters(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab *_`[]()@\n", max_size=30))
def test_spans_hold_all_text(text):
    marks = {"text": ("", ""), "code": ("`", "`"), "italic": ("", ""), "bold": ("", ""), "mention": ("", ""), "link": ("[", "]")}
    shown = "".join(marks[s["type"]][0] + s["text"] + marks[s["type"]][1] + (f"({s['href']})" if s["href"] else "") for s in md.spans_of(text))
    strip = lambda t: re.sub(r"[*_]", "", t)
    assert strip(shown) == strip(text)


def test_blocks_of_tables(spark):
    rows = [(1, "# a\n\n- x\n- y"), (2, None), (3, ""), (4, "para " * 50_000), (1, "# a\n\n- x\n- y")]
    found = md.block_rows(spark.createDataFrame(rows, "id int, text string"), "id").collect()
    assert sorted((r.id, r.place, r.type) for r in found) == [(1, 0, "heading"), (1, 0, "heading"), (1, 1, "list"), (1, 1, "list"), (4, 0, "paragraph")]
    line = spark.createDataFrame([("a **b** `c`",), (None,)], "t string").select(md.plain(md.spans(F.col("t"))).alias("p")).collect()
    assert [r.p for r in line] == ["a b c", ""]
