"""The structural chunker on Markdown pages."""

import pytest

from sluice.operators import segment

PAGE = """Preface of the page.

# Guide

## Install

Run the installer.

```sh
# not a heading

make
```

## Use

Short.

### Details

Some more words here.

# Appendix

Tables follow."""


@pytest.fixture(scope="module")
def chunks(spark):
    def run(text, low=40, high=120, doc_type=None, **options):
        df = spark.createDataFrame([(1, "doc.md", text, doc_type)], "doc_id int, source string, text string, doc_type string")
        return [(r.chunk_id, r.title, r.content) for r in segment.chunk_sections(df, low, high, doc_type="doc_type", **options).orderBy("chunk_no").collect()]

    return run


def test_chunks_follow_topics_and_keep_the_text(chunks):
    got = chunks(PAGE)
    assert "\n\n".join(c for _, _, c in got) == PAGE
    assert [(i, t) for i, t, _ in got] == [
        ("P1-C001", "【doc.md】- Preface of t"), ("P1-C002", "【Guide】- Install"), ("P1-C003", "【Guide】- Install"), ("P1-C004", "【Use】- Details"), ("P1-C005", "【doc.md】- Appendix"),
    ]
    assert got[1][2] == "# Guide\n\n## Install\n\nRun the installer."
    assert got[2][2] == "```sh\n# not a heading\n\nmake\n```\n\n## Use\n\nShort."  # code stays whole, and a short topic joins its neighbour
    assert not any(c.rstrip().split("\n")[-1].startswith("#") for _, _, c in got)  # no heading is left without its text


def test_a_paragraph_is_never_broken_and_sizes_hold(chunks):
    paragraphs = [f"{k} " + "x" * (k * 13 % 90) for k in range(60)]
    text = "\n\n".join(("## part\n\n" + p) if k % 7 == 3 else p for k, p in enumerate(paragraphs))
    got = [c for _, _, c in chunks(text)]
    assert "\n\n".join(got) == text and all(p in c for p in paragraphs for c in got if p.split(" ")[0] == c.split(" ")[0])
    assert all(len(c) <= 120 or c.count("\n\n") <= 1 for c in got)


def test_question_lists_have_a_chunk_for_each_pair(chunks):
    text = "常见问题\n\nQ1: How?\nA: Like this.\n\nMore of it.\n\n问：为什么？\n答：因为。\n\n## May I?\n\nYes.\n\n**Q: Last one**\nA: end"
    got = chunks(text, doc_type="FAQ")
    assert [c for _, _, c in got] == ["常见问题", "Q1: How?\nA: Like this.\n\nMore of it.", "问：为什么？\n答：因为。", "## May I?\n\nYes.", "**Q: Last one**\nA: end"]
    assert [t for _, t, _ in got][1:] == ["【doc.md】- Q1: How?", "【doc.md】- 问：为什么？", "【doc.md】- May I?", "【doc.md】- Q: Last one"]
    assert len(chunks(text, doc_type="制度合规", high=800)) < 5


def test_headings_in_force_and_edges(chunks):
    deep = "# A\n\n## B\n\n### C\n\n" + "c" * 50 + "\n\n" + "d" * 50 + "\n\n## E ##\n\n" + "e" * 50
    assert [t for _, t, _ in chunks(deep)] == ["【B】- C", "【B】- C", "【A】- E"]
    assert chunks(None) == [] and chunks("") == [] and chunks("\n\n") == []
    assert chunks("one line") == [("P1-C001", "【doc.md】- one line", "one line")]
    assert chunks("# only a heading") == [("P1-C001", "【doc.md】- only a heading", "# only a heading")]
    assert [c for _, _, c in chunks("a\nb\n# h\nc", low=1, sep="\n")] == ["a", "b", "# h\nc"]
