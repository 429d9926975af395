import io
import zipfile

import pytest

from conceptmill.operators import text as X

NOTE = "intro line\n\n# Top\n\n## One\nalpha\n```\n# not a heading\n```\n### Deep ##\nbeta\n## Two\ngamma\n"


def test_markdown_sections():
    got = [(s.title, s.breadcrumb, s.level) for s in X.markdown_sections(NOTE)]
    assert got == [("", "", 0), ("One", "Top > One", 2), ("Deep", "Top > One > Deep", 3), ("Two", "Top > Two", 2)]
    assert "# not a heading" in X.markdown_sections(NOTE)[1].text
    assert X.markdown_sections("") == [] and X.markdown_sections(None) == []


def test_docx_and_dispatch():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = f'<w:document {w}><w:body>{p("Heading1", "A")}{p("Normal", "one")}{p("h2", "B")}{p("Normal", "two")}</w:body></w:document>'
    styles = f'<w:styles {w}><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style></w:styles>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", styles)
    assert [(s.breadcrumb, s.level, s.text) for s in X.note_sections("x.DOCX", data.getvalue())] == [("A", 1, "one"), ("A > B", 2, "two")]
    assert X.note_sections("x.md", b"# H\nt\xff")[0].title == "H"
    with pytest.raises(ValueError):
        X.note_sections("x.pdf", b"")


def test_chunks():
    assert X.chunk_text("a" * 450, 200) == ["a" * 200, "a" * 200, "a" * 50]
    assert X.chunk_text("one\n\ntwo\n\n" + "b" * 199, 200) == ["one\n\ntwo", "b" * 199]
    assert X.chunk_text("a" * 250 + "\n\nend", 10) == ["a" * 200, "a" * 50 + "\n\nend"]
    assert X.chunk_text("") == []
    long = X.chunk_sections([X.Section("T", "A > T", 2, "x" * 300 + "\n\n" + "y" * 50)], 100)
    assert [c.split("\n")[0] for c in long] == ["【笔记位置：A > T】"] * 2
    assert X.chunk_sections([X.Section("T", "A", 1, "short")])[0].endswith("\nshort")


def test_distributed_chunks(spark):
    df = spark.createDataFrame([(1, NOTE), (2, ""), (3, None)], "k int, t string")
    assert X.sections(df, "k", "t").filter("k = 1").count() == 4
    assert [(r.k, r.chunk_id) for r in X.chunks(df, "k", "t").collect()] == [(1, "chunk-0001")]


def test_tolerant_json():
    assert X.parse_object('{"a": 1}') == {"a": 1}
    assert X.parse_object('```json\n{"a": [1]}\n```') == {"a": [1]}
    assert X.parse_object('well: {"a": "x } y"} done') == {"a": "x } y"}
    assert X.parse_object('{bad} then {"a": {}}') == {"a": {}}
    for bad in ("", "none", "[1, 2]", None):
        with pytest.raises(ValueError):
            X.parse_object(bad)
