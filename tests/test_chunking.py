import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.operators.chunking import by_paragraph, chunks, code, fallback, lines_of, markdown, signature


def spans(found):
    return [(c.start_line, c.end_line) for c in found]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("line1\nline2\nline3\nline4\nline5", 10, 2, [(1, 2), (2, 3), (3, 4), (4, 5)]),
        ("short", 100, 10, [(1, 1)]),
        ("a\nb\nc\nd\ne", 3, 1, [(1, 2), (2, 3), (3, 4), (4, 5)]),
        ("", 10, 2, []),
        ("a very long line indeed\nb", 5, 0, [(1, 1), (2, 2)]),
        ("\n\nx\n", 10, 0, [(1, 3)]),
    ],
)
def test_golden(text, size, overlap, want):
    assert spans(fallback(text, "f.txt", size, overlap)) == want


def test_leading_empty_lines_leave_no_trace():
    assert fallback("\n\nx\n\ny", "f.txt", 10, 0)[0].content == "x\n\ny"


def test_lengths_are_bytes():
    assert spans(fallback("éé\néé", "f.txt", 7, 0)) == [(1, 1), (2, 2)]


@given(st.text(st.sampled_from("ab é\n\r"), max_size=80), st.integers(1, 12), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_every_line_is_covered_in_order(text, size, overlap):
    found = fallback(text, "f.txt", size, overlap)
    covered = {n for c in found for n in range(c.start_line, c.end_line + 1)}
    assert covered == set(range(1, len(lines_of(text)) + 1))
    assert all(c.start_line <= c.end_line for c in found)
    assert all(a.start_line < b.start_line and a.end_line <= b.end_line for a, b in zip(found, found[1:], strict=False))


def test_markdown_sections():
    text = "# A\none\n## B\ntwo\n### C\nthree"
    assert spans(markdown(text, "x.md", 50, 5)) == [(1, 2), (3, 4), (5, 6)]
    assert markdown("a\nb\nc", "x.md", 20, 2) == fallback("a\nb\nc", "x.md", 20, 2)
    assert spans(markdown("intro\n# A\nx", "x.md", 50, 5)) == [(1, 1), (2, 3)]
    assert markdown("####### no", "x.md", 50, 5) == fallback("####### no", "x.md", 50, 5)


def test_code_definitions():
    rust = "use x;\n\nfn alpha() {\n  1\n}\n\npub fn beta() {\n  2\n}\n"
    found = code(rust, "a.rs", 200, 20)
    assert len(found) == 2 and "alpha" in found[0].content and "beta" in found[1].content
    assert spans(found) == [(3, 5), (7, 9)]
    python = "import os\n\n@deco\ndef f(a):\n    return 1\n\nclass G:\n    pass\n"
    assert spans(code(python, "a.py", 200, 20)) == [(3, 5), (7, 8)]
    assert code("def (", "a.py", 20, 2) == fallback("def (", "a.py", 20, 2)
    assert code("x\ny", "a.xyz", 20, 2) == fallback("x\ny", "a.xyz", 20, 2)


def test_long_definitions_keep_their_signature():
    go = "func BigFunc() {\n" + "\n\n".join(f"\tstep{i}()" for i in range(12)) + "\n}\n"
    found = code(go, "a.go", 40, 5)
    assert len(found) > 2 and all(c.content.startswith("func BigFunc() {\n") for c in found)
    assert signature("def f(a,\n      b):\n    x = {}\n", "python") == "def f(a,\n      b):"
    assert by_paragraph("\n\n", 1, 10, 0, "s") == []


def test_chunks_on_spark(spark):
    rows = spark.createDataFrame([(1, "a.txt", "x\ny", 3), (2, "b.md", "# h\nz", 0), (3, "c.txt", None, 0), (4, "d.txt", "", 0)], "key long, path string, text string, line_offset long")
    got = {(r.key, r.chunk_index, r.start_line, r.end_line, r.content) for r in chunks(rows, 100, 0).collect()}
    assert got == {(1, 0, 4, 5, "x\ny"), (2, 0, 1, 2, "# h\nz")}


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.js", "function f() {\n  const s = `{ ${g({a: `}`})}\n  }}} `\n  return s\n}\n\n/* function no() {\n*/\nclass B {\n  // }\n  x = '}'\n}\n", [(1, 5), (9, 12)]),
        ("a.rs", "fn f<'a>(x: &'a str) -> char {\n  let s = r#\"} \"} \n }\"#;\n  /* }\n } */\n  '}'\n}\n\nstruct S;\nimpl S {\n  fn g() { \"{\\\"{\n{\"; }\n}\n", [(1, 7), (9, 9), (10, 13)]),
        ("a.go", "func f() string {\n\treturn `{{\nfunc no() {\n`\n}\n\ntype T struct { // {\n\tx rune /* { */\n}\n\nfunc g() rune { return '{' }\n", [(1, 5), (7, 9), (11, 11)]),
    ],
)
def test_braces_in_literals_and_comments(path, text, want):
    assert spans(code(text, path, 400, 20)) == want
