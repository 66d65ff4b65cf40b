"""Cutting text into chunks of whole lines that overlap, by bytes."""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import chunker_of

SIZE, OVERLAP, SIGNATURE = 512, 50, 200
_HEADING = re.compile(r"\s*#{1,6} ")


@dataclass(frozen=True)
class Chunk:
    start_line: int
    end_line: int
    content: str


def _bytes(text: str) -> int:
    return len(text.encode())


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a final end makes no empty line."""
    parts = text.split("\n")
    tail = parts.pop()
    return [p.removesuffix("\r") for p in parts] + ([tail] if tail else [])


def _next_start(sizes: list[int], i: int, j: int, overlap: int) -> int:
    """Where the window after [i, j) begins: the fewest last items that cover `overlap`, or j if that is all."""
    if not overlap or j >= len(sizes):
        return j
    covered = itertools.accumulate(sizes[k] + 1 for k in range(j - 1, i - 1, -1))
    steps = next((s for s, c in enumerate(covered, 1) if c >= overlap), j - i)
    return j - steps if steps < j - i else j


def pack_lines(lines: list[str], size: int, overlap: int, first: int = 1) -> list[Chunk]:
    """Greedy chunks: a line joins while what is there and the line together have at most `size` bytes.

    A line that is too long is a chunk by itself. Empty lines that open a chunk count as lines and leave
    no trace in its content.
    """
    sizes = [_bytes(x) for x in lines]

    out, i = [], 0
    while i < len(sizes):
        held, j = sizes[i], i + 1
        while j < len(sizes) and held + sizes[j] <= size:
            held += sizes[j] + (held > 0)
            j += 1
        out.append(Chunk(first + i, first + j - 1, "\n".join(itertools.dropwhile(lambda x: not x, lines[i:j]))))
        i = _next_start(sizes, i, j, overlap)
    return out


def fallback(text: str, path: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    return pack_lines(lines_of(text), size, overlap)


def markdown(text: str, path: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks that never cross a heading; what stands before the first heading is a section too, and an
    empty line that ends a section is left out."""
    lines = lines_of(text)
    headings = [k for k, x in enumerate(lines) if _HEADING.match(x)]
    if not headings:
        return pack_lines(lines, size, overlap)
    starts = sorted({0, *headings})
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        out += pack_lines(lines[a : b - (not lines[b - 1])], size, overlap, a + 1)
    return out


#: What opens a definition in languages read by braces.
_OPENS = {
    "rust": r"\s*(pub(\([^)]*\))?\s+)?((async|unsafe|const|extern(\s+\"[^\"]*\")?)\s+)*(fn|struct|enum|impl|trait|mod)\b",
    "javascript": r"\s*(export\s+)?(default\s+)?((async\s+)?function\b|class\b|interface\b|(const|let|var)\s+\w+\s*=\s*(async\s*)?(\([^)]*\)|\w+)\s*=>)",
    "go": r"\s*(func|type)\b",
}
#: Comments, and literals that may hold braces, by language; Rust's lifetimes are no literals.
_APART = {
    "rust": r"//[^\n]*|/\*.*?\*/|\bb?r(?P<hash>#*)\".*?\"(?P=hash)|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]{1,10}?|[^\\'\n])'",
    "javascript": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}`]|`[^`]*`)*\})*\}|[^`\\])*`",
    "go": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\[^\n]{1,10}?|[^\\'\n])'",
}
_LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "go": "go"}


def _python_spans(text: str) -> list[tuple[int, int]]:
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    nodes = [x for x in ast.parse(text).body if isinstance(x, kinds)]
    return [(min([x.lineno, *(d.lineno for d in x.decorator_list)]) - 1, x.end_lineno) for x in nodes]


def _bare(text: str, language: str) -> str:
    """The text with blanks in place of comments and literals; lines stay where they are."""
    return re.sub(_APART[language], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _brace_spans(text: str, language: str) -> list[tuple[int, int]]:
    """Outermost definitions: from a line that opens one to where its braces are closed again.

    Braces in comments and literals don't count, over several lines either. It stands in for a syntax tree: nested
    block comments, literals of regular expressions and templates deep inside templates can mislead it.
    """
    lines, opens = lines_of(_bare(text, language)), _OPENS[language]
    out, k = [], 0
    while k < len(lines):
        if not re.match(opens, lines[k]):
            k += 1
            continue
        depth, seen, end = 0, False, k
        for end in range(k, len(lines)):
            depth += lines[end].count("{") - lines[end].count("}")
            seen |= "{" in lines[end]
            if (seen and depth <= 0) or (not seen and lines[end].rstrip().endswith(";")):
                break
        out.append((k, end + 1))
        k = end + 1
    return out


def signature(content: str, language: str) -> str:
    """The lines up to the one that opens the body, at most 200 bytes."""
    opener = re.compile(r":\s*(#.*)?$") if language == "python" else re.compile(r"\{")
    lines = lines_of(content)
    at = next((k for k, x in enumerate(lines) if opener.search(x)), len(lines) - 1)
    return "\n".join(lines[: at + 1]).rstrip().encode()[:SIGNATURE].decode("utf-8", "ignore")


def by_paragraph(content: str, first: int, size: int, overlap: int, head: str) -> list[Chunk]:
    """A long definition by its paragraphs, every chunk under the definition's signature."""
    lines = lines_of(content)
    blank = [not x.strip() for x in lines]
    edges = [k for k in range(len(lines)) if not blank[k] and (k == 0 or blank[k - 1])]
    ends = [k + 1 for k in range(len(lines)) if not blank[k] and (k + 1 == len(lines) or blank[k + 1])]
    paragraphs = list(zip(edges, ends, strict=True))
    room = max(0, size - _bytes(head) - 1)
    texts = ["\n".join(lines[a:b]) for a, b in paragraphs]
    sizes = [_bytes(t) for t in texts]

    out, i = [], 0
    while i < len(sizes):
        a, b = paragraphs[i]
        if sizes[i] > room:
            out += pack_lines(lines[a:b], size, overlap, first + a)
            i += 1
            continue
        held, j = sizes[i], i + 1
        while j < len(sizes) and held + sizes[j] + 1 <= room:
            held += sizes[j] + 1
            j += 1
        out.append(Chunk(first + a, first + paragraphs[j - 1][1] - 1, "\n".join(texts[i:j])))
        i = _next_start(sizes, i, j, overlap)
    return [replace(c, content=f"{head}\n{c.content}") for c in out]


def code(text: str, path: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """One chunk for each outermost definition, long ones by paragraph; without definitions, by lines."""
    language = _LANGUAGES.get(path.rpartition(".")[2])
    lines = lines_of(text)
    try:
        spans = _python_spans(text) if language == "python" else _brace_spans(text, language) if language else []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        spans = []
    if not spans:
        return fallback(text, path, size, overlap)
    out = []
    for a, b in spans:
        content = "\n".join(lines[a:b])
        out += by_paragraph(content, a + 1, size, overlap, signature(content, language)) if _bytes(content) > size else [Chunk(a + 1, b, content)]
    return out


CHUNKERS: dict[str, Callable[..., list[Chunk]]] = {"fallback": fallback, "markdown": markdown, "code": code}
SCHEMA = "chunk_index int, start_line int, end_line int, content string"


def chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, chunkers: dict[str, Callable[..., list[Chunk]]] | None = None, errors: bool = False) -> DataFrame:
    """Rows (key, path, chunk_index, start_line, end_line, content) of files (key long, path, text).

    The chunker is the one `chunker_of(path)` names, in `chunkers` or else here. Lines count from
    1, plus the file's line_offset if it has that column. Null and empty texts have no chunks. With errors there is a
    column error, and a file whose chunker fails has one row that says why; otherwise the job fails.
    """
    given = {**CHUNKERS, **(chunkers or {})}
    shift = F.col("line_offset").cast("int") if "line_offset" in files.columns else F.lit(0)
    rows = files.select(F.col("key").cast("long"), "path", "text", shift.alias("shift"), chunker_of(F.col("path")).alias("chunker"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "path", "chunk_index", "start_line", "end_line", "content", "error"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for key, path, text, moved, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    cut = given[kind](text, path or "", size, overlap) if text else []
                    out += [(key, path, k, c.start_line + moved, c.end_line + moved, c.content, None) for k, c in enumerate(cut)]
                except Exception as error:
                    if not errors:
                        raise
                    out.append((key, path, None, None, None, None, f"chunking: {error!r}"))
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    cut = rows.mapInArrow(run, f"key long, path string, {SCHEMA}, error string")
    return cut if errors else cut.drop("error")
