"""Reading registered files as text, with rejects kept apart."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

#: Extensions read as code, and which chunker each kind of file takes.
CODE_TEXT = ["c", "cpp", "fish", "go", "h", "hpp", "java", "js", "json", "py", "rs", "sh", "toml", "ts", "yaml", "yml", "zsh"]
CODE_CHUNKED = ["c", "cpp", "go", "h", "hpp", "java", "js", "py", "rs", "ts"]
#: Extensions read as they are, which have a chunker and no reader otherwise.
PLAIN_TEXT = ["jsx", "tsx", "txt"]


def strip_frontmatter(text: Column) -> Column:
    """Text after a YAML block that opens it, without leading white space; else the text itself.

    A block opens with `---` as the first line and ends with the next line `---`; both lines may end in
    CR LF. A block that is never closed stays. Null stays null.
    """
    unix, dos = F.locate("\n---\n", text, 4), F.locate("\r\n---\r\n", text, 5)
    rest = lambda at, n: F.regexp_replace(F.substring(text, at + n, F.length(text)), r"(?U)^\s+", "")
    return F.when(F.startswith(text, F.lit("---\n")) & (unix > 0), rest(unix, 5)).when(F.startswith(text, F.lit("---\r\n")) & (dos > 0), rest(dos, 7)).otherwise(text)


def line_offset(text: Column, stripped: Column) -> Column:
    """How many lines strip_frontmatter took, so that chunks can name the file's own lines."""
    taken = F.substring(text, F.lit(1), F.length(text) - F.length(stripped))
    return F.length(taken) - F.length(F.replace(taken, F.lit("\n"), F.lit("")))


def reader_of(path: Column) -> Column:
    ext = F.lower(extension(path))
    return F.when(ext == "md", "markdown").when(ext == "pdf", "pdf").when(ext.isin(CODE_TEXT + PLAIN_TEXT), "text")


def chunker_of(path: Column) -> Column:
    ext = F.lower(extension(path))
    return F.when(ext == "md", "markdown").when(ext.isin(CODE_CHUNKED), "code").otherwise("fallback")


def language_of(path: Column) -> Column:
    """The definitions' language; the extension's case counts."""
    ext = extension(path)
    return F.when(ext == "rs", "rust").when(ext == "py", "python").when(ext.isin("js", "ts", "jsx", "tsx"), "javascript").when(ext == "go", "go")


#: Reasons of paths that are no files of their own (any more); what is stored of them goes. Other rejects keep what they had.
GONE = ["missing", "link"]
READ_BYTES = 8 << 20


def _opened(path: str):
    """The file system and the path in it. A path without a scheme, or of `file:`, is one of this machine or of a shared mount."""
    from pyarrow import fs

    if path.startswith("file:") or ":/" not in path:
        return None, "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _status(given: str) -> tuple[str, int | None, str | None]:
    """Where a path leads when its links are followed, when that was changed (unix seconds), and why it isn't a file."""
    if not given.startswith("/") and ":/" not in given:
        return given, None, "not absolute"
    try:
        system, inner = _opened(given)
        if system is None:
            real = os.path.realpath(inner, strict=True)
            found = os.stat(real)
            return f"file:{real}", int(found.st_mtime), None if stat.S_ISREG(found.st_mode) else "missing"
        found = system.get_file_info(inner)
        return given, int(found.mtime.timestamp()) if found.mtime else 0, None if found.is_file else "missing"
    except (FileNotFoundError, NotADirectoryError):
        return f"file:{inner}" if system is None else given, None, "missing"
    except Exception as error:
        return given, None, f"unreadable: {error!r}"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = [p for p in batch.column("path").to_pylist() if p is not None]
        rows = [(*_status(p), _qualified(p)) for p in given]
        path, changed, reason, qualified = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(qualified, pa.string()), pa.array(path, pa.string()), pa.array(changed, pa.int64()), pa.array(reason, pa.string())], ["given", "path", "last_modified", "reason"])


def _qualified(path: str) -> str:
    return f"file:{_opened(path)[1]}" if path.startswith(("/", "file:")) else path


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opens files one after the other and passes on at most READ_BYTES at once, or one text."""
    names, types = ["path", "last_modified", "text", "reason"], [pa.string(), pa.int64(), pa.string(), pa.string()]
    rows: list[tuple] = []

    def written() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows.clear()
        return out

    size = 0
    for batch in batches:
        for path, changed in zip(batch.column("path").to_pylist(), batch.column("last_modified").to_pylist(), strict=True):
            text, reason = None, None
            try:
                system, inner = _opened(path)
                with open(inner, "rb") if system is None else system.open_input_stream(inner) as file:
                    raw = file.read()
                text = raw.decode()
                size += len(raw)
            except UnicodeDecodeError:
                reason = "not UTF-8"
            except FileNotFoundError:
                reason = "missing"
            except Exception as error:
                reason = f"unreadable: {error!r}"
            rows.append((path, changed, text, reason))
            if size >= READ_BYTES:
                yield written()
                size = 0
    if rows:
        yield written()


def read_paths(paths: DataFrame) -> DataFrame:
    """What registered paths (path) hold: (path, file_type, last_modified, text, line_offset, reason), a row for each file and each reject.

    Tasks follow links, look at what is there and, dealt anew by the path that a link leads to, open each file once: nothing about a
    single path happens on the driver. reason is null for a file that could be read as text. Otherwise it says "missing" (nothing there, or no
    regular file), "link" (what the link leads to is read in its place), "not absolute", "unsupported: <extension>" (PDF too: there is no
    library for it here), "not UTF-8" or "unreadable: <error>". Folders aren't searched. A null path is left out. Tasks reach local
    paths only where all machines share them; other file systems are those of `pyarrow.fs`.
    """
    found = paths.select("path").mapInArrow(_resolve, "given string, path string, last_modified long, reason string")
    linked = found.where("reason is null and given <> path").select(F.col("given").alias("path"), F.lit("link").alias("reason"))
    kinds = reader_of(F.col("path"))
    supported = found.withColumn("reason", F.coalesce("reason", F.when(kinds.isNull() | (kinds == "pdf"), F.concat(F.lit("unsupported: "), extension(F.col("path"))))))
    each = supported.groupBy("path").agg(F.max("last_modified").alias("last_modified"), F.max("reason").alias("reason"))
    read = each.where("reason is null").select("path", "last_modified").mapInArrow(_content, "path string, last_modified long, text string, reason string")
    whole = F.col("text")
    text = F.when(reader_of(F.col("path")) == "markdown", strip_frontmatter(whole)).otherwise(whole)
    read = read.select("path", "last_modified", text.alias("text"), line_offset(whole, text).alias("line_offset"), "reason")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("last_modified", "long"), ("text", "string"), ("line_offset", "int"))]
    other = each.where("reason is not null").select("path", "reason").unionByName(linked.distinct()).select("path", *none, "reason")
    return read.unionByName(other).select("path", F.lower(extension(F.col("path"))).alias("file_type"), "last_modified", "text", "line_offset", "reason")


def parted(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of read_paths' rows the files (path, file_type, last_modified, text, line_offset) and the rejects (path, reason)."""
    return read.where("reason is null").drop("reason"), read.where("reason is not null").select("path", "reason")


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files and rejects of a list of absolute paths, as read_paths has them."""
    if relative := [p for p in paths if not p.startswith("/") and ":/" not in p]:
        raise ValueError(f"not absolute: {relative}")
    return parted(read_paths(spark.createDataFrame([(p,) for p in paths], "path string")))
