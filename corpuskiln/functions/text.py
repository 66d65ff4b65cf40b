"""Text, time and encoding expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """What follows the last dot of a file name that has something before it; else empty."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def is_heading(line: Column) -> Column:
    return line.rlike(r"^\s*#{1,6} ")


def iso8601(seconds: Column) -> Column:
    """UTC text of unix seconds; what is before 1970 counts as 1970."""
    return F.date_format(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def base64url_decoded(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def base64url(data: Column) -> Column:
    """Without padding."""
    return F.rtrim(F.translate(F.replace(F.base64(data), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def short_code(number: Column) -> Column:
    """ddd-ddd of a number's last six digits."""
    digits = F.lpad((number % 1_000_000).cast("string"), 6, "0")
    return F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3))


def path_tail(path: Column, most: int = 50) -> Column:
    """A path that is too long shows an ellipsis and its end."""
    return F.when(F.length(path) > most, F.concat(F.lit("…"), F.right(path, F.lit(most - 1)))).otherwise(path)


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"\r$", "")


def listed(text: Column) -> Column:
    """Comma-separated values, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def is_url(text: Column) -> Column:
    return F.startswith(text, F.lit("http://")) | F.startswith(text, F.lit("https://"))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: JSON-RPC error codes.
INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL = -32600, -32601, -32602, -32603
METHODS = ["initialize", "initialized", "tools/call", "tools/list"]


def rpc_error(body: Column) -> Column:
    """The error code a JSON-RPC request gets before its tool runs, or null; without an id it gets none."""
    method, version = F.get_json_object(body, "$.method"), F.get_json_object(body, "$.jsonrpc")
    bad = F.when(F.coalesce(version != "2.0", F.lit(True)) | method.isNull(), INVALID_REQUEST).when(~method.isin(METHODS), NO_METHOD)
    bad = bad.when((method == "tools/call") & F.get_json_object(body, "$.params.name").isNull(), INVALID_PARAMS)
    return F.when(F.get_json_object(body, "$.id").isNotNull(), bad)


def pretty_json(items: Column, fields: list[str]) -> Column:
    """An array of structs of scalars as JSON text over lines, indented by two spaces; nulls are written, an empty array is `[]`."""
    scalar = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    one = lambda x: F.concat(F.lit("  {\n"), F.concat_ws(",\n", *(F.concat(F.lit(f'    "{f}": '), scalar(x[f])) for f in fields)), F.lit("\n  }"))
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(items, one), ",\n"), F.lit("\n]")))


def vector_similarity(distance: Column) -> Column:
    """Cosine similarity from the distance of unit vectors, within 0 and 1."""
    return clamp(1 - distance * distance / 2)
