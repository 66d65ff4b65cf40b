"""The table functions under names that SQL can use."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import CHUNKERS, OVERLAP, SCHEMA, SIZE


@udtf(returnType=SCHEMA)
class ChunkText:
    """chunk_text(text, path, kind): the chunks of a text by the chunker `kind` names."""

    def eval(self, text: str, path: str, kind: str) -> Iterator[tuple]:
        for i, c in enumerate(CHUNKERS[kind](text, path or "", SIZE, OVERLAP) if text else []):
            yield i, c.start_line, c.end_line, c.content


def register(spark: SparkSession) -> None:
    """Makes chunk_text known: SELECT ... FROM files, LATERAL chunk_text(text, path, 'markdown')."""
    spark.udtf.register("chunk_text", ChunkText)
